"""A search index that follows changes: segments that are never altered, and the documents that have left them.

A change (documents that are new or edited, ids of those that are gone) becomes a segment of its own, and the older copies
of its documents are listed as dead. A question reads its tokens' postings of all live segments without the dead ones, so
counts of documents and figures of the corpus are those of a new index, and so are the scores. What a change costs follows
its size: it is chunked, sorted and written alone, and beside that ids and digests are read. When there are more than MOST
segments, or a segment is mostly dead, the smallest and the mostly dead ones become one without their dead.

A version lists the live segments with their figures. It is written last, under the next number, and two writers can't both
write the same; readers take the newest finished one. `vacuum` removes what the newest version doesn't list.

Defined cases: an edit with the same text changes nothing; null texts have no chunks; an id that is changed twice in one
change keeps its largest text; ids that are gone and changed are changed; unknown ids that are gone change nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import file_system, written
from .chunk import chunk
from .index import CODEC, write_sorted
from .joins import with_facts
from .search import postings

MOST, LIVE_SHARE = 8, 0.5
_TABLES = {
    "chunks": "doc_id long, chunk_no int, text string, tokens array<string>, segment string",
    "postings": "doc_id long, chunk_no int, token string, tf long, length int, segment string",
    "docs": "doc_id long, digest string, chunks long, tokens long, segment string",
}
_FIGURES = ["documents", "chunks", "tokens"]
_VERSION = "segment string, " + ", ".join(f"{c} long, dead_{c} long" for c in _FIGURES) + ", dead array<string>"
_DEAD = "segment string, doc_id long, chunks long, tokens long"


@dataclass(frozen=True)
class SegmentedIndex:
    """`chunks`, `postings` and `figures` are those of an index of the documents as they are now."""

    spark: SparkSession
    path: str

    def versions(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/versions")
        names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(path(p, "_SUCCESS")))

    def segments(self) -> list[dict]:
        """The live segments, a row each."""
        found = self.versions()
        return [r.asDict() for r in self.spark.read.schema(_VERSION).parquet(f"{self.path}/versions/v={found[-1]}").collect()] if found else []

    def _read(self, table: str, segments: list[dict]) -> DataFrame:
        schema = _TABLES[table]
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/segment={s['segment']}" for s in segments])

    def _dead(self, segments: list[dict]) -> DataFrame:
        """segment and doc_id of what has left these segments."""
        files = sorted({d for s in segments for d in s["dead"]})
        if not files:
            return self.spark.createDataFrame([], _DEAD)
        names = [s["segment"] for s in segments]
        return self.spark.read.schema(_DEAD).parquet(*[f"{self.path}/dead/{d}" for d in files]).filter(F.col("segment").isin(names))

    def _live(self, table: str, segments: list[dict]) -> DataFrame:
        rows = self._read(table, segments)
        return rows.join(self._dead(segments).select("segment", "doc_id"), ["segment", "doc_id"], "left_anti") if any(s["dead"] for s in segments) else rows

    @property
    def chunks(self) -> DataFrame:
        return self._live("chunks", self.segments()).drop("segment")

    @property
    def postings(self) -> DataFrame:
        return self._live("postings", self.segments()).drop("segment")

    @property
    def figures(self) -> DataFrame:
        total = {c: sum(s[c] - s[f"dead_{c}"] for s in self.segments()) for c in _FIGURES}
        return self.spark.range(1).select(F.lit(total["chunks"]).cast("long").alias("chunks"), F.lit(total["tokens"] / max(total["chunks"], 1)).alias("mean_tokens"), F.lit(total["documents"]).cast("long").alias("documents"))

    def _write_segment(self, docs: DataFrame, chunks: DataFrame, rows: DataFrame) -> dict:
        """docs is (doc_id, digest); chunks and rows are the tables of an index."""
        name = uuid.uuid4().hex[:12]
        at = lambda table: f"{self.path}/{table}/segment={name}"
        chunks.select("doc_id", "chunk_no", "text", "tokens").write.option("compression", CODEC).parquet(at("chunks"))
        stored = self._read("chunks", [{"segment": name}])
        sizes = stored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("tokens")).cast("long").alias("tokens"))
        zero = F.lit(0).cast("long")
        docs.join(sizes, "doc_id", "left").select("doc_id", "digest", F.coalesce("chunks", zero).alias("chunks"), F.coalesce("tokens", zero).alias("tokens")).write.parquet(at("docs"))
        n = self._read("docs", [{"segment": name}]).agg(F.count(F.lit(1)), F.sum("chunks"), F.sum("tokens")).first()
        write_sorted(rows(stored) if callable(rows) else rows, n[2] or 0, at("postings"))
        return {"segment": name, **{c: v or 0 for c, v in zip(_FIGURES, n)}, **{f"dead_{c}": 0 for c in _FIGURES}, "dead": []}

    def _commit(self, segments: list[dict]) -> None:
        names = [part.split()[0] for part in _VERSION.split(", ")]
        number = max([0, *self.versions()]) + 1
        rows = [tuple(s[n] for n in names) for s in segments]
        self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/v={number}")  # a row a segment

    def apply(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Takes in documents (doc_id, text) that are new or edited, and lets go of ids (doc_id)."""
        segments = self.segments()
        new = written(_once(changed.select(F.col("doc_id").cast("long"), "text")).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), "changed")
        ids = new.select("doc_id", "digest")
        if gone is not None:
            ids = ids.unionByName(gone.select(F.col("doc_id").cast("long"), F.lit(None).cast("string").alias("digest")).distinct().join(new.select("doc_id"), "doc_id", "left_anti"))
        known = self._live("docs", segments).withColumnRenamed("digest", "was")
        met = written(known.join(ids, "doc_id"), "met")
        same = met.filter("was = digest").select("doc_id")
        fresh = new.join(same.hint("shuffle_hash"), "doc_id", "left_anti") if segments else new  # ids are held, texts pass by unsorted
        dead = met.filter("digest IS NULL OR was <> digest").select("segment", "doc_id", "chunks", "tokens")
        if not dead.isEmpty():
            name = uuid.uuid4().hex[:12]
            dead.write.parquet(f"{self.path}/dead/{name}")
            left = self.spark.read.schema(_DEAD).parquet(f"{self.path}/dead/{name}").groupBy("segment").agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"))
            for r in left.collect():  # a row a segment
                s = next(s for s in segments if s["segment"] == r["segment"])
                s.update({f"dead_{c}": s[f"dead_{c}"] + r[c] for c in _FIGURES}, dead=[*s["dead"], name])
        if not fresh.isEmpty():
            segments.append(self._write_segment(fresh.select("doc_id", "digest"), chunk(fresh), postings))
        self._commit(self._merged(segments))

    def _merged(self, segments: list[dict]) -> list[dict]:
        """The same documents in at most MOST segments of which none is mostly dead."""
        live = lambda s: s["documents"] - s["dead_documents"]
        segments = sorted((s for s in segments if live(s)), key=live)
        few = segments[: len(segments) - MOST // 2] if len(segments) > MOST else []
        few += [s for s in segments if s not in few and live(s) < LIVE_SHARE * s["documents"]]
        if not few:
            return segments
        one = self._write_segment(self._live("docs", few).select("doc_id", "digest"), self._live("chunks", few), self._live("postings", few))
        return [*(s for s in segments if s not in few), one]

    def vacuum(self) -> None:
        """Removes segments, lists of dead and versions that the newest version doesn't need; no reader may use an older one."""
        segments, newest = self.segments(), self.versions()[-1:]
        keep = {f"segment={s['segment']}" for s in segments} | {d for s in segments for d in s["dead"]} | {f"v={n}" for n in newest}
        for table in (*_TABLES, "dead", "versions"):
            fs, at = file_system(self.spark, f"{self.path}/{table}")
            for status in fs.listStatus(at) if fs.exists(at) else []:
                if status.getPath().getName() not in keep:
                    fs.delete(status.getPath(), True)


def _once(rows: DataFrame) -> DataFrame:
    """A row for each id, that with its largest text; only texts of ids that come more than once are shuffled."""
    again = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("_again")), "repeated-ids")
    if again.isEmpty():
        return rows
    marked = with_facts(rows, again, ["doc_id"], ["text"], "left")
    return marked.filter("_again IS NULL").drop("_again").unionByName(marked.filter("_again").groupBy("doc_id").agg(F.max("text").alias("text")))


def changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of `after` (doc_id, text) that are new or have another text, and ids of `before` that are gone; texts are
    compared by digest, so they don't shuffle."""
    digest = lambda df: df.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    new = written(digest(after).join(digest(before), ["doc_id", "digest"], "left_anti").select("doc_id"), "new-ids")
    return after.join(new, "doc_id", "left_semi"), before.select("doc_id").join(after.select("doc_id"), "doc_id", "left_anti")
