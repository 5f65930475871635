"""WARC archives: writing with revisit records, and reading by verified boundary chains.

Writing: a record for each page. Of pages with equal payloads of at least LEAST bytes the one with the smallest id is
written whole as `response`; the others are `revisit` records without a block. Only digests and ids are grouped;
pages join the repeated digests, by broadcast while those are few and by a shuffle beyond. Each task writes its archive
under a name of its own attempt, moves it among the archives when it is whole, and reports it; readers are told the reported
ones, so a rerun task leaves an unused file and no record twice.

Reading: archives are cut into blocks that tasks scan on their own. A block's task can't know whether the record magic
it finds is a boundary or part of a payload, so it emits every well-formed candidate with the offset of its successor,
already followed to the first offset outside the block. Spark then doubles these pointers from each file's start:
after k rounds all blocks within 2^k steps know their true entry, and candidates that no chain reaches, such as a whole
record quoted in a page, are never read. Tasks extract each block's records from its entry on, and check payloads
against their digests.

Defined cases: null html is the empty payload; a null url or id is left out of the record; pages that share id and
payload are responses alike; names in a url can't break a header line, as control characters are percent-encoded; an
empty table writes no archive and reads back empty; a payload of any size may span blocks; in a damaged archive the
records before the damage are returned.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, new_dir, slices, staged

#: HEADER: bytes that are read past a block at first; a longer header is read on to its end.
LEAST, BLOCK, HEADER, FEW_DIGESTS = 100, 8 << 20, 64 << 10, 200_000
#: Blocks of a task where there are very many.
TASK_BLOCKS = 16
#: Fixed values of the format.
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
DATE, PROFILE = "1970-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record with its closing blank lines."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Bytes: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def head(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """Fields, start of the block and start of the next record, if a record's head stands at this place."""
    if not MAGIC.match(data, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None
    return fields, end + 4, end + 4 + int(size) + 4


def successors(data: bytes, last: int, more: Callable[[int], bytes]) -> dict[int, int]:
    """Start of each well-formed head that stands before `last`, and the start of the record after it.

    A head of any length is followed to its blank line: `more` gives the bytes from a place on, none at the file's end.
    What follows a line start is kept, so heads that run through the same lines cost one walk.
    """
    found: dict[int, int] = {}
    known: dict[int, tuple[int, bytes | None] | None] = {}  # line start: end of the head and the length it declares
    for at in [m.start() for m in MAGIC.finditer(data, 0, last + 9) if m.start() < last]:
        place, lines = at + 10, []
        while place not in known:
            end, seen = data.find(b"\r\n", place), place
            while end < 0 and (further := more(len(data))):
                seen = max(place, len(data) - 1)
                data += further
                end = data.find(b"\r\n", seen)
            line = data[place:end] if end >= 0 else b""
            if not line:
                known[place] = (end + 2, None) if end >= 0 else None
            elif b":" not in line:
                known[place] = None
            else:
                lines.append((place, line))
                place = end + 2
        rest = known[place]
        for start, line in reversed(lines):
            name, _, value = line.partition(b":")
            if rest and rest[1] is None and name.strip().lower() == b"content-length":
                rest = (rest[0], value.strip())
            known[start] = rest
        # the length is the last one in the head, as head() has it
        if rest and rest[1] and rest[1].isdigit():
            found[at] = rest[0] + int(rest[1]) + 4
    return found


def decide(pages: DataFrame, id_column: str = "page_id", html: str = "html", least: int = LEAST) -> DataFrame:
    """Adds _warc_digest and _warc_first, the smallest id of the pages with the same large payload, null where it is alone."""
    payload = F.coalesce(F.col(html), F.lit(""))
    pages = pages.withColumn("_warc_digest", F.sha2(payload, 256))
    large = pages.filter(F.octet_length(payload) >= least)
    groups = large.groupBy(F.col("_warc_digest").alias("_warc_d")).agg(F.min(id_column).alias("_warc_first"), F.count(F.lit(1)).alias("n"))
    repeated = staged(groups.filter("n > 1").drop("n"), "warc-repeats")
    if repeated.count() <= FEW_DIGESTS:
        repeated = F.broadcast(repeated)
    return pages.join(repeated, F.col("_warc_digest") == F.col("_warc_d"), "left").drop("_warc_d")


def write(pages: DataFrame, directory: str, id_column: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> list[tuple[str, int]]:
    """Writes the archives and returns (path, records) of each. Runs at once."""
    rows = decide(pages.select(F.col(id_column).cast("long").alias("p"), F.col(url).alias("u"), F.col(html).alias("h")), "p", "h", least)
    rows = rows.select("p", "u", F.coalesce("h", F.lit("")).alias("h"), "_warc_digest", "_warc_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = file_system(directory)
        part = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex[:12]
        unfinished, path, out, n = f"{base}/_unfinished/{attempt}", f"{base}/part-{part:06d}-{attempt}.warc", None, 0
        for batch in slices(batches, "h"):
            for page_id, u, h, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(f"{base}/_unfinished", recursive=True)
                    out = fs.open_output_stream(unfinished, compression=None)
                out.write(record(page_id, u, h.encode("utf-8", "replace"), digest, first, first is not None and first != page_id))
                n += 1
        if out is not None:
            out.close()
            fs.move(unfinished, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "n"])

    return [tuple(r) for r in rows.mapInArrow(run, "path string, n long").collect()]


def blocks_of(spark: SparkSession, directory: str, block: int = BLOCK, archives: list[str] | None = None) -> DataFrame | None:
    """path, bytes and number of each block of the archives in a directory, all or those named; None if there are none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(directory).select("path", F.col("length").alias("bytes"))
    files = files.filter("bytes > 0").withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    if archives is not None:  # a row for each writing task, as `write` returns them
        names = spark.createDataFrame([(a.rsplit("/", 1)[-1],) for a in archives], "name string")
        files = files.join(names, F.substring_index("path", "/", -1) == F.col("name"), "left_semi")
    return files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block))).alias("block"))


def candidates(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, at, leaves: each candidate record and the first offset of its chain outside its block, -1 where the chain breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, number in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "block"))):
                fs, name = file_system(path)
                start = number * block
                with fs.open_input_file(name) as source:
                    data = source.read_at(min(block + HEADER, size - start), start)
                    more = lambda n: source.read_at(min(max(n, HEADER), size - start - n), start + n)  # noqa: B023, E731
                    found = {start + at: start + to for at, to in successors(data, block, more).items() if start + to <= size}
                leaves: dict[int, int] = {}
                for at in sorted(found, reverse=True):
                    to = found[at]
                    leaves[at] = leaves.get(to, -1) if to < min(start + block, size) else to
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(leaves), pa.string()), pa.array(list(leaves), pa.int64()), pa.array(list(leaves.values()), pa.int64())], ["path", "at", "leaves"])

    return blocks.mapInArrow(run, "path string, at long, leaves long")


def entries(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, at: where the true chain enters each block, by pointer jumping from offset 0."""
    n, most = blocks.agg(F.count(F.lit(1)), F.max("block")).first()
    parts = max(1, min(int(n), 4096), int(n) // TASK_BLOCKS)
    found = staged(candidates(blocks.repartition(parts, "path", "block"), block), "warc-candidates")
    reached = found.filter("at = 0").select("path", "at")
    jumps = found.filter("leaves >= 0")
    for k in range(math.ceil(math.log2(int(most or 0) + 1))):
        step = reached.join(jumps, ["path", "at"]).select("path", F.col("leaves").alias("at"))
        step = step.join(found.select("path", "at"), ["path", "at"], "left_semi")
        reached = staged(reached.union(step).distinct(), f"warc-reached-{k}")
        ahead = jumps.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("further"))
        jumps = staged(jumps.join(ahead, ["path", "leaves"]).select("path", "at", F.col("further").alias("leaves")), f"warc-jumps-{k}")
    return reached.repartition(parts, "path", "at")


def read(spark: SparkSession, directory: str, with_payload: bool = False, block: int = BLOCK, archives: list[str] | None = None) -> DataFrame:
    """A row for each record of the archives, all of the directory's or those named: page_id, url, payload_bytes, payload_digest, record_type, refers_to; the payload if asked for."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    blocks = blocks_of(spark, directory, block, archives)
    if blocks is None:
        return spark.createDataFrame([], schema)

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist()):
                fs, name = file_system(path)
                rows = []
                with fs.open_input_file(name) as source:
                    end, size = (at // block + 1) * block, source.size()
                    base, data = at, source.read_at(min(end - at + HEADER, size - at), at)
                    while at < min(end, size):
                        if at - base > len(data):
                            base, data = at, b""
                        while data.find(b"\r\n\r\n", at - base) < 0 and base + len(data) < size:  # a head of any length
                            data += source.read_at(min(max(len(data), HEADER), size - base - len(data)), base + len(data))
                        if not (h := head(data, at - base)):
                            break
                        fields, body, after = h
                        payload = data[body : after - 4] if after - 4 <= len(data) else source.read_at(after - 4 - body, base + body)
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        revisit = fields.get("warc-type") == "revisit"
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload of the record at {at} doesn't match its digest")
                        n = number(fields.get("warc-payload-bytes")) if revisit else len(payload)
                        rows.append((number(fields.get("warc-page-id")), fields.get("warc-target-uri"), n, digest, fields.get("warc-type"), number(fields.get("warc-refers-to-page-id")), *([payload] * with_payload)))
                        at = base + after
                for i in range(0, len(rows), 2000):
                    columns = zip(*rows[i : i + 2000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return entries(blocks, block).mapInArrow(run, schema)


def dedup_archive(pages: DataFrame, directory: str | None = None, **columns) -> DataFrame:
    """Writes the pages as archives and reads them back; an error if not every record that was written comes back."""
    spark = pages.sparkSession
    directory = directory or new_dir(spark, "warc")
    archives = write(pages, directory, **columns)
    found = staged(read(spark, directory, archives=[path for path, _ in archives]), "warc-read")
    if (n := found.count()) != (written := sum(n for _, n in archives)):
        raise ValueError(f"{directory}: {n} of {written} records were read")
    return found
