"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A shard is a file of frames, one for each document, so a reader decompresses the requested documents only. After them
come a skippable frame with the documents' ids and a skippable frame with the seek table of the public "zstd seekable
format": for each frame its compressed size, decompressed size and the low 32 bits of the XXH64 of its content, then
the number of frames, a descriptor and a magic number. Any zstandard decoder reads the whole file; a reader that wants
some documents starts at the end.

    [frame of doc 0] [frame of doc 1] ... [skippable: doc ids, int64] [skippable: seek table]

Texts are encoded and compressed where they are read, and only frames shuffle. Frames are dealt by ranges of (doc_id, hash
of the ids, row number) and sorted inside each, so shards follow one another in ascending doc_id order and no document,
however often its id and text repeat, makes a shard too large. Each task writes its shard under a
name of its own attempt and reports it in its result row; a rerun task leaves an unused file and no wrong one. Starts
need the totals of the shards before, a row for each shard, which is what goes through the driver.

Defined cases: null text is empty and holds the end id only; equal doc_ids stand in hash order; a null doc_id comes
first and is stored as the smallest 64-bit integer; repeated rows are documents of their own; the spelling of an added
token in a text is that token, as the library has it; an empty table gives no shard and reads back empty; texts of any
length are one frame; extra columns aren't read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, slices, staged
from .tokens import encoder

VOCABULARY, END, SHARD_BYTES = "word_bpe_49k.json", 2, 64 << 20
#: Fixed values of the public formats.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)


def make_frame(compress, raw: bytes, width: str) -> tuple[bytes, int, int]:
    """Frame of a document's ids (little-endian unsigned 32-bit), the size of its content and the content's checksum."""
    import xxhash

    body = np.frombuffer(raw, "<u4").astype(width).tobytes()
    return compress(body), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF


def compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress


def write_shard(out, frames: Iterator[tuple[int, bytes, int, int]], width: str) -> tuple[int, int]:
    """Writes (doc_id, frame, content size, checksum) to an open file: the number of documents and of their ids."""
    ids, table, size = [], [], 0
    for doc_id, frame, length, checksum in frames:
        out.write(frame)
        ids.append(doc_id)
        table.append(struct.pack("<III", len(frame), length, checksum))
        size += length
    index = struct.pack("<B", int(width[-1])) + np.array(ids, "<i8").tobytes()
    out.write(struct.pack("<II", SKIPPABLE_IDS, len(index)) + index)
    seek = b"".join(table) + struct.pack("<IBI", len(table), 0x80, SEEKABLE)
    out.write(struct.pack("<II", SKIPPABLE_TABLE, len(seek)) + seek)
    return len(ids), size // int(width[-1])


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompress = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        frames, descriptor, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the file's end")
        at = size - 9 - 12 * frames - 8
        head = struct.unpack("<II", source.read_at(8, at))
        if head != (SKIPPABLE_TABLE, 12 * frames + 9):
            raise ValueError("the seek table's frame is damaged")
        table = np.frombuffer(source.read_at(12 * frames, at + 8), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.sums = table[:, :2], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        length = 8 + 1 + 8 * frames
        block = source.read_at(length, int(self.starts[-1]))
        if struct.unpack("<II", block[:8]) != (SKIPPABLE_IDS, length - 8):
            raise ValueError("the doc ids' frame is damaged")
        self.width = f"<u{block[8]}"
        self.doc_ids = np.frombuffer(block[9:], "<i8")

    def document(self, frame: int, raw: bytes | None = None) -> bytes:
        """A document's ids as little-endian unsigned 32-bit bytes; raises if its checksum differs."""
        import xxhash

        if raw is None:
            raw = self.source.read_at(int(self.sizes[frame, 0]), int(self.starts[frame]))
        body = self.decompress(raw, max_output_size=int(self.sizes[frame, 1]))
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"frame {frame} fails its checksum")
        return np.frombuffer(body, self.width).astype("<u4").tobytes()

    def all(self, block: int = 8 << 20) -> Iterator[tuple[int, bytes]]:
        """(doc_id, ids) of every document, read in blocks of about `block` bytes."""
        first = 0
        while first < len(self.doc_ids):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + block)) - 1)
            base = int(self.starts[first])
            raw = self.source.read_at(int(self.starts[last]) - base, base)
            for k in range(first, last):
                yield int(self.doc_ids[k]), self.document(k, raw[self.starts[k] - base : self.starts[k + 1] - base])
            first = last

    def requested(self, doc_ids: list[int]) -> Iterator[tuple[int, bytes]]:
        """The documents with these ids only."""
        for doc_id in doc_ids:
            for k in range(*np.searchsorted(self.doc_ids, [doc_id, doc_id + 1])):
                yield doc_id, self.document(k)


def frames(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """d (doc_id), frame, size, checksum and width (bytes of an id) of each document."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compress = encoder(vocabulary), compressor()
        width = 2 if len(encode.bytes_of) <= 1 << 16 and end < 1 << 16 else 4
        for batch in slices(batches, "t"):
            made = [make_frame(compress, raw + last, f"<u{width}") for raw in encode.encode(batch.column("t"))]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("d"), *columns, pa.array([width] * len(made), pa.int32())], ["d", "frame", "size", "checksum", "width"])

    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("d"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "d long, frame binary, size long, checksum long, width int")


def write(docs: DataFrame, directory: str, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, shards: int | None = None) -> DataFrame:
    """Writes all documents as shards: shard, path, n_docs, n_tokens, start (ids of the shards before). Runs at once.

    Frames are written once before they are dealt, as finding the ranges reads them too.
    """
    spark = docs.sparkSession
    rows = staged(frames(docs, id_column, text, vocabulary, end), "token-frames")
    if shards is None:
        shards = int((rows.agg(F.sum(F.octet_length("frame"))).first()[0] or 0) // SHARD_BYTES) + 1
        shards = max(shards, spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(shards, "d", "checksum", "row").sortWithinPartitions("d", "checksum").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        width = f"<u{first.column('width')[0].as_py()}"
        fs, base = file_system(directory)
        fs.create_dir(base, recursive=True)
        path = f"{base}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.ids.zst"
        source = (row for b in itertools.chain([first], batches) for row in zip(*(b.column(c).to_pylist() for c in ("d", "frame", "size", "checksum"))))
        with fs.open_output_stream(path, compression=None) as out:
            n, tokens = write_shard(out, source, width)
        columns = [[TaskContext.get().partitionId()], [path], [n], [tokens]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "path", "n_docs", "n_tokens"])

    done = sorted(rows.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long").collect())
    starts = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in done])]).astype(int).tolist()
    table = [(r["shard"], r["path"], r["n_docs"], r["n_tokens"], s) for r, s in zip(done, starts)]
    return spark.createDataFrame(table, "shard long, path string, n_docs long, n_tokens long, start long")


def read(shards: DataFrame, directory: str, with_ids: bool = True) -> DataFrame:
    """Every document of the shards that `write` reported: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(directory)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows, held = [], 0
                with fs.open_input_file(path) as source:
                    for doc_id, raw in ShardReader(source).all():
                        ids = (np.frombuffer(raw, "<u4").astype(np.int64),) if with_ids else ()
                        rows.append((None if doc_id == NULL_ID else doc_id, start, len(raw) // 4, zlib.crc32(raw), *ids))
                        start, held = start + len(raw) // 4, held + len(raw) * with_ids + 40
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = max(1, shards.count())
    return shards.select("path", "start").repartition(n, "path").mapInArrow(run, schema)


def read_some(spark: SparkSession, shards: DataFrame, directory: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id and ids of the requested documents only; each shard is opened once and only their frames are read.

    Requested ids are spread over every shard that may hold them: shards are sorted by id, so an id's first shard is found
    by its place among the shards' first ids, and an id that goes on over several shards is in all of these.
    """
    schema = "doc_id long, ids array<long>"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fs, _ = file_system(directory)
        with fs.open_input_file(key[0].as_py()) as source:
            found = list(ShardReader(source).requested(sorted(table.column("doc_id").to_pylist())))
        columns = [[d for d, _ in found], [np.frombuffer(raw, "<u4").astype(np.int64) for _, raw in found]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64())))], ["doc_id", "ids"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(directory)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            edges = []
            for path in paths:
                with fs.open_input_file(path) as source:
                    ids = ShardReader(source).doc_ids
                    edges.append((int(ids[0]), int(ids[-1])))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([e[0] for e in edges]), pa.array([e[1] for e in edges])], ["path", "low", "high"])

    spans = sorted(shards.select("path").mapInArrow(ranges, "path string, low long, high long").collect(), key=lambda r: (r["low"], r["high"], r["path"]))
    held = spark.sparkContext.broadcast((np.array([r["low"] for r in spans], np.int64), np.array([r["high"] for r in spans], np.int64), [r["path"] for r in spans]))  # a row for each shard, as in `write`

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs, paths = held.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(highs, ids, "left"), np.searchsorted(lows, ids, "right")
            times = np.maximum(last - first, 0)
            at = np.concatenate([*(np.arange(a, b) for a, b in zip(first, last)), np.zeros(0, np.int64)]).astype(int)
            yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in at], pa.string()), pa.array(ids.repeat(times), pa.int64())], ["path", "doc_id"])

    wanted = doc_ids.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct().mapInArrow(place, "path string, doc_id long")
    return wanted.groupBy("path").applyInArrow(run, schema)
