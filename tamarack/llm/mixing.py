"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a size (the words of its documents). The mix takes `share` of all words. Targets rise in
proportion to the weights; a source whose target would pass `epochs` times its size is clamped there, and what it
can't take is shared out again by weight until no target is above its cap. A source's target over its size is the
number of repetitions of its documents: each is taken whole that many times, and the fraction left is a seeded choice
of whole documents.

The choice: a source's documents stand in the order of a seeded hash, and are taken from its start up to a hash below which
all fit into what the fraction asks for. That hash is found by counting words in ever finer intervals, BITS at a time. What
stands there is too large for the words that are missing, so PASSES times more the order goes on behind it, with documents of
at most a STEPth of them. For the rest a source has a reserve: of its documents that are left and fit, the RESERVE smallest
hashes in each class of sizes (powers of two), and the RESERVE smallest documents. From it the largest that fits is taken,
and the next, until none fits, and at the end the smallest that is left where that brings the source nearer to its target.
So whether a document is taken follows from its own hash and size and a few numbers of its source, of a bounded length: no
document's text is shuffled, no source is sorted whole, and the rows are read a fixed number of times.

Sources are a written table of a row each; it is broadcast while it is small and joined by (source, salt) beyond.

Defined cases: null or empty text has size 0 and is taken with the whole repetitions of its source, adding no words; a
null source is a source of its own, last in order; if all sizes are 0 nothing is taken; rows that share id (and text, in
`mix`) share their hash and are taken equally often; an empty table gives an empty table; extra columns stay, in `mix`
whatever their names; `plan_mix` replaces columns with the names of its results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, few_parts, recorded, staged

WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20240917
#: Bits of the 63-bit hash that each count looks at, documents of each kind in a source's reserve, parts of a large source.
BITS, PASSES, STEP, RESERVE, SALTS = (12, 12, 12), 2, 8, 8, 64
_STEPS = "array<struct<from:long,upto:long,most:long>>"


def word_count(text: Column) -> Column:
    """Number of words between the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: float) -> float:
    """Level at which the sum of min(cap, level * weight) is the total, or infinity where the caps can't reach it.

    Every round clamps the sources that are full at the level and shares out what is left, as long as that fills others.
    """
    level, full = 0.0, -1
    while True:
        is_full = F.col("cap") <= F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        left, weight, n = sources.agg(F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))), F.count_if(is_full)).first()
        if n == full:
            return level
        full = n
        if not weight:
            return float("inf")
        level = max(total - left, 0.0) / weight


def source_targets(df: DataFrame, size: str, source: str, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """_mix_s, size and target of each source; weights repeat in code-point order of the sources, null last."""
    found = df.groupBy(F.col(source).alias("_mix_s")).agg(F.sum(size).alias("size"))
    found = staged(found.orderBy(F.col("_mix_s").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part, row = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1)
    before, starts = 0, {}
    for r in sorted(found.groupBy(part).agg(F.max(row).alias("last")).collect()):  # a row for each sorted range
        starts[r["part"]] = before
        before += r["last"] + 1
    start = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])[F.shiftright("at", 33)] if starts else F.lit(0)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((start + row) % len(weights) + 1).cast("int"))
    sources = staged(found.select("_mix_s", "size", weight.alias("weight"), (F.col("size") * float(epochs)).alias("cap")), "mix-weights")
    level = water_level(sources, share * float(sources.agg(F.sum("size")).first()[0] or 0))
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("_mix_s", "size", target.alias("target"))


def _with_source(rows: DataFrame, sources: DataFrame, count: int, source: str = "source", h: str = "h") -> DataFrame:
    """Rows of a known source with its columns: it is broadcast while there are few, and joined by (source, salt) beyond."""
    if count <= 10_000:
        return rows.join(F.broadcast(sources), F.col(source).eqNullSafe(F.col("_mix_s"))).drop("_mix_s")
    salted = sources.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.col(h), F.lit(SALTS)).cast("int")
    return rows.join(salted, F.col(source).eqNullSafe(F.col("_mix_s")) & (salt == F.col("_mix_salt"))).drop("_mix_s", "_mix_salt")


def _counted(rows: DataFrame, cut: DataFrame, count: int, shift: int, bits: int) -> DataFrame:
    """source, total and m (interval, what is missing before it) of the first interval of `bits` more bits in which the words
    of the documents in a source's interval pass what it needs; m is null where they don't."""
    inside = _with_source(rows, cut, count).filter(F.shiftright("h", shift) == F.col("bin"))
    summed = inside.groupBy("source", F.shiftright("h", shift - bits).alias("bin")).agg(F.sum("size").alias("words"), F.max("need").alias("need"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    passes = F.when(F.col("upto") > F.col("need"), F.struct("bin", (F.col("need") - F.col("upto") + F.col("words")).alias("need")))
    return summed.withColumn("upto", upto).groupBy("source").agg(F.min(passes).alias("m"), F.max("upto").alias("total"))


def _prefix(rows: DataFrame, needs: DataFrame, count: int) -> DataFrame:
    """_mix_s, upto, behind and need: all documents (source, h, size) below the hash `upto` fit, those from `behind` on come
    after what doesn't, and what is missing then."""
    first = _counted(rows, needs.select("_mix_s", F.lit(0).cast("long").alias("bin"), "need"), count, 63, BITS[0]).persist()  # a row a source
    cut, shift = first.filter("m IS NOT NULL").select(F.col("source").alias("_mix_s"), "m.bin", "m.need"), 63 - BITS[0]
    for bits in BITS[1:]:
        cut = _counted(rows, cut, count, shift, bits).select(F.col("source").alias("_mix_s"), "m.bin", "m.need")
        shift -= bits
    ends = cut.select("_mix_s", F.shiftleft("bin", shift).alias("upto"), F.shiftleft(F.col("bin") + 1, shift).alias("behind"), "need")
    every = F.lit((1 << 63) - 1)
    whole = first.filter("m IS NULL").select(F.col("source").alias("s"), F.col("total").alias("words"))
    whole = needs.join(whole, F.col("_mix_s").eqNullSafe(F.col("s"))).select("_mix_s", every.alias("upto"), every.alias("behind"), (F.col("need") - F.col("words")).alias("need"))
    return ends.union(whole)


def _reserve(left: DataFrame, count: int) -> DataFrame:
    """source, h, words and need of the documents that may fill what is missing. Rows that share a hash are one choice."""
    kinds = [
        (Window.partitionBy("source", F.floor(F.log2("size"))).orderBy("h", "size"), F.col("size") <= F.col("need")),
        (Window.partitionBy("source").orderBy("size", "h"), F.lit(True)),
    ]
    some = [left.filter(fits).withColumn("at", F.row_number().over(w)).filter(F.col("at") <= RESERVE).select("source", "h") for w, fits in kinds]
    hashes = staged(few_parts(reduce(DataFrame.union, some).distinct(), 0), "mix-reserve")
    few = hashes.select(F.col("source").alias("s"), F.col("h").alias("g"))
    few = F.broadcast(few) if count <= 1000 else few  # at most RESERVE * 64 for each source
    same = left.join(few, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("g")))
    return same.groupBy("source", "h").agg(F.sum("size").alias("words"), F.max("need").alias("need"))


def _chosen(reserve: DataFrame) -> DataFrame:
    """_mix_s and the hashes that are taken of a source's reserve."""
    items = reserve.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("words", "h")), asc=False).alias("items"), F.max("need").alias("need"))

    def step(state: Column, item: Column) -> Column:
        fits = item["words"] <= state["need"]
        taken = F.struct((state["need"] - item["words"]).alias("need"), F.array_append(state["taken"], item["h"]).alias("taken"), state["least"].alias("least"))
        left = F.struct(state["need"].alias("need"), state["taken"].alias("taken"), item.alias("least"))  # items come by size
        return F.when(fits, taken).otherwise(left)

    zero = F.struct(F.col("need"), F.array().cast("array<long>").alias("taken"), F.lit(None).cast("struct<words:long,h:long>").alias("least"))
    end = items.select(F.col("source").alias("_mix_s"), F.aggregate("items", zero, step).alias("end"))
    nearer = F.col("end.least.words") < 2 * F.col("end.need")
    return end.select("_mix_s", F.when(nearer, F.array_append("end.taken", F.col("end.least.h"))).otherwise(F.col("end.taken")).alias("_mix_chosen"))


def plan_mix(df: DataFrame, size: str = "size", source: str = "source", id_column: str = "doc_id", weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED, hash_column: str | None = None) -> DataFrame:
    """Adds _mix_source_size, _mix_target and _mix_times, how often the document is taken.

    The frame is read several times: write it first where making it is dear.
    """
    h = _hash(F.col(hash_column or id_column), seed)
    choice, count = mix_choice(df.select(F.col(source).alias("source"), h.alias("h"), F.col(size).alias("size")), weights, share, epochs)
    names = ["_mix_source_size", "_mix_target", "_mix_times"]
    rows = recorded(df.drop(*names), F.col(source).alias("source"), h.alias("h"), F.col(size).alias("size"))
    return times_of(rows, choice, count).select("record.*", *names)


def _hash(key: Column, seed: int) -> Column:
    """63 bits, so that intervals of it are intervals of numbers."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1)


def times_of(rows: DataFrame, choice: DataFrame, count: int) -> DataFrame:
    """Adds _mix_source_size, _mix_target and _mix_times to rows with source, h and size."""
    out = _with_source(rows, choice, count)
    fraction = (F.col("size") > 0) & (_is_taken("_mix_steps") | F.array_contains("_mix_chosen", F.col("h")))
    return out.withColumn("_mix_times", (F.col("_mix_whole") + F.when(fraction, 1).otherwise(0)).cast("long")).drop("_mix_whole", "_mix_steps", "_mix_chosen")


def _is_taken(steps: str) -> Column:
    return F.exists(steps, lambda s: (F.col("h") >= s["from"]) & (F.col("h") < s["upto"]) & (F.col("size") <= s["most"]))


def mix_choice(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> tuple[DataFrame, int]:
    """For rows of source, h and size: _mix_s, _mix_source_size, _mix_target, _mix_whole (whole repetitions), _mix_steps (hashes
    and sizes that are taken once more) and _mix_chosen (hashes that are too) of each source; the number of sources."""
    goal = source_targets(rows, "size", "source", weights, share, epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long").alias("whole")
    goal = goal.select("_mix_s", "size", "target", whole)
    need = F.floor(F.col("target") - F.col("whole") * F.col("size") + 1e-6).cast("long")
    goal = goal.withColumn("need", need).persist()
    count, some, none = goal.count(), rows.filter("size > 0"), F.lit(0).cast("long")
    now = goal.select("_mix_s", "need", none.alias("behind"), F.array().cast(_STEPS).alias("steps"))
    for turn in range(1 + PASSES):
        most = F.col("need") if not turn else F.floor(F.col("need") / STEP)
        most = F.lit((1 << 63) - 1) if not turn else most.cast("long")
        open_ = _with_source(some, now.select("_mix_s", F.col("behind").alias("from"), most.alias("most")), count).filter((F.col("h") >= F.col("from")) & (F.col("size") <= F.col("most")))
        cut = _prefix(open_.select("source", "h", "size"), now.filter("need > 0").select("_mix_s", "need"), count)
        cut = _named(cut.withColumnRenamed("behind", "new_behind").withColumnRenamed("need", "new_need"), "s")
        step = F.array(F.struct(F.col("behind").alias("from"), "upto", most.alias("most"))).cast(_STEPS)
        joined = now.join(cut, F.col("_mix_s").eqNullSafe(F.col("s")), "left")
        steps = F.when(F.col("upto").isNull(), F.col("steps")).otherwise(F.concat("steps", step))
        now = joined.select("_mix_s", F.coalesce("new_need", "need").alias("need"), F.coalesce("new_behind", "behind").alias("behind"), steps.alias("steps"))
        now = staged(few_parts(now, count), "mix-steps")
    left = _with_source(some, now, count).filter((F.col("need") > 0) & ~_is_taken("steps")).select("source", "h", "size", "need")
    chosen = _named(_chosen(_reserve(left, count)), "s2")
    out = goal.drop("need").join(_named(now, "s1"), F.col("_mix_s").eqNullSafe(F.col("s1")), "left").join(chosen, F.col("_mix_s").eqNullSafe(F.col("s2")), "left")
    hashes = F.coalesce("_mix_chosen", F.array().cast("array<long>"))
    out = out.select("_mix_s", F.col("size").alias("_mix_source_size"), F.col("target").alias("_mix_target"), F.col("whole").alias("_mix_whole"), F.col("steps").alias("_mix_steps"), hashes.alias("_mix_chosen"))
    return staged(few_parts(out, count), "mix-choice"), count


def _named(table: DataFrame, name: str) -> DataFrame:
    return table.withColumnRenamed("_mix_s", name)


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id", seed: int = SEED, **options) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken.

    The choice is made on sources, hashes and sizes; whether a document is taken then follows from its own hash, so no text
    is shuffled.
    """
    h = _hash(F.xxhash64(F.col(id_column), F.coalesce(F.col(text), F.lit(""))), seed).alias("h")
    facts = [F.col(source).alias("source"), h, word_count(F.col(text)).alias("size")]
    narrow = staged(docs.select(*facts), "mix-sizes")
    choice, count = mix_choice(narrow, **options)
    out = times_of(recorded(docs, *facts), choice, count).filter("_mix_times > 0")
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int")))).select("record.*")
