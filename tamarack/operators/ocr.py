"""Word-level OCR results: validation, alignment, dictionary and fuzzy line lookup.

A result is one row with words ARRAY<STRUCT<id, line, text, box ARRAY<DOUBLE>, confidence>>, segments
ARRAY<STRUCT<wordIds, rumi, bm, en>> and line_translations ARRAY<STRUCT<line, wordIds, en>>. Lookups work on the words as
rows and join small dictionary tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean

WORDS = "array<struct<id:string,line:int,text:string,box:array<double>,confidence:double>>"
SEGMENTS = "array<struct<wordIds:array<string>,rumi:string,bm:string,en:string>>"
LINES = "array<struct<line:int,wordIds:array<string>,en:string>>"
MOST_WORDS, MOST_SEGMENTS, MOST_LINES = 1500, 500, 100
#: Schema labels that a model copies instead of a reading; confidence limits.
COPIED = r"(?i)^(?:Rumi setia|BM moden|English)$"
PHRASE_LEAST, LINE_LEAST, MATCHED_LEAST, KNOWN_LEAST, UNKNOWN_LEAST, DIGITS_MOST = 0.85, 0.45, 0.45, 0.5, 0.85, 0.49

NO_WORDS = "Model tidak menghasilkan perkataan dan lokasi yang sah."
BAD_WORD = "Koordinat atau penjajaran perkataan tidak sah. Cuba imej yang lebih jelas."
NO_SEGMENTS = "Transkripsi tidak mempunyai penjajaran sumber. Hasil tidak dipaparkan sebagai terjemahan sah."


def word_is_valid(w: Column) -> Column:
    """One token of at most 100 characters and a box of four numbers from 0 to 1000 with an area."""
    box = w["box"]
    inside = (F.size(box) == 4) & F.forall(box, lambda n: n.isNotNull() & ~F.isnan(n) & n.between(0, 1000))
    area = (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1)))
    text = clean(w["text"])
    return F.coalesce((text != "") & (F.length(w["text"]) <= 100) & ~F.contains(text, F.lit(" ")) & inside & area, F.lit(False))


def validate(results: DataFrame) -> DataFrame:
    """Adds error (null if the result is fit for use) and aligned words, segments and line_translations.

    Words get new ids w0, w1, ...; ids that segments and lines name are mapped to them, the last word of an id counts,
    and unknown ones go. A line translation stays if all its words are on one line.
    """
    count = F.coalesce(F.size("words"), F.lit(-1))
    bad = F.when((count < 1) | (count > MOST_WORDS), NO_WORDS).when(~F.forall("words", word_is_valid), BAD_WORD)
    fresh = F.transform(
        "words",
        lambda w, i: F.struct(
            F.concat(F.lit("w"), i.cast("string")).alias("id"), F.when(w["line"].between(0, 1499), w["line"]).otherwise(0).alias("line"), w["text"].alias("text"), w["box"].alias("box"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(w["confidence"], F.lit(0.0)))).alias("confidence"), w["id"].alias("old"),
        ),
    )
    df = results.withColumns({"error": bad, "_fresh": F.when(bad.isNull(), fresh)})

    def word_of(old: Column) -> Column:
        return F.element_at(F.filter("_fresh", lambda w: w["old"] == old), -1)

    def mapped(ids: Column) -> Column:
        known = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.exists("_fresh", lambda w: w["old"] == i))
        return F.transform(known, word_of)

    def segment(s: Column) -> Column:
        words = mapped(s["wordIds"])
        text = lambda n: F.substring(F.coalesce(s[n], F.lit("")), 1, 1500).alias(n)
        return F.struct(F.transform(words, lambda w: w["id"]).alias("wordIds"), F.coalesce(F.get(words, F.lit(0))["line"], F.lit(0)).alias("line"), text("rumi"), text("bm"), text("en"))

    def line(s: Column) -> Column:
        words = mapped(s["wordIds"])
        first = F.coalesce(F.get(words, F.lit(0))["line"], F.lit(0))
        return F.struct(first.alias("line"), F.transform(words, lambda w: w["id"]).alias("wordIds"), F.substring(F.coalesce(s["en"], F.lit("")), 1, 500).alias("en"), F.forall(words, lambda w: w["line"] == first).alias("one"))

    copied = lambda s: s["rumi"].rlike(COPIED) | s["bm"].rlike(COPIED) | s["en"].rlike(COPIED)
    segments = F.filter(F.transform(F.slice(F.coalesce("segments", F.array().cast(SEGMENTS)), 1, MOST_SEGMENTS), segment), lambda s: (F.size(s["wordIds"]) > 0) & ~copied(s))
    lines = F.filter(F.transform(F.slice(F.coalesce("line_translations", F.array().cast(LINES)), 1, MOST_LINES), line), lambda s: (F.size(s["wordIds"]) > 0) & (s["en"] != "") & s["one"])
    df = df.withColumns({"segments": F.when(F.col("error").isNull(), segments), "line_translations": F.when(F.col("error").isNull(), F.transform(lines, lambda s: F.struct(s["line"].alias("line"), s["wordIds"].alias("wordIds"), s["en"].alias("en"))))})
    df = df.withColumn("error", F.when(F.col("error").isNull() & (F.size("segments") < 1), NO_SEGMENTS).otherwise(F.col("error")))
    words = F.transform("_fresh", lambda w: F.struct(w["id"].alias("id"), w["line"].alias("line"), w["text"].alias("text"), w["box"].alias("box"), w["confidence"].alias("confidence")))
    return df.withColumn("words", F.when(F.col("error").isNull(), words)).drop("_fresh")


def readable(words: DataFrame) -> DataFrame:
    """Words in Arabic script or digits only; words with a digit aren't trusted above DIGITS_MOST."""
    out = words.filter(F.col("text").rlike(r"[\x{0600}-\x{08FF}]") | F.col("text").rlike(r"^\p{Nd}+$"))
    return out.withColumn("confidence", F.when(F.col("text").rlike(r"\p{Nd}"), F.least("confidence", F.lit(DIGITS_MOST))).otherwise(F.col("confidence")))


def scaled_box(chars: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """Box of a word in thousandths of the page from its characters' points (ARRAY<STRUCT<x, y>>), at least one unit wide."""

    def span(axis: str, offset: Column, size: Column) -> tuple[Column, Column]:
        values = F.transform(chars, lambda p: p[axis])
        a = F.greatest(F.lit(0), F.least(F.lit(999), F.bround((offset + F.array_min(values)) * 1000 / size))).cast("int")
        b = F.least(F.lit(1000), F.bround((offset + F.array_max(values)) * 1000 / size)).cast("int")
        return a, F.greatest(a + 1, b)

    (x0, x1), (y0, y1) = span("x", left, width), span("y", top, height)
    return F.array(x0, y0, x1, y1)


def lexicon_lookup(words: DataFrame, lexicon: DataFrame, matched: Column | None = None) -> DataFrame:
    """Adds rumi, bm, en of the word where its confidence is high enough, else empty; known spellings need less."""
    small = F.broadcast(lexicon.select(F.col("spelling").alias("_s"), "rumi", "bm", "en"))
    limit = F.when(F.coalesce(matched, F.lit(False)) if matched is not None else F.lit(False), MATCHED_LEAST).when(F.col("_s").isNotNull(), KNOWN_LEAST).otherwise(UNKNOWN_LEAST)
    joined = words.join(small, F.col("text") == F.col("_s"), "left").withColumn("_ok", F.col("confidence") >= limit)
    return joined.withColumns({c: F.when(F.col("_ok"), F.coalesce(c, F.lit(""))).otherwise("") for c in ("rumi", "bm", "en")}).drop("_s", "_ok")


def lines_of(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, line, tokens in order and the least confidence of each line."""
    rows = words.groupBy(*keys, F.coalesce("line", F.lit(0)).alias("line")).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("w"), F.min("confidence").alias("least"))
    return rows.select(*keys, "line", F.transform("w", lambda w: w["text"]).alias("tokens"), "least")


def phrase_lookup(lines: DataFrame, phrases: DataFrame) -> DataFrame:
    """Lines whose tokens are a phrase of the dictionary and whose least confidence is high."""
    return lines.filter(F.col("least") >= PHRASE_LEAST).join(F.broadcast(phrases), "tokens")


def supported_lines(lines: DataFrame, keys: list[str], known: DataFrame, most: int = 2) -> DataFrame:
    """Lines that are a known line, or differ from exactly one known line in one token by at most `most` edits.

    Lines and known lines meet by equality only: on their tokens with one place left out. A line that one token keeps
    from a known line shares that key with it, so no pair without a chance is made. A tie for the best is no match.
    """
    fit = lines.filter((F.col("least") >= LINE_LEAST) & (F.size("tokens") > 0))

    def keyed(df: DataFrame, tokens: str) -> DataFrame:
        rest = lambda i: F.concat(F.slice(tokens, F.lit(1), i), F.array(F.lit("\x00")), F.slice(tokens, i + 2, F.size(tokens)))
        return df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size(tokens) - 1))).withColumn("_key", F.array_join(rest(F.col("_i")), "\x01"))

    table = keyed(known.select(F.col("tokens").alias("_known"), "en").filter(F.size("tokens") > 0), "_known").select("_key", "_i", "_known", "en")
    pairs = keyed(fit, "tokens").join(F.broadcast(table), ["_key", "_i"])
    distance = F.levenshtein(F.get("tokens", F.col("_i")), F.get("_known", F.col("_i")), most)
    pairs = pairs.withColumn("distance", distance).filter("distance >= 0")
    best = pairs.groupBy(*keys, "line", "_known").agg(F.min("distance").alias("distance"), F.first("en").alias("en"))
    ranked = best.withColumns({"_least": F.min("distance").over(Window.partitionBy(*keys, "line"))}).filter("distance = _least")
    one = ranked.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("_n"), F.first("_known").alias("spelling"), F.first("en").alias("en"), F.first("distance").alias("distance"))
    return one.filter("_n = 1").drop("_n")


def coverage(words: DataFrame, keys: list[str]) -> DataFrame:
    """words, lines, verified words (with a reading), their ratio and whether it is low."""
    out = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"), F.countDistinct("line").alias("lines"), F.count_if(F.col("en") != "").alias("verified"))
    return out.withColumn("ratio", F.col("verified") / F.col("words")).withColumn("low", F.col("ratio") < 0.45)
