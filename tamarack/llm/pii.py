"""Personal data: base patterns, widened by bootstrapped contextual extraction.

The base patterns find emails, IP addresses, card and phone numbers in the whole text. They are the seeds. Every other
token, part of a token of joined values, or number written with single blanks that has the rough shape of an identifier is
a candidate, of any length. A seed's or candidate's lexical patterns are the whole words around it: the two before, the one
before with the one after, and a label just before it such as "tel:" or "mail=", of which the last LONGEST characters count.
Words and values of more than LONGEST characters go on by their hash, so no two of them are taken for one.

Spark scores the graph of patterns and instances in ROUNDS rounds. For each kind, a pattern's confidence is the mean
confidence of its distinct instances, shrunk towards 0 where it has few; a candidate's confidence is the largest of its
patterns'. Seeds keep confidence 1 for their own kind and 0 for others, so a pattern that also surrounds other things
stays weak. After the last round, candidates whose pattern is confident and backed by at least SUPPORT distinct seeds
become spans of the pattern's kind if their shape allows that kind. Base spans always stay.

Texts are read once; what goes on are tables of ids, spans and candidates. Edges are made distinct by (pattern,
instance) with map-side combining, patterns without SUPPORT seeds are dropped before they join anything, and a frequent
pattern's edges are joined by (pattern, salt), so no word pair gathers a large share of them in one task.

Defined cases: null text is empty and has no spans; repeated rows give repeated results; ties in confidence go to the
kind listed first; an empty table gives an empty table; no regular expression here backtracks over more than one
token, so a text of one endless run of characters takes linear time; extra columns aren't carried.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, texts_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, CONFIDENT, SHRINK, SALTS, LONGEST = 3, 5, 0.8, 1.0, 32, 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS, _NUMBER = re.compile(r"[0-9]"), re.compile(r"[0-9]+")
_AT, _HINT = re.compile(r"(?i)[\[(]at[\])]"), re.compile(r"(?i)[0-9@]|[\[(]at[\])]")
#: Numbers of several tokens with single blanks between them; what joins values in one token, and what stands between its parts.
_SPACED = re.compile(r"(?<![0-9A-Za-z.+(/-])[+(]?[0-9][0-9().+/-]*(?:\x20[0-9(][0-9().+/-]*)+(?![0-9A-Za-z])")
_JOINED, _PART = re.compile(r"[&?;|]"), re.compile(r"[^&?;|=,#\"'<>\[\]{}]+")
#: A candidate's core inside its token, without what opens and closes it.
_OPEN, _CLOSE = "\"'([{<", "\"')]}>.,;:!?"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the local part and on over the domain: what the leftmost pattern would match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans in order of start, then kind as listed."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def shapes(token: str) -> list[str]:
    """Kinds whose rough shape a token has."""
    digits = len(_DIGITS.findall(token))
    kinds = []
    if "@" in token[1:-1] or _AT.search(token):
        kinds.append("email")
    if digits >= 4 and re.fullmatch(r"[0-9]{1,3}(?:[.:,-][0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}", token):
        kinds.append("ip")
    if digits >= 12 and re.fullmatch(r"[0-9](?:[ .-]?[0-9]){11,22}", token):
        kinds.append("card")
    if 7 <= digits <= 15 and re.fullmatch(r"[+(]?[0-9][0-9().+/\x20-]+", token):
        kinds.append("phone")
    return kinds


def _short(value: str) -> str:
    """The value, or its hash where it is long."""
    return value if len(value) <= LONGEST else "#" + hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def tokens_of(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of a text's tokens."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    return [s for s, _ in spans], [e for _, e in spans]


def contexts(text: str, start: int, end: int, tokens: tuple[list[int], list[int]] | None = None) -> list[str]:
    """Lexical patterns around a span: words are lower-cased, digits in them are written as 0."""
    starts, ends = tokens or tokens_of(text)

    def word(i: int) -> str:
        return _short(_NUMBER.sub("0", text[starts[i] : ends[i]].lower()))

    first = bisect_right(starts, start) - 1  # the token that the span begins in
    label = text[max(starts[first], start - LONGEST) : start]
    label = _JOINED.split(label)[-1] or label  # in a joined token, the value's own key
    if label:
        return ["L|" + _NUMBER.sub("0", label.lower())]
    last = bisect_right(starts, end - 1) - 1
    out = []
    if first >= 2:
        out.append("B|" + word(first - 2) + " " + word(first - 1))
    if first and last + 1 < len(starts) and ends[last] == end:
        out.append("S|" + word(first - 1) + " _ " + word(last + 1))
    return out


def _candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, list[str]]]:
    """Tokens, parts of joined tokens and numbers written with blanks that look like identifiers and touch no base span."""
    if not _HINT.search(text):
        return []
    found: set[tuple[int, int]] = set()

    def core_of(token: str, stop: int) -> None:
        core = token.split("=")[-1].split(":")[-1] if token.count(":") == 1 or "=" in token else token
        start = stop - len(core)
        core = core.rstrip(_CLOSE)
        cut = len(core) - len(core.lstrip(_OPEN))
        if len(core) > cut:
            found.add((start + cut, start + len(core)))

    for m in _TOKEN.finditer(text):
        token = m[0]
        if not _HINT.search(token):
            continue
        core_of(token, m.end())
        if len(token) > LONGEST or _JOINED.search(token):
            for part in _PART.finditer(token):
                if _HINT.search(part[0]):
                    core_of(part[0], m.start() + part.end())
    for m in _SPACED.finditer(text):
        found.add((m.start(), m.start() + len(m[0].rstrip(_CLOSE))))
    out, i = [], 0
    for start, end in sorted(found):
        while i < len(taken) and taken[i][2] <= start:
            i += 1
        if any(s < end and e > start for _, s, e in taken[max(0, i - 4) : i + 4]):
            continue
        if kinds := shapes(text[start:end]):
            out.append((start, end, kinds))
    return out


def scan(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, base and cand (arrays of kind, start, end), edges (value hash, kind, seed, pattern, place in cand)."""
    span = "array<struct<kind:string,start:int,end:int>>"
    schema = f"row long, doc_id long, base {span}, cand array<struct<start:int,end:int,kinds:array<string>>>, edges array<struct<value:string,kind:string,seed:boolean,pattern:string,place:int>>"
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        cand_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kinds", pa.list_(pa.string()))]))
        edge_type = pa.list_(pa.struct([("value", pa.string()), ("kind", pa.string()), ("seed", pa.bool_()), ("pattern", pa.string()), ("place", pa.int32())]))
        for batch in slices(batches, "text"):
            base, cand, edges = [], [], []
            for t in texts_of(batch, "text"):
                spans = base_spans(t)
                others = _candidates(t, spans)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                cand.append([{"start": s, "end": e, "kinds": kinds} for s, e, kinds in others])
                at = tokens_of(t) if spans or others else None
                own = [{"value": _short(t[s:e].lower()), "kind": k, "seed": True, "pattern": p, "place": -1} for k, s, e in spans for p in contexts(t, s, e, at)]
                for i, (s, e, kinds) in enumerate(others):
                    value, around = _short(t[s:e].lower()), contexts(t, s, e, at)
                    own += [{"value": value, "kind": k, "seed": False, "pattern": p, "place": i} for k in kinds for p in around]
                edges.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(base, span_type), pa.array(cand, cand_type), pa.array(edges, edge_type)], ["row", "doc_id", "base", "cand", "edges"])

    return rows.mapInArrow(run, schema)


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """kind, pattern and confidence of the patterns that are confident after the last round.

    A pattern needs `support` distinct seeds of its kind. Its confidence for the kind is the mean confidence over all its
    distinct instances, seeds of other kinds counting 0, with SHRINK doubtful instances added.
    """
    distinct = edges.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))
    seeds = distinct.filter("seed").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= support)
    seeds = staged(seeds, "pii-seeds")
    every = distinct.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("all_seeds"))
    seeds = staged(seeds.join(every, "pattern"), "pii-patterns")
    # only candidates in patterns with enough seeds can change anything
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS))
    salted = seeds.select("pattern", "kind").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    open_ = staged(distinct.filter("NOT seed").withColumn("salt", salt).join(salted, ["pattern", "kind", "salt"]).select("pattern", "kind", "value"), "pii-open")
    scored = seeds.select("pattern", "kind", (F.col("seeds") / (F.col("all_seeds") + SHRINK)).alias("confidence"))
    for k in range(rounds if open_.limit(1).count() else 0):
        scored_salted = scored.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        with_score = open_.withColumn("salt", salt).join(scored_salted, ["pattern", "kind", "salt"])
        instance = with_score.groupBy("kind", "value").agg(F.max("confidence").alias("belief"))
        gained = open_.join(instance, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"), F.count(F.lit(1)).alias("open"))
        mean = (F.col("seeds") + F.coalesce("belief", F.lit(0.0))) / (F.col("all_seeds") + F.coalesce("open", F.lit(0)) + SHRINK)
        scored = staged(seeds.join(gained, ["pattern", "kind"], "left").select("pattern", "kind", mean.alias("confidence")), f"pii-scores-{k}")
    return scored.filter(F.col("confidence") >= confident)


def find(df: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """row, doc_id, base and spans (arrays of kind, start, end, in order): base spans, and with those that contexts add."""
    scanned = staged(scan(df, id_column, text), "pii-scan")
    edges = scanned.select("row", F.explode("edges").alias("e")).select("row", "e.*")
    patterns = staged(bootstrap(edges.drop("row", "place"), **options), "pii-confident")
    if not patterns.limit(1).count():
        return scanned.select("row", "doc_id", "base", F.col("base").alias("spans"))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    salted = patterns.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    hits = edges.filter("NOT seed").withColumn("salt", salt).join(salted, ["pattern", "kind", "salt"])
    order = F.when(F.col("kind") == "email", 4).when(F.col("kind") == "ip", 3).when(F.col("kind") == "card", 2).otherwise(1)
    best = hits.groupBy("row", "place").agg(F.max_by("kind", F.struct("confidence", order)).alias("kind"))
    more = best.groupBy("row").agg(F.collect_list(F.struct("place", "kind")).alias("more"))
    joined = scanned.select("row", "doc_id", "base", "cand").join(more, "row", "left")
    new = F.transform(F.coalesce("more", F.array().cast("array<struct<place:int,kind:string>>")), lambda m: F.struct(m["kind"].alias("kind"), F.get("cand", m["place"])["start"].alias("start"), F.get("cand", m["place"])["end"].alias("end")))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    sortable = F.transform(F.concat("base", new), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(sortable), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("row", "doc_id", "base", ordered.alias("spans"))


def listed(spans: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: str) -> str:
    """SHA-256 of the base spans of one text, as the query returns it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text)).encode()).hexdigest()


def redact(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets; overlapping spans become one."""

    def mask(t: str, spans) -> str:
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [t[at : s["start"]], f"<{s['kind']}>"]
            at = max(at, s["end"])
        return "".join(out) + t[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [mask(t, spans) for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    # the same rows in the same order get the same row numbers only from one written table
    source = staged(df.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id()), "pii-texts")
    found = find(source.select(F.col("_row").alias("doc_id"), "text"))
    joined = source.join(found.select(F.col("doc_id").alias("_row"), "spans"), "_row").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, source.select("doc_id", "text").schema)
