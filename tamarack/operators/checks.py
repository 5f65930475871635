"""Validation of requests, frames and forms, and the merging of partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest text of each kind of request.
LONGEST = {"question": 4000, "transcript": 12_000, "speech": 2000}
IMAGE, IMAGE_CHARS = r"^data:image/(?:png|jpeg|webp);base64,[A-Za-z0-9+/=]+$", 14_000_000
QUERY, FRAME_BYTES = 500, 3200


def request_error(kind: Column, text: Column) -> Column:
    """null for a request that may be served, else what is wrong."""
    most = F.create_map(*[F.lit(x) for pair in LONGEST.items() for x in pair])[kind]
    return F.when(most.isNull(), "unknown kind").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.length(text) > most, "too long")


def image_error(data_url: Column) -> Column:
    """null for an image that may be read, else what is wrong."""
    return F.when(F.length(data_url) > IMAGE_CHARS, "too long").when(~F.coalesce(data_url.rlike(IMAGE), F.lit(False)), "no image")


def search_query(text: Column) -> Column:
    """What a search looks at of its question."""
    return F.substring(F.coalesce(text, F.lit("")), 1, QUERY)


def frame_error(pcm: Column) -> Column:
    return F.when(pcm.isNull() | (F.octet_length(pcm) != FRAME_BYTES), "not one frame")


def form_errors(forms: DataFrame, fields: list[tuple[str, bool, int]], key: str = "form_id") -> DataFrame:
    """key, field, error of the invalid fields; forms has values MAP<STRING, STRING>, fields are (name, required, longest; 0 for any length)."""
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("required"), F.lit(n).alias("longest")) for f, r, n in fields])
    rows = forms.select(key, "values", F.explode(listed).alias("f")).select(key, "values", "f.*")
    value = F.trim(F.coalesce(F.col("values")[F.col("field")], F.lit("")))
    error = F.when(F.col("required") & (value == ""), "required").when((F.col("longest") > 0) & (F.length(value) > F.col("longest")), "max")
    return rows.select(key, "field", error.alias("error")).filter("error IS NOT NULL")


def merge_parts(parts: DataFrame, key: str, field: str, value: str, order: str) -> DataFrame:
    """One value for each key and field: the parts in order, each appended unless what is there already contains it."""
    listed = parts.filter(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(key, field).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("p"))
    join = lambda done, p: F.when(done == "", p[value]).when(F.contains(done, p[value]), done).otherwise(F.concat(done, F.lit("; "), p[value]))
    return listed.select(key, field, F.aggregate("p", F.lit(""), join).alias(value))


def with_line_translation(segments: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with their line's translation, null where the line has none."""
    one = lines.groupBy(*keys, "line").agg(F.first("en", ignorenulls=True).alias("line_en"))
    return segments.join(one, [*keys, "line"], "left")


def polygon_area(points: DataFrame, key: str, order: str) -> DataFrame:
    """Signed area of each closed polygon of points x, y."""
    w = Window.partitionBy(key).orderBy(order)
    first = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    cross = F.col("x") * nxt("y") - nxt("x") * F.col("y")
    return points.withColumn("_cross", cross).groupBy(key).agg((F.sum("_cross") / 2).alias("area"))


def contains_all(expected: Column, found: Column) -> Column:
    return F.size(F.array_except(expected, found)) == 0


#: The steps of an answer, from the question to its end; a session may ask again after that.
ANSWER_STEPS = [
    (None, "ask"), ("ask", "answer"), ("ask", "error"), ("answer", "preparing"), ("answer", "speech_segment"), ("answer", "done"), ("answer", "error"), ("preparing", "speech_segment"), ("preparing", "done"), ("preparing", "error"),
    ("speech_segment", "frame"), ("frame", "preparing"), ("frame", "speech_segment"), ("frame", "done"), ("frame", "error"), ("done", "ask"), ("error", "ask"),
]


def out_of_order(events: DataFrame, keys: list[str], order: list[str], kind: str, steps: list[tuple[str | None, str]] = ANSWER_STEPS) -> DataFrame:
    """Events that no listed step leads to, with `before`, the kind of the event before them in their session (null at its start)."""
    rows = events.withColumn("before", F.lag(kind).over(Window.partitionBy(*keys).orderBy(*order)))
    after = {}
    for before, now in steps:
        after.setdefault(before, []).append(now)
    fits = F.lit(False)
    for before, kinds in after.items():
        fits = fits | (F.col("before").eqNullSafe(F.lit(before)) & F.coalesce(F.col(kind).isin(*kinds), F.lit(False)))
    return rows.filter(~fits)
