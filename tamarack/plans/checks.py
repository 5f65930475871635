"""Queries on validation and merging, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..sources import files
from ..tables import load, sql_values

FIELDS = [("apa", True, 10), ("bila", False, 20), ("dimana", False, 30)]
PARTS = ["lampu rosak", "rosak", "di jalan", ""]
STEPS = [(None, "view"), ("view", "view"), ("view", "click"), ("click", "view"), ("click", "click"), ("click", "purchase"), ("purchase", "view")]
KINDS = ["ask", "answer", "preparing", "speech_segment", "frame", "done", "error"]
IMAGES = ["png", "jpeg", "webp", "gif"]


def _pick(values: list[str], n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def request_validation(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, [*checks.LONGEST, "other"]))).alias("kind"))
    return rows.select("doc_id", "kind", checks.request_error(F.col("kind"), F.col("text")).alias("error"))


def frame_validity(spark, d):
    """Each document's bytes as a stream that is cut into frames: a rest that fills no frame, or no bytes at all, is an error."""
    rows = load(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    last = F.greatest(F.ceil(F.coalesce(F.octet_length("pcm"), F.lit(0)) / checks.FRAME_BYTES) - 1, F.lit(0)).cast("int")
    frames = rows.select("doc_id", "pcm", F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    return frames.select("doc_id", "seq", checks.frame_error(F.substring("pcm", F.col("seq") * checks.FRAME_BYTES + 1, F.lit(checks.FRAME_BYTES))).alias("error"))


def form_validation(spark, d):
    """Events as filled-in forms: some lack what is required, some are too long."""
    n = F.col("event_id")
    values = F.create_map(F.lit("apa"), F.when(n % 3 == 0, "").otherwise(F.col("event_type")), F.lit("bila"), F.when(n % 4 == 1, "on the eighteenth of September").otherwise(""), F.lit("dimana"), F.repeat(F.lit("k"), (F.col("user_id") % 50).cast("int")))
    return checks.form_errors(load(spark, d, "events").select(n.alias("form_id"), values.alias("values")), FIELDS)


def event_order(spark, d):
    """Events of a user that don't follow from the one before: a visit starts with a view, and only a click leads to a purchase."""
    rows = checks.out_of_order(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", STEPS)
    return rows.select("event_id", "user_id", "before", F.col("event_type").alias("kind"))


def answer_protocol(spark, d):
    """Events of answer sessions that break the order of an answer."""
    rows = load(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), _pick(KINDS, F.floor(F.col("event_id") / 3)).alias("kind"))
    return checks.out_of_order(rows, ["session"], ["seq"], "kind")


def field_merge(spark, d):
    """What a user's events of a kind add to one value."""
    rows = load(spark, d, "events").select(F.col("user_id").alias("statement"), F.col("event_type").alias("field"), F.col("event_id").alias("part"), F.concat(_pick(PARTS, F.col("event_id")), F.when(F.col("event_id") % 8 == 2, F.get_json_object("props", "$.k")).otherwise("")).alias("value"))
    return checks.merge_parts(rows, "statement", "field", "value", "part")


def conversation_merge(spark, d):
    """The roles of each conversation in order, each once."""
    return checks.merge_parts(load(spark, d, "conversations").withColumn("field", F.lit("role")), "conv_id", "field", "role", "turn")


def polygon_areas(spark, d):
    """Vectors as polygons: two neighbouring values, in thousandths, are a point."""
    at = lambda i: F.floor(F.get("embedding", i).cast("double") * 1000).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: F.struct(i.alias("n"), at(i * 2).alias("x"), at(i * 2 + 1).alias("y")))
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("shape"), F.explode(points).alias("p")).select("shape", "p.*")
    return checks.polygon_area(rows, "shape", "n")


def image_data_urls(spark, d):
    """Documents as images in data addresses; a quarter is of a kind that isn't read."""
    url = F.concat(F.lit("data:image/"), _pick(IMAGES, F.col("doc_id")), F.lit(";base64,"), F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")))
    return load(spark, d, "documents").select("doc_id", F.octet_length(files.image_bytes(url)).alias("bytes"))


def line_translation_join(spark, d):
    """Events as segments and their users' hourly levels as line translations."""
    hour = F.hour("ts").alias("line")
    segments = load(spark, d, "events").select("event_id", "user_id", hour)
    lines = load(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id", hour).agg(F.count(F.lit(1)).cast("string").alias("en"))
    return checks.with_line_translation(segments, lines, ["user_id"])


QUERIES = {f.__name__: f for f in (request_validation, frame_validity, form_validation, field_merge, conversation_merge, polygon_areas, image_data_urls, line_translation_join, event_order, answer_protocol)}
ORACLE_SQL = {
    "request_validation": """SELECT doc_id, kind, CASE WHEN most IS NULL THEN 'unknown kind' WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) > most THEN 'too long' END AS error
        FROM documents, (VALUES ('question', 4000), ('transcript', 12000), ('speech', 2000), ('other', NULL)) AS k(kind, most)""",
    "frame_validity": """SELECT doc_id, seq, CASE WHEN text IS NULL OR strlen(text) < 3200 * (seq + 1) THEN 'not one frame' END AS error
        FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(coalesce(strlen(text), 0) / 3200) AS BIGINT), 1))) AS seq FROM documents)""",
    "form_validation": """SELECT event_id AS form_id, 'apa' AS field, 'required' AS error FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'bila', 'max' FROM events WHERE event_id % 4 = 1
        UNION ALL SELECT event_id, 'dimana', 'max' FROM events WHERE user_id % 50 > 30""",
    "field_merge": """WITH p AS (SELECT user_id, event_type, event_id, ['lampu rosak', 'rosak', 'di jalan', ''][event_id % 4 + 1] || CASE WHEN event_id % 8 = 2 THEN json_extract_string(props, '$.k') ELSE '' END AS v FROM events)
        SELECT user_id AS statement, event_type AS field, list_reduce(list(v ORDER BY event_id), lambda d, x: CASE WHEN contains(d, x) THEN d ELSE d || '; ' || x END) AS value FROM p WHERE v <> '' GROUP BY ALL""",
    "conversation_merge": """WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, 'role' AS field, string_agg(role, '; ' ORDER BY t) AS role FROM f GROUP BY conv_id""",
    "polygon_areas": """WITH p AS (SELECT vec_id AS shape, n, floor(CAST(embedding[2 * n + 1] AS DOUBLE) * 1000) AS x, floor(CAST(embedding[2 * n + 2] AS DOUBLE) * 1000) AS y FROM (SELECT *, unnest(range(0, len(embedding) // 2)) AS n FROM embeddings)),
        q AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM p WINDOW w AS (PARTITION BY shape ORDER BY n))
        SELECT shape, sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) / 2 AS area FROM q GROUP BY shape""",
    "image_data_urls": "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 AND text <> '' THEN strlen(text) END AS bytes FROM documents",
    "line_translation_join": """SELECT e.event_id, e.user_id, hour(e.ts) AS line, l.en AS line_en FROM events e LEFT JOIN
        (SELECT user_id, hour(ts) AS line, CAST(count(*) AS VARCHAR) AS en FROM events WHERE event_type = 'purchase' GROUP BY ALL) l ON e.user_id = l.user_id AND hour(e.ts) = l.line""",
    "event_order": """WITH e AS (SELECT event_id, user_id, event_type AS kind, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
        SELECT event_id, user_id, before, kind FROM e WHERE NOT CASE kind WHEN 'view' THEN before IS NULL OR before IN ('view', 'click', 'purchase') WHEN 'click' THEN coalesce(before IN ('view', 'click'), false)
        WHEN 'purchase' THEN coalesce(before = 'click', false) ELSE false END""",
    "answer_protocol": f"""WITH e AS (SELECT user_id AS session, event_id AS seq, {KINDS}[event_id // 3 % {len(KINDS)} + 1] AS kind FROM events), b AS (SELECT *, lag(kind) OVER (PARTITION BY session ORDER BY seq) AS before FROM e)
        SELECT session, seq, kind, before FROM b WHERE NOT EXISTS (SELECT 1 FROM {sql_values(checks.ANSWER_STEPS, ["was", "now"])} WHERE v.was IS NOT DISTINCT FROM before AND v.now = kind)""",
}
