"""Queries on signals, frames and spoken text: embeddings as one-dimensional signals, events as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import speech
from ..functions import text as T
from ..operators import media, signals
from ..operators.utterances import utterances
from ..tables import load

THRESHOLD, SILENCE, MOST = 12.0, 2, 8


def signal(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, pos, value of every position of every vector."""
    rows = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return rows.select("vec_id", "pos", F.col("v").cast("double").alias("value"))


def row_islands(spark, d):
    return signals.islands(signal(spark, d).filter("value > 0"), ["vec_id"], "pos", 2)


def moving_average(spark, d):
    """Rounded as doubles: F.round goes through decimals, which lose the sign of a small negative average."""
    six = F.rint(F.col("smooth") * 1e6) / 1e6
    return signals.moving_average(signal(spark, d), ["vec_id"], "pos", "value", 9).select("vec_id", "pos", six.alias("smooth"))


def signal_peaks(spark, d):
    return signals.peaks(signal(spark, d), ["vec_id"], "pos", "value", 0.1, 6)


def valley_argmin(spark, d):
    """Valleys between the positions that are multiples of 16."""
    rows = signal(spark, d)
    return signals.valleys(rows, rows.filter("pos % 16 = 0").select("vec_id", "pos"), ["vec_id"], "pos", "value")


def ink_percentile(spark, d):
    return signal(spark, d).groupBy("vec_id").agg(F.round(F.percentile("value", 0.3), 6).alias("p30"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events")


def _micros():
    """Microseconds since 1970; the events' times have no zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))


def frame_rms(spark, d):
    hour = F.date_trunc("hour", "ts")
    return events(spark, d).groupBy("user_id", hour.alias("hour")).agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.count(F.lit(1)).alias("n"))


def utterance_sessions(spark, d):
    return utterances(events(spark, d), "user_id", ["ts", "event_id"], "value", THRESHOLD, SILENCE, MOST)


def rolling_levels(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-27, 0)
    return events(spark, d).select("event_id", F.max("value").over(w).alias("peak"), F.round(F.avg("value").over(w), 6).alias("mean"))


def fifo_cache(spark, d):
    rows = events(spark, d).select("event_id", "user_id", F.get_json_object("props", "$.k").alias("key"), F.round(F.col("value") * 100).cast("long").alias("bytes"))
    return media.byte_bounded_cache(rows, "event_id", "key", "bytes", 20_000, "user_id").select("user_id", "key", "event_id", "bytes", "held")


def sessions_by_gap(spark, d):
    """Sessions of a user with gaps of at most six hours."""
    rows = events(spark, d).select("user_id", _micros().alias("t"), "value")
    found = signals.islands(rows, ["user_id"], "t", 6 * 3600 * 1_000_000, [F.round(F.sum("value"), 4).alias("total")])
    return found.select("user_id", F.col("island").cast("long").alias("session"), "start", "end", "n", "total")


def cached_prefix(spark, d):
    """For each conversation the number of turns before the first one that isn't the user's."""
    rows = load(spark, d, "conversations")
    miss = F.min(F.when(F.col("role") != "system", F.col("turn")))
    return rows.groupBy("conv_id").agg(F.coalesce(miss, F.count(F.lit(1))).alias("prefix"))


def speech_segments(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(speech.speech_segments("text")).alias("seq", "part"))


def tts_chunks(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(speech.tts_chunks("text")).alias("seq", "part"))


def fixed_chunks(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"))).alias("seq", "part")).select("doc_id", "seq", F.md5("part").alias("digest"))


def latency_summary(spark, d):
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, _micros()))
    return events(spark, d).groupBy("user_id").agg((first("click") - first("view")).alias("view_to_click"), (first("purchase") - first("view")).alias("view_to_purchase"))


QUERIES = {
    f.__name__: f
    for f in (
        row_islands, moving_average, signal_peaks, valley_argmin, ink_percentile, frame_rms, utterance_sessions, rolling_levels, fifo_cache, sessions_by_gap, cached_prefix,
        speech_segments, tts_chunks, fixed_chunks, latency_summary,
    )
}

_SIGNAL = "s AS (SELECT vec_id, pos - 1 AS pos, CAST(embedding[pos] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))"
ORACLE_SQL = {
    "row_islands": f"""WITH {_SIGNAL}, a AS (SELECT *, pos - lag(pos) OVER (PARTITION BY vec_id ORDER BY pos) AS step FROM s WHERE value > 0),
        g AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY pos) AS island FROM a)
        SELECT vec_id, island, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM g GROUP BY vec_id, island""",
    "moving_average": f"WITH {_SIGNAL} SELECT a.vec_id, a.pos, round(sum(b.value) / 9, 6) AS smooth FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.pos BETWEEN a.pos - 4 AND a.pos + 4 GROUP BY a.vec_id, a.pos",
    "valley_argmin": f"""WITH {_SIGNAL}, p AS (SELECT vec_id, pos AS l, lead(pos) OVER (PARTITION BY vec_id ORDER BY pos) AS r FROM s WHERE pos % 16 = 0)
        SELECT vec_id, l AS "left", r AS "right", pos AS valley FROM p JOIN s USING (vec_id) WHERE pos BETWEEN l AND r QUALIFY row_number() OVER (PARTITION BY vec_id, l ORDER BY value, pos) = 1""",
    "ink_percentile": f"WITH {_SIGNAL} SELECT vec_id, round(quantile_cont(value, 0.3), 6) AS p30, round(sqrt(avg(value * value)), 6) AS rms FROM s GROUP BY vec_id",
    "frame_rms": "SELECT user_id, date_trunc('hour', ts) AS hour, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS n FROM events GROUP BY ALL",
    "utterance_sessions": f"""WITH RECURSIVE f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total, value > {THRESHOLD} AS speaks FROM events),
        r AS (SELECT user_id, 0 AS n, -1 AS st, 0 AS quiet, 0 AS cnt, -1 AS os, 0 AS oc FROM f WHERE n = 1
          UNION ALL
          SELECT user_id, n, CASE WHEN idle AND NOT speaks THEN -1 WHEN ends THEN -1 ELSE s2 END, CASE WHEN (idle AND NOT speaks) OR ends THEN 0 ELSE q2 END, CASE WHEN (idle AND NOT speaks) OR ends THEN 0 ELSE c2 END,
                 CASE WHEN NOT (idle AND NOT speaks) AND (ends OR n = total) THEN s2 ELSE -1 END, c2
          FROM (SELECT *, q2 >= {SILENCE} OR c2 >= {MOST} AS ends FROM (
            SELECT f.user_id, f.n, f.total, f.speaks, r.st < 0 AS idle, CASE WHEN r.st < 0 THEN f.n ELSE r.st END AS s2, CASE WHEN f.speaks THEN 0 ELSE r.quiet + 1 END AS q2, r.cnt + 1 AS c2
            FROM r JOIN f ON f.user_id = r.user_id AND f.n = r.n + 1)))
        SELECT user_id, os AS start, n AS "end", oc AS frames, CASE WHEN oc < 6 THEN 1 ELSE 1 + CAST(ceil((oc - 6) / 5.0) AS INT) END AS blocks FROM r WHERE os >= 0""",
    "rolling_levels": "SELECT event_id, max(value) OVER w AS peak, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)",
    "fifo_cache": """WITH e AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS key, CAST(round(value * 100) AS BIGINT) AS bytes FROM events),
        o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY event_id) = 1)
        SELECT user_id, key, event_id, bytes, sum(bytes) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS held FROM o QUALIFY held <= 20000""",
    "sessions_by_gap": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step FROM e),
        k AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS session FROM g)
        SELECT user_id, session, min(t) AS start, max(t) AS "end", count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, session""",
    "cached_prefix": "SELECT conv_id, coalesce(min(turn) FILTER (role <> 'system'), count(*)) AS prefix FROM conversations GROUP BY conv_id",
    "fixed_chunks": "SELECT doc_id, i AS seq, md5(substring(text, i * 1400 + 1, 1400)) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1400.0) AS BIGINT))) AS i FROM documents)",
    "latency_summary": """SELECT user_id, min(epoch_us(ts)) FILTER (event_type = 'click') - min(epoch_us(ts)) FILTER (event_type = 'view') AS view_to_click,
        min(epoch_us(ts)) FILTER (event_type = 'purchase') - min(epoch_us(ts)) FILTER (event_type = 'view') AS view_to_purchase FROM events GROUP BY user_id""",
}
