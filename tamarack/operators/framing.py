"""Messages of any length as frames of one size, the batch form.

A session's bytes are one sequence, whatever messages they came in. Where a message starts in it is a running sum of lengths
over ranges of (session, order), so a session of any size is spread; a message then gives each frame that it touches its
part, and a frame is put together from at most `size` parts. No session is gathered.

Defined cases: null and empty messages add nothing; null sessions are a session of their own; a rest that fills no frame is
left out unless it is asked for; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Blocks

#: Fixed value: bytes of 1,600 samples of 16 bits.
FRAME_BYTES = 3200


def frames(messages: DataFrame, session: str, order: list[str], payload: str, size: int = FRAME_BYTES, rest: bool = False, block_count: int | None = None) -> DataFrame:
    """session, n (from 0) and frame of each session's frames."""
    by = [f"o{i}" for i in range(len(order))]
    rows = messages.select(F.col(session).alias("s"), *[F.col(o).alias(b) for o, b in zip(order, by)], F.coalesce(F.col(payload), F.lit(b"")).alias("p"))
    ranges = Blocks(rows, ["s"], by, block_count)
    found = ranges.running(ranges.rows, {"end": ("sum", F.octet_length("p").cast("long"))}).filter("octet_length(p) > 0")
    start = F.col("end") - F.octet_length("p")
    touched = found.withColumn("start", start).withColumn("n", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    low = F.greatest(F.col("start"), F.col("n") * size)
    part = F.substring("p", (low - F.col("start") + 1).cast("int"), (F.least(F.col("end"), (F.col("n") + 1) * size) - low).cast("int"))
    parts = touched.select("s", "n", low.alias("low"), F.hex(part).alias("h"))
    whole = parts.groupBy("s", "n").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("low", "h"))), lambda x: x["h"]), "")).alias("frame"))
    return whole.filter(F.lit(rest) | (F.octet_length("frame") == size)).select(F.col("s").alias(session), "n", "frame")
