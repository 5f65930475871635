"""One-dimensional signals as rows (key, pos, value): islands, smoothing, peaks, valleys. Keys are dealt out, so images or sessions run apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(active: DataFrame, keys: list[str], pos: str, gap: Column | int, carry: list[Column] = ()) -> DataFrame:
    """Runs of active positions with gaps of at most `gap`: keys, island, start, end, n and the aggregates in carry."""
    w = Window.partitionBy(*keys).orderBy(pos)
    step = F.col(pos) - F.lag(pos).over(w)
    rows = active.withColumn("_new", F.when(step.isNull() | (step > gap), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n"), *carry)


def moving_average(rows: DataFrame, keys: list[str], pos: str, value: str, width: int, name: str = "smooth") -> DataFrame:
    """Sum over a centred window divided by its full width, so that edges count missing values as 0."""
    before, after = width // 2, (width - 1) // 2
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-before, after)
    return rows.withColumn(name, F.sum(value).over(w) / F.lit(float(width)))


def find_peaks(x: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Positions of local maxima (middles of plateaus) that are `distance` apart, highest first, and stand out by `prominence`."""
    x = np.asarray(x, float)
    peaks, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    keep = np.ones(len(peaks), bool)
    for k in sorted(range(len(peaks)), key=lambda k: (x[peaks[k]], k), reverse=True):
        if keep[k]:
            for m in range(len(peaks)):
                if m != k and abs(peaks[m] - peaks[k]) < distance:
                    keep[m] = False
    out = []
    for p in np.array(peaks, int)[keep] if peaks else []:
        higher_left = np.flatnonzero(x[:p] > x[p])
        higher_right = np.flatnonzero(x[p + 1 :] > x[p])
        left = x[(higher_left[-1] + 1 if len(higher_left) else 0) : p + 1].min()
        right = x[p : (p + 1 + higher_right[0] if len(higher_right) else n)].min()
        if x[p] - max(left, right) >= prominence:
            out.append(int(p))
    return np.array(out, int)


def peaks(rows: DataFrame, keys: list[str], pos: str, value: str, prominence: float, distance: int) -> DataFrame:
    """keys and pos of the peaks; a key's signal is one small array."""
    schema = rows.select(*keys, pos).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, ignore_index=True)
        return pdf.loc[find_peaks(pdf[value].to_numpy(), prominence, distance), [*keys, pos]]

    return rows.select(*keys, pos, value).groupBy(*keys).applyInPandas(run, schema)


def valleys(rows: DataFrame, found: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """The first smallest position between each two neighbouring peaks, both included: keys, left, right, valley."""
    w = Window.partitionBy(*keys).orderBy(pos)
    marks = found.select(*keys, pos).withColumn("_peak", F.lit(True))
    marked = rows.join(marks, [*keys, pos], "left").withColumn("left", F.last(F.when(F.col("_peak"), F.col(pos)), ignorenulls=True).over(w))
    inner = marked.filter("left IS NOT NULL").select(*keys, "left", F.col(pos).alias("p"), F.col(value).alias("v"))
    # a peak closes the gap on its left too
    closing = marked.filter("_peak").withColumn("left", F.lag(pos).over(w)).filter("left IS NOT NULL").select(*keys, "left", F.col(pos).alias("p"), F.col(value).alias("v"))
    ends = closing.select(*keys, "left", F.col("p").alias("right"))
    best = inner.unionByName(closing).join(ends, [*keys, "left"]).groupBy(*keys, "left", "right")
    return best.agg(F.min_by("p", F.struct("v", "p")).alias("valley"))


def frames_to_rms(frames: DataFrame, pcm: str = "pcm") -> DataFrame:
    """Adds rms of 16-bit little-endian samples, scaled to 1; null where the frame is not whole samples."""

    @F.pandas_udf("double")
    def rms(pcm: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in pcm:
            yield series.map(lambda b: None if b is None or len(b) % 2 or not len(b) else float(np.sqrt(np.mean((np.frombuffer(b, "<i2") / 32768.0) ** 2))))

    return frames.withColumn("rms", rms(pcm))
