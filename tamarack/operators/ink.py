"""Ink of page images, given as rows of pixels: which pixels are ink, and how much of it stands in rows, columns and groups.

Images are keys and run apart; what comes back to the pixels is one threshold for each image. An image without ink has
counts of 0 and no groups; pixels with a null level are no ink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written
from .joins import with_facts
from .signals import islands

#: Thresholds of printed ink.
GREY_MOST, GREY_BELOW, GREY_RANK = 190, 18, 0.3
DARK, GREY_DARK = 125, 140
LEAST_COLUMN, LEAST_MASS, LEAST_SHARE = 1, 12, 0.12
#: A rank of 0.3 or more, and so its part between two levels, is a multiple of 1 / DIGITS; a level times DIGITS fits a long.
DIGITS = 1 << 54


def _grey_limit(low: Column, high: Column, at: Column) -> Column:
    """Below it a pixel is ink; from the levels before and after the rank `at`. The percentile between them is rounded as DuckDB's
    quantile_cont does, low * (1 - part) + high * part with the first product and the sum rounded once (a fused multiply-add): it comes
    out just below or at a whole number, which moves the limit by one. Sums of longs are exact, and the cast to double is that rounding."""
    part = at - F.floor(at)
    total = low.cast("long") * ((1 - part) * F.lit(float(DIGITS))).cast("long") + (high * part * F.lit(float(DIGITS))).cast("long")
    return F.least(F.lit(GREY_MOST), F.floor(total.cast("double") / F.lit(float(DIGITS))).cast("int") - GREY_BELOW)


def grey_ink(pixels: DataFrame, image: str = "image", grey: str = "grey") -> DataFrame:
    """Adds `ink`: pixels clearly darker than the image's 30th percentile. Levels are whole numbers of 0 to 255 and are counted first,
    so an image of any size has 257 rows at most where its ranks are found."""
    counted = pixels.groupBy(F.col(image).alias("_image"), F.col(grey).alias("_level")).agg(F.count(grey).alias("_n"))
    of_image = Window.partitionBy("_image")
    counted = counted.withColumns({"_to": F.sum("_n").over(of_image.orderBy("_level")), "_at": (F.sum("_n").over(of_image) - 1) * F.lit(GREY_RANK)})
    level = lambda rank: F.min(F.when(F.col("_to") > rank, F.col("_level")))
    ranks = counted.groupBy("_image").agg(level(F.floor("_at")).alias("_low"), level(F.ceil("_at")).alias("_high"), F.first("_at").alias("_at"))
    limits = ranks.select("_image", _grey_limit(F.col("_low"), F.col("_high"), F.col("_at")).alias("_limit"))
    rows = pixels.join(limits, F.col(image).eqNullSafe(F.col("_image")))
    return rows.withColumn("ink", F.coalesce(F.col(grey) < F.col("_limit"), F.lit(False))).drop("_image", "_limit")


def colour_ink(red: Column, green: Column, blue: Column) -> Column:
    """Dark or red print."""
    dark = F.greatest(red, green, blue) < DARK
    is_red = (red > 140) & (green < 110) & (blue < 130) & (red > F.lit(1.7) * green)
    return F.coalesce(dark | is_red, F.lit(False))


def dark_grey(grey: Column) -> Column:
    return F.coalesce(grey < GREY_DARK, F.lit(False))


def grey_line_counts(images: DataFrame, width: int, image: str = "image", levels: str = "levels") -> DataFrame:
    """image, y, n_ink of images whose levels come as an array, row by row: the counts that `grey_ink` gives for their pixels, made
    inside the image's row. Images that come in several rows are put together as pixels."""
    rows = images.select(F.col(image), F.col(levels).alias("_levels"))  # ids alone are counted, so levels are made once
    again = written(images.groupBy(image).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(image, F.lit(True).alias("_again")), "repeated-images")
    parted = not again.isEmpty()
    if parted:
        rows = with_facts(rows, again, [image], ["_levels"], "left")
    one = rows.filter("_again IS NULL") if parted else rows
    one = one.withColumn("_sorted", F.sort_array(F.array_compact("_levels"))).withColumn("_at", (F.size("_sorted") - 1) * F.lit(GREY_RANK))
    low, high = F.get("_sorted", F.floor("_at").cast("int")), F.get("_sorted", F.ceil("_at").cast("int"))
    one = one.withColumn("_limit", _grey_limit(low, high, F.col("_at")))
    of_line = lambda y: F.size(F.filter(F.slice("_levels", y * width + 1, F.lit(width)), lambda g: g < F.col("_limit"))).cast("long")
    numbers = F.when(F.size("_levels") > 0, F.sequence(F.lit(0), F.floor((F.size("_levels") - 1) / width).cast("int")))
    lines = F.transform(numbers, lambda y: F.struct(y.cast("long").alias("y"), of_line(y).alias("n_ink")))
    counts = one.select(image, F.explode(lines).alias("_line")).select(image, "_line.y", "_line.n_ink")
    if not parted:
        return counts
    pixels = rows.filter("_again").select(image, F.posexplode("_levels").alias("at", "grey")).withColumn("y", F.floor(F.col("at") / width))
    return counts.unionByName(ink_counts(grey_ink(pixels, image), [image], "y"))


def ink_counts(pixels: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """n_ink of each row (axis y) or column (axis x); combined before the shuffle, so an image of any size is no burden."""
    return pixels.groupBy(*keys, axis).agg(F.count_if(F.col("ink")).alias("n_ink"))


def column_groups(columns: DataFrame, keys: list[str], gap: Column | int, pos: str = "x") -> DataFrame:
    """Runs of inked columns with their mass, and `kept`: whether that is enough beside the image's heaviest run."""
    runs = islands(columns.filter(F.col("n_ink") > LEAST_COLUMN), keys, pos, gap, [F.sum("n_ink").alias("mass")])
    most = F.max("mass").over(Window.partitionBy(*keys))
    return runs.withColumn("kept", F.col("mass") >= F.greatest(F.lit(float(LEAST_MASS)), most * LEAST_SHARE))
