"""Outlines of dark pixels as closed rings, and their simplification.

A dark pixel has an edge on each side that borders on no dark pixel, directed so that the pixel lies on its right. What comes
after an edge follows from the two pixels ahead: a ring turns to its own pixel's next side, goes straight on, or turns onto
the pixel that stands in its way. So every edge knows its successor. Edges are dealt by tiles of their images, and a task chains those that it holds
at once: most rings close there, and what goes on elsewhere becomes one section. Sections then find their rings in rounds: each looks as far ahead as
all rounds before together, and remembers the smallest edge it has seen and how far that is. After as many rounds as the
logarithm of the sections of the longest ring, all know the ring's first edge and their place after it. How edges are dealt changes no result, and an
image or ring of any size is spread over all tasks.

Where two dark pixels touch at a corner only, a ring stays with its own pixel; in the original that depended on the order
of its walk. Simplification (Ramer-Douglas-Peucker) splits all open intervals of all shapes at once in each round: a
point knows its interval's ends, the farthest point of every interval is found, and intervals that are close
enough are done. Lines of at most WHOLE points do their rounds in a task that holds some of them; longer ones are spread, with one aggregate a round.

Defined cases: a null darkness is light; repeated pixels count once; images without dark pixels have no rings; rings of fewer
than three points after simplification are left out of `outlines`; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import replaced, written
from .joins import with_facts

#: The smallest area that counts, and how far a point may lie off a simplified line.
LEAST_AREA, TOLERANCE = 18.0, 1.35
#: Dark pixels of the mark.
DARK_LEVEL, DARK_SUM = 205, 475
#: Directions east, south, west, north, for the sides top, right, bottom, left.
_EAST, _DOWN = (1, 0, -1, 0), (0, 1, 0, -1)
_AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
_SIDE = 1 << 28  # images have fewer rows and columns than that
#: Bits of the width of tiles that edges are dealt by, rows that a task chains or simplifies at once, and the longest line that is simplified there.
TILE, AT_ONCE, WHOLE = 7, 200_000, 100_000


def is_dark(red: Column, green: Column, blue: Column) -> Column:
    return F.coalesce((F.greatest(red, green, blue) < DARK_LEVEL) & (red + green + blue < DARK_SUM), F.lit(False))


def _number(x: Column, y: Column, side: Column | int) -> Column:
    """An edge's number; they go by row, column and side."""
    return (y * _SIDE + x) * 4 + side


def edges(dark: DataFrame, image: str = "image") -> DataFrame:
    """image, edge, next and the place (x, y) where the edge starts, of the dark pixels (image, x, y)."""
    pixels = dark.select(image, F.col("x").cast("long"), F.col("y").cast("long"))
    # each dark pixel tells the nine pixels around it; one shuffle, summed before it
    seen = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1 << i).alias("bit")) for i, (dx, dy) in enumerate(_AROUND)]))
    told = pixels.select(image, "x", "y", seen.alias("t")).groupBy(image, (F.col("x") - F.col("t.dx")).alias("x"), (F.col("y") - F.col("t.dy")).alias("y")).agg(F.bit_or("t.bit").alias("mask"))

    def dark_at(dx: int, dy: int) -> Column:
        return F.col("mask").bitwiseAND(1 << _AROUND.index((dx, dy))) != 0

    found = []
    for side in range(4):
        ahead, out = (_EAST[side], _DOWN[side]), (_EAST[side - 1], _DOWN[side - 1])
        beside = (ahead[0] + out[0], ahead[1] + out[1])
        x, y = F.col("x"), F.col("y")
        turn = _number(x, y, (side + 1) % 4)
        straight = _number(x + ahead[0], y + ahead[1], side)
        onto = _number(x + beside[0], y + beside[1], (side + 3) % 4)
        following = F.when(~dark_at(*ahead), turn).when(~dark_at(*beside), straight).otherwise(onto)
        corner = ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))[side]
        edge = F.struct(_number(x, y, side).alias("edge"), following.alias("next"), corner[0].alias("x"), corner[1].alias("y"))
        found.append(F.when(~dark_at(*out), edge))
    own = told.filter(dark_at(0, 0)).select(image, F.explode(F.array_compact(F.array(*found))).alias("e"))
    return own.select(image, "e.*")


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to some AT_ONCE rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values, nulls too, as equal numbers."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (image, edge, next, x, y): the ring, place, size and twice the area of edges whose ring is closed by the rows at hand. Others have their section's
    first edge as `head`, their place in the section, and the first one has the section's next edge, length, smallest edge and the way to it."""
    for table in _gathered(batches):
        n, image = table.num_rows, _codes(table.column(0))
        edge, after = (table.column(i).to_numpy() for i in (1, 2))
        known, number = np.unique(np.concatenate([edge, after]), return_inverse=True)
        key, wanted = image * len(known) + number[:n], image * len(known) + number[n:]
        order = np.argsort(key)
        at = np.minimum(np.searchsorted(key[order], wanted), n - 1)
        to = np.where(key[order][at] == wanted, order[at], n)  # n: not here
        has_before = np.zeros(n + 1, bool)
        has_before[to] = True
        jump, least, off = np.append(to, n), np.append(edge, np.iinfo(np.int64).max), np.zeros(n + 1, np.int64)
        last, left, reach = np.arange(n + 1), np.append(np.ones(n, np.int64), 0), 1
        while True:  # all look twice as far ahead in each round
            nearer, open_ = least[jump] < least, jump != n
            off = np.where(nearer, off[jump] + reach, off)
            least = np.minimum(least, least[jump])
            left = left + left[jump]
            last = np.where(open_, last[jump], last)
            jump, reach = jump[jump], 2 * reach
            if not nearer.any() and ((jump != n) == open_).all():
                break
        closed = jump[:n] != n
        x, y, side = table.column(3).to_numpy(), table.column(4).to_numpy(), edge % 4
        turn = x * (y + np.array(_DOWN)[side]) - (x + np.array(_EAST)[side]) * y
        _, group = np.unique(image * len(known) + np.searchsorted(known, least[:n]), return_inverse=True)
        size, area = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(size, group[closed], 1)
        np.add.at(area, group[closed], turn[closed])
        size, area = size[group], area[group]
        start = ~has_before[:n] & ~closed
        head_of, length_of = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        heads = np.flatnonzero(start)
        head_of[last[heads]], length_of[last[heads]] = heads, left[heads]
        head = head_of[last[:n]]
        place = np.where(closed, (size - off[:n]) % np.maximum(size, 1), length_of[last[:n]] - left[:n])
        following = after[last[:n] % n]
        pick = lambda values, where: pa.array(values, pa.int64(), mask=~where)
        columns = [
            pick(least[:n], closed), pa.array(place), pick(size, closed), pick(area, closed), pick(edge[head], ~closed),
            pick(following, start), pick(left[:n], start), pick(least[:n], start), pick(off[:n], start),
        ]
        names = [table.column_names[0], "edge", "x", "y", "ring", "place", "size", "turns", "head", "next", "length", "first", "off"]
        yield from pa.table([*(table.column(i) for i in (0, 1, 3, 4)), *columns], names=names).to_batches()


_CHAINED = "edge long, x long, y long, ring long, place long, size long, turns long, head long, next long, length long, first long, off long"


def _sections(state: DataFrame, image: str) -> DataFrame:
    """image, head, ring and the place of each section (image, head, next, length, first, off) in its ring, with the ring's size."""
    columns = [image, "head", "length", "next", "first", "off", "reach"]
    state, path = replaced(state.withColumn("reach", F.col("length")).select(*columns), "ring-sections", None)
    before = None
    while True:
        ahead = state.select(F.col(image).alias("_image"), F.col("head").alias("_head"), F.col("next").alias("_next"), F.col("first").alias("_first"), F.col("off").alias("_off"), F.col("reach").alias("_reach"))
        # both sides have each section once; their files are small beside what a broadcast of them takes
        joined = state.join(ahead.hint("merge"), F.col(image).eqNullSafe(F.col("_image")) & (F.col("next") == F.col("_head")))
        nearer = F.col("_first") < F.col("first")
        off = F.when(nearer, F.col("reach") + F.col("_off")).otherwise(F.col("off"))
        state, path = replaced(joined.select(image, "head", "length", F.col("_next").alias("next"), F.least("first", "_first").alias("first"), off.alias("off"), (F.col("reach") + F.col("_reach")).alias("reach")), "ring-sections", path)
        # sums of what may only fall: equal sums mean that nothing changed
        now = state.agg(F.count(F.lit(1)), F.sum(F.col("first").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    sizes = written(state.groupBy(image, "first").agg(F.sum("length").alias("size")), "ring-sizes")
    rows = with_facts(state, sizes, [image, "first"], ["head"])
    return written(rows.select(image, "head", F.col("first").alias("ring"), F.pmod(F.col("size") - F.col("off"), F.col("size")).alias("place"), "size"), "ring-places")


def _rings(found: DataFrame, image: str) -> DataFrame:
    """What `rings` gives, with each ring's size and twice its area."""
    tile = [F.shiftright("y", TILE), F.shiftright("x", TILE)]
    dealt = found.select(image, "edge", "next", "x", "y").repartition(image, *tile).sortWithinPartitions(image, *tile, "edge")
    schema = f"`{image}` {found.schema[image].dataType.simpleString()}, {_CHAINED}"
    rows = written(dealt.mapInArrow(_chained, schema), "ring-edges")
    own = lambda df: df.select(image, "ring", "place", "x", "y", F.col("edge").bitwiseAND(3).cast("int").alias("side"), "size", "turns")
    open_ = rows.filter("head IS NOT NULL")
    if open_.isEmpty():
        return own(rows)
    places = _sections(open_.filter("next IS NOT NULL").select(image, "head", "next", "length", "first", "off"), image)
    parts = with_facts(open_.select(image, "edge", "x", "y", "head", F.col("place").alias("at")), places, [image, "head"], ["edge"])
    parts = written(own(parts.withColumns({"place": (F.col("place") + F.col("at")) % F.col("size"), "turns": F.lit(None).cast("long")})), "ring-parts")
    twice = written(areas(parts, image).select(image, "ring", (F.col("area") * 2).cast("long").alias("turns")), "ring-areas")
    return own(rows.filter("head IS NULL")).unionByName(with_facts(parts.drop("turns"), twice, [image, "ring"], ["place"]))


def rings(found: DataFrame, image: str = "image") -> DataFrame:
    """image, ring (its smallest edge), place (from 0), x, y and side of every edge that `edges` gives."""
    return _rings(found, image).drop("size", "turns")


def areas(ring_rows: DataFrame, image: str = "image", **more: Column) -> DataFrame:
    """image, ring, area (signed: shapes are positive, holes negative) and size of each ring, and more aggregates of its rows."""
    to_x = F.col("x") + F.element_at(F.array(*map(F.lit, _EAST)), F.col("side").cast("int") + 1)
    to_y = F.col("y") + F.element_at(F.array(*map(F.lit, _DOWN)), F.col("side").cast("int") + 1)
    return ring_rows.groupBy(image, "ring").agg((F.sum(F.col("x") * to_y - to_x * F.col("y")) / 2).alias("area"), F.count(F.lit(1)).alias("size"), *(c.alias(name) for name, c in more.items()))


def _distance() -> Column:
    """Of (x, y) from the line through (ax, ay) and (bx, by), or from that point where both are one."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    off = F.abs(dy * F.col("x") - dx * F.col("y") + F.col("bx") * F.col("ay") - F.col("by") * F.col("ax"))
    away = F.sqrt((F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay")))
    return F.when((dx == 0) & (dy == 0), away).otherwise(off / F.sqrt((dx * dx + dy * dy).cast("double")))


def _split(points: DataFrame, ends: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The points that stay: the ends, and the farthest point of each interval in which one is farther than the tolerance.

    `points` (keys, place, x, y, low, high, ax, ay, bx, by) lie inside the open intervals (low, high); ends have keys, place, x, y.
    """
    kept, state, path = ends, points, None
    while True:
        far = F.struct(_distance().alias("d"), (-F.col("place")).alias("first"), "x", "y")
        farthest = state.groupBy(*keys, "low").agg(F.max(far).alias("m")).filter(F.col("m.d") > tolerance)
        splits = written(farthest.select(*keys, "low", (-F.col("m.first")).alias("middle"), F.col("m.x").alias("mx"), F.col("m.y").alias("my")), "splits")
        if splits.isEmpty():
            return kept
        kept = kept.unionByName(splits.select(*keys, F.col("middle").alias("place"), F.col("mx").alias("x"), F.col("my").alias("y")))
        rows = with_facts(state, splits, [*keys, "low"], ["place"]).filter("place <> middle")
        left = F.col("place") < F.col("middle")
        new = {"high": F.when(left, F.col("middle")).otherwise(F.col("high")), "ax": F.when(left, F.col("ax")).otherwise(F.col("mx")), "ay": F.when(left, F.col("ay")).otherwise(F.col("my"))}
        new |= {"bx": F.when(left, F.col("mx")).otherwise(F.col("bx")), "by": F.when(left, F.col("my")).otherwise(F.col("by")), "low": F.when(left, F.col("low")).otherwise(F.col("middle"))}
        state, path = replaced(rows.withColumns(new).select(*state.columns), "open-points", path)


def simplified(points: DataFrame, keys: list[str], tolerance: float = TOLERANCE, closed: bool = True) -> DataFrame:
    """The points (keys, place, x, y) that stay, places counted anew from 0.

    An open line keeps its first and last point. A closed ring starts at its leftmost point, the first of several, and is two
    lines that meet there and at its rightmost one.
    """
    rows = written(points.select(*keys, "place", "x", "y"), "line-points")
    long = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select(*keys, F.lit(True).alias("_long")), "long-lines")
    dealt = long.isEmpty()
    short = rows if dealt else with_facts(rows, long, keys, ["place"], "left").filter("_long IS NULL").drop("_long")
    local = short.repartition(*keys).sortWithinPartitions(*keys, "place").mapInArrow(partial(_simplified_whole, n_keys=len(keys), tolerance=tolerance, closed=closed), rows.withColumn("place", F.col("place").cast("long")).schema)
    if dealt:
        return local
    return local.unionByName(_simplified_spread(written(with_facts(rows, long, keys, ["place"]).drop("_long"), "long-points"), keys, tolerance, closed))


def _lines(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole lines, some AT_ONCE points at a time, and where each starts; rows come in the order of their keys."""
    rest = None
    for table in _gathered(batches):
        table = table if rest is None else pa.concat_tables([rest, table])
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for i in range(n_keys):
            code = _codes(table.column(i))
            new[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(new)
        rest = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _simplified_whole(batches: Iterable[pa.RecordBatch], n_keys: int, tolerance: float, closed: bool) -> Iterator[pa.RecordBatch]:
    """What stays of lines that are whole in a task, by the rounds of `_split`."""
    for table, starts in _lines(batches, n_keys):
        n = table.num_rows
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        sizes = np.diff(np.append(starts, n))
        line, start, size = np.repeat(np.arange(len(starts)), sizes), np.repeat(starts, sizes), np.repeat(sizes, sizes)
        order = np.arange(n)
        if closed:  # a ring goes from its leftmost point, the first of several
            left = np.lexsort((order, x, line))[starts]
            order = start + (order - start + np.repeat(left - starts, sizes)) % size
            x, y = x[order], y[order]
        turned = np.arange(n) - start
        # a ring has its first point once more behind the last, so that intervals have an end; `at` is where a line starts in that form
        more = int(closed)
        at = starts + np.arange(len(starts)) * more
        spot = np.repeat(at, sizes) + turned
        px, py = np.empty(n + more * len(starts), x.dtype), np.empty(n + more * len(starts), y.dtype)
        px[spot], py[spot] = x, y
        ends = at + sizes - 1 + more
        px[ends], py[ends] = px[at], py[at] if closed else py[ends]
        if not closed:
            px[spot] = x
        kept = np.zeros(len(px), bool)
        kept[at] = True
        turn = ends
        if closed:
            # the rightmost point, of several the first by its place before turning
            first = np.lexsort((order, -x, line))[starts]
            turn = spot[first]
        kept[turn] = True
        low, high = np.concatenate([at, turn]), np.concatenate([turn, ends])
        while True:
            wide = high - low > 1
            low, high = low[wide], high[wide]
            if not len(low):
                break
            inside = high - low - 1
            begin = np.cumsum(inside) - inside
            interval = np.repeat(np.arange(len(low)), inside)
            p = np.arange(inside.sum()) - begin[interval] + low[interval] + 1
            ax, ay, bx, by = (v[interval] for v in (px[low], py[low], px[high], py[high]))
            dx, dy = bx - ax, by - ay
            span = np.sqrt((dx * dx + dy * dy).astype(float))
            off = np.abs(dy * px[p] - dx * py[p] + bx * ay - by * ax) / np.where(span == 0, 1.0, span)
            d = np.where(span == 0, np.sqrt(((px[p] - ax) * (px[p] - ax) + (py[p] - ay) * (py[p] - ay)).astype(float)), off)
            most = np.maximum.reduceat(d, begin)
            hits = np.flatnonzero(d == most[interval])
            middle = p[hits[np.unique(interval[hits], return_index=True)[1]]]  # the first of several
            far = most > tolerance
            middle, low, high = middle[far], low[far], high[far]
            kept[middle] = True
            low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        stays = kept[spot]
        count = np.cumsum(stays) - stays
        out = table.take(pa.array(order[stays]))
        place = (count - count[start])[stays]
        columns = [pa.array(place, pa.int64()) if c == "place" else out.column(c) for c in out.column_names]
        yield from pa.table(columns, names=out.column_names).to_batches()


def _simplified_spread(rows: DataFrame, keys: list[str], tolerance: float, closed: bool) -> DataFrame:
    """What stays of lines of any length, spread over all tasks."""
    first = lambda value: F.min_by(F.struct("place", "x", "y"), F.struct(value, "place"))
    if closed:
        ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first(F.col("x")).alias("a"), first(-F.col("x")).alias("b"))
        ends = ends.withColumns({"n": F.col("n"), "turn": F.pmod(F.col("b.place") - F.col("a.place"), F.col("n"))})
        start = F.col("a.place")
    else:
        ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first(F.col("place")).alias("a"), first(-F.col("place")).alias("b")).withColumn("turn", F.col("n") - 1)
        start = F.lit(0)
    ends = written(ends, "line-ends")
    known = with_facts(rows, ends, keys, ["place"]).withColumn("place", F.pmod(F.col("place") - start, F.col("n")))
    second = F.col("place") > F.col("turn")
    pick = lambda name: F.when(second, F.col(f"b.{name}")).otherwise(F.col(f"a.{name}"))
    other = lambda name: F.when(second, F.col(f"a.{name}")).otherwise(F.col(f"b.{name}"))
    inside = known.filter((F.col("place") > 0) & (F.col("place") != F.col("turn")))
    inside = inside.select(*keys, "place", "x", "y", F.when(second, F.col("turn")).otherwise(F.lit(0)).cast("long").alias("low"), F.when(second, F.col("n")).otherwise(F.col("turn")).cast("long").alias("high"), pick("x").alias("ax"), pick("y").alias("ay"), other("x").alias("bx"), other("y").alias("by"))
    both = ends.select(*keys, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), "a.x", "a.y"), F.struct(F.col("turn").cast("long").alias("place"), "b.x", "b.y"))).alias("e")).select(*keys, "e.*").distinct()
    kept = _split(inside.withColumn("place", F.col("place").cast("long")), both, keys, tolerance)
    # what stays of a shape is what describes it
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("place")) - 1)


def outlines(dark: DataFrame, image: str = "image", least_area: float = LEAST_AREA, tolerance: float = TOLERANCE) -> DataFrame:
    """image, rank (by absolute area, the largest first), ring, area, points and place, x, y of each simplified outline's points."""
    rows = _rings(edges(dark, image), image).filter(F.abs("turns") >= 2 * least_area).withColumn("area", F.col("turns") / 2)
    rows = written(rows.select(image, "ring", "place", "x", "y", "area"), "rings")
    sizes = rows.filter("place = 0").select(image, "ring", "area")
    points = written(simplified(rows, [image, "ring"], tolerance), "outline-points")
    whole = points.groupBy(image, "ring").agg(F.count(F.lit(1)).alias("points")).filter("points >= 3")
    ranked = sizes.join(whole.hint("merge"), [image, "ring"]).withColumn("rank", F.row_number().over(Window.partitionBy(image).orderBy(F.desc(F.abs("area")), "ring")))
    return with_facts(points, written(ranked.select(image, "ring", "area", "points", "rank"), "ranked"), [image, "ring"], ["place"]).select(image, "rank", "ring", "area", "points", "place", "x", "y")
