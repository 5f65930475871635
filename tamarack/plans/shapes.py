"""Queries on outlines: turns of conversations as images, a character a pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contours
from ..tables import load

WIDTH = 64


def dark_pixels(spark, d):
    """image, x, y: a turn's characters, WIDTH a row, whose code gives a dark colour."""
    image = (F.col("conv_id") * 1000 + F.col("turn")).alias("image")
    rows = load(spark, d, "conversations").select(image, F.posexplode(F.split("text", "")).alias("at", "c")).filter("c <> ''")
    grey = F.ascii("c") % 256
    dark = contours.is_dark(grey * 3 % 256, grey * 5 % 256, grey * 7 % 256)
    return rows.filter(dark).select("image", (F.col("at") % WIDTH).cast("long").alias("x"), F.floor(F.col("at") / WIDTH).alias("y"))


def outline_rings(spark, d):
    """Every ring's first edge, length and area, and how it goes, as a digest of its points."""
    found = contours.rings(contours.edges(dark_pixels(spark, d)))
    points = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return contours.areas(found, digest=F.md5(points))  # what describes a shape of the given size


def simplified_outlines(spark, d):
    return contours.outlines(dark_pixels(spark, d)).select("image", "rank", "area", "points", "place", "x", "y")


QUERIES = {f.__name__: f for f in (outline_rings, simplified_outlines)}

_S = 1 << 28
_RINGS = f"""c AS (SELECT conv_id * 1000 + turn AS image, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS i FROM conversations WHERE length(text) > 0),
  g AS (SELECT image, i % {WIDTH} AS x, i // {WIDTH} AS y, unicode(c) % 256 AS g FROM c),
  p AS MATERIALIZED (SELECT image, x, y FROM (SELECT *, g * 3 % 256 AS r, g * 5 % 256 AS k, g * 7 % 256 AS b FROM g) WHERE greatest(r, k, b) < 205 AND r + k + b < 475),
  sides AS (SELECT * FROM (VALUES (0, 1, 0, 0, -1, 0, 0), (1, 0, 1, 1, 0, 1, 0), (2, -1, 0, 0, 1, 1, 1), (3, 0, -1, -1, 0, 0, 1)) AS v(s, ax, ay, ox, oy, cx, cy)),
  e AS MATERIALIZED (SELECT p.image, (p.y * {_S} + p.x) * 4 + s AS edge, p.x + cx AS x, p.y + cy AS y, s,
      CASE WHEN a.x IS NULL THEN (p.y * {_S} + p.x) * 4 + (s + 1) % 4 WHEN b.x IS NULL THEN ((p.y + ay) * {_S} + p.x + ax) * 4 + s ELSE ((p.y + ay + oy) * {_S} + p.x + ax + ox) * 4 + (s + 3) % 4 END AS next
    FROM p CROSS JOIN sides LEFT JOIN p o ON o.image = p.image AND o.x = p.x + ox AND o.y = p.y + oy
    LEFT JOIN p a ON a.image = p.image AND a.x = p.x + ax AND a.y = p.y + ay LEFT JOIN p b ON b.image = p.image AND b.x = p.x + ax + ox AND b.y = p.y + ay + oy WHERE o.x IS NULL),
  w AS (SELECT image, edge AS ring, edge AS now, 0 AS place FROM e UNION ALL
    SELECT w.image, ring, e.next, place + 1 FROM w JOIN e ON e.image = w.image AND e.edge = w.now WHERE e.next > ring),
  closed AS (SELECT w.image, ring, max(place) + 1 AS n FROM w JOIN e ON e.image = w.image AND e.edge = w.now GROUP BY ALL HAVING bool_or(e.next = ring))"""
#: A ring is what comes back to its smallest edge when it is walked; a walk that meets a smaller edge is given up.
_WALKS = f"""WITH RECURSIVE {_RINGS},
  walked AS MATERIALIZED (SELECT w.image, w.ring, w.place, e.x, e.y, e.s FROM w JOIN closed USING (image, ring) JOIN e ON e.image = w.image AND e.edge = w.now),
  stepped AS (SELECT *, x + CASE s WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS nx, y + CASE s WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS ny FROM walked),
  areas AS MATERIALIZED (SELECT image, ring, sum(x * ny - nx * y) / 2 AS area, count(*) AS size, md5(string_agg(x || ',' || y, ' ' ORDER BY place)) AS digest FROM stepped GROUP BY ALL)"""
ORACLE_SQL = {
    "outline_rings": f"{_WALKS} SELECT * FROM areas",
    "simplified_outlines": f"""{_WALKS},
  big AS MATERIALIZED (SELECT image, ring, area, size AS n FROM areas WHERE abs(area) >= 18),
  ends AS (SELECT image, ring, any_value(n) AS n, arg_min(place, x * 1000000 + place) AS a, arg_min(place, -x * 1000000 + place) AS b FROM walked JOIN big USING (image, ring) GROUP BY ALL),
  turned AS MATERIALIZED (SELECT image, ring, (place - a + n) % n AS place, x, y FROM walked JOIN ends USING (image, ring)),
  pts AS MATERIALIZED (SELECT * FROM turned UNION ALL SELECT t.image, t.ring, n, x, y FROM turned t JOIN ends USING (image, ring) WHERE place = 0),
  iv AS (SELECT image, ring, 0::BIGINT AS low, ((b - a + n) % n)::BIGINT AS high FROM ends UNION SELECT image, ring, ((b - a + n) % n)::BIGINT, n::BIGINT FROM ends
    UNION ALL SELECT image, ring, unnest([low, middle]), unnest([middle, high]) FROM (
      SELECT i.image, i.ring, low, high, -max(struct_pack(d := CASE WHEN q.x = r.x AND q.y = r.y THEN sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))
          ELSE abs((r.y - q.y) * p.x - (r.x - q.x) * p.y + r.x * q.y - r.y * q.x) / sqrt((r.x - q.x) * (r.x - q.x) + (r.y - q.y) * (r.y - q.y)) END, m := -p.place)).m AS middle,
        max(CASE WHEN q.x = r.x AND q.y = r.y THEN sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))
          ELSE abs((r.y - q.y) * p.x - (r.x - q.x) * p.y + r.x * q.y - r.y * q.x) / sqrt((r.x - q.x) * (r.x - q.x) + (r.y - q.y) * (r.y - q.y)) END) AS d
      FROM iv i JOIN pts q ON q.image = i.image AND q.ring = i.ring AND q.place = low JOIN pts r ON r.image = i.image AND r.ring = i.ring AND r.place = high
      JOIN pts p ON p.image = i.image AND p.ring = i.ring AND p.place > low AND p.place < high GROUP BY i.image, i.ring, low, high) WHERE d > 1.35),
  kept AS (SELECT DISTINCT image, ring, low AS place FROM iv),
  counted AS (SELECT *, count(*) OVER (PARTITION BY image, ring) AS points, row_number() OVER (PARTITION BY image, ring ORDER BY place) - 1 AS k FROM kept),
  ranked AS (SELECT image, ring, area, row_number() OVER (PARTITION BY image ORDER BY abs(area) DESC, ring) AS rank FROM big JOIN (SELECT DISTINCT image, ring FROM counted WHERE points >= 3) USING (image, ring))
  SELECT image, rank, area, points, k AS place, x, y FROM counted JOIN ranked USING (image, ring) JOIN pts USING (image, ring, place)""",
}
