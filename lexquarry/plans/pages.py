"""Pages of placed strings, put together from order lines, and glyphs in painted boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators import intervals, page_layout

from .base import query

_ITEMS = """SELECT l_orderkey // 50 AS page, l_orderkey * 8 + l_linenumber AS id, x0, x0 + width AS x1, (900 - (l_orderkey % 50) * 5 - CASE WHEN l_orderkey % 50 > 25 THEN 40 ELSE 0 END - l_linenumber % 2 * 2)::DOUBLE AS y, h
FROM (SELECT l_orderkey, l_linenumber, (min(l_partkey) % 3 * 200 + min(l_suppkey) * 7 % 120)::DOUBLE AS x0, (20 + min(l_quantity) % 30)::DOUBLE AS width, (8 + min(l_partkey) % 3)::DOUBLE AS h FROM lineitem GROUP BY 1, 2) x"""


def _items(t) -> DataFrame:
    one = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    y = "CAST(900 - (l_orderkey % 50) * 5 - CASE WHEN l_orderkey % 50 > 25 THEN 40 ELSE 0 END - l_linenumber % 2 * 2 AS DOUBLE)"
    placed = one.selectExpr("CAST(floor(l_orderkey / 50) AS BIGINT) AS page", "l_orderkey * 8 + l_linenumber AS id", "CAST(p % 3 * 200 + s * 7 % 120 AS DOUBLE) AS x0", "CAST(20 + q % 30 AS DOUBLE) AS w", f"{y} AS y", "CAST(8 + p % 3 AS DOUBLE) AS h")
    return placed.selectExpr("page", "id", "x0", "x0 + w AS x1", "y", "h")


_LINED = f"""WITH RECURSIVE items AS ({_ITEMS}), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y DESC, x0, id) AS rn FROM items),
walk AS (SELECT page, id, rn, 1 AS line, y AS top, h AS height FROM o WHERE rn = 1 UNION ALL
  SELECT o.page, o.id, o.rn, CASE WHEN abs(top - o.y) > 0.5 * least(o.h, height) THEN line + 1 ELSE line END, CASE WHEN abs(top - o.y) > 0.5 * least(o.h, height) THEN o.y ELSE top END,
    CASE WHEN abs(top - o.y) > 0.5 * least(o.h, height) THEN o.h ELSE height END FROM walk w JOIN o ON o.page = w.page AND o.rn = w.rn + 1),
l AS (SELECT o.*, w.line, w.top, w.height FROM o JOIN walk w USING (page, rn))"""
_GUTTERS = f"""{_LINED}, b0 AS (SELECT page, x0, x1, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
b AS (SELECT page, before AS start, x0 AS stop FROM b0 WHERE x0 > before + 0.1), per AS (SELECT page, line, min(x1) AS first_end, max(x0) AS last_start, max(height) AS h FROM l GROUP BY 1, 2),
mid AS (SELECT page, median(h) AS mid FROM per GROUP BY 1),
g AS (SELECT page, start, stop, count(CASE WHEN first_end <= start THEN 1 END)::BIGINT AS before, count(CASE WHEN last_start >= stop THEN 1 END)::BIGINT AS after
  FROM b JOIN mid USING (page) JOIN per USING (page) WHERE stop - start >= {page_layout.GUTTER_HEIGHTS} * mid GROUP BY 1, 2, 3 HAVING before >= {page_layout.GUTTER_LINES} AND after >= {page_layout.GUTTER_LINES})"""


@query(f"{_LINED} SELECT page, line::BIGINT AS line, count(*)::BIGINT AS items, max(top) AS y, min(x0) AS x0, max(x1) AS x1 FROM l GROUP BY page, line")
def text_lines(t) -> DataFrame:
    """The lines of each page by a running tolerance around their first item."""
    return page_layout.lines(_items(t)).groupBy("page", "line").agg(F.count("*").alias("items"), F.max("y").alias("y"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(f"{_GUTTERS} SELECT * FROM g")
def page_gutters(t) -> DataFrame:
    """Clear bands of each page, wide enough, with two lines or more on both sides."""
    return page_layout.gutters(page_layout.lines(_items(t)))


@query(f"""{_GUTTERS}, f AS (SELECT page, line, max(top) AS y, max(height) AS h FROM l GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN lag(y) OVER w - y - greatest(h, lag(h) OVER w) >= {page_layout.BAND_HEIGHTS} * h THEN 1 ELSE 0 END AS cut FROM f WINDOW w AS (PARTITION BY page ORDER BY line)),
bd AS (SELECT page, line, 1 + sum(cut) OVER (PARTITION BY page ORDER BY line) AS band FROM c),
pl AS (SELECT l.*, band, (SELECT count(*) FROM g WHERE g.page = l.page AND (x0 + x1) / 2 > g.start) AS col FROM l JOIN bd USING (page, line) WHERE page IN (SELECT page FROM g)),
wd AS (SELECT page, band, col, line, sum(new) AS words FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, line, col ORDER BY x0, id) <= {page_layout.WORD_HEIGHTS} * h THEN 0 ELSE 1 END AS new FROM pl) x GROUP BY 1, 2, 3, 4),
cm AS (SELECT page, band, col, avg(words) AS mean FROM wd GROUP BY 1, 2, 3), n AS (SELECT page, count(*) + 1 AS columns FROM g GROUP BY 1), ln AS (SELECT page, band, count(*) AS lines FROM bd GROUP BY 1, 2)
SELECT page, band::BIGINT AS band, columns::BIGINT AS columns, lines::BIGINT AS lines, lines >= 2 AND count(*) = columns AND min(mean) >= {page_layout.PROSE_WORDS} AS prose FROM cm JOIN n USING (page) JOIN ln USING (page, band) GROUP BY page, band, columns, lines""")
def prose_bands(t) -> DataFrame:
    """Bands of the pages with gutters, and whether every column of them holds prose."""
    return page_layout.prose_bands(page_layout.lines(_items(t)))


_BOX = "p_partkey % 50 AS page, p_partkey AS box, CAST(p_partkey * 37 % 500 AS DOUBLE) AS x0, CAST(p_partkey * 37 % 500 + p_size * 6 AS DOUBLE) AS x1, CAST(p_partkey * 61 % 700 AS DOUBLE) AS y0, CAST(p_partkey * 61 % 700 + p_size * 4 AS DOUBLE) AS y1"
_GLYPH = "l_suppkey % 50 AS page, CAST(l_partkey * 7 % 612 AS DOUBLE) AS x, CAST(l_orderkey * 13 % 792 AS DOUBLE) AS y"


@query(f"WITH b AS (SELECT {_BOX} FROM part), g AS (SELECT {_GLYPH} FROM lineitem) SELECT box, count(*)::BIGINT AS glyphs FROM b JOIN g ON g.page = b.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY box")
def glyphs_in_boxes(t) -> DataFrame:
    """How many glyphs lie in each painted box of their page."""
    boxes, glyphs = t.part.selectExpr(*_BOX.split(", ")), t.lineitem.selectExpr(*_GLYPH.split(", "))
    return intervals.count_points_in_boxes(glyphs, boxes, ["page"], "x", "y", ("x0", "y0", "x1", "y1"), "box").withColumnRenamed("n", "glyphs")
