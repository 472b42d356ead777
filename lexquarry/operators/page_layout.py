"""Lines, gutters, bands and prose of pages of placed strings.

items: page, id, x0, x1, y, h (y upwards). Lines need their items in order, so they are read from partitions sorted by page
with nothing carried along but the open line's first item; everything after that is aggregates and windows over a page's
lines, which are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Least width of a gutter and gap of words and bands, in heights; lines on each side of a gutter; words of a line of prose.
GUTTER_HEIGHTS, WORD_HEIGHTS, BAND_HEIGHTS, GUTTER_LINES, PROSE_WORDS = 1.0, 0.25, 1.0, 2, 2.0


def lines(items: DataFrame) -> DataFrame:
    """items with `line` from 1: from the top, an item joins the open line if its height differs from that of the line's
    first item by at most half the lesser of both font heights, else it opens the next. Ties in y are taken by x0, then id."""
    schema = T.StructType([*items.schema.fields, T.StructField("line", T.LongType())])
    arrow, at = to_arrow_schema(schema), [items.columns.index(c) for c in ("page", "y", "h")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, line, top, height, begun = None, 0, 0.0, 0.0, False
        for batch in batches:
            out = []
            for p, y, h in zip(*[batch.column(k).to_pylist() for k in at]):
                h = max(h, 0.1)
                if not begun or p != page:
                    page, line, top, height, begun = p, 1, y, h, True
                elif abs(top - y) > 0.5 * min(h, height):
                    line, top, height = line + 1, y, h
                out.append(line)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.int64())], schema=arrow)

    return items.repartition("page").sortWithinPartitions("page", F.desc("y"), "x0", "id").mapInArrow(run, schema)


def merged_spans(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, lo, hi: islands of extents [x0, x1] that touch within 0.1."""
    order = Window.partitionBy(*key).orderBy("x0", "x1")
    before = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("fresh", F.when(before.isNull() | (F.col("x0") > before + 0.1), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "island").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi")).drop("island")


def gutters(lined: DataFrame) -> DataFrame:
    """page, start, stop, before, after: clear bands between the merged extents of a page that are a gutter's width of its
    median line height, with `before` and `after` lines that have text ending left and beginning right of them."""
    m = merged_spans(lined.select("page", "x0", "x1"), ["page"])
    bands = m.select("page", F.col("hi").alias("start"), F.lead("lo").over(Window.partitionBy("page").orderBy("lo")).alias("stop")).where("stop IS NOT NULL")
    per_line = lined.groupBy("page", "line").agg(F.min("x1").alias("first_end"), F.max("x0").alias("last_start"), F.max_by("h", F.struct("y", F.negative("x0"), F.negative("id"))).alias("h"))
    height = per_line.groupBy("page").agg(F.median("h").alias("mid"))
    wide = bands.join(height, "page").where(F.col("stop") - F.col("start") >= GUTTER_HEIGHTS * F.col("mid"))
    both = wide.join(per_line, "page").groupBy("page", "start", "stop").agg(F.count_if(F.col("first_end") <= F.col("start")).alias("before"), F.count_if(F.col("last_start") >= F.col("stop")).alias("after"))
    return both.where((F.col("before") >= GUTTER_LINES) & (F.col("after") >= GUTTER_LINES))


def bands(lined: DataFrame) -> DataFrame:
    """page, line, band: lines cut where a vertical gap of a line or more lies between two; a line stands where its first item does."""
    first = lined.groupBy("page", "line").agg(F.max_by(F.struct("y", "h"), F.struct("y", F.negative("x0"), F.negative("id"))).alias("f")).select("page", "line", "f.y", "f.h")
    order = Window.partitionBy("page").orderBy("line")
    gap = F.lag("y").over(order) - F.col("y") - F.greatest(F.col("h"), F.lag("h").over(order))
    cut = first.withColumn("cut", F.when(gap >= BAND_HEIGHTS * F.col("h"), 1).otherwise(0))
    return cut.withColumn("band", (F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("bigint")).select("page", "line", "band")


def prose_bands(lined: DataFrame) -> DataFrame:
    """page, band, columns, lines, prose: a band is prose if it has two lines or more and each column, of those that the page's
    gutters make, has so many words a line on average where it has text. A word ends where a gap follows."""
    cuts = gutters(lined).groupBy("page").agg(F.array_sort(F.collect_list("start")).alias("cuts"))
    placed = lined.join(cuts, "page").join(bands(lined), ["page", "line"])
    placed = placed.withColumn("column", F.size(F.filter("cuts", lambda c: (F.col("x0") + F.col("x1")) / 2 > c)))
    order = Window.partitionBy("page", "line", "column").orderBy("x0", "id")
    apart = F.col("x0") - F.lag("x1").over(order) > WORD_HEIGHTS * F.col("h")
    words = placed.withColumn("new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).groupBy("page", "band", "column", "line").agg(F.sum("new").alias("words"), F.max(F.size("cuts")).alias("n"))
    columns = words.groupBy("page", "band", "column").agg(F.avg("words").alias("mean"), F.max("n").alias("n"))
    counted = bands(lined).groupBy("page", "band").agg(F.count("*").alias("lines"))
    each = columns.groupBy("page", "band").agg((F.max("n") + 1).cast("bigint").alias("columns"), F.count("*").alias("held"), F.min("mean").alias("least")).join(counted, ["page", "band"])
    prose = (F.col("lines") >= 2) & (F.col("held") == F.col("columns")) & (F.col("least") >= PROSE_WORDS)
    return each.select("page", "band", "columns", "lines", prose.alias("prose"))
