"""Interval and box joins as equi-joins on cells: no nested loop, no group without a bound on what meets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: Distinct points, and boxes, of one key that meet in one task.
POINTS, BOXES = 200_000, 200_000


def cells(low: Column, high: Column, size: int) -> Column:
    """Numbers of the cells that a half-open interval touches; an empty one touches none."""
    first, last = F.floor(low / size), F.floor((high - 1) / size)
    return F.when(high > low, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], size: int = 512) -> DataFrame:
    """Rows of left and right with equal `on` whose half-open intervals a and b overlap, each pair once.

    Both sides are dealt to cells of `size`; a pair meets in every cell both touch and is kept in the first of them, so
    nothing is made distinct afterwards. Columns besides `on` must have different names.
    """
    lo = left.withColumn("__cell", F.explode(cells(F.col(a[0]), F.col(a[1]), size)))
    hi = right.withColumn("__cell", F.explode(cells(F.col(b[0]), F.col(b[1]), size)))
    meet = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / size) == F.col("__cell")
    hit = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    return lo.join(hi, [*on, "__cell"]).where(hit & meet).drop("__cell")


def points_in_boxes(points: DataFrame, boxes: DataFrame, on: list[str], x: str, y: str, box: tuple[str, str, str, str], size: int = 64) -> DataFrame:
    """Rows of points and boxes with equal `on` where a point lies in a closed box (x0, y0, x1, y1).

    A box is dealt to every grid cell that it touches and a point to its own, so a pair meets once; a large box is many
    rows in many cells rather than one in a hot one. Boxes turned round hold nothing; nulls meet nothing.
    """
    x0, y0, x1, y1 = box
    cell = lambda c: F.floor(F.col(c) / size).cast("bigint")
    across = F.when(F.col(x1) >= F.col(x0), F.sequence(cell(x0), cell(x1))).otherwise(F.array().cast("array<bigint>"))
    down = F.when(F.col(y1) >= F.col(y0), F.sequence(cell(y0), cell(y1))).otherwise(F.array().cast("array<bigint>"))
    dealt = boxes.withColumn("__cx", F.explode(across)).withColumn("__cy", F.explode(down))
    own = points.withColumn("__cx", cell(x)).withColumn("__cy", cell(y))
    inside = F.col(x).between(F.col(x0), F.col(x1)) & F.col(y).between(F.col(y0), F.col(y1))
    return own.join(dealt, [*on, "__cx", "__cy"]).where(inside).drop("__cx", "__cy")


def count_points_in_boxes(points: DataFrame, boxes: DataFrame, on: list[str], x: str, y: str, box: tuple[str, str, str, str], ident: str) -> DataFrame:
    """ident, n: how many points with equal `on` lie in each closed box; boxes without any are left out.

    No pair is made: points of equal place become one with a weight, and a task counts its boxes over its points by ranks, so
    the work is that of sorting. A key of many points or boxes is dealt to a grid of tasks, over which counts are summed.
    """
    x0, y0, x1, y1 = box
    lone = F.greatest(F.ceil(F.count("*") / F.lit(POINTS)), F.lit(1)).cast("int")
    placed = points.select(*on, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL").groupBy(*on, "x", "y").agg(F.count("*").alias("w"))
    asked = boxes.select(*on, F.col(ident).cast("bigint").alias("b"), *[F.col(c).cast("double").alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))]).where("x1 >= x0 AND y1 >= y0")
    # as many parts as the raw points could need, counted where they are read; equal places only make parts smaller
    grid = points.groupBy(*on).agg(lone.alias("rows")).join(boxes.groupBy(*on).agg(F.greatest(F.ceil(F.count("*") / F.lit(BOXES)), F.lit(1)).cast("int").alias("columns")), on)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_points = placed.join(grid, on).withColumn("row", F.pmod(F.xxhash64("x", "y"), F.col("rows")).cast("int")).withColumn("column", every("columns"))
    dealt_boxes = asked.join(grid, on).withColumn("column", F.pmod(F.xxhash64("b", "x0", "y0"), F.col("columns")).cast("int")).withColumn("row", every("rows"))
    schema = StructType([StructField("b", LongType()), StructField("n", LongType())])
    arrow = to_arrow_schema(schema)

    def count(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return arrow.empty_table()
        of = lambda t, *names: [t.column(n).to_numpy() for n in names]
        n = weights_in_boxes(*of(p, "x", "y", "w"), *of(q, "x0", "y0", "x1", "y1"))
        return pa.table([pa.array(of(q, "b")[0][n > 0]), pa.array(n[n > 0])], schema=arrow)

    key = [*on, "row", "column"]
    counted = dealt_points.select(*key, "x", "y", "w").groupBy(*key).cogroup(dealt_boxes.select(*key, "b", "x0", "y0", "x1", "y1").groupBy(*key)).applyInArrow(count, schema)
    return counted.groupBy(F.col("b").alias(ident)).agg(F.sum("n").alias("n"))


def weights_in_boxes(x, y, w, x0, y0, x1, y1) -> np.ndarray:
    """The weight of the points in each closed box: ranks of y in the order of x, split bit by bit; every box follows its range of places."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    levels = np.unique(y)
    rank = np.searchsorted(levels, y)
    first, last = np.searchsorted(x, x0, "left"), np.searchsorted(x, x1, "right")
    bits = max(1, int(len(levels)).bit_length())

    splits, at, weight = [], rank, w
    for bit in range(bits - 1, -1, -1):
        one = (at >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        place = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        at, weight = at[place], weight[place]
        splits.append((bit, zeros, np.concatenate([[0], np.cumsum(weight)])))

    def below(bound: np.ndarray) -> np.ndarray:
        """Weight between first and last of ranks under the bound."""
        total, a, b = np.zeros(len(bound), dtype=np.int64), first, last
        for bit, zeros, upto in splits:
            high = (bound >> bit) & 1 == 1
            za, zb = zeros[a], zeros[b]
            total += np.where(high, upto[zb] - upto[za], 0)
            a, b = np.where(high, zeros[-1] + a - za, za), np.where(high, zeros[-1] + b - zb, zb)
        return total

    return below(np.searchsorted(levels, y1, "right")) - below(np.searchsorted(levels, y0, "left"))
