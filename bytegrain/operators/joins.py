"""Joins that Spark has no operator for, made of those that it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, columns: list[str], span: int) -> DataFrame:
    """The rows of left, each with `columns` of the row of right that has the same `by` and the latest `time` before its own (null where there is none).

    `time` is a number of the same scale in both. Rows meet within spans of time, and what a span needs of those before it is one row for each
    `by` and span; so one key's rows are spread over as many tasks as it has spans. Of rows of right with equal times the largest counts.
    """
    last, at = F.struct(time, *columns), F.floor(F.col(time) / span)
    marked = left.withColumns({"_right": F.lit(False), "_last": F.lit(None).cast(right.select(last.alias("x")).schema["x"].dataType)})
    other = right.select(by, time, F.lit(True).alias("_right"), last.alias("_last"))
    both = marked.unionByName(other, allowMissingColumns=True).withColumn("_span", at)
    inside = Window.partitionBy(by, "_span").orderBy(time, "_right", "_last").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_here", F.last("_last", ignorenulls=True).over(inside)).filter("not _right")
    spans = right.select(by, at.alias("_span"), last.alias("_last")).groupBy(by, "_span").agg(F.max("_last").alias("_own"))
    wanted = found.filter("_here is null").select(by, "_span").distinct().join(spans, [by, "_span"], "full")
    before = wanted.withColumn("_before", F.last("_own", ignorenulls=True).over(Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))).select(by, "_span", "_before")
    joined = found.join(before, [by, "_span"], "left").withColumn("_found", F.coalesce("_here", "_before"))
    return joined.select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in columns))


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """All pairs of a row of points and one of intervals with low <= point < high, as an equi-join on cells of `width`: an interval is in all
    cells that it meets, so width should be about an interval's length."""
    cells = intervals.filter(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col(point) / width)).join(cells, "_cell").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")
