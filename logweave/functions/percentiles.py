"""The four percentile definitions in use. They differ; each has its own name and they are never mixed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(column: str, p: float) -> Column:
    """The value at place ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def linear(column: str, p: float) -> Column:
    """Interpolated between the neighbouring places."""
    return F.expr(f"percentile_cont({p}) within group (order by {column})")


def floor_index(p: float) -> Callable[[Column], Column]:
    """The index min(n - 1, floor(p * n)) of the sorted values."""
    return lambda n: F.least(F.floor(F.lit(p) * n), n - 1)


def upper_median(n: Column) -> Column:
    """The index n div 2 of the sorted values."""
    return F.floor(n / 2)


def at_index(rows: DataFrame, value: str, *by: str, **index: Callable[[Column], Column]) -> DataFrame:
    """(by..., a column for each index): the value at that index of its group's sorted values.

    Equal values are counted first, then their counts are summed by ranges, so no task holds a group's values.
    """
    from logweave.operators.ordering import prefix_sums

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c")).withColumn("_range", F.floor(F.col(value) / 1024).cast("long"))
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    sums = prefix_sums(counts, "_range", [value], {"_before": "_c"}, by).join(sizes, list(by))
    here = lambda at: F.max(F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_c")), F.col(value)))
    return sums.groupBy(*by).agg(*(here(at(F.col("_n"))).alias(name) for name, at in index.items()))
