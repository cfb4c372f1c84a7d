"""Exact order statistics per group, from counted values instead of a buffer per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.operators.scan import scan

#: Values of one block differ by about one part in STEPS.
STEPS = 64


def value_block(value: Column) -> Column:
    """A block number that never falls as the value grows, narrow near 0 and wide far off."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * STEPS).cast("long")


def medians(df: DataFrame, key: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """The exact median of each expression per key, null where it has no values.

    Equal values are counted, the counts summed over blocks of values, and the one or
    two values in the middle picked; no task holds the values of a key.
    """
    key = list(key)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), e.cast("double").alias("_value")) for n, e in values.items()]))
    rows = df.select(*key, each.alias("_e")).select(*key, "_e.*").filter("_value IS NOT NULL")
    counted = rows.groupBy(*key, "_name", "_value").agg(F.count(F.lit(1)).alias("_n"))
    sums = scan(counted, [*key, "_name"], ["_value"], value_block(F.col("_value")), total={"_upto": F.col("_n")})
    sizes = counted.groupBy(*key, "_name").agg(F.sum("_n").alias("_all"))
    placed = sums.join(sizes, [*key, "_name"])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto")), F.col("_value")))

    middle = placed.groupBy(*key, "_name").agg(((at(F.expr("(_all + 1) div 2")) + at(F.expr("_all div 2 + 1"))) / 2).alias("_median"))
    found = middle.groupBy(*key).agg(*[F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(n) for n in values])
    return df.select(*key).distinct().join(found, key, "left")
