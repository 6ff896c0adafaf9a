"""Running sums and neighbours in order within a unit of any size: a unit is cut into blocks by its order, so none is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the order in a block.
BLOCK = 1 << 16


def block_of(order: Column, block: int | None = None) -> Column:
    return F.floor(order / F.lit(block or BLOCK)).cast("long")


def carried(sums: DataFrame, keys: list[str], column: str, how=F.sum) -> DataFrame:
    """sums (keys, _block, column: one row a block) with `how` of the column over the blocks before."""
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(column, how(column).over(earlier))


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str) -> DataFrame:
    """df with the sum of value over its unit (keys) up to each row in order (a whole number); rows of equal order in any order.

    Within blocks first, then over the blocks' sums; null keys are a unit of their own.
    """
    blocked = df.withColumn("_block", block_of(F.col(order))).withColumn("_value", value)
    upto = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("_local", F.sum("_value").over(upto))
    sums = carried(blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_before")), keys, "_before")
    named = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_before")
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(named, same, "left")
    return joined.withColumn(out, F.coalesce(F.col("_local"), F.lit(0)) + F.coalesce(F.col("_before"), F.lit(0))).drop("_block", "_value", "_local", "_b", "_before", *[f"_k{i}" for i in range(len(keys))])


def with_neighbours(df: DataFrame, order: str, reach: int, block: int | None = None) -> DataFrame:
    """df with _block and _own: each row in its block (_own), and also in the next ones if it lies within `reach` of their ends, so
    a window over a block sees all neighbours; keep the rows with _own afterwards."""
    n = F.col(order)
    both = F.array_distinct(F.array(block_of(n - reach, block), block_of(n, block), block_of(n + reach, block)))
    return df.withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == block_of(n, block))


def previous(df: DataFrame, keys: list[str], order: str, column: str, out: str) -> DataFrame:
    """df with the value that column has in the row before, in order within the unit (keys); null in its first row.

    Within blocks first; the first row of a block takes the last value of the block before that has rows.
    """
    blocked = df.withColumn("_block", block_of(F.col(order)))
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    local = blocked.withColumn("_lag", F.lag(column).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    last = carried(blocked.groupBy(*keys, "_block").agg(F.max_by(F.struct(column), order).alias("_last")), keys, "_last", lambda c: F.last(c))
    named = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_last")
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(named, same & F.col("_first"), "left")
    value = F.when(F.col("_first"), F.col("_last")[column]).otherwise(F.col("_lag"))
    return joined.withColumn(out, value).drop("_block", "_lag", "_first", "_last", "_b", *[f"_k{i}" for i in range(len(keys))])
