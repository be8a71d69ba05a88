"""Ranks that no single task has to count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.plans.scratch import stored


def positions(df: DataFrame, group: str, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with its row's place (from 0) inside ``group`` by ``order``.

    A group may be any share of the table: rows are dealt by ranges of (group, order), numbered where
    they lie, and the number of earlier rows of the group in earlier ranges is added. The sorted
    table is stored, so that both uses of it see the same ranges.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = [k.alias(f"_pos_k{i}") for i, k in enumerate(keys)]
    sort = [group, *(f"_pos_k{i}" for i in range(len(keys)))]
    laid = stored(df.select("*", *named).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_pos_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_pos_at", 33)
    spans = laid.groupBy(F.col(group).alias("_pos_group"), part.alias("_pos_part")).agg(F.min("_pos_at").alias("_pos_first"), F.count(F.lit(1)).alias("_pos_n"))
    earlier = F.sum("_pos_n").over(Window.partitionBy("_pos_group").orderBy("_pos_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("_pos_group", "_pos_part", (F.coalesce(earlier, F.lit(0)) - F.col("_pos_first")).alias("_pos_shift"))
    joined = laid.withColumn("_pos_own", part).join(spans, F.col(group).eqNullSafe(F.col("_pos_group")) & (F.col("_pos_own") == F.col("_pos_part")))
    return joined.select(*df.columns, (F.col("_pos_at") + F.col("_pos_shift")).alias(name))


def with_previous(df: DataFrame, group: str, order: Sequence[Column | str], columns: Sequence[str], name: str = "pos") -> DataFrame:
    """``df`` with its place in ``group`` and, as previous_<column>, what the row before holds there: an equi join
    on (group, place), so that a group may be any share of the table."""
    laid = positions(df, group, order, name)
    before = laid.select(F.col(group).alias("_before_group"), (F.col(name) + 1).alias("_before_at"), *[F.col(c).alias(f"previous_{c}") for c in columns])
    return laid.join(before, F.col(group).eqNullSafe(F.col("_before_group")) & (F.col(name) == F.col("_before_at")), "left").drop("_before_group", "_before_at")


def running_sum(df: DataFrame, group: str, at: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` over its ``group`` up to place ``at``: inside blocks of places, then over
    the blocks' sums."""
    cut = df.withColumn("_block", F.expr(f"`{at}` div {block}"))
    sums = cut.groupBy(F.col(group).alias("_sum_group"), F.col("_block").alias("_sum_block")).agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("_sum_group").orderBy("_sum_block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_sum_group", "_sum_block", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    inside = F.sum(value).over(Window.partitionBy(group, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    joined = cut.withColumn("_inside", inside).join(sums, F.col(group).eqNullSafe(F.col("_sum_group")) & (F.col("_block") == F.col("_sum_block")))
    return joined.withColumn(name, F.col("_inside") + F.col("_earlier")).drop("_block", "_inside", "_earlier", "_sum_group", "_sum_block")


def top_k(df: DataFrame, k: int, by: Sequence[Column], per: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """The first k rows by ``by`` (of each ``per``), with their rank from 1.

    Spark cuts each task's rows to k before the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy(*per).orderBy(*by) if per else Window.partitionBy(F.lit(1)).orderBy(*by)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def firsts(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key: the first by ``order`` (D1). A partial aggregation, so hot keys combine early."""
    order_columns = [F.col(o) if isinstance(o, str) else o for o in order]
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order_columns)).alias("_row")).select("_row.*")
