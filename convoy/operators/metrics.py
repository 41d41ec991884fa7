"""Operational measures over outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.operators.ranking import Fold, blocks_of, prefix


def latency(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``n``, minimum, mean, exact percentiles ``p50`` ... (interpolated) and maximum of ``value``; nulls do not count.

    Exact percentiles combine on the map side as counts per distinct value.
    """
    aggs = [F.count(value).alias("n"), F.min(value).alias("min"), F.round(F.avg(value), 6).alias("mean")]
    aggs += [F.round(F.percentile(value, p), 6).alias(f"p{int(p * 100)}") for p in points]
    return df.groupBy(*by).agg(*aggs, F.max(value).alias("max"))


def counts_by(df: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """Rows per group, and rows per named condition."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def depth_series(schedule: DataFrame, queue: str, arrived: str, dispatched: str, tie: str, block_length: int) -> DataFrame:
    """The depth of each queue after each arrival (+1) and dispatch (-1), one row per event: ``queue, at_us, <tie>, change, depth``.

    At the same instant arrivals come first, then ``tie`` decides.
    """
    events = F.explode(F.array(F.struct(F.col(arrived).alias("at_us"), F.lit(1).alias("change")), F.struct(F.col(dispatched).alias("at_us"), F.lit(-1).alias("change"))))
    both = schedule.select(queue, tie, events.alias("e")).select(queue, "e.at_us", tie, "e.change", (-F.col("e.change")).alias("_down"))
    return prefix(both, [queue], ["at_us", "_down", tie], blocks_of("at_us", block_length), {"depth": Fold("sum", F.col("change").cast("bigint"))}).drop("_down")


def changes(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], block: Column) -> DataFrame:
    """Rows whose ``value`` differs from the last of their group; the first one counts as a change. Nulls are passed over."""
    before = prefix(df.where(F.col(value).isNotNull()), by, order, block, {"_last": Fold("last", F.col(value), before=True)})
    return before.where(F.col("_last").isNull() | (F.col("_last") != F.col(value))).drop("_last")


def approx_distinct(df: DataFrame, by: Sequence[str], value: str, rsd: float = 0.02) -> DataFrame:
    return df.groupBy(*by).agg(F.approx_count_distinct(value, rsd).alias("approx_n"))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], left_tie: str, block: Column) -> DataFrame:
    """``left`` with the last ``values`` of ``right`` at or before each row's time; at the same time right comes first.

    Both sides are one sequence per key, and the last values are carried along it by blocks.
    """
    marks = right.select(*by, at, *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (*by, at)], F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    rows = left.withColumns({"_v": F.lit(None).cast(dict(marks.dtypes)["_v"]), "_side": F.lit(1)})
    carried = prefix(rows.unionByName(marks), by, [at, "_side", left_tie], block, {"_as": Fold("last", F.col("_v"))})
    return carried.where("_side = 1").select(*left.columns, *[F.col("_as")[v].alias(v) for v in values])
