"""Per-key results where a few keys hold most records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.functions.columns import text
from convoy.operators.ranking import rank_in_blocks


def key_states(df: DataFrame, fields: Sequence[str], at_ms: str = "at_ms") -> DataFrame:
    """One row per field and value: ``field_name, key_value, n_rows, first_ms, last_ms``.

    Null and empty values are no keys; a null time counts as a row but not as first or last. The aggregates are
    algebraic, so each map task folds its rows into one state per key (in a hash table that spills) and only those
    states are shuffled: a hot key arrives as one row per task.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), text(f).alias("key_value")) for f in fields]))
    return (
        df.select(pairs.alias("p"), F.col(at_ms).alias("t"))
        .select("p.*", "t")
        .where("key_value is not null")
        .groupBy("field_name", "key_value")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("first_ms"), F.max("t").alias("last_ms"))
    )


def heavy_keys(df: DataFrame, fields: Sequence[str], share_percent: int = 5, at_ms: str = "at_ms") -> DataFrame:
    """The states of the keys that hold at least ``share_percent`` of all rows of ``df``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return key_states(df, fields, at_ms).where(F.col("n_rows") * 100 >= total * share_percent)


def waiting_order(jobs: DataFrame, key: str = "queue_key", at_ms: str = "at_ms", job_id: str = "id", block_ms: int = 3_600_000) -> DataFrame:
    """Adds ``position``, the place in its queue by (time, id), from 1. Jobs with a null or empty key wait nowhere."""
    return rank_in_blocks(
        jobs.where(text(key).isNotNull()), [key], [at_ms, job_id], F.floor(F.col(at_ms) / F.lit(block_ms))
    )
