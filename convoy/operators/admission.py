"""Admission under pressure: thresholds, rejected keys that come again, and how long clients are told to wait."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.operators.ranking import Fold, Then, mark_first, prefix

#: Wait told where none is configured, and the longest (fixed values), in seconds.
DEFAULT_WAIT_S, LONGEST_WAIT_S = 5, 60


def decision(memory_mb: Column, max_memory_mb: int, db_bytes: Column, max_db_bytes: int) -> Column:
    """Struct of ``allowed, reason, limit, current``: refused when memory, or else the database, is above its limit.

    A limit of 0 is none. What is allowed has an empty reason and zeros; null measurements are below any limit.
    """
    def verdict(ok: bool, reason: str, limit: int, now: Column) -> Column:
        return F.struct(F.lit(ok).alias("allowed"), F.lit(reason).alias("reason"), F.lit(limit).cast("bigint").alias("limit"), now.cast("bigint").alias("current"))

    over = lambda c, limit: F.coalesce(c > limit, F.lit(False)) if limit > 0 else F.lit(False)
    return (
        F.when(over(memory_mb, max_memory_mb), verdict(False, "memory", max_memory_mb, memory_mb))
        .when(over(db_bytes, max_db_bytes), verdict(False, "database", max_db_bytes, db_bytes))
        .otherwise(verdict(True, "", 0, F.lit(0)))
    )


def limits_snapshot(spark, memory_mb: int, max_memory_mb: int, db_bytes: int, max_db_bytes: int, max_body: int, base_s: int) -> DataFrame:
    """The state a health report shows: one row of limits and measurements, ``enabled`` if any limit is set."""
    limited = max_memory_mb > 0 or max_db_bytes > 0
    return spark.range(1).select(
        F.lit(limited).alias("enabled"), F.lit(memory_mb).alias("memory_mb"), F.lit(max_memory_mb).alias("max_memory_mb"), F.lit(db_bytes).alias("db_bytes"),
        F.lit(max_db_bytes).alias("max_db_bytes"), F.lit(max_body).alias("max_body_bytes"), F.lit(base_s).alias("retry_after_s"),
    )


def outcome(requests: DataFrame, key: str, order: Sequence[str], allowed: Column) -> DataFrame:
    """Adds ``outcome`` (accepted, duplicate, rejected) and ``accepted_seq``, the accepted request of the key, if any.

    A rejected first request leaves its key free, so the first allowed one of a key is accepted; what came before was
    rejected, what comes after is a duplicate, pressure or not.
    """
    marked = mark_first(requests, [key], order, F.coalesce(allowed, F.lit(False)))
    at = F.struct(*order)
    what = F.when(at == F.col("first"), "accepted").when(at > F.col("first"), "duplicate").otherwise("rejected")
    return marked.withColumns({"outcome": what, "accepted_seq": F.col("first")[order[-1]]}).drop("first")


def wait_seconds(streak: Column, base_s: int) -> Column:
    """Seconds told at the ``streak``-th rejection in a row: the base (5 if not positive), doubled each time, at most 60
    from the second on."""
    base = base_s if base_s > 0 else DEFAULT_WAIT_S
    doubled = F.least(F.lit(LONGEST_WAIT_S), F.lit(base) * F.pow(F.lit(2), F.least(streak - 1, F.lit(30))))
    return F.when(streak <= 1, F.lit(base)).otherwise(doubled.cast("int")).cast("int")


def retry_after(checked: DataFrame, order: Sequence[str], rejected: Column, base_s: int, block: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rejections with ``streak`` (how many in a row, since the last that was allowed) and ``retry_after_s``.

    The rows are those that reached the check, so duplicates are left out beforehand. The streak is the difference of two
    running counts: rejections so far, less those up to the last allowed row. Without ``by`` it is one sequence.
    """
    keyed = checked if by else checked.withColumn("_all", F.lit(0))
    keys = [*by] or ["_all"]
    # The count so far never falls, so what the last allowed row had is the largest any allowed one had.
    based = prefix(
        keyed, keys, order, block, {"_n": Fold("sum", F.when(rejected, 1).otherwise(0).cast("bigint"))}, {"_at": Then("max", F.when(~rejected, F.col("_n")), F.col("_n"))}
    )
    out = based.where(rejected).withColumn("streak", F.col("_n") - F.coalesce("_at", F.lit(0)))
    return out.withColumn("retry_after_s", wait_seconds(F.col("streak"), base_s)).drop("_n", "_at", "_all")


def oversized(requests: DataFrame, body: str, limit: int) -> DataFrame:
    """Requests whose body has more than ``limit`` bytes, with ``body_bytes`` and ``limit_bytes``."""
    return requests.withColumns({"body_bytes": F.octet_length(body).cast("bigint"), "limit_bytes": F.lit(limit).cast("bigint")}).where(F.col("body_bytes") > limit)
