"""The relation of stored jobs: de-duplication on entry, reads that honour expiry, and the periodic sweep.

``now`` is always a parameter (epoch milliseconds). A job is visible while ``expires_at > now`` and deleted once
``expires_at < now``; at equality it is neither.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.operators.ranking import mark_first

#: How long a job is kept after its status changed, in ms, and when one in flight counts as stale (fixed values).
TTL_MS = {"completed": 30 * 60_000, "failed": 2 * 3_600_000}
OTHER_TTL_MS, STALE_MS = 24 * 3_600_000, 5 * 60_000


def idempotency_hash(user: str | Column, key: str | Column) -> Column:
    """Hex SHA-256 of ``user:key``."""
    cast = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.sha2(F.concat_ws(":", F.coalesce(cast(user), F.lit("")), F.coalesce(cast(key), F.lit(""))), 256)


def check_or_insert(requests: DataFrame, hash_col: str, order: Sequence[str], history: DataFrame | None = None) -> DataFrame:
    """Requests with ``first_seq`` (the last column of ``order`` of the first request with the hash) and ``duplicate``.

    With ``history`` (columns ``hash_col`` and ``first_seq``, one row per hash), hashes known there are duplicates of
    what they name. Expiry plays no part: a key blocks until its row is deleted.
    """
    marked = mark_first(requests, [hash_col], order)
    out = marked.withColumns({"first_seq": F.col("first")[order[-1]], "duplicate": F.struct(*order) > F.col("first")}).drop("first")
    if history is None:
        return out
    known = history.select(F.col(hash_col).alias("_h"), F.col("first_seq").alias("_s"))
    joined = out.join(known, F.col(hash_col) == F.col("_h"), "left")
    return joined.withColumns({"duplicate": F.col("duplicate") | F.col("_s").isNotNull(), "first_seq": F.coalesce("_s", "first_seq")}).drop("_h", "_s")


def duplicate_report(deduplicated: DataFrame, by: Sequence[str]) -> DataFrame:
    return deduplicated.groupBy(*by).agg(F.count(F.lit(1)).alias("n_requests"), F.count_if("duplicate").alias("n_duplicates"))


def latest(exports: DataFrame, key: str, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The last row of each key by ``order``, which should be total: ``key``, ``order`` and ``columns`` (all others if None).

    An aggregate, so copies combine before the shuffle; only the columns named are read, sorted and shuffled."""
    rest = [c for c in (exports.columns if columns is None else columns) if c not in (key, *order)]
    return exports.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_l")).select(key, "_l.*")


def visible(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.where(F.col("expires_at") > now)


def lookup(jobs: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """The visible jobs whose ``id`` is among ``ids`` (column ``id``)."""
    return visible(jobs, now).join(ids.select("id").distinct(), "id", "left_semi")


def queued(jobs: DataFrame, now: int) -> DataFrame:
    return visible(jobs, now).where("status = 'queued'")


def counts(jobs: DataFrame, now: int) -> DataFrame:
    """``total`` (queued or in flight) and ``depth`` (queued) of the visible jobs; one row even if there are none."""
    live = visible(jobs, now)
    return live.agg(F.count_if(F.col("status").isin("queued", "in_flight")).alias("total"), F.count_if(F.col("status") == "queued").alias("depth"))


def expiry_after(status: Column, at_ms: Column) -> Column:
    """When a job expires whose status changed at ``at_ms``."""
    ttl = F.when(status == "completed", TTL_MS["completed"]).when(status == "failed", TTL_MS["failed"]).otherwise(OTHER_TTL_MS)
    return at_ms + ttl.cast("bigint")


def recover_in_flight(jobs: DataFrame, queue_key: str, now: int) -> DataFrame:
    """The next state of the jobs of one queue: ``returned`` marks those handed back, visible ones in flight.

    All in flight become queued, also expired ones, as the default backend does it.
    """
    flying = F.col("status") == "in_flight"
    return jobs.where(F.col("queue_key") == queue_key).withColumns(
        {"returned": F.coalesce(flying, F.lit(False)) & (F.col("expires_at") > now), "status": F.when(flying, "queued").otherwise(F.col("status"))}
    )


def sweep(jobs: DataFrame, now: int) -> DataFrame:
    """The next snapshot: expired jobs deleted, those in flight since over five minutes after creation queued again."""
    stale = (F.col("status") == "in_flight") & (F.col("created_ms") < now - STALE_MS)
    return jobs.where(F.col("expires_at") >= now).withColumn("status", F.when(stale, "queued").otherwise(F.col("status")))


def delete(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs without those whose ``id`` is among ``ids``; the key of a deleted job is free again."""
    return jobs.join(ids.select("id").distinct(), "id", "left_anti")
