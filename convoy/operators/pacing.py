"""Dispatch in order of arrival under rate and concurrency limits, and the feedback that moves them.

Times are integer microseconds. Waiting never adds jitter, so schedules are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.operators.ranking import Fold, Then, prefix

#: Lowest rate, and growth of the rate per completion without a header (fixed values).
MIN_RPS, GROWTH = 0.5, 1.05


def queue_position(jobs: DataFrame, queue: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Adds ``position``, from 1, in order of arrival."""
    return prefix(jobs, queue, order, block, {"position": Fold("count")})


def paced(jobs: DataFrame, queue: Sequence[str], arrived: str, order: Sequence[str], interval: int, block: Column) -> DataFrame:
    """Adds ``dispatch_us`` and ``wait_us``: each job at its arrival or one interval after the one before, if later.

    With ``n`` the number of earlier jobs: ``interval * n + max over jobs so far of (arrival - interval * n)``.
    """
    interval = F.lit(interval)
    slack = prefix(jobs, queue, order, block, {"_n": Fold("count", before=True)}, {"_m": Then("max", F.col(arrived) - interval * F.col("_n"), -interval * F.col("_n"))})
    out = slack.withColumn("dispatch_us", (interval * F.col("_n") + F.col("_m")).cast("bigint"))
    return out.withColumn("wait_us", F.col("dispatch_us") - F.col(arrived)).drop("_n", "_m")


def paced_serial(jobs: DataFrame, queue: Sequence[str], arrived: str, service: str, order: Sequence[str], interval: int, block: Column) -> DataFrame:
    """Likewise with one job at a time: the next starts no earlier than the interval and the service time of the last.

    ``C + max over jobs so far of (arrival - C)``, where ``C`` sums ``greatest(interval, service)`` of earlier jobs.
    """
    step = F.greatest(F.lit(interval), F.coalesce(F.col(service), F.lit(0)))
    slack = prefix(jobs, queue, order, block, {"_c": Fold("sum", step, before=True)}, {"_m": Then("max", F.col(arrived) - F.col("_c"), -F.col("_c"))})
    out = slack.withColumn("dispatch_us", (F.col("_c") + F.col("_m")).cast("bigint"))
    return out.withColumn("wait_us", F.col("dispatch_us") - F.col(arrived)).drop("_c", "_m")


def multi_schedule(arrived: Sequence[int], service: Sequence[int], interval: int, slots: int) -> list[int]:
    """Dispatch times with ``slots`` jobs at a time: a heap of the times at which slots come free."""
    free, out, last = [0] * slots, [], None
    for a, s in zip(arrived, service, strict=True):
        t = max(a, free[0]) if last is None else max(a, free[0], last + interval)
        heapq.heapreplace(free, t + s)
        out.append(t)
        last = t
    return out


def paced_multi(jobs: DataFrame, queue: Sequence[str], arrived: str, service: str, order: Sequence[str], interval: int, slots: int) -> DataFrame:
    """Likewise with ``slots`` at a time: ``dispatch_us`` per job.

    Which slot comes free first depends on all jobs before, and no window states it, so each queue is one task's group.
    Only the columns needed go there. A queue is one upstream's or tenant's, served one job after the other in reality
    too; one beyond a task's memory must use :func:`paced` or :func:`paced_serial`.
    """
    kinds = dict(jobs.dtypes)
    cols = list(dict.fromkeys([*queue, *order, arrived, service]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        pdf["dispatch_us"] = multi_schedule(pdf[arrived].tolist(), pdf[service].fillna(0).astype("int64").tolist(), interval, slots)
        return pdf

    return jobs.select(*cols).groupBy(*queue).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", dispatch_us bigint")


def after_first_member(jobs: DataFrame, pool: str, arrived: str, members: DataFrame) -> DataFrame:
    """Adds ``ready_us``: a pool's jobs wait for its first member (``members``: pool and ``first_us``); null if none comes."""
    firsts = members.groupBy(pool).agg(F.min("first_us").alias("_f"))
    return jobs.join(firsts, pool, "left").withColumn("ready_us", F.when(F.col("_f").isNotNull(), F.greatest(arrived, "_f"))).drop("_f")


def rate_trajectory(events: DataFrame, queue: Sequence[str], order: Sequence[str], header: str, configured: float, block: Column) -> DataFrame:
    """Adds ``rps`` after each completion, rounded to 6 digits.

    A header sets the rate, clamped to [0.5, configured]; without one it grows by 5 % up to the configured rate. From the
    last header's rate and the number of events since: ``least(configured, base * 1.05 ** since)``.
    """
    clamped = F.when(F.col(header).isNotNull(), F.least(F.lit(configured), F.greatest(F.lit(MIN_RPS), F.col(header))))
    # Numbers rise, so the last header's number is the largest.
    based = prefix(events, queue, order, block, {"_n": Fold("count"), "_base": Fold("last", clamped)}, {"_at": Then("max", F.when(clamped.isNotNull(), F.col("_n")), F.col("_n"))})
    since = F.least(F.col("_n") - F.coalesce("_at", F.lit(0)), F.lit(4000))  # keeps the power finite; capped long before
    rate = F.least(F.lit(configured), F.coalesce("_base", F.lit(configured)) * F.pow(F.lit(GROWTH), since))
    return based.withColumn("rps", F.round(rate, 6)).drop("_n", "_base", "_at")


def concurrency_trajectory(events: DataFrame, queue: Sequence[str], order: Sequence[str], header: str, configured: int, block: Column) -> DataFrame:
    """Adds ``max_concurrent`` after each completion: the last positive header, at most the configured number."""
    said = prefix(events, queue, order, block, {"_h": Fold("last", F.when(F.col(header) > 0, F.col(header)))})
    return said.withColumn("max_concurrent", F.coalesce(F.least(F.col("_h"), F.lit(configured)), F.lit(configured)).cast("int")).drop("_h")


def first_header(*names: str) -> Column:
    """Of several spellings of a header, the first that is not empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def rate_header(c: Column) -> Column:
    """A rate header as a number; text that is none reads as 0, which later clamps to the lowest rate."""
    return F.when(c.isNotNull(), F.coalesce(c.try_cast("double"), F.lit(0.0)))


def pool_rate(capacity: DataFrame, configured: float) -> DataFrame:
    """Adds ``rps`` to pool capacities: at most the configured default, at least 0.5; null for a pool without capacity."""
    return capacity.withColumn("rps", F.when(F.col("capacity_rps") > 0, F.greatest(F.least(F.col("capacity_rps"), F.lit(configured)), F.lit(MIN_RPS))))


def fair_share(queues: DataFrame, upstream: str, rps: str, ceiling: float | Column) -> DataFrame:
    """Adds ``share_rps``: with two or more queues whose rates exceed the upstream's ceiling, each is scaled down, to 0.5 at
    least; otherwise the rate stays. Sums are joined back, not gathered, so an upstream may have any number of queues.
    """
    ceiling = F.lit(ceiling) if isinstance(ceiling, float) else ceiling
    sums = queues.groupBy(upstream).agg(F.sum(rps).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    scaled = F.greatest(F.col(rps) * ceiling / F.col("_sum"), F.lit(MIN_RPS))
    return queues.join(sums, upstream).withColumn("share_rps", F.when((F.col("_n") >= 2) & (F.col("_sum") > ceiling), scaled).otherwise(F.col(rps))).drop("_sum", "_n")
