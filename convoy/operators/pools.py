"""Pools of workers: weights, selection, reputation and eviction.

Outcomes and heartbeats of a member are one sequence of events (``kind``: success, failure or heartbeat) in total order.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.operators.ranking import Fold, Then, prefix
from convoy.sources.tables import scratch

#: Factors on reputation, the floor and how long a member may stay at it, missed beats that evict, lowest weight (fixed values).
FAILURE, SUCCESS, HEARTBEAT = 0.5, 1.5, 1.1
FLOOR, FLOOR_US, MISSED, MIN_WEIGHT = 0.05, 12_000_000, 3, 0.001


def weight(declared: str | Column, reputation: str | Column) -> Column:
    w = (F.col(declared) if isinstance(declared, str) else declared) * (F.col(reputation) if isinstance(reputation, str) else reputation)
    return F.when(w > 0, w).otherwise(MIN_WEIGHT)


def capacity(members: DataFrame, pool: str, declared: str, reputation: str) -> DataFrame:
    """``capacity_rps`` (sum of weights) and ``members`` of each pool."""
    return members.groupBy(pool).agg(F.sum(weight(declared, reputation)).alias("capacity_rps"), F.count(F.lit(1)).alias("members"))


def reputation(events: DataFrame, member: Sequence[str], order: Sequence[str], block: Column, kind: str = "kind") -> DataFrame:
    """Adds ``reputation`` after each event: from 1, halved by a failure, times 1.5 by a success, 1.1 by a heartbeat, at most 1.

    A walk of logarithms reflected at 0: with ``S`` the sum so far, ``exp(S - max(0, largest S so far))``. ``S`` is made of
    three running counts, so it does not depend on how sums are split.
    """
    is_ = lambda k: F.when(F.col(kind) == k, 1).otherwise(0).cast("bigint")
    walk = F.col("_f") * F.log(F.lit(FAILURE)) + F.col("_s") * F.log(F.lit(SUCCESS)) + F.col("_h") * F.log(F.lit(HEARTBEAT))
    counts = {f"_{k[0]}": Fold("sum", is_(k)) for k in ("failure", "success", "heartbeat")}
    topped = prefix(events, member, order, block, counts, {"_m": Then("max", walk, walk)})
    return topped.withColumn("reputation", F.exp(walk - F.greatest(F.lit(0.0), F.col("_m")))).drop("_f", "_s", "_h", "_m")


def final_reputation(events: DataFrame, member: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """The reputation after each member's last event, and ``n_events``."""
    walked = reputation(events, member, order, block)
    return walked.groupBy(*member).agg(F.max_by("reputation", F.struct(*order)).alias("reputation"), F.count(F.lit(1)).alias("n_events"))


def first_eviction(events: DataFrame, member: Sequence[str], at_us: str, order: Sequence[str], block: Column, stay_us: int = FLOOR_US) -> DataFrame:
    """Members evicted and when first: ``evicted_us``.

    A failure that leaves the reputation at or below the floor starts a timer if none runs; a later one ``stay_us`` or
    more after it evicts. A success, or a failure above the floor, clears the timer; heartbeats do not.
    """
    narrow = list(dict.fromkeys([*member, *order, at_us, "kind", "reputation"]))
    # Written once, as the fold below reads it twice.
    path = scratch(events.sparkSession, "walked")
    low = (F.col("kind") == "failure") & (F.col("reputation") <= FLOOR)
    reputation(events, member, order, block).where("kind <> 'heartbeat'").withColumn("_low", low).select(*narrow, "_low").write.parquet(path)
    walked = events.sparkSession.read.parquet(path)
    # Between two events that clear the timer only failures at the floor lie; the first of them started it. One fold numbers
    # the stretches, and the earliest failure that lasts long enough is found by an aggregate over each.
    stretches = prefix(walked, member, order, block, {"_g": Fold("sum", F.when(F.col("_low"), 0).otherwise(1).cast("bigint"))}).where("_low")
    starts = stretches.groupBy(*member, "_g").agg(F.min(at_us).alias("_t0"), F.max(at_us).alias("_t1")).where(F.col("_t1") - F.col("_t0") >= stay_us)
    # Of a member's stretches that last long enough the earliest decides.
    first = starts.groupBy(*[F.col(m).alias(f"_m{i}") for i, m in enumerate(member)]).agg(F.min(F.struct("_t0", "_g")).alias("_s"))
    same = [F.col(m).eqNullSafe(F.col(f"_m{i}")) for i, m in enumerate(member)]
    timed = stretches.join(first, same, "inner").where((F.col("_g") == F.col("_s._g")) & (F.col(at_us) - F.col("_s._t0") >= stay_us))
    return timed.groupBy(*member).agg(F.min(at_us).alias("evicted_us"))


def evictions(kinds: Sequence[str], times: Sequence[int], stay_us: int = FLOOR_US) -> list[int]:
    """All evictions of one member by its events in order: after one, the next event registers it afresh."""
    out, rep, since = [], 1.0, None
    for kind, t in zip(kinds, times, strict=True):
        if kind == "failure":
            rep *= FAILURE
            if rep > FLOOR:
                since = None
            elif since is None:
                since = t
            elif t - since >= stay_us:
                out.append(t)
                rep, since = 1.0, None
        elif kind == "success":
            rep, since = min(1.0, rep * SUCCESS), None
        else:
            rep = min(1.0, rep * HEARTBEAT)
    return out


def all_evictions(events: DataFrame, member: Sequence[str], at_us: str, order: Sequence[str], stay_us: int = FLOOR_US) -> DataFrame:
    """Every eviction of members that register again: ``epoch`` from 1 and ``evicted_us``.

    Each epoch starts where the last ended, which no window states. Members without a first eviction by the set form can
    be left out beforehand; a member's events are one group.
    """
    kinds = dict(events.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        found = evictions(pdf["kind"].tolist(), pdf[at_us].tolist(), stay_us)
        head = {m: [pdf[m].iloc[0]] * len(found) for m in member}
        return pd.DataFrame(head | {"epoch": range(1, len(found) + 1), "evicted_us": found})

    cols = list(dict.fromkeys([*member, *order, at_us, "kind"]))
    return events.select(*cols).groupBy(*member).applyInPandas(run, ", ".join(f"{m} {kinds[m]}" for m in member) + ", epoch int, evicted_us bigint")


def round_robin(members: DataFrame, pool: str, member: str, weight_col: str, picks: int) -> DataFrame:
    """The first ``picks`` picks of each pool: ``pick`` from 1 and the member.

    Always the member with the least virtual time, which then grows by the inverse of its weight; ties go to the lower
    member id. Candidate ``k`` of a member stands at ``k / weight``; no member needs more than its share of the picks, one
    more, and one for rounding, so candidates number ``picks`` and a few per member.
    """
    w = Window.partitionBy(pool)
    shared = members.join(members.groupBy(pool).agg(F.sum(weight_col).alias("_sum")), pool)
    most = F.ceil(F.col(weight_col) * picks / F.col("_sum")).cast("int") + 1
    stand = shared.select(pool, member, weight_col, F.explode(F.sequence(F.lit(0), most)).alias("_k")).withColumn("_v", F.col("_k") / F.col(weight_col))
    ranked = stand.withColumn("pick", F.row_number().over(w.orderBy(F.round("_v", 9), member)).cast("bigint"))
    return ranked.where(F.col("pick") <= picks).select(pool, "pick", member)


def round_robin_share(members: DataFrame, pool: str, member: str, weight_col: str, picks: int) -> DataFrame:
    """Picks per member among the first ``picks`` of its pool; members never picked are left out."""
    return round_robin(members, pool, member, weight_col, picks).groupBy(pool, member).agg(F.count(F.lit(1)).alias("picks"))


def latest_members(beats: DataFrame, pool: str, member: str, at: str, tie: str) -> DataFrame:
    """Each member as its last valid heartbeat (by time, then ``tie``) left it."""
    rest = [c for c in beats.columns if c not in (pool, member, at, tie)]
    return beats.groupBy(pool, member).agg(F.max(F.struct(at, tie, *rest)).alias("_l")).select(pool, member, "_l.*")


def heartbeat_gaps(beats: DataFrame, pool: str, member: str, at_us: str, interval_us: str, tie: str) -> DataFrame:
    """Silences that evict: a gap to the next beat of more than three intervals, ``lost_us`` being the deadline.

    A member without a positive interval is exempt. The last beat of a member has no gap. A member beats at most once per
    interval, so its own beats are the window's group.
    """
    w = Window.partitionBy(pool, member).orderBy(at_us, tie)
    gaps = beats.withColumn("next_us", F.lead(at_us).over(w)).withColumn("lost_us", F.col(at_us) + MISSED * F.col(interval_us))
    return gaps.where((F.col(interval_us) > 0) & (F.col("next_us") > F.col("lost_us"))).select(pool, member, at_us, "lost_us", "next_us")


def alive(members: DataFrame, at_us: str, interval_us: str, now_us: int) -> DataFrame:
    """Members whose last beat, at or before ``now_us``, is at most three intervals old, or who have no interval."""
    return members.where((F.col(at_us) <= now_us) & ((F.col(interval_us) <= 0) | (now_us - F.col(at_us) <= MISSED * F.col(interval_us))))
