"""Queries over pools of workers."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import pools
from convoy.operators.ranking import blocks_of
from convoy.plans.views import DAY_US, NOW_MS, OUTCOME_ORDER, beats, members, outcomes, with_

#: Reputations are dyadic, and many lie half way between two roundings: 1e-9 is added before, here and in SQL.
#: Twelve seconds at the floor become twelve days, as line items have days only.
STAY_US = 12 * DAY_US
MEMBER = ["member_id"]


def _block():
    return blocks_of("at_us", 90 * DAY_US)


def reputation_trajectory(spark, sf):
    r = pools.reputation(outcomes(spark, sf), MEMBER, OUTCOME_ORDER, _block())
    return r.select(*OUTCOME_ORDER, "member_id", "kind", F.round(F.col("reputation") + 1e-9, 6).alias("reputation"))


def reputation_final(spark, sf):
    r = pools.final_reputation(outcomes(spark, sf), MEMBER, OUTCOME_ORDER, _block())
    return r.select("member_id", F.round(F.col("reputation") + 1e-9, 6).alias("reputation"), "n_events")


def _weighted(spark, sf):
    """Members with their final reputation; the reputations are few - one per member - but joined without a hint."""
    r = pools.final_reputation(outcomes(spark, sf), MEMBER, OUTCOME_ORDER, _block())
    return members(spark, sf).join(r.select("member_id", F.round(F.col("reputation") + 1e-9, 6).alias("reputation")), "member_id", "left").withColumn("reputation", F.coalesce("reputation", F.lit(1.0)))


def pool_capacity(spark, sf):
    return pools.capacity(_weighted(spark, sf), "pool_id", "declared_rps", "reputation").withColumn("capacity_rps", F.round("capacity_rps", 6))


def wrr_schedule(spark, sf):
    """The first 200 picks of each pool by declared rate."""
    return pools.round_robin(members(spark, sf), "pool_id", "member_id", "declared_rps", 200)


def wrr_share(spark, sf):
    return pools.round_robin_share(members(spark, sf), "pool_id", "member_id", "declared_rps", 2000)


def floor_eviction_first(spark, sf):
    return pools.first_eviction(outcomes(spark, sf), MEMBER, "at_us", OUTCOME_ORDER, _block(), STAY_US)


def floor_eviction_epochs(spark, sf):
    return pools.all_evictions(outcomes(spark, sf), MEMBER, "at_us", OUTCOME_ORDER, STAY_US)


def member_latest(spark, sf):
    return pools.latest_members(beats(spark, sf), "pool_id", "member_id", "at_us", "hb_id")


def heartbeat_gaps(spark, sf):
    return pools.heartbeat_gaps(beats(spark, sf), "pool_id", "member_id", "at_us", "interval_us", "hb_id")


def alive_members(spark, sf):
    seen = beats(spark, sf).where(F.col("at_us") <= NOW_MS * 1000)
    return pools.alive(pools.latest_members(seen, "pool_id", "member_id", "at_us", "hb_id"), "at_us", "interval_us", NOW_MS * 1000).select("pool_id", "member_id", "at_us")


_REPUTED = with_("walk")
_FINAL = _REPUTED + ", final as (select member_id, round(arg_max(reputation, (at_us, l_orderkey, l_linenumber, l_extendedprice)) + 1e-9, 6) as reputation, count(*) as n_events from reputed group by member_id)"
_PICKS = "with m as (select s_nationkey as pool_id, s_suppkey as member_id, s_acctbal / 100 as w from supplier where s_acctbal > 0), s as (select *, sum(w) over (partition by pool_id) as total from m), c as (select pool_id, member_id, unnest(range(0, cast(ceil(w * {n} / total) as bigint) + 2)) / w as v from s), p as (select *, row_number() over (partition by pool_id order by round(v, 9), member_id) as pick from c) "
_LATEST = "select pool_id, member_id, at_us, hb_id, address, capacity_rps, interval_us from beats {where} qualify row_number() over (partition by pool_id, member_id order by at_us desc, hb_id desc) = 1"
_CAPACITY = _FINAL + ", " + with_("members").removeprefix("with ") + ", capacity as (select pool_id, round(sum(case when declared_rps * coalesce(reputation, 1) > 0 then declared_rps * coalesce(reputation, 1) else 0.001 end), 6) as capacity_rps, count(*) as members from members left join final using (member_id) group by pool_id)"

#: One event after the other: reputation, when the timer started, how many evictions so far, and whether this one is another.
_EPOCHS = with_("outcomes").replace("with ", "with recursive ", 1) + f""", i as (select member_id, at_us, kind, row_number() over (partition by member_id order by at_us, l_orderkey, l_linenumber, l_extendedprice) as i from outcomes),
    w as (select member_id, 0::bigint as i, 1.0::double as rep, null::bigint as since, 0 as epoch, false as gone, 0::bigint as at_us from (select distinct member_id from outcomes)
        union all select member_id, i, case when out then 1.0 else rep end, case when out or kind = 'success' or kind = 'failure' and rep > 0.05 then null when kind = 'failure' then coalesce(since, at_us) else since end, epoch + out::int, out, at_us
        from (select *, kind = 'failure' and rep <= 0.05 and coalesce(at_us - since >= {STAY_US}, false) as out
            from (select i.*, w.since, w.epoch, case i.kind when 'failure' then w.rep * 0.5 when 'success' then least(1.0, w.rep * 1.5) else least(1.0, w.rep * 1.1) end as rep from w join i on i.member_id = w.member_id and i.i = w.i + 1)))
    select member_id, epoch, at_us as evicted_us from w where gone"""

QUERIES = {
    f.__name__: f
    for f in (reputation_trajectory, reputation_final, pool_capacity, wrr_schedule, wrr_share, floor_eviction_first, floor_eviction_epochs, member_latest, heartbeat_gaps, alive_members)
}
SQL = {
    "floor_eviction_epochs": _EPOCHS,
    "reputation_trajectory": _REPUTED + "select at_us, l_orderkey, l_linenumber, l_extendedprice, member_id, kind, round(reputation + 1e-9, 6) as reputation from reputed",
    "reputation_final": _FINAL + "select * from final",
    "pool_capacity": _CAPACITY + "select * from capacity",
    "pool_rate": _CAPACITY + "select pool_id, round(case when capacity_rps > 0 then greatest(least(capacity_rps, 1000.0), 0.5) end, 6) as rps from capacity",
    "wrr_schedule": _PICKS.format(n=200) + "select pool_id, pick, member_id from p where pick <= 200",
    "wrr_share": _PICKS.format(n=2000) + "select pool_id, member_id, count(*) as picks from p where pick <= 2000 group by all",
    "floor_eviction_first": _REPUTED
    + f", b as (select *, kind = 'failure' and reputation <= 0.05 as low from reputed where kind <> 'heartbeat'), g as (select *, sum((not low)::int) over (partition by member_id order by at_us, l_orderkey, l_linenumber, l_extendedprice rows unbounded preceding) as g from b), t as (select *, min(at_us) over (partition by member_id, g) as t0 from g where low) select member_id, min(at_us) as evicted_us from t where at_us - t0 >= {STAY_US} group by member_id",
    "member_latest": with_("beats") + _LATEST.format(where=""),
    "heartbeat_gaps": with_("beats") + "select pool_id, member_id, at_us, lost_us, next_us from (select *, at_us + 3 * interval_us as lost_us, lead(at_us) over (partition by pool_id, member_id order by at_us, hb_id) as next_us from beats) where interval_us > 0 and next_us > lost_us",
    "alive_members": with_("beats") + f", l as ({_LATEST.format(where=f'where at_us <= {NOW_MS * 1000}')}) select pool_id, member_id, at_us from l where interval_us <= 0 or {NOW_MS * 1000} - at_us <= 3 * interval_us",
}
