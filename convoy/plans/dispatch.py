"""Queries over pacing, feedback and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import attempts, pacing
from convoy.operators.sessions import sessionize
from convoy.plans.pools import pool_capacity
from convoy.plans.views import INTERVAL_US, ORDER, by_day, fresh, micros, requests, with_
from convoy.sources.tables import table

RPS, CONCURRENT, CEILING, POOL_RPS = 20.0, 4, 50.0, 1000.0
QUEUE = ["upstream"]


def queue_position(spark, sf):
    return pacing.queue_position(fresh(spark, sf), QUEUE, ORDER, by_day()).select("seq", "upstream", "position")


def _paced(spark, sf):
    return pacing.paced(fresh(spark, sf), QUEUE, "arrived_us", ORDER, INTERVAL_US, by_day())


def paced_schedule(spark, sf):
    """One job per 1200 s and upstream."""
    return _paced(spark, sf).select("seq", "upstream", "dispatch_us", "wait_us")


def _serial(spark, sf):
    return pacing.paced_serial(fresh(spark, sf), QUEUE, "arrived_us", "service_us", ORDER, INTERVAL_US, by_day())


def paced_schedule_serial(spark, sf):
    return _serial(spark, sf).select("seq", "upstream", "dispatch_us", "wait_us")


def paced_schedule_multi(spark, sf):
    return pacing.paced_multi(fresh(spark, sf), QUEUE, "arrived_us", "service_us", ORDER, INTERVAL_US, 3)


def paced_after_member(spark, sf):
    """Queues wait for the first member of their pool, which comes with the 100th request; then pacing starts."""
    r = fresh(spark, sf)
    firsts = r.where("seq >= 100").groupBy("upstream").agg(F.min("arrived_us").alias("first_us"))
    ready = pacing.after_first_member(r, "upstream", "arrived_us", firsts).where("ready_us is not null")
    return pacing.paced(ready, QUEUE, "ready_us", ORDER, INTERVAL_US, by_day()).select("seq", "upstream", "dispatch_us")


def _feedback(spark, sf):
    """Completions in order; every tenth key carries a rate header, every fifteenth a concurrency header."""
    return requests(spark, sf).withColumns({"hdr_rps": F.when(F.col("k") % 10 == 0, F.col("value") / 10), "hdr_max": F.when(F.col("k") % 15 == 0, (F.col("k") % 7).cast("int"))})


def _rates(spark, sf):
    return pacing.rate_trajectory(_feedback(spark, sf), QUEUE, ORDER, "hdr_rps", RPS, by_day())


def rate_trajectory(spark, sf):
    return _rates(spark, sf).select("seq", "upstream", "rps")


def concurrency_trajectory(spark, sf):
    return pacing.concurrency_trajectory(_feedback(spark, sf), QUEUE, ORDER, "hdr_max", CONCURRENT, by_day()).select("seq", "upstream", "max_concurrent")


def pool_rate(spark, sf):
    c = pacing.pool_rate(pool_capacity(spark, sf), POOL_RPS)
    return c.select("pool_id", F.round("rps", 6).alias("rps"))


def fair_share(spark, sf):
    """Tenants' queues of an upstream, each at 1 to 5 rps, under a ceiling of 50."""
    queues = requests(spark, sf).select("upstream", "user_id", (1.0 + F.col("user_id") % 5).alias("rps")).distinct()
    return pacing.fair_share(queues, "upstream", "rps", CEILING).select("upstream", "user_id", F.round("share_rps", 6).alias("share_rps"))


def queue_sessions(spark, sf):
    """Stretches in which an upstream's queue was never idle for five minutes."""
    r = requests(spark, sf).withColumn("at_ms", F.expr("arrived_us div 1000"))
    return sessionize(r, "upstream", "at_ms").select("upstream", "start_ms", "end_ms", "n_events")


def retry_schedule(spark, sf):
    return attempts.schedule(requests(spark, sf), "arrived_us", attempts.attempts_needed(F.col("http_status"))).select("seq", "attempt", "backoff_s", "attempt_us")


def _attempted(spark, sf):
    """Receipts as attempts of their job, the last received deciding."""
    t = table(spark, sf, "target_server").where("job_id is not null")
    return attempts.outcomes(t.withColumn("at", F.struct(micros("received_at").alias("us"), "rec_id")), "job_id", "at", "response_status", "reason")


def outcome_classify(spark, sf):
    return _attempted(spark, sf).select("job_id", "status", "n_attempts")


def failure_report(spark, sf):
    return _attempted(spark, sf).where("status = 'failed'").select("job_id", "status", "response_status", "reason")


def failover_attempts(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("code", F.when(F.col("l_returnflag") == "R", 500).otherwise(200))
    return attempts.failover(li, "l_orderkey", "l_linenumber", "l_suppkey", "code").groupBy("l_suppkey", "kind").agg(F.count(F.lit(1)).alias("n"))


def webhook_retry_schedule(spark, sf):
    t = table(spark, sf, "target_server").withColumn("received_us", micros("received_at"))
    return attempts.schedule(t, "received_us", attempts.attempts_needed(F.col("response_status"), True)).select("rec_id", "attempt", "backoff_s", "attempt_us")


_W = "(partition by upstream order by arrived_us, seq rows unbounded preceding)"
_PACED = with_("fresh") + f", n as (select *, row_number() over (partition by upstream order by arrived_us, seq) - 1 as n from fresh), paced as (select *, {INTERVAL_US} * n + max(arrived_us - {INTERVAL_US} * n) over {_W} as dispatch_us from n)"
_SERIAL = with_("fresh") + f", c as (select *, cast(coalesce(sum(greatest({INTERVAL_US}, coalesce(service_us, 0))) over (partition by upstream order by arrived_us, seq rows between unbounded preceding and 1 preceding), 0) as bigint) as c from fresh), serial as (select *, c + max(arrived_us - c) over {_W} as dispatch_us from c)"
_FEED = with_("requests") + ", feed as (select *, case when k % 10 = 0 then value / 10 end as hdr_rps, case when k % 15 = 0 then cast(k % 7 as int) end as hdr_max from requests)"
_RATES = _FEED + f""", m as (select *, row_number() over (partition by upstream order by arrived_us, seq) as n from feed),
    b as (select *, last_value(case when hdr_rps is not null then least({RPS}, greatest(0.5, hdr_rps)) end ignore nulls) over {_W} as base, last_value(case when hdr_rps is not null then n end ignore nulls) over {_W} as based from m),
    rates as (select *, round(least({RPS}, coalesce(base, {RPS}) * pow(1.05::double, least(n - coalesce(based, 0), 4000))), 6) as rps from b)"""
_STEPS = "(values (0, 0, 0), (1, 1, 1), (2, 2, 3), (3, 4, 7), (4, 8, 15)) as s(attempt, backoff_s, done)"
_OUTCOME = """with t as (select *, row_number() over (partition by job_id order by received_at desc, rec_id desc) as r, count(*) over (partition by job_id) as n_attempts from target_server where job_id is not null),
    o as (select job_id, case when coalesce(response_status, 0) = 0 or response_status >= 500 then 'failed' else 'completed' end as status, coalesce(response_status, 0) as response_status,
        coalesce(nullif(reason, ''), case when coalesce(response_status, 0) = 0 then 'no answer' else 'upstream returned ' || response_status end) as reason, n_attempts from t where r = 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        queue_position, paced_schedule, paced_schedule_serial, paced_schedule_multi, paced_after_member, rate_trajectory, concurrency_trajectory, pool_rate, fair_share, queue_sessions,
        retry_schedule, outcome_classify, failure_report, failover_attempts, webhook_retry_schedule,
    )
}
#: One job after the other: the slot that is free first, the pace, and the slots afterwards.
_MULTI = with_("fresh").replace("with ", "with recursive ", 1) + f""", i as (select upstream, arrived_us, seq, service_us, row_number() over (partition by upstream order by arrived_us, seq) as i from fresh),
    w as (select upstream, 0::bigint as arrived_us, 0::bigint as seq, 0::bigint as service_us, 0::bigint as i, null::bigint as t, [0, 0, 0]::bigint[] as free from (select distinct upstream from fresh)
        union all select upstream, arrived_us, seq, service_us, i, t, list_sort(list_append(free[2:], t + coalesce(service_us, 0)))
        from (select i.*, w.free, greatest(i.arrived_us, w.free[1], coalesce(w.t + {INTERVAL_US}, i.arrived_us)) as t from w join i on i.upstream = w.upstream and i.i = w.i + 1))
    select upstream, arrived_us, seq, service_us, t as dispatch_us from w where i > 0"""

SQL = {
    "paced_schedule_multi": _MULTI,
    "queue_position": with_("fresh") + "select seq, upstream, row_number() over (partition by upstream order by arrived_us, seq) as position from fresh",
    "paced_schedule": _PACED + " select seq, upstream, dispatch_us, dispatch_us - arrived_us as wait_us from paced",
    "paced_schedule_serial": _SERIAL + " select seq, upstream, dispatch_us, dispatch_us - arrived_us as wait_us from serial",
    "paced_after_member": with_("fresh")
    + f", f as (select upstream, min(arrived_us) as first_us from fresh where seq >= 100 group by upstream), r as (select fresh.*, greatest(arrived_us, first_us) as ready_us, row_number() over (partition by fresh.upstream order by arrived_us, seq) - 1 as n from fresh join f using (upstream)) select seq, upstream, {INTERVAL_US} * n + max(ready_us - {INTERVAL_US} * n) over {_W} as dispatch_us from r",
    "rate_trajectory": _RATES + " select seq, upstream, rps from rates",
    "concurrency_trajectory": _FEED + f" select seq, upstream, coalesce(least(last_value(case when hdr_max > 0 then hdr_max end ignore nulls) over {_W}, {CONCURRENT}), {CONCURRENT}) as max_concurrent from feed",
    "fair_share": f"with q as (select distinct event_type as upstream, user_id, 1.0::double + user_id % 5 as rps from events), s as (select upstream, sum(rps) as s, count(*) as n from q group by upstream) select upstream, user_id, round(case when n >= 2 and s > {CEILING} then greatest(rps * {CEILING} / s, 0.5) else rps end, 6) as share_rps from q join s using (upstream)",
    "queue_sessions": with_("requests")
    + ", t as (select upstream, arrived_us // 1000 as t from requests), m as (select *, case when t - lag(t) over (partition by upstream order by t) <= 300000 then 0 else 1 end as fresh from t), n as (select *, sum(fresh) over (partition by upstream order by t rows unbounded preceding) as s from m) select upstream, min(t) as start_ms, max(t) as end_ms, count(*) as n_events from n group by upstream, s",
    "retry_schedule": with_("requests") + f"select seq, attempt, backoff_s, arrived_us + done * 1000000 as attempt_us from requests join {_STEPS} on http_status >= 500 or attempt = 0",
    "outcome_classify": _OUTCOME + " select job_id, status, n_attempts from o",
    "failure_report": _OUTCOME + " select job_id, status, response_status, reason from o where status = 'failed'",
    "failover_attempts": "select l_suppkey, case l_returnflag when 'R' then 'failure' else 'success' end as kind, count(*) as n from lineitem group by all",
    "webhook_retry_schedule": f"select rec_id, attempt, backoff_s, epoch_us(received_at) + done * 1000000 as attempt_us from target_server join {_STEPS} on coalesce(response_status, 0) not between 200 and 299 or attempt = 0",
}
