"""Queries over admission, protocol data, metrics, the simulator and load reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import admission, metrics, protocol, scenario
from convoy.operators.ranking import Fold, blocks_of, prefix, rank_in_blocks
from convoy.operators.routing import upstream_key
from convoy.plans.dispatch import _PACED, _RATES, _SERIAL, _paced, _rates, _serial
from convoy.plans.views import DAY_US, ORDER, UPSTREAM, by_day, jobs, micros, requests, with_
from convoy.sources.sinks import write_csv
from convoy.sources.tables import scratch, table

HOUR_US = 3_600_000_000
MAX_MB, MAX_DB, MAX_BODY = 200, 90_000_000, 24
WORKERS = list(range(1, 21))


def admission_decision(spark, sf):
    """Memory is the request's value, the database a million bytes per key number."""
    d = admission.decision(F.col("value"), MAX_MB, F.col("k") * 1_000_000, MAX_DB)
    return requests(spark, sf).select("seq", d.alias("d")).select("seq", "d.*")


def _admitted(spark, sf):
    return admission.outcome(requests(spark, sf), "idem_hash", ORDER, F.col("upstream") != "error")


def admission_outcome(spark, sf):
    return _admitted(spark, sf).select("seq", "outcome", "accepted_seq")


def retry_after_streaks(spark, sf):
    checked = _admitted(spark, sf).where("outcome <> 'duplicate'")
    return admission.retry_after(checked, ORDER, F.col("outcome") == "rejected", 5, by_day()).select("seq", "streak", "retry_after_s")


def oversized_bodies(spark, sf):
    return admission.oversized(jobs(spark, sf, "body"), "body", MAX_BODY).select("id", "body_bytes", "limit_bytes")


def admission_snapshot(spark, sf):
    return admission.limits_snapshot(spark, 21, MAX_MB, 4096, MAX_DB, MAX_BODY, 5)


def _replays(spark, sf, memory_s):
    """Challenges are taken as received in the middle of their quarter of an hour."""
    c = protocol.replays(table(spark, sf, "challenges"), "nonce", F.col("ts_seconds"), F.expr("ts_seconds - ts_seconds % 900 + 450"), "challenge_id", memory_s)
    return c.select("challenge_id", protocol.challenge_message("challenge_id", "nonce").alias("message"), "verdict")


def nonce_replay(spark, sf):
    """With the rule's memory of five minutes."""
    return _replays(spark, sf, protocol.WINDOW_S)


def nonce_replay_days(spark, sf):
    """With a memory of two days, as nonces of the test table come again after hours and days."""
    return _replays(spark, sf, 2 * 86_400)


def delivery_digest(spark, sf):
    return table(spark, sf, "target_server").select("rec_id", protocol.delivery_digest("x_l8_delivery_id", "x_l8_timestamp", "body").alias("message"))


def metrics_by_upstream(spark, sf):
    s = F.col("status")
    j = jobs(spark, sf, "user_id", "url").select("user_id", upstream_key().alias("upstream"), "status")
    return metrics.counts_by(j, ["user_id", "upstream"], dispatched=s.isin("in_flight", "completed", "failed"), completed=s == "completed", failed=s == "failed")


def latency_by_upstream(spark, sf):
    return metrics.latency(requests(spark, sf), ["upstream"], "value")


def latency_summary(spark, sf):
    r = requests(spark, sf)
    rate = r.agg(
        F.round(F.count(F.lit(1)) * 1e6 / (F.max("arrived_us") - F.min("arrived_us")), 6).alias("rate"), F.round(F.avg(F.when(F.col("http_status") < 500, 1.0).otherwise(0.0)), 6).alias("success"), F.lit(0).alias("one")
    )
    return metrics.latency(r.withColumn("one", F.lit(0)), ["one"], "value").join(rate, "one").drop("one")


def failures_by_reason(spark, sf):
    return metrics.counts_by(table(spark, sf, "target_server").where("status = 'failed'"), ["reason"])


def webhook_attempts(spark, sf):
    from convoy.operators.attempts import attempts_needed

    t = table(spark, sf, "target_server")
    ok = F.coalesce(F.col("response_status"), F.lit(0)).between(200, 299)
    return t.groupBy(ok.alias("delivered")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(attempts_needed(F.col("response_status"), True)), 6).alias("mean_attempts"))


def queue_depth_series(spark, sf):
    return metrics.depth_series(_paced(spark, sf), "upstream", "arrived_us", "dispatch_us", "seq", DAY_US)


def flow_rate_changes(spark, sf):
    """The rate as reported, cut to two decimals, whenever it changes."""
    r = _rates(spark, sf).withColumn("flow", F.floor(F.col("rps") * 100) / 100)
    return metrics.changes(r, ["upstream"], "flow", ORDER, by_day()).select("seq", "upstream", "flow")


def scenario_workers(spark, sf):
    return scenario.workers(spark, 24)


def scenario_overload(spark, sf):
    """Each worker of the harsh scenario, and two bad ones, get up to seven requests a second for a minute."""
    bad = spark.range(25, 27).select(F.lit("harsh").alias("scenario"), F.col("id").cast("int").alias("worker_id"), F.lit("bad").alias("behavior"), F.lit(5.0).alias("capacity_rps"))
    w = scenario.workers(spark, 24).where("scenario = 'harsh'").unionByName(bad).withColumn("second", F.explode(F.sequence(F.lit(1), F.lit(60))))
    n = (F.col("worker_id") + F.col("second")) % 8
    calls = w.withColumn("n", n).where("n > 0").withColumn("seq", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return scenario.overload(calls).withColumns({c: F.round(c, 6) for c in ("advertised_rps", "overload")})


def _responses(spark, sf):
    """Requests as responses of 20 workers, hours standing for seconds."""
    s = F.when(F.col("upstream") == "error", 500).when(F.col("k") % 10 == 0, 429).otherwise(200)
    return requests(spark, sf).select(F.expr(f"arrived_us div {HOUR_US}").alias("second"), (F.col("user_id") % 20 + 1).cast("int").alias("worker_id"), s.alias("status"))


def observations(spark, sf):
    return scenario.observations(_responses(spark, sf))


def observations_pivot(spark, sf):
    return scenario.observations_pivot(scenario.observations(_responses(spark, sf)), WORKERS)


def observations_csv(spark, sf):
    """Written as CSV and read again, all columns as text."""
    o = scenario.observations(_responses(spark, sf)).withColumns({"advertised_rps": F.col("requests") / 3, "overload": F.col("http_500") * 0.7, "capacity_rps": F.lit(5.0), "reputation": F.col("http_200") / F.col("requests")})
    path = scratch(spark, "observations")
    write_csv(scenario.csv_rows(o), path)
    names = ["second", "worker_id", "requests", "http_200", "http_429", "http_500", "advertised_rps", "overload", "capacity_rps", "reputation"]
    return spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).csv(path)


def scenario_summary(spark, sf):
    """When nine tenths of the requests were done, counting through all hours."""
    r = requests(spark, sf)
    per = _responses(spark, sf).groupBy("second").agg(F.count_if(F.col("status") < 500).alias("c"), F.count_if(F.col("status") >= 500).alias("f")).withColumn("all", F.lit(0))
    up = prefix(per, ["all"], ["second"], blocks_of("second", 24), {"completed": Fold("sum", F.col("c")), "failed": Fold("sum", F.col("f"))})
    jobs_n = F.floor(r.agg(F.count(F.lit(1))).scalar() * 9 / 10)
    return scenario.summary(up, jobs_n)


def round_robin_assign(spark, sf):
    n = rank_in_blocks(requests(spark, sf).withColumn("all", F.lit(0)), ["all"], ORDER, by_day(), "n")
    return scenario.round_robin(n, 20).select("seq", "worker_id")


def burst_phases(spark, sf):
    """Ten days of baseline, ten of burst, ten of recovery."""
    day = F.dayofmonth("ts")
    phase = F.when(day <= 10, "baseline").when(day <= 20, "burst").otherwise("recovery")
    return metrics.latency(requests(spark, sf).withColumn("phase", phase), ["phase"], "value")


def status_histogram(spark, sf):
    return metrics.counts_by(table(spark, sf, "target_server"), ["response_status"])


def first_rejection(spark, sf):
    t = table(spark, sf, "target_server")
    refused = F.col("response_status") == 429
    return t.agg(F.count(F.lit(1)).alias("total"), F.count_if(refused).alias("rejected"), F.min(F.when(refused, micros("received_at"))).alias("first_us"))


def recovery_census(spark, sf):
    """Where the jobs that receipts mention are now."""
    ids = table(spark, sf, "target_server").select(F.col("job_id").alias("id")).where("id is not null").distinct()
    found = ids.join(jobs(spark, sf).select("id", F.coalesce("status", F.lit("unknown")).alias("status")), "id", "left")
    return found.groupBy(F.coalesce("status", F.lit("not_found")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def tenant_wait(spark, sf):
    return _paced(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("wait_us").alias("max_wait_us"), F.round(F.sum("wait_us") / F.count(F.lit(1)), 3).alias("mean_wait_us"))


def ramp_ceiling(spark, sf):
    """The lowest hourly rate at which some request failed."""
    per = requests(spark, sf).groupBy(F.expr(f"arrived_us div {HOUR_US}").alias("hour")).agg(F.count(F.lit(1)).alias("rate"), F.avg(F.when(F.col("http_status") < 500, 1.0).otherwise(0.0)).alias("ok"))
    return per.agg(F.min(F.when(F.col("ok") < 1, F.col("rate"))).alias("first_failing_rate"), F.max(F.when(F.col("ok") == 1, F.col("rate"))).alias("best_clean_rate"))


def drain_time(spark, sf):
    return _serial(spark, sf).groupBy("upstream").agg((F.max(F.col("dispatch_us") + F.col("service_us")) - F.min("arrived_us")).alias("drain_us"))


def rate_asof(spark, sf):
    """For each error, the value of the user's last click at or before it."""
    r = requests(spark, sf)
    errors, clicks = r.where("upstream = 'error'").select("user_id", "arrived_us", "seq"), r.where("upstream = 'click'").select("user_id", "arrived_us", F.col("value").alias("last_value"))
    return metrics.as_of(errors, clicks, ["user_id"], "arrived_us", ["last_value"], "seq", by_day())


def _windowed(spark, sf, *window):
    w = F.window(F.col("ts").cast("timestamp"), *window)
    return requests(spark, sf).groupBy(w.alias("w"), "upstream").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start_us"), "upstream", "n")


def arrivals_tumbling(spark, sf):
    return _windowed(spark, sf, "1 day")


def arrivals_sliding(spark, sf):
    return _windowed(spark, sf, "2 days", "1 day")


def arrivals_session(spark, sf):
    """A tenant's arrivals less than six hours apart."""
    from convoy.operators.sessions import sessionize

    r = requests(spark, sf).select(F.col("user_id").cast("string").alias("user_id"), F.expr("arrived_us div 1000").alias("at_ms"))
    return sessionize(r, gap_ms=6 * 3_600_000)


def traffic_rollup(spark, sf):
    r = requests(spark, sf).rollup("upstream", "user_id").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("service_us").alias("service_us"))
    return r


def approx_tenants(spark, sf):
    return metrics.approx_distinct(requests(spark, sf), ["upstream"], "user_id")


def approx_tenants_error(spark, sf):
    """Exact numbers of tenants, and whether the approximate ones lie within five standard errors of them."""
    r = requests(spark, sf)
    exact = r.groupBy("upstream").agg(F.count_distinct("user_id").alias("n_tenants"))
    return exact.join(metrics.approx_distinct(r, ["upstream"], "user_id"), "upstream").select("upstream", "n_tenants", (F.abs(F.col("approx_n") - F.col("n_tenants")) <= 0.1 * F.col("n_tenants")).alias("within"))


_LAT = "count(value) as n, min(value) as min, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99, max(value) as max"
_RESP = with_("requests") + f", resp as (select arrived_us // {HOUR_US} as second, cast(user_id % 20 + 1 as int) as worker_id, case when upstream = 'error' then 500 when k % 10 = 0 then 429 else 200 end as status from requests), obs as (select second, worker_id, count(*) as requests, count(*) filter (status = 200) as http_200, count(*) filter (status = 429) as http_429, count(*) filter (status = 500) as http_500 from resp group by all) "
_ADM = with_("requests") + ", f as (select *, min((arrived_us, seq)) filter (upstream <> 'error') over (partition by idem_hash) as first from requests), adm as (select *, case when (arrived_us, seq) = first then 'accepted' when (arrived_us, seq) > first then 'duplicate' else 'rejected' end as outcome, first[2] as accepted_seq from f) "
_SESSION = "with t as (select cast(user_id as varchar) as user_id, epoch_us(ts) // 1000 as t from events), m as (select *, case when t - lag(t) over (partition by user_id order by t) <= 21600000 then 0 else 1 end as fresh from t), n as (select *, sum(fresh) over (partition by user_id order by t rows unbounded preceding) as s from m) select user_id, min(t) as start_ms, max(t) as end_ms, max(t) - min(t) as duration_ms, count(*) as n_events from n group by user_id, s"

_WORKERS = "with w as (select cast(i as int) as i, s from range(1, 25) t(i), (values ('steady'), ('weighted'), ('flapping'), ('backpressure'), ('recovering'), ('mixed'), ('harsh')) x(s)) select s as scenario, i as worker_id, case when s = 'flapping' and i = 24 then 'flapping' when s = 'backpressure' and i % 3 = 0 then 'dynamic' when s = 'recovering' and i = 24 then 'recovering' when s in ('mixed', 'harsh') and i = 24 then 'recovering' when s in ('mixed', 'harsh') and i = 23 then 'flapping' when s = 'harsh' and i % 3 = 0 then 'fragile' when s in ('mixed', 'harsh') and i % 4 = 0 then 'dynamic' else 'stable' end as behavior, cast(case when s = 'weighted' then 1 + i % 5 when s = 'harsh' and (i >= 23 or i % 3 = 0) then 3 when s = 'harsh' then 4 else 5 end as double) as capacity_rps from w"
#: One request after the other: what is left of the overload, what this request adds, and the rules by behaviour, crash and load.
_OVERLOAD = """ww as (select worker_id, behavior, capacity_rps from ({workers}) where scenario = 'harsh' union all select unnest([25, 26]), 'bad', 5.0),
    calls as (select worker_id, behavior, capacity_rps, cast(second as int) as second, cast(seq as int) as seq, row_number() over (partition by worker_id order by second, seq) as i
        from ww, range(1, 61) s(second), range(1, 8) c(seq) where seq <= (worker_id + second) % 8),
    w as (select worker_id, 0::bigint as i, ''::varchar as behavior, 0::double as capacity_rps, 0 as second, 0 as seq, 0::double as o, 0 as crashed_until, 0 as n, 0 as status, 0::double as rate, 0 as delay from ww
        union all select worker_id, i, behavior, capacity_rps, second, seq, o, case when o >= 8 then greatest(crashed_until, second + 2) else crashed_until end, n,
            case when crash or o >= 5 then 500 else st end, case when o >= 5 then 1.0 when o >= 3 then greatest(1.0, capacity_rps * 0.5) when crash then 1.0 else ra end,
            greatest(case when crash or o >= 8 then 250 when o >= 5 then 150 when o >= 3 then 100 else 0 end, case when n > floor(capacity_rps * 2) then 75 else 0 end)
        from (select *, crashed_until >= second as crash,
                case when behavior = 'bad' or behavior = 'flapping' and second between 5 and 10 or behavior = 'recovering' and second <= 5 then 500 when behavior = 'dynamic' and n > floor(greatest(1.0, capacity_rps) * 1.5) then 429 else 200 end as st,
                case behavior when 'stable' then case when n > floor(capacity_rps * 1.4) then greatest(1.0, capacity_rps * 0.7) else 0.0 end when 'dynamic' then greatest(1.0, capacity_rps) when 'flapping' then case when second between 5 and 10 then 1.0 else 0.0 end
                    when 'recovering' then case when second <= 5 then 1.0 when second <= 10 then 2.0 else capacity_rps end when 'bad' then 1.0 else greatest(1.0, capacity_rps - o / 2) end as ra
            from (select *, kept + greatest(0, n - cast(floor(capacity_rps) as int)) * case behavior when 'fragile' then 1.4 when 'dynamic' then 1.0 when 'flapping' then 1.2 when 'recovering' then 1.2 else 0.7 end as o
                from (select c.*, w.crashed_until, case when c.second = w.second then w.n + 1 else 1 end as n,
                        case when c.second = w.second then w.o when w.o * pow(0.65, c.second - w.second) < 0.1 then 0 else w.o * pow(0.65, c.second - w.second) end::double as kept
                    from w join calls c on c.worker_id = w.worker_id and c.i = w.i + 1))))
    select worker_id, behavior, capacity_rps, second, seq, status, round(rate, 6) as advertised_rps, delay as delay_ms, round(o, 6) as overload, crashed_until >= second as crashed from w where i > 0"""
_REPLAYS = """with recursive c as (select *, ts_seconds - ts_seconds % 900 + 450 as r, coalesce(abs(ts_seconds - ts_seconds % 900 + 450 - ts_seconds) <= 300, false) as fresh from challenges),
    f as (select nonce, r, min(challenge_id) as t from c where fresh and nonce is not null group by all),
    lives as (select nonce, min(r) as s from f group by nonce union all
        select l.nonce, min(f.r) from lives l join f on f.nonce = l.nonce and f.r > l.s + {memory} group by l.nonce, l.s),
    n as (select c.*, (select max(s) from lives l where l.nonce = c.nonce and l.s <= c.r) as s from c)
    select challenge_id, coalesce(challenge_id, '') || ':' || coalesce(n.nonce, '') as message,
        case when not fresh then 'stale' when n.nonce is not null and (n.r, challenge_id) > (n.s, f.t) then 'replayed' else 'ok' end as verdict
    from n left join f on f.nonce = n.nonce and f.r = n.s"""

QUERIES = {
    f.__name__: f
    for f in (
        admission_decision, admission_outcome, retry_after_streaks, oversized_bodies, admission_snapshot, nonce_replay, nonce_replay_days, delivery_digest, metrics_by_upstream, latency_by_upstream, latency_summary,
        failures_by_reason, webhook_attempts, queue_depth_series, flow_rate_changes, scenario_workers, scenario_overload, observations, observations_pivot, observations_csv, scenario_summary,
        round_robin_assign, burst_phases, status_histogram, first_rejection, recovery_census, tenant_wait, ramp_ceiling, drain_time, rate_asof, arrivals_tumbling, arrivals_sliding, arrivals_session,
        traffic_rollup, approx_tenants, approx_tenants_error,
    )
}
SQL = {
    "admission_decision": with_("requests") + f"select seq, not (value > {MAX_MB} or k * 1000000 > {MAX_DB}) as allowed, case when value > {MAX_MB} then 'memory' when k * 1000000 > {MAX_DB} then 'database' else '' end as reason, cast(case when value > {MAX_MB} then {MAX_MB} when k * 1000000 > {MAX_DB} then {MAX_DB} else 0 end as bigint) as \"limit\", cast(case when value > {MAX_MB} then trunc(value) when k * 1000000 > {MAX_DB} then k * 1000000 else 0 end as bigint) as current from requests",
    "admission_outcome": _ADM + "select seq, outcome, accepted_seq from adm",
    "retry_after_streaks": _ADM + ", c as (select *, sum((outcome = 'accepted')::int) over (order by arrived_us, seq rows unbounded preceding) as island from adm where outcome <> 'duplicate'), s as (select *, row_number() over (partition by island order by arrived_us, seq) as streak from c where outcome = 'rejected') select seq, streak, cast(case when streak <= 1 then 5 else least(60, 5 * pow(2, streak - 1)) end as int) as retry_after_s from s",
    "oversized_bodies": with_("latest") + f"select id, cast(strlen(body) as bigint) as body_bytes, cast({MAX_BODY} as bigint) as limit_bytes from latest where strlen(body) > {MAX_BODY}",
    "admission_snapshot": f"select true as enabled, 21 as memory_mb, {MAX_MB} as max_memory_mb, 4096 as db_bytes, {MAX_DB} as max_db_bytes, {MAX_BODY} as max_body_bytes, 5 as retry_after_s",
    "nonce_replay": _REPLAYS.format(memory=300),
    "nonce_replay_days": _REPLAYS.format(memory=172_800),
    "delivery_digest": "select rec_id, x_l8_delivery_id || '.' || x_l8_timestamp || '.' || to_base64(unhex(sha256(coalesce(body, '')))) as message from target_server",
    "metrics_by_upstream": with_("latest") + f"select user_id, {UPSTREAM} as upstream, count(*) as n, count(*) filter (status in ('in_flight', 'completed', 'failed')) as dispatched, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed from latest group by all",
    "latency_by_upstream": f"select event_type as upstream, {_LAT} from events group by all",
    "latency_summary": f"select {_LAT}, round(count(*) * 1e6::double / (max(epoch_us(ts)) - min(epoch_us(ts))), 6) as rate, round(avg((event_type <> 'error')::int), 6) as success from events",
    "failures_by_reason": "select reason, count(*) as n from target_server where status = 'failed' group by all",
    "webhook_attempts": "select coalesce(response_status, 0) between 200 and 299 as delivered, count(*) as n, round(avg(case when coalesce(response_status, 0) between 200 and 299 then 1 else 5 end), 6) as mean_attempts from target_server group by all",
    "queue_depth_series": _PACED + ", e as (select upstream, arrived_us as at_us, seq, 1 as change from paced union all select upstream, dispatch_us, seq, -1 from paced) select *, cast(sum(change) over (partition by upstream order by at_us, -change, seq rows unbounded preceding) as bigint) as depth from e",
    "flow_rate_changes": _RATES + ", fl as (select seq, upstream, floor(rps * 100) / 100 as flow, arrived_us from rates), l as (select *, lag(flow) over (partition by upstream order by arrived_us, seq) as last from fl) select seq, upstream, flow from l where last is null or last <> flow",
    "scenario_workers": _WORKERS,
    "scenario_overload": "with recursive " + _OVERLOAD.replace("{workers}", _WORKERS),
    "observations": _RESP + "select * from obs",
    "observations_pivot": _RESP + "select second, " + ", ".join(f"cast(coalesce(sum(requests) filter (worker_id = {w}), 0) as bigint) as w{w}" for w in WORKERS) + " from obs group by second",
    "observations_csv": _RESP + "select second::varchar as second, worker_id::varchar as worker_id, requests::varchar as requests, http_200::varchar as http_200, http_429::varchar as http_429, http_500::varchar as http_500, printf('%.2f', requests / 3) as advertised_rps, printf('%.2f', http_500 * 0.7::double) as overload, '5.00' as capacity_rps, printf('%.4f', http_200 / requests) as reputation from obs",
    "scenario_summary": _RESP + ", per as (select second, sum(http_200 + http_429) as c, sum(http_500) as f from obs group by second), up as (select second, cast(sum(c) over (order by second rows unbounded preceding) as bigint) as completed, cast(sum(f) over (order by second rows unbounded preceding) as bigint) as failed from per), n as (select count(*) * 9 // 10 as jobs from requests) select max(completed) as completed, max(failed) as failed, cast(max(jobs) - max(completed + failed) as bigint) as remaining, cast(coalesce(min(second) filter (completed + failed >= jobs), 0) as bigint) as drained_at from up cross join n",
    "round_robin_assign": "select event_id as seq, cast((row_number() over (order by ts, event_id) - 1) % 20 + 1 as int) as worker_id from events",
    "burst_phases": f"select case when day(ts) <= 10 then 'baseline' when day(ts) <= 20 then 'burst' else 'recovery' end as phase, {_LAT} from events group by all",
    "status_histogram": "select response_status, count(*) as n from target_server group by all",
    "first_rejection": "select count(*) as total, count(*) filter (response_status = 429) as rejected, min(epoch_us(received_at)) filter (response_status = 429) as first_us from target_server",
    "recovery_census": with_("latest") + "select coalesce(case when latest.id is not null then coalesce(status, 'unknown') end, 'not_found') as state, count(*) as n from (select distinct job_id from target_server where job_id is not null) t left join latest on latest.id = t.job_id group by all",
    "tenant_wait": _PACED + "select user_id, count(*) as n, max(dispatch_us - arrived_us) as max_wait_us, round(cast(sum(dispatch_us - arrived_us) as bigint) / count(*), 3) as mean_wait_us from paced group by all",
    "ramp_ceiling": f"with h as (select epoch_us(ts) // {HOUR_US} as hour, count(*) as rate, avg((event_type <> 'error')::int) as ok from events group by 1) select min(rate) filter (ok < 1) as first_failing_rate, max(rate) filter (ok = 1) as best_clean_rate from h",
    "drain_time": _SERIAL + "select upstream, max(dispatch_us + service_us) - min(arrived_us) as drain_us from serial group by all",
    "rate_asof": with_("requests") + "select e.user_id, e.arrived_us, e.seq, c.value as last_value from (select * from requests where upstream = 'error') e asof left join (select * from requests where upstream = 'click') c on e.user_id = c.user_id and e.arrived_us >= c.arrived_us",
    "arrivals_tumbling": f"select epoch_us(ts) // {DAY_US} * {DAY_US} as start_us, event_type as upstream, count(*) as n from events group by all",
    "arrivals_sliding": f"select (epoch_us(ts) // {DAY_US} - back) * {DAY_US} as start_us, event_type as upstream, count(*) as n from events, (values (0), (1)) b(back) group by all",
    "approx_tenants_error": "select event_type as upstream, count(distinct user_id) as n_tenants, true as within from events group by all",
    "arrivals_session": _SESSION,
    "traffic_rollup": with_("requests") + "select upstream, user_id, cast(grouping(upstream, user_id) as bigint) as level, count(*) as n, cast(sum(service_us) as bigint) as service_us from requests group by rollup (upstream, user_id)",
}
