"""Queries over several stages: from the request as it comes to what became of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import admission, attempts, pacing, routing, store
from convoy.operators.ranking import blocks_of
from convoy.plans.dispatch import RPS
from convoy.plans.reports import _ADM
from convoy.plans.streams import _finish as finish
from convoy.plans.views import INTERVAL_US, ORDER, by_day, requests, with_
from convoy.sources.sinks import read_requests
from convoy.sources.tables import scratch, size_on_disk, table, table_path

#: The middle of the events' month, where stored history ends.
SPLIT_US = 1_705_276_800_000_000


def pipeline_outcome(spark, sf):
    """Validated, admitted, de-duplicated, routed to the upstream's queue or, while it isolates, the tenant's, paced, and answered."""
    r = requests(spark, sf).withColumns({"method": F.lit("POST"), "pool_id": F.lit(None).cast("string")})
    valid = r.where(routing.validation_message(F.col("user_id").cast("string"), "idem_hash", "upstream", "pool_id", "method", "idem_hash") == "")
    accepted = admission.outcome(valid, "idem_hash", ORDER, F.col("upstream") != "error").where("outcome = 'accepted'")
    said = accepted.withColumn("mode", F.when(F.col("k") % 7 == 0, "enabled").when(F.col("k") % 7 == 1, "disabled").otherwise(""))
    queued = routing.isolation_mode(said, "upstream", "mode", ORDER, by_day()).withColumn("queue", F.when(F.col("isolated"), F.concat_ws(":", "upstream", "user_id")).otherwise(F.col("upstream")))
    paced = pacing.paced(queued, ["queue"], "arrived_us", ORDER, INTERVAL_US, by_day())
    return paced.select("seq", "queue", "dispatch_us", F.when(F.col("k") % 10 == 0, "failed").otherwise("completed").alias("status"))


def dedup_with_history(spark, sf):
    """Requests of the second half of the month against what the first half stored."""
    r = requests(spark, sf)
    history = store.check_or_insert(r.where(F.col("arrived_us") < SPLIT_US), "idem_hash", ORDER).where(~F.col("duplicate")).select("idem_hash", F.col("seq").alias("first_seq"))
    return store.check_or_insert(r.where(F.col("arrived_us") >= SPLIT_US), "idem_hash", ORDER, history).select("seq", "idem_hash", "first_seq", "duplicate")


def _json_requests(spark, sf):
    """Jobs written as JSON lines, those of failed jobs broken; where they lie."""
    j = table(spark, sf, "jobs").select("status", "user_id", F.col("idempotent_key_hash").alias("idempotent_key"), "url", "method")
    line = F.to_json(F.struct("user_id", "idempotent_key", "url", "method"))
    path = scratch(spark, "requests")
    j.select(F.when(F.lower("status") == "failed", F.concat(F.lit("!"), line)).otherwise(line).alias("value")).write.text(path)
    return path


def _census(read):
    return read.groupBy(F.upper("method").alias("method"), F.col("bad_line").isNotNull().alias("bad")).agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("n_urls"), F.count_distinct("user_id").alias("n_users"))


def requests_from_json(spark, sf):
    """What parses of requests as JSON lines, and how many lines do not."""
    return _census(read_requests(spark, _json_requests(spark, sf)))


def stream_requests(spark, sf):
    """The same lines as a stream, appended to a table."""
    return _census(finish(read_requests(spark, _json_requests(spark, sf), stream=True)))


def rate_from_headers(spark, sf):
    """Rates by the header under its own name, else under the older one; text that is no number counts as 0."""
    own = F.when(F.col("k") % 10 == 0, (F.col("value") / 10).cast("string")).when(F.col("k") % 10 == 1, "")
    older = F.when(F.col("k") % 4 == 0, "fast").when(F.col("k") % 4 == 1, "3.5")
    r = requests(spark, sf).withColumns({"own": own, "older": older})
    r = r.withColumn("hdr_rps", pacing.rate_header(pacing.first_header("own", "older")))
    return pacing.rate_trajectory(r, ["upstream"], ORDER, "hdr_rps", RPS, by_day()).select("seq", "upstream", "rps")


def failover_credit(spark, sf):
    """Orders as jobs of three pools (one without members), their lines as tries, returned ones as failures."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    answers = li.select((F.col("l_orderkey") % 3).alias("pool_id"), "l_orderkey", "l_linenumber", F.when(F.col("flag") == "R", 500).when(F.col("flag") == "N", 200).alias("code"))
    members = table(spark, sf, "supplier").select((F.col("s_suppkey") % 2).alias("pool_id"), F.col("s_suppkey").alias("member_id"))
    walk = attempts.failover_walk(answers, members, "pool_id", "l_orderkey", "l_linenumber", "code", "member_id", blocks_of("l_orderkey", 1_000_000))
    return walk.groupBy("pool_id", "member_id", "kind", "reason").agg(F.count(F.lit(1)).alias("n"))


def store_size(spark, sf):
    """Whether the store on disk is above a limit of one byte, and of a million gigabytes."""
    size = F.lit(size_on_disk(spark, table_path(sf, "jobs")))
    limits = [(1, "small"), (10**15, "large")]
    out = None
    for limit, name in limits:
        one = spark.range(1).select(F.lit(name).alias("name"), admission.decision(F.lit(0), 0, size, limit).alias("d")).select("name", "d.allowed", "d.reason")
        out = one if out is None else out.unionByName(one)
    return out


_TURN = """with li as (select l_orderkey, l_linenumber, max(l_returnflag) as flag from lineitem group by all),
    a as (select l_orderkey % 3 as pool_id, l_orderkey, l_linenumber, case flag when 'R' then 500 when 'N' then 200 end as code from li),
    e as (select *, min(l_linenumber) filter (code < 500) over (partition by l_orderkey) as e, row_number() over (partition by l_orderkey order by l_linenumber) as t from a),
    n as (select *, row_number() over (partition by pool_id order by l_orderkey, l_linenumber) as n from e where (e is null or l_linenumber <= e) and t <= 5),
    m as (select s_suppkey % 2 as pool_id, s_suppkey as member_id, row_number() over (partition by s_suppkey % 2 order by s_suppkey) - 1 as k, count(*) over (partition by s_suppkey % 2) as c from supplier),
    s as (select distinct pool_id, c from m)
    select n.pool_id, m.member_id, case when s.c is not null then case when code < 500 then 'success' else 'failure' end end as kind,
        case when s.c is null then 'no pool members registered' when code is null then 'no answer' when code >= 500 then 'upstream returned ' || code end as reason, count(*) as n
    from n left join s on s.pool_id = n.pool_id left join m on m.pool_id = n.pool_id and m.k = (n.n - 1) % s.c where s.c is not null or t = 1 group by all"""
_W = "(partition by upstream order by arrived_us, seq rows unbounded preceding)"

_CENSUS = "select case when lower(status) = 'failed' then null else upper(method) end as method, coalesce(lower(status) = 'failed', false) as bad, count(*) as n, count(case when coalesce(lower(status) <> 'failed', true) then url end) as n_urls, count(distinct case when coalesce(lower(status) <> 'failed', true) then user_id end) as n_users from jobs group by all"

QUERIES = {f.__name__: f for f in (pipeline_outcome, dedup_with_history, requests_from_json, stream_requests, rate_from_headers, failover_credit, store_size)}
SQL = {
    "pipeline_outcome": _ADM
    + f""", acc as (select * from adm where outcome = 'accepted'), iso as (select *, coalesce(last_value(case k % 7 when 0 then 'enabled' when 1 then 'disabled' end ignore nulls) over {_W} = 'enabled', false) as isolated from acc),
        q as (select *, case when isolated then upstream || ':' || user_id else upstream end as queue from iso), n as (select *, row_number() over (partition by queue order by arrived_us, seq) - 1 as n from q)
        select seq, queue, {INTERVAL_US} * n + max(arrived_us - {INTERVAL_US} * n) over (partition by queue order by arrived_us, seq rows unbounded preceding) as dispatch_us, case when k % 10 = 0 then 'failed' else 'completed' end as status from n""",
    "dedup_with_history": with_("deduped") + f"select seq, idem_hash, first_seq, duplicate from deduped where arrived_us >= {SPLIT_US}",
    "requests_from_json": _CENSUS,
    "stream_requests": _CENSUS,
    "rate_from_headers": with_("requests")
    + f""", h as (select *, coalesce(case k % 10 when 0 then cast(value / 10 as varchar) end, case k % 4 when 0 then 'fast' when 1 then '3.5' end) as h, row_number() over (partition by upstream order by arrived_us, seq) as n from requests),
        r as (select *, case when h is not null then least({RPS}, greatest(0.5, coalesce(try_cast(h as double), 0))) end as c from h),
        b as (select *, last_value(c ignore nulls) over {_W} as base, last_value(case when c is not null then n end ignore nulls) over {_W} as based from r)
        select seq, upstream, round(least({RPS}, coalesce(base, {RPS}) * pow(1.05::double, least(n - coalesce(based, 0), 4000))), 6) as rps from b""",
    "failover_credit": _TURN,
    "store_size": "select * from (values ('small', false, 'database'), ('large', true, '')) v(name, allowed, reason)",
}
