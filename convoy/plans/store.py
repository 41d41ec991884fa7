"""Queries over the store, validation and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import routing, store
from convoy.plans.views import NOW_MS, ORDER, UPSTREAM, URL, by_day, exports, jobs, requests, with_
from convoy.sources.tables import table

CORE = ["id", "user_id", "queue_key", "status", "created_ms", "expires_at"]
PAIR = "id, user_id, queue_key, status, created_ms, expires_at"


def idempotent_dedup(spark, sf):
    return store.check_or_insert(requests(spark, sf), "idem_hash", ORDER).select("seq", "idem_hash", "first_seq", "duplicate")


def duplicate_report(spark, sf):
    return store.duplicate_report(store.check_or_insert(requests(spark, sf), "idem_hash", ORDER), ["user_id"])


def job_lookup(spark, sf):
    """The visible jobs that receipts mention."""
    return store.lookup(jobs(spark, sf, *CORE), table(spark, sf, "target_server").select(F.col("job_id").alias("id")), NOW_MS).select(*CORE)


def queued_jobs(spark, sf):
    return store.queued(jobs(spark, sf, *CORE), NOW_MS).select(*CORE)


def store_counts(spark, sf):
    return store.counts(jobs(spark, sf, "expires_at"), NOW_MS)


def job_latest_status(spark, sf):
    return jobs(spark, sf).select("id", "status", "loaded_us")


def job_expiry(spark, sf):
    return jobs(spark, sf).select("id", "status", store.expiry_after(F.col("status"), F.expr("loaded_us div 1000")).alias("expires_at"))


def recover_in_flight(spark, sf):
    return store.recover_in_flight(jobs(spark, sf, *CORE), routing.SHARED, NOW_MS).select(*CORE, "returned")


def ttl_sweep(spark, sf):
    return store.sweep(jobs(spark, sf, *CORE), NOW_MS).select(*CORE)


def deleted_jobs(spark, sf):
    """Jobs left when those whose delivery failed are deleted."""
    failed = table(spark, sf, "target_server").where("status = 'failed'").select(F.col("job_id").alias("id"))
    return store.delete(jobs(spark, sf, *CORE), failed).select(*CORE)


def request_validation(spark, sf):
    """Jobs without a url, and failed ones, name their queue as a pool, so that all rules are met: neither, both and either."""
    message = routing.validation_message(idempotent_key="idempotent_key_hash", pool_id="pool_id")
    pool = F.when((F.coalesce("url", F.lit("")) == "") | (F.col("status") == "failed"), F.col("queue_key"))
    return exports(spark, sf).withColumn("pool_id", pool).select("id", "loaded_us", F.upper("method").alias("method"), message.alias("message")).distinct()


def member_validation(spark, sf):
    h = table(spark, sf, "heartbeats").distinct()
    return h.select("hb_id", routing.member_message().alias("message"), routing.heartbeat_interval().cast("int").alias("interval_s"))


def rate_config_lookup(spark, sf):
    return routing.rate_limits(jobs(spark, sf, "url"), table(spark, sf, "rate_cfg"), routing.host_of()).select("id", "rps", "max_concurrent")


def upstream_key(spark, sf):
    return jobs(spark, sf, "url").select("id", routing.upstream_key().alias("upstream"), routing.trust_name().alias("trust_name"))


def tenant_queue_key(spark, sf):
    """Every upstream isolated but those without a host."""
    isolated = routing.host_of() != ""
    return jobs(spark, sf, "user_id", "headers", "url").select("id", routing.tenant_key("user_id", "headers", isolated).alias("queue"))


def queue_mode_asof(spark, sf):
    said = requests(spark, sf).withColumn("mode", F.when(F.col("k") % 7 == 0, "enabled").when(F.col("k") % 7 == 1, "disabled").otherwise(""))
    return routing.isolation_mode(said, "upstream", "mode", ORDER, by_day()).select("seq", "upstream", "isolated")


_DEDUP, _LATEST = with_("deduped"), with_("latest")
_API = "coalesce(" + ", ".join(f"nullif(case when json_valid(headers) then headers->>'$.\"{h}\"' end, '')" for h in ("Authorization", "x-api-key", "api-key")) + ", '')"
_RULES = " ".join(
    f"when {c} then '{m}'"
    for c, m in zip(("coalesce(user_id, '') = ''", "coalesce(idempotent_key_hash, '') = ''", "coalesce(url, '') = '' and coalesce(pool_id, '') = ''", "coalesce(url, '') <> '' and coalesce(pool_id, '') <> ''", "coalesce(method, '') = ''", "coalesce(webhook_url, '') = ''"), routing.MESSAGES, strict=True)
)

QUERIES = {
    f.__name__: f
    for f in (
        idempotent_dedup, duplicate_report, job_lookup, queued_jobs, store_counts, job_latest_status, job_expiry, recover_in_flight, ttl_sweep, deleted_jobs,
        request_validation, member_validation, rate_config_lookup, upstream_key, tenant_queue_key, queue_mode_asof,
    )
}
SQL = {
    "idempotent_dedup": _DEDUP + "select seq, idem_hash, first_seq, duplicate from deduped",
    "duplicate_report": _DEDUP + "select user_id, count(*) as n_requests, count(*) filter (duplicate) as n_duplicates from deduped group by all",
    "job_lookup": _LATEST + f"select {PAIR} from latest where expires_at > {NOW_MS} and id in (select job_id from target_server)",
    "queued_jobs": _LATEST + f"select {PAIR} from latest where expires_at > {NOW_MS} and status = 'queued'",
    "store_counts": _LATEST + f"select count(*) filter (status in ('queued', 'in_flight')) as total, count(*) filter (status = 'queued') as depth from latest where expires_at > {NOW_MS}",
    "job_latest_status": _LATEST + "select id, status, loaded_us from latest",
    "job_expiry": _LATEST + "select id, status, loaded_us // 1000 + case status when 'completed' then 1800000 when 'failed' then 7200000 else 86400000 end as expires_at from latest",
    "recover_in_flight": _LATEST + f"select id, user_id, queue_key, case when status = 'in_flight' then 'queued' else status end as status, created_ms, expires_at, coalesce(status = 'in_flight', false) and expires_at > {NOW_MS} as returned from latest where queue_key = '__shared__'",
    "ttl_sweep": _LATEST + f"select id, user_id, queue_key, case when status = 'in_flight' and created_ms < {NOW_MS} - 300000 then 'queued' else status end as status, created_ms, expires_at from latest where expires_at >= {NOW_MS}",
    "deleted_jobs": _LATEST + f"select {PAIR} from latest where not exists (select 1 from target_server t where t.job_id = latest.id and t.status = 'failed')",
    "request_validation": with_("exports") + f", p as (select *, case when coalesce(url, '') = '' or status = 'failed' then queue_key end as pool_id from exports) select distinct id, loaded_us, upper(method) as method, case {_RULES} else '' end as message from p",
    "member_validation": "select distinct hb_id, case when coalesce(pool_id, '') = '' then 'pool_id is required' when coalesce(member_id, '') = '' then 'member_id is required' when coalesce(address, '') = '' then 'address is required' when not coalesce(capacity_rps > 0, false) then 'capacity_rps must be positive' else '' end as message, case when heartbeat_interval_seconds > 0 then heartbeat_interval_seconds else 30 end as interval_s from heartbeats",
    "rate_config_lookup": _LATEST + f", d as (select max(rps) as r, max(max_concurrent) as c from rate_cfg where host is null), c as (select host, max((rps, max_concurrent)) as e from rate_cfg where host is not null group by host) select id, case when e is null then case when r > 0 then r else 2.0 end else e[1] end as rps, case when e is null then case when d.c > 0 then d.c else 1 end else e[2] end as max_concurrent from latest cross join d left join c on c.host = regexp_extract(coalesce(url, ''), {URL}, 2)",
    "upstream_key": _LATEST + f"select id, {UPSTREAM} as upstream, replace(regexp_replace({UPSTREAM}, '^[a-z][a-z0-9+.-]*://', ''), ':', '_') as trust_name from latest",
    "tenant_queue_key": _LATEST + f"select id, case when regexp_extract(coalesce(url, ''), {URL}, 2) <> '' then sha256(coalesce(user_id, '') || ':' || {_API}) else '__shared__' end as queue from latest",
    "queue_mode_asof": with_("requests") + "select seq, upstream, coalesce(last_value(case k % 7 when 0 then 'enabled' when 1 then 'disabled' end ignore nulls) over (partition by upstream order by arrived_us, seq rows unbounded preceding) = 'enabled', false) as isolated from requests",
}
