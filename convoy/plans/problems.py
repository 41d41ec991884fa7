"""Queries p1 to p3 over the job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.columns import epoch_ms
from convoy.operators.delivery import first_deliveries, receipt_key
from convoy.operators.keys import heavy_keys, key_states, waiting_order
from convoy.operators.sessions import sessionize
from convoy.sources.tables import table, table_path

KEYS = ["queue_key", "url", "user_id"]


def timed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of jobs as written, with their time in epoch milliseconds."""
    return table(spark, sf, "jobs").withColumn("at_ms", epoch_ms("created_at"))


def p1_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessionize(timed_jobs(spark, sf), event_id="id").withColumnRenamed("n_events", "n_jobs")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_sessions(spark, sf).select("user_id", "start_ms", "end_ms")


def _receipts(spark: SparkSession, sf: str):
    return first_deliveries(spark, table_path(sf, "target_server"), receipt_key(), ["received_at", "rec_id"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _receipts(spark, sf).surplus(["rec_id"])


def p2_once(spark: SparkSession, sf: str) -> DataFrame:
    return _receipts(spark, sf).kept()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys(timed_jobs(spark, sf), KEYS).select("field_name", "key_value")


def p3_key_states(spark: SparkSession, sf: str) -> DataFrame:
    return key_states(timed_jobs(spark, sf), KEYS)


def p3_waiting_order(spark: SparkSession, sf: str) -> DataFrame:
    once = timed_jobs(spark, sf).groupBy("id").agg(F.max(F.struct("queue_key", "at_ms")).alias("j")).select("id", "j.*")
    return waiting_order(once)


_MS = "case when created_at < 100000000000 then created_at * 1000 when created_at >= 100000000000000 then created_at // 1000 else created_at end"
_KEYED = " union all ".join(f"select '{f}' as field_name, {f} as key_value, {_MS} as t from jobs" for f in KEYS)
_STATES = f"select field_name, key_value, count(*) as n_rows, min(t) as first_ms, max(t) as last_ms from ({_KEYED}) where key_value <> '' group by all"
_SESSIONS = f"""
    with j as (select distinct id, user_id, {_MS} as t from jobs where user_id <> ''),
    m as (select *, case when t - lag(t) over (partition by user_id order by t) <= 300000 then 0 else 1 end as fresh from j),
    n as (select *, sum(fresh) over (partition by user_id order by t rows unbounded preceding) as k from
          (select user_id, t, max(fresh) as fresh, count(*) as c from m group by user_id, t))
    select user_id, min(t) as start_ms, max(t) as end_ms, max(t) - min(t) as duration_ms, cast(sum(c) as bigint) as n_jobs
    from n group by user_id, k"""
_SURPLUS = r"""
    with k as (select *, nullif(lower(trim(x_l8_delivery_id, e' \t\n\r\f\x0b')), '') as d from target_server),
    m as (select *, coalesce('d' || d, 'j' || job_id || ':' || x_l8_timestamp, 'r' || rec_id) as message from k),
    n as (select *, row_number() over (partition by message order by received_at, rec_id) as copy from m)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p2_found, p2_once, p3_found, p3_key_states, p3_waiting_order)}
SQL = {
    "p1_found": f"select user_id, start_ms, end_ms from ({_SESSIONS})",
    "p1_sessions": _SESSIONS,
    "p2_found": f"{_SURPLUS} select rec_id from n where copy > 1",
    "p2_once": f"{_SURPLUS} select * exclude (d, message, copy) from n where copy = 1",
    "p3_found": f"select field_name, key_value from ({_STATES}) where n_rows * 100 >= 5 * (select count(*) from jobs)",
    "p3_key_states": _STATES,
    "p3_waiting_order": f"select *, row_number() over (partition by queue_key order by at_ms, id) as position from (select distinct id, queue_key, {_MS} as at_ms from jobs where queue_key <> '')",
}
