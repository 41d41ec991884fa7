"""The test tables as requests, jobs, outcomes, members and heartbeats, and the same as SQL.

Events stand for requests (the key is ``props.k``, the upstream the event type, the service time ``value`` in seconds);
line items for outcomes of members (suppliers), whose kinds are the return flags; jobs, receipts, heartbeats, challenges
and rate limits are tables of their own. Model times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.columns import epoch_ms
from convoy.operators.ranking import blocks_of
from convoy.operators.store import check_or_insert, idempotency_hash, latest
from convoy.sources.tables import table

DAY_US = 86_400_000_000
#: "Now" of every query that needs one: 2023-01-04 12:00 UTC.
NOW_MS = 1_672_833_600_000
#: Pacing interval of a queue at the scale of the test tables.
INTERVAL_US = 1_200_000_000
ORDER = ["arrived_us", "seq"]
OUTCOME_ORDER = ["at_us", "l_orderkey", "l_linenumber", "l_extendedprice"]


def micros(c: str) -> Column:
    """A timestamp without zone as microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def by_day(c: str = "arrived_us") -> Column:
    return blocks_of(c, DAY_US)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.select(
        F.col("event_id").alias("seq"), "user_id", "k", F.col("event_type").alias("upstream"), micros("ts").alias("arrived_us"), F.round(F.col("value") * 1e6).cast("bigint").alias("service_us"),
        "value", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"), idempotency_hash("user_id", "k").alias("idem_hash"), "ts",
    )


def fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Requests without duplicates."""
    return check_or_insert(requests(spark, sf), "idem_hash", ORDER).where(~F.col("duplicate")).drop("duplicate", "first_seq")


def exports(spark: SparkSession, sf: str) -> DataFrame:
    """Job rows as written, statuses in lower case, times in milliseconds."""
    j = table(spark, sf, "jobs")
    return j.withColumns({"status": F.lower("status"), "created_ms": epoch_ms("created_at"), "loaded_us": micros("loaded_at")}).drop("created_at", "loaded_at")


def jobs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The last export of each job: ``id, loaded_us, status`` and the columns named. Ties go to the later row of the files,
    so what is read is what is asked for."""
    place = {"_f": F.xxhash64("_metadata.file_path"), "_r": F.col("_metadata.row_index")}
    e = exports(spark, sf).select("*", *[c.alias(n) for n, c in place.items()])
    return latest(e, "id", ["loaded_us", "status", "_f", "_r"], columns).drop("_f", "_r")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "failure").when(F.col("l_returnflag") == "A", "success").otherwise("heartbeat")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("member_id"), micros("l_shipdate").alias("at_us"), "l_orderkey", "l_linenumber", "l_extendedprice", kind.alias("kind"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").alias("pool_id"), F.col("s_suppkey").alias("member_id"), (F.col("s_acctbal") / 100).alias("declared_rps")).where("declared_rps > 0")


def beats(spark: SparkSession, sf: str) -> DataFrame:
    """Heartbeats once each, in microseconds, those that fail validation left out; an interval that is not positive is 0."""
    h = table(spark, sf, "heartbeats").distinct()
    return h.where("pool_id <> '' and member_id <> '' and address <> '' and capacity_rps > 0").select(
        "pool_id", "member_id", micros("beat_at").alias("at_us"), "hb_id", "address", "capacity_rps",
        (F.greatest(F.col("heartbeat_interval_seconds"), F.lit(0)).cast("bigint") * 1_000_000).alias("interval_us"),
    )


MS = "case when created_at < 100000000000 then created_at * 1000 when created_at >= 100000000000000 then created_at // 1000 else created_at end"
URL = r"'^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^/?#]*@)?([^/?#]*)'"
UPSTREAM = f"case when regexp_matches(coalesce(url, ''), {URL}) then lower(regexp_extract(url, {URL}, 1)) || '://' || regexp_extract(url, {URL}, 2) when coalesce(url, '') = '' then '://' else url end"
SQL = {
    "requests": """requests as (select event_id as seq, user_id, cast(props->>'$.k' as bigint) as k, event_type as upstream, epoch_us(ts) as arrived_us, cast(round(value * 1e6) as bigint) as service_us, value,
        case when event_type = 'error' then 500 else 200 end as http_status, sha256(user_id || ':' || (props->>'$.k')) as idem_hash, ts from events)""",
    "deduped": "deduped as (select *, first_value(seq) over (partition by idem_hash order by arrived_us, seq) as first_seq, row_number() over (partition by idem_hash order by arrived_us, seq) > 1 as duplicate from requests)",
    "fresh": "fresh as (select * from deduped where not duplicate)",
    "exports": f"exports as (select * exclude (status, created_at, loaded_at), lower(status) as status, {MS} as created_ms, epoch_us(loaded_at) as loaded_us from jobs)",
    "latest": "latest as (select * from exports qualify row_number() over (partition by id order by loaded_us desc, status desc nulls last) = 1)",
    "outcomes": "outcomes as (select l_suppkey as member_id, epoch_us(l_shipdate) as at_us, l_orderkey, l_linenumber, l_extendedprice, case l_returnflag when 'R' then 'failure' when 'A' then 'success' else 'heartbeat' end as kind from lineitem)",
    "walk": """walk as (select *, sum((kind = 'failure')::int) over w * ln(0.5) + sum((kind = 'success')::int) over w * ln(1.5) + sum((kind = 'heartbeat')::int) over w * ln(1.1) as s
        from outcomes window w as (partition by member_id order by at_us, l_orderkey, l_linenumber, l_extendedprice rows unbounded preceding)),
        reputed as (select *, exp(s - greatest(0, max(s) over (partition by member_id order by at_us, l_orderkey, l_linenumber, l_extendedprice rows unbounded preceding))) as reputation from walk)""",
    "members": "members as (select s_nationkey as pool_id, s_suppkey as member_id, s_acctbal / 100 as declared_rps from supplier where s_acctbal > 0)",
    "beats": "beats as (select distinct pool_id, member_id, epoch_us(beat_at) as at_us, hb_id, address, capacity_rps, cast(greatest(coalesce(heartbeat_interval_seconds, 0), 0) as bigint) * 1000000 as interval_us from heartbeats where pool_id <> '' and member_id <> '' and address <> '' and capacity_rps > 0)",
}
_NEEDS = {"deduped": ["requests"], "fresh": ["deduped"], "latest": ["exports"], "walk": ["outcomes"]}


def with_(*names: str) -> str:
    """A WITH clause of the views named and those they need."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in _NEEDS.get(n, ()):
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return "with " + ", ".join(SQL[n] for n in order) + " "
