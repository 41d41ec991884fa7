"""Validation of requests, and where they go: upstream, tenant queue, rate configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions.columns import URL_PARTS
from convoy.operators.ranking import Fold, prefix

SHARED = "__shared__"
DEFAULT_RPS, DEFAULT_CONCURRENT = 2.0, 1
#: Messages of the validation rules, first failing rule first (fixed values).
MESSAGES = (
    "user_id is required",
    "idempotent_key is required",
    "either url or pool_id is required",
    "url and pool_id are mutually exclusive — a job dispatches to one or the other",
    "method is required",
    "webhook_url is required",
)


def _empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def validation_message(user_id="user_id", idempotent_key="idempotent_key", url="url", pool_id="pool_id", method="method", webhook_url="webhook_url") -> Column:
    """The message of the first rule a request breaks, or the empty string. Null counts as empty."""
    rules = (_empty(user_id), _empty(idempotent_key), _empty(url) & _empty(pool_id), ~_empty(url) & ~_empty(pool_id), _empty(method), _empty(webhook_url))
    out = F.when(rules[0], MESSAGES[0])
    for rule, message in zip(rules[1:], MESSAGES[1:], strict=True):
        out = out.when(rule, message)
    return out.otherwise("")


def member_message(pool_id="pool_id", member_id="member_id", address="address", rate="capacity_rps") -> Column:
    """Likewise for the registration of a pool member."""
    return F.when(_empty(pool_id), "pool_id is required").when(_empty(member_id), "member_id is required").when(_empty(address), "address is required").when(~F.coalesce(F.col(rate) > 0, F.lit(False)), "capacity_rps must be positive").otherwise("")


def heartbeat_interval(seconds="heartbeat_interval_seconds") -> Column:
    """Seconds; 30 where not positive or null."""
    return F.when(F.col(seconds) > 0, F.col(seconds)).otherwise(30)


def upstream_key(url: str | Column = "url") -> Column:
    """``scheme://host`` with the port and without user info, the scheme in lower case; what has no scheme and host
    keeps only ``://`` if empty, and is itself the key otherwise."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    parts = F.concat(F.lower(F.regexp_extract(c, URL_PARTS, 1)), F.lit("://"), F.regexp_extract(c, URL_PARTS, 2))
    return F.when(c.rlike(URL_PARTS), parts).when(c == "", "://").otherwise(c)


def host_of(url: str | Column = "url") -> Column:
    """Host with port as written; empty if there is none."""
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), URL_PARTS, 2)


def trust_name(url: str | Column = "url") -> Column:
    """The upstream without its scheme, colons as underscores: the stem of a file name."""
    return F.translate(F.regexp_replace(upstream_key(url), "^[a-z][a-z0-9+.-]*://", ""), ":", "_")


def api_key(headers: str | Column) -> Column:
    """The first non-empty of three headers of a JSON object, names case-sensitive; empty if none or not parsable."""
    known = F.from_json(F.col(headers) if isinstance(headers, str) else headers, "map<string,string>")
    one = lambda k: F.nullif(F.try_element_at(known, F.lit(k)), F.lit(""))
    return F.coalesce(one("Authorization"), one("x-api-key"), one("api-key"), F.lit(""))


def tenant_key(user: str | Column, headers: str | Column, isolated: Column) -> Column:
    """The shared queue, or where ``isolated`` holds the SHA-256 of ``user:api key``."""
    user = F.col(user) if isinstance(user, str) else user
    own = F.sha2(F.concat(F.coalesce(user, F.lit("")), F.lit(":"), api_key(headers)), 256)
    return F.when(isolated, own).otherwise(SHARED)


def isolation_mode(requests: DataFrame, upstream: str, mode: str, order: Sequence[str], block: Column) -> DataFrame:
    """Adds ``isolated``: whether the last non-empty mode of the upstream, up to this request, was ``enabled``."""
    said = prefix(requests, [upstream], order, block, {"_mode": Fold("last", F.nullif(F.col(mode), F.lit("")))})
    return said.withColumn("isolated", F.coalesce(F.col("_mode") == "enabled", F.lit(False))).drop("_mode")


def rate_limits(jobs: DataFrame, config: DataFrame, host: Column, max_hosts: int = 100_000) -> DataFrame:
    """Adds ``rps`` and ``max_concurrent`` by exact host, else the defaults (the row of ``config`` without a host).

    Defaults that are not positive become 2.0 and 1; entries of a host are taken as they are. Of several entries for a
    host the largest counts. The configuration is broadcast if it has at most ``max_hosts`` rows.
    """
    base = config.where("host is null").agg(F.max("rps").alias("r"), F.max("max_concurrent").alias("c"))
    one = base.select(
        F.when(F.col("r") > 0, F.col("r")).otherwise(DEFAULT_RPS).alias("r"), F.when(F.col("c") > 0, F.col("c")).otherwise(DEFAULT_CONCURRENT).alias("c")
    ).first()  # one row
    known = config.where("host is not null").groupBy("host").agg(F.max(F.struct("rps", "max_concurrent")).alias("_e"))
    if known.limit(max_hosts + 1).count() <= max_hosts:
        known = F.broadcast(known)
    joined = jobs.withColumn("_host", host).join(known.withColumnRenamed("host", "_host"), "_host", "left")
    return joined.withColumns(
        {"rps": F.when(F.col("_e").isNull(), F.lit(one.r)).otherwise(F.col("_e.rps")), "max_concurrent": F.when(F.col("_e").isNull(), F.lit(one.c)).otherwise(F.col("_e.max_concurrent"))}
    ).drop("_host", "_e")
