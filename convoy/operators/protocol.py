"""Rules on data of the signing protocol: replay, time window and the message that is signed. Nothing is signed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions.columns import spare

#: How far a timestamp may lie from the time of receipt, either way, in seconds (fixed value).
WINDOW_S = 300


def replays(challenges: DataFrame, nonce: str, stamp_s: Column, received_s: Column, tie: str, memory_s: int = WINDOW_S) -> DataFrame:
    """Adds ``verdict``: ``stale`` if the timestamp lies over five minutes off, ``replayed`` if the nonce was still
    remembered from an earlier challenge in time (by receipt, then ``tie``), else ``ok``.

    A nonce is remembered for ``memory_s`` seconds from the first use in time, whatever becomes of that challenge; a
    replay does not renew it, and the first use after that begins a new life of the nonce. Forgetting is exact, not
    rounded to a periodic look. A null nonce is one of its own; a null time of receipt is stale.

    Where a life begins depends on the one before, so uses are reduced to one per nonce and second, cut into stretches
    without a silence of ``memory_s`` (a silence always ends a life), and each stretch - at most one number a second - is
    walked in order. Lives lie more than ``memory_s`` apart, so every challenge finds its life by an equality join on two
    buckets of time, where a hot nonce can be split.
    """
    r, fresh, s, t, b, n = spare(challenges, "r", "f", "s", "t", "b", "n")
    marked = challenges.withColumns({r: received_s.cast("bigint"), fresh: F.coalesce(F.abs(received_s - stamp_s) <= WINDOW_S, F.lit(False)), n: F.col(nonce)})
    uses = marked.where(F.col(fresh) & F.col(n).isNotNull()).groupBy(n, r).agg(F.min(tie).alias(t))
    stretches = uses.groupBy(n, F.session_window(F.timestamp_seconds(r), f"{memory_s} seconds 500 milliseconds")).agg(F.array_sort(F.collect_list(F.struct(F.col(r).alias("r"), F.col(t).alias("t")))).alias("u"))
    lives = F.aggregate("u", F.slice("u", 1, 1), lambda found, use: F.when(use["r"] - F.element_at(found, -1)["r"] > memory_s, F.concat(found, F.array(use))).otherwise(found))
    begun = stretches.select(n, F.explode(lives).alias("l")).select(n, F.col("l.r").alias(s), F.col("l.t").alias(t))
    bucket = F.floor(F.col(s) / F.lit(memory_s))
    begun = begun.select("*", F.explode(F.array(bucket, bucket + 1)).alias(b)).withColumn(fresh, F.lit(True))
    joined = marked.withColumn(b, F.floor(F.col(r) / F.lit(memory_s))).alias("c").join(
        begun.alias("l"), (F.col(f"c.{n}") == F.col(f"l.{n}")) & (F.col(f"c.{b}") == F.col(f"l.{b}")) & (F.col(f"c.{fresh}") == F.col(f"l.{fresh}")) & F.col(f"c.{r}").between(F.col(f"l.{s}"), F.col(f"l.{s}") + memory_s), "left"
    )
    again = F.struct(F.col(f"c.{r}"), F.col(f"c.{tie}")) > F.struct(F.col(f"l.{s}"), F.col(f"l.{t}"))
    verdict = F.when(~F.col(f"c.{fresh}"), "stale").when(F.col(f"l.{s}").isNotNull() & again, "replayed").otherwise("ok")
    return joined.select(*[F.col(f"c.{c}") for c in challenges.columns if c != "verdict"], verdict.alias("verdict"))


def challenge_message(challenge_id: str, nonce: str) -> Column:
    return F.concat(F.coalesce(F.col(challenge_id), F.lit("")), F.lit(":"), F.coalesce(F.col(nonce), F.lit("")))


def delivery_digest(delivery_id: str, stamp: str, body: str) -> Column:
    """``delivery id . timestamp . base64(sha256(body))``; null without id or timestamp, a null body counts as empty."""
    return F.concat(F.col(delivery_id), F.lit("."), F.col(stamp), F.lit("."), F.base64(F.unhex(F.sha2(F.coalesce(F.col(body), F.lit("")), 256))))
