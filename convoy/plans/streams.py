"""Queries that run a stream over the test tables to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.columns import epoch_ms
from convoy.operators.sessions import sessionize_stream
from convoy.operators.store import idempotency_hash
from convoy.plans.pools import SQL as POOLS
from convoy.plans.problems import SQL as PROBLEMS
from convoy.plans.views import DAY_US, OUTCOME_ORDER, micros, with_
from convoy.sources.tables import scratch, table, table_path
from convoy.streaming import jobs as streaming


def _source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The files of one table as a stream. A stream's path must be a folder or a pattern; this pattern fits both."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{table_path(sf, name)[:-1]}[t]")


def _finish(stream: DataFrame, mode: str = "append", out: str | None = None) -> DataFrame:
    """Run to the end of the input into a table of the shared folder, and read it."""
    spark, out = stream.sparkSession, out or scratch(stream.sparkSession, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(f"{out}/rows")
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows/batch={i}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One request per key; the watermark keeps keys for the 30 days the table covers."""
    e = _source(spark, sf, "events").withColumns({"idem_hash": idempotency_hash("user_id", F.get_json_object("props", "$.k").cast("bigint")), "at": F.col("ts").cast("timestamp")})
    return _finish(streaming.first_only(e.select("idem_hash", "at"), "idem_hash", "at", "40 days")).select("idem_hash")


#: An instant after all events, by which a finite input is known to be at its end.
END_MS = 32_503_680_000_000


def stream_sessions(spark: SparkSession, sf: str, files_per_batch: int | None = None) -> DataFrame:
    """All sessions of the jobs. The watermark closes them 10 days behind the newest job (rows are exported up to 9 days late).

    At the end of the input the query goes on from its checkpoint with one row of a far later time, which closes those
    still open; its own session stays open and does not come out.
    """
    out = scratch(spark, "stream")
    name = "jobs"
    schema = table(spark, sf, name).schema
    last = spark.createDataFrame([("end", "end", END_MS)], "id string, user_id string, created_at bigint").coalesce(1)

    def sessions(path: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        j = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path).withColumn("at", F.timestamp_millis(epoch_ms("created_at")))
        return sessionize_stream(j.select("user_id", "at", "id"), "user_id", "at", event_id="id")

    with streaming.settings(spark, spark__sql__streaming__sessionWindow__merge__sessions__in__local__partition="true"):
        _finish(sessions(f"{table_path(sf, name)[:-1]}[t]"), out=out)
        last.write.parquet(f"{out}/end")
        # A pattern again: a plain folder would be taken for the base of the files read before.
        return _finish(sessions(f"{out}/en[d]"), out=out)


def stream_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each member at the end: what came out last of all batches."""
    kind = F.when(F.col("l_returnflag") == "R", "failure").when(F.col("l_returnflag") == "A", "success").otherwise("heartbeat")
    li = _source(spark, sf, "lineitem").select(F.col("l_suppkey").alias("member_id"), kind.alias("kind"), micros("l_shipdate").alias("at_us"), *OUTCOME_ORDER[1:])
    with streaming.enable_state(spark):
        out = _finish(streaming.reputation(li, OUTCOME_ORDER), "update")
    return out.groupBy("member_id").agg(F.round(F.max_by("reputation", "n_events") + 1e-9, 6).alias("reputation"), F.max("n_events").alias("n_events"))


def stream_lost_members(spark: SparkSession, sf: str) -> DataFrame:
    h = _source(spark, sf, "heartbeats").where("pool_id <> '' and member_id <> '' and address <> '' and capacity_rps > 0")
    b = h.select("pool_id", "member_id", micros("beat_at").alias("at_us"), (F.greatest(F.col("heartbeat_interval_seconds"), F.lit(0)).cast("bigint") * 1_000_000).alias("interval_us"), F.col("beat_at").cast("timestamp").alias("at"))
    with streaming.enable_state(spark):
        return _finish(streaming.lost_members(b, "at", "1 day"))


QUERIES = {f.__name__: f for f in (stream_dedup, stream_sessions, stream_reputation, stream_lost_members)}
SQL = {
    "stream_dedup": "select distinct sha256(user_id || ':' || (props->>'$.k')) as idem_hash from events",
    "stream_sessions": f"select user_id, start_ms, end_ms, duration_ms, n_jobs as n_events from ({PROBLEMS['p1_sessions']})",
    "stream_reputation": POOLS["reputation_final"],
    # Silences that a beat ended, and those whose deadline the watermark, a day behind the newest beat, has passed.
    "stream_lost_members": with_("beats")
    + f"""select pool_id, member_id, at_us, at_us + 3 * interval_us as lost_us from (select *, lead(at_us) over (partition by pool_id, member_id order by at_us, hb_id) as next_us from beats)
        where interval_us > 0 and (next_us > at_us + 3 * interval_us or next_us is null and (at_us + 3 * interval_us) // 1000 + 1 <= ((select max(at_us) from beats) - {DAY_US}) // 1000)""",
}
