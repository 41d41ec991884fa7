"""Writers and lenient readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is known of a request that comes as JSON; other fields are ignored.
REQUEST = T.StructType([T.StructField(n, T.StringType()) for n in ("user_id", "idempotent_key", "url", "pool_id", "method", "body", "webhook_url")] + [T.StructField("headers", T.MapType(T.StringType(), T.StringType()))])


#: Bytes of the longest line that is read as a request (fixed value).
MAX_LINE = 16 << 20


def read_requests(spark: SparkSession, path: str, stream: bool = False, max_line: int = MAX_LINE) -> DataFrame:
    """Requests from files of JSON lines, with ``bad_line``: the text of a line that is no JSON object, else null.

    Of a line of more than ``max_line`` bytes nothing is kept but a note of its length. Blank lines are none.
    """
    schema = T.StructType([*REQUEST.fields, T.StructField("bad_line", T.StringType())])
    lines = (spark.readStream if stream else spark.read).text(path).where(F.btrim("value") != "")
    long = F.octet_length("value") > max_line
    parsed = F.from_json(F.when(~long, F.col("value")), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"})
    note = F.concat(F.lit("line of "), F.octet_length("value").cast("string"), F.lit(" bytes"))
    names = [f.name for f in REQUEST.fields]
    kept = lines.select(parsed.alias("r"), F.when(long, note).alias("n"))
    return kept.select(*[F.col(f"r.{n}").alias(n) for n in names], F.coalesce("n", "r.bad_line").alias("bad_line"))


def parse_records(rows: DataFrame, value: str, schema: str) -> DataFrame:
    """The rows of ``value`` (JSON text) that parse, as columns; others are skipped, as in a scan of a key-value store."""
    parsed = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select(parsed.alias("r")).where("r is not null").select("r.*")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header in each."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str, available_now: bool = True):
    """Start a stream into Parquet whose batches can be repeated without repeating rows: each batch overwrites its own
    folder, so a batch run again after a failure replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def config_rows(spark: SparkSession, config: dict) -> DataFrame:
    """Rate limits from a parsed configuration (``defaults`` and ``upstreams`` of ``rps`` and ``max_concurrent``): ``host, rps, max_concurrent``."""
    entries = [(None, config.get("defaults") or {}), *(config.get("upstreams") or {}).items()]
    rows = [(h, float(c.get("rps") or 0), int(c.get("max_concurrent") or 0)) for h, c in entries]
    return spark.createDataFrame(rows, "host string, rps double, max_concurrent int")
