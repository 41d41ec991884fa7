"""Most frequent values in bounded memory: lossy counting in every partition, then a merge of the summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.sources.tables import shared_dir

SUMMARY = "field_name string, item_value string, seen bigint, missed bigint, buckets bigint"


class LossyCounter:
    """Entries ``value -> [count, most it can have missed before]``, pruned after each bucket of ``width`` values.

    Holds at most ``width * (1 + log(n / width))`` entries after ``n`` values, whatever their distribution. An absent
    value occurred at most ``buckets`` times; a present one at most its two numbers together.
    """

    def __init__(self, width: int):
        self.width, self.buckets, self.entries = width, 0, {}
        self.waiting: list[pa.Array] = []
        self.n_waiting = 0

    def add(self, values: pa.Array) -> None:
        while len(values):
            part = values.slice(0, self.width - self.n_waiting)
            values = values.slice(len(part))
            self.waiting.append(part)
            self.n_waiting += len(part)
            if self.n_waiting == self.width:
                self._count(last=False)

    def _count(self, last: bool) -> None:
        """Take in the bucket gathered; unless it is cut short by the end, prune."""
        counts = pa.chunked_array(self.waiting, pa.string()).value_counts() if self.waiting else []
        missed, entries = self.buckets, self.entries
        if len(counts):
            for value, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True):
                entry = entries.get(value)
                if entry is not None:
                    entry[0] += n
                elif n > 1 or last:  # a new value seen once would be pruned at this boundary
                    entries[value] = [n, missed]
        self.waiting, self.n_waiting = [], 0
        if not last:
            self.buckets = now = missed + 1
            self.entries = {v: e for v, e in entries.items() if e[0] + e[1] > now}

    def end(self) -> dict[str, list[int]]:
        self._count(last=True)
        return self.entries


def summaries(df: DataFrame, fields: Sequence[str], error: float) -> DataFrame:
    """One summary per partition and field; a row without a value carries the rows read and the buckets pruned."""
    width = max(2, int(-(-1 // error)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counters, rows = [LossyCounter(width) for _ in fields], 0
        for batch in batches:
            rows += batch.num_rows
            for counter, column in zip(counters, batch.columns, strict=True):
                column = column.cast(pa.string())
                counter.add(column.filter(pc.fill_null(pc.not_equal(column, ""), False)))
        for field, counter in zip(fields, counters, strict=True):
            entries = counter.end()
            values = [None, *entries]
            seen = [rows, *(e[0] for e in entries.values())]
            missed = [0, *(e[1] for e in entries.values())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([field] * len(values)), pa.array(values, pa.string()), pa.array(seen, pa.int64()), pa.array(missed, pa.int64()), pa.array([counter.buckets] * len(values), pa.int64())],
                names=["field_name", "item_value", "seen", "missed", "buckets"],
            )

    return df.select(*fields).mapInArrow(scan, SUMMARY)


def frequent_items(df: DataFrame, fields: Sequence[str], share: float = 0.01, error: float = 0.001) -> DataFrame:
    """Values that may hold at least ``share`` of all rows: ``field_name, item_value, count_low, count_high``.

    The true count lies in the interval, whose width is at most ``error`` times the rows; no value with the share is
    left out, and at most ``1 / (share - error)`` values per field come out. Nulls and empty strings are no items but
    count as rows. Summaries merge by adding counts and possible misses; a value a summary lacks may have been missed
    there as often as that summary pruned. An empty table gives an empty result.
    """
    return _intervals(df, fields, share, error).drop("total")


def _intervals(df: DataFrame, fields: Sequence[str], share: float, error: float) -> DataFrame:
    """The same with ``total``, the rows of the table as the summaries counted them."""
    if not 0 < error < share <= 1:
        raise ValueError("error must be positive and below share")
    shared_dir(df.sparkSession)
    merged = (
        summaries(df, fields, error)
        .groupBy("field_name", "item_value")
        .agg(F.sum("seen").alias("seen"), F.sum("missed").alias("missed"), F.sum("buckets").alias("buckets"))
        .checkpoint()  # summaries are small; both uses below read them once made
    )
    totals = merged.where("item_value is null").select("field_name", F.col("seen").alias("total"), F.col("buckets").alias("pruned"))
    return (
        merged.where("item_value is not null")
        .join(F.broadcast(totals), "field_name")  # one row per field named
        .withColumn("count_high", F.expr("seen + missed + pruned - buckets"))
        .where(F.col("count_high") >= F.col("total") * F.lit(share))
        .select("field_name", "item_value", F.col("seen").alias("count_low"), "count_high", "total")
    )


def frequent_exact(df: DataFrame, fields: Sequence[str], share_percent: int = 1, error: float = 0.001) -> DataFrame:
    """The values with at least ``share_percent`` of all rows, their intervals and exact counts ``n_rows``.

    A second pass counts the candidates of :func:`frequent_items`; there are at most ``1 / (share - error)`` per field,
    so they are broadcast.
    """
    candidates = _intervals(df, fields, share_percent / 100, error)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("item_value")) for f in fields]))
    counted = (
        df.select(pairs.alias("p")).select("p.*")
        .join(F.broadcast(candidates), ["field_name", "item_value"])
        .groupBy("field_name", "item_value", "count_low", "count_high", "total").agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return counted.where(F.col("n_rows") * 100 >= F.col("total") * share_percent).drop("total")
