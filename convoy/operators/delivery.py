"""Messages delivered at least once: keep one copy, without moving the payloads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.sources.tables import remove, scratch

#: Rows of a file that share one entry of its deletion vector, as a power of two.
CHUNK_BITS = 16
#: Input files whose vectors share a folder, and bytes of a row group of vectors, of which a reader takes those of its file.
FILES_PER_FOLDER, GROUP_BYTES = 32, 4 << 20
BLANKS = " \t\n\r\f\v"


def receipt_key(delivery_id: str = "x_l8_delivery_id", job_id: str = "job_id", stamp: str = "x_l8_timestamp") -> Column:
    """The message a receipt belongs to, or null if it is a message of its own.

    The delivery id counts without letter case and outer blanks; one of blanks only counts as missing. Without it,
    the pair of job and timestamp decides, as written, if both are there.
    """
    d = F.nullif(F.lower(F.btrim(F.col(delivery_id), F.lit(BLANKS))), F.lit(""))
    return F.coalesce(F.concat(F.lit("d"), d), F.concat(F.lit("j"), F.length(job_id).cast("string"), F.lit(":"), F.col(job_id), F.lit(":"), F.col(stamp)))


@dataclass
class DeletionVectors:
    """Row positions of surplus copies, by file, as a table in the shared folder."""

    source: str
    path: str
    folders: int
    spark: SparkSession

    def _read(self, surplus: bool, columns: Sequence[str] | None) -> DataFrame:
        wide = self.spark.read.parquet(self.source)
        is_surplus = _surplus_test(self.path, self.folders)(F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index"))
        # Only the position of a row goes to Python; its payload waits in the JVM.
        return wide.where(is_surplus if surplus else ~is_surplus).select(*(columns or wide.columns))

    def kept(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The first copy of each message, whole rows or the columns named."""
        return self._read(False, columns)

    def surplus(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The copies left out of :meth:`kept`."""
        return self._read(True, columns)

    def drop(self) -> None:
        """Delete the vectors; DataFrames made from them can't be run afterwards."""
        remove(self.spark, self.path)


def first_deliveries(spark: SparkSession, source: str, key: Column, order: Sequence[str]) -> DeletionVectors:
    """Find all but the first row, by ``order``, of each value of ``key`` in the Parquet files under ``source``.

    Rows whose key is null are all first. ``order`` must tell copies apart; where it does not, the row's place in the
    files decides. Nulls in ``order`` come first, as in an ascending sort. An empty source gives empty vectors.

    1. Key, order and position - never the payload - are aggregated to the first position per key, with map-side
       combining, so a message with a third of all rows arrives as one row per task.
    2. Keys with copies are joined back to the narrow rows; all but the winner's position are surplus. A hot key is
       split by adaptive skew joins, as its one winner can be repeated.
    3. Surplus positions are gathered by file and chunk of rows (at most 2**16 to a vector entry) into a table in the
       shared folder, in one file for every ``FILES_PER_FOLDER`` input files, sorted by input file. Payloads are then
       read with the entries of their own file as a filter: a reader opens one file of vectors and reads the row groups
       that hold its own, so work grows with the number of input files and not with its square.
    """
    wide = spark.read.parquet(source)
    folders = max(1, -(-len(wide.inputFiles()) // FILES_PER_FOLDER))
    narrow = (
        wide
        .select(key.alias("k"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("at"))
        .where("k is not null")
    )
    winners = narrow.groupBy("k").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "first")
    surplus = narrow.join(winners, "k").where("at <> first").select(F.col("at.f").alias("f"), F.col("at.r").alias("r"))
    path = scratch(spark, "vectors")
    (
        surplus.groupBy("f", F.shiftright("r", CHUNK_BITS).alias("chunk"))
        .agg(F.collect_list(F.col("r").bitwiseAND((1 << CHUNK_BITS) - 1).cast("int")).alias("rows"))
        .withColumn("folder", F.pmod("f", F.lit(folders)))
        .repartition("folder")
        .sortWithinPartitions("folder", "f", "chunk")
        .write.option("parquet.block.size", GROUP_BYTES).partitionBy("folder").parquet(path)
    )
    return DeletionVectors(source, path, folders, spark)


def _surplus_test(path: str, folders: int):
    """A vectorised predicate over (file, row) that loads a file's vector when it first meets the file."""

    def test(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[int, np.ndarray] = {}
        for files, rows in batches:
            f, r, out = files.to_numpy(), rows.to_numpy(), np.zeros(len(files), dtype=bool)
            for one in np.unique(f):
                if one not in known:
                    if len(known) > 3:
                        known.clear()
                    known[one] = load_vector(path, folders, int(one))
                here = f == one
                vector, at = known[one], r[here]
                if len(vector):
                    found = np.minimum(np.searchsorted(vector, at), len(vector) - 1)
                    out[here] = vector[found] == at
            yield pd.Series(out)

    return F.pandas_udf(test, "boolean")


def load_vector(path: str, folders: int, file: int) -> np.ndarray:
    """The sorted surplus row numbers of one file."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds
    from pyarrow import fs

    place = f"{path}/folder={file % folders}"
    if urlparse(place).scheme in ("", "file"):
        system, place = fs.LocalFileSystem(), unquote(urlparse(place).path)
    else:
        system, place = fs.FileSystem.from_uri(place)
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return np.empty(0, dtype=np.int64)
    found = ds.dataset(place, format="parquet", filesystem=system).to_table(columns=["chunk", "rows"], filter=pc.field("f") == file)
    if not found.num_rows:
        return np.empty(0, dtype=np.int64)
    lists = found["rows"].combine_chunks()
    chunks = np.repeat(found["chunk"].to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return np.sort((chunks << CHUNK_BITS) + lists.flatten().to_numpy().astype(np.int64))
