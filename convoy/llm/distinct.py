"""Distinct identifiers per group and combination of groups, from membership patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions.columns import text


def memberships(df: DataFrame, fields: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """The mergeable partial result: one row per field, identifier and cell (combination of groups) that holds it.

    Columns ``field_name, i1, i2`` and the groups; an identifier is carried as two 64-bit hashes, so its length does not
    matter (two of 10**11 identifiers share both with a probability under 10**-16). Null and empty identifiers are none.
    Partial results of several inputs merge by :func:`merge_memberships`.
    """
    ids = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.xxhash64(F.col(f)).alias("i1"), F.xxhash64(F.lit(7), F.col(f)).alias("i2"), text(f).isNotNull().alias("there"))
        for f in fields
    ]))
    return df.select(ids.alias("__id"), *groups).where("__id.there").select("__id.field_name", "__id.i1", "__id.i2", *groups).distinct()


def merge_memberships(*parts: DataFrame) -> DataFrame:
    """The partial result of all inputs together."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.distinct()


def pattern_totals(cells: DataFrame) -> DataFrame:
    """Patterns of membership and how many identifiers have each: ``field_name, p1, p2, n_ids`` and a row per cell.

    The pattern of an identifier is the set of its cells. It is never gathered: the exclusive or of two hashes of each
    cell, and their number, stand for the set (an aggregate with map-side combining), identical ones are counted, and
    the cells are those of one identifier that represents the pattern. A null group is a group of its own.
    """
    groups = [c for c in cells.columns if c not in ("field_name", "i1", "i2")]
    # xxhash64 passes nulls over, so each group's null flag is hashed with it: ('a', null) and (null, 'a') are two cells.
    hashed = [F.bit_xor(F.xxhash64(F.lit(seed), *[x for g in groups for x in (F.col(g).isNull(), F.col(g))])).alias(f"x{seed}") for seed in (1, 2)]
    sets = cells.groupBy("field_name", "i1", "i2").agg(*hashed, F.count(F.lit(1)).alias("n_cells"))
    patterns = sets.groupBy("field_name", "x1", "x2", "n_cells").agg(F.count(F.lit(1)).alias("n_ids"), F.min(F.struct("i1", "i2")).alias("rep"))
    stands_for = patterns.select("field_name", F.col("rep.i1").alias("i1"), F.col("rep.i2").alias("i2"), "n_ids")
    return cells.join(stands_for, ["field_name", "i1", "i2"]).withColumnsRenamed({"i1": "p1", "i2": "p2"})


def distinct_counts(patterns: DataFrame, by: Sequence[Sequence[str]]) -> DataFrame:
    """Exact counts for each grouping in ``by``: ``field_name``, all groups (null where not grouped by), ``level``, ``n_distinct``.

    ``level`` is the grouping's place in ``by``. A pattern counts once in each group one of its cells lies in.
    """
    groups = [c for c in patterns.columns if c not in ("field_name", "p1", "p2", "n_ids")]
    kind = dict(patterns.dtypes)
    levels = F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), *[(F.col(g) if g in one else F.lit(None).cast(kind[g])).alias(g) for g in groups]) for i, one in enumerate(by)
    ]))
    spread = patterns.select("field_name", "p1", "p2", "n_ids", levels.alias("__l")).select("field_name", "p1", "p2", "n_ids", "__l.*").distinct()
    return spread.groupBy("field_name", "level", *groups).agg(F.sum("n_ids").alias("n_distinct"))


def distinct_within(patterns: DataFrame, cells: Column) -> DataFrame:
    """Exact distinct counts over the union of any cells: ``field_name, n_distinct`` for the cells where ``cells`` holds."""
    touched = patterns.where(cells).select("field_name", "p1", "p2", "n_ids").distinct()
    return touched.groupBy("field_name").agg(F.sum("n_ids").alias("n_distinct"))
