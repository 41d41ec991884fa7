"""Ordered folds within keys that may hold any share of the table.

A fold over a key's rows in order - a number, a running sum or extreme, the last value so far - is computed in two
levels: rows are folded inside blocks of a key, blocks are folded among themselves, and each row combines what came
before its block with what came before it inside. No task ever holds more than one block of a key, and blocks that hold
more than ``SPLIT_ROWS`` rows are cut at quantiles of their own order, so a block does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.functions.columns import spare


#: Rows beyond which a block is cut, and into how many pieces at most, in two steps of the square root of it.
SPLIT_ROWS, STEP = 1_000_000, 32
#: Input of fewer bytes cannot hold blocks worth cutting; counting them is left out (the plan differs, the result does not).
SPLIT_BYTES = 64 << 20


class Fold(NamedTuple):
    """``kind`` is count, sum, max, min or last (the last value that is not null); ``before`` leaves out the row itself."""

    kind: str
    value: Column | None = None
    before: bool = False


class Then(NamedTuple):
    """A running max or min of ``value``, an expression that may name other folds of the same call.

    Inside a block those are still without what came before it; ``shift``, an expression of what came before them, is
    what that adds to ``value``.
    """

    kind: str
    value: Column
    shift: Column


_HOW = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min, "last": F.max}


def prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, folds: Mapping[str, Fold], then: Mapping[str, Then] | None = None, split_rows: int | None = None) -> DataFrame:
    """``df`` with a column per fold, over the rows of the same ``keys`` up to each row in ``order``.

    ``block`` must never fall while ``order`` rises; rows whose block is null form one. Null keys form one group, as in
    SQL windows. Equal rows in ``order`` are taken one after the other, so it should be total. Counts and sums of
    nothing are 0, other folds of nothing null. Rows are shuffled once, by key and block; blocks are few. Blocks of more
    than ``split_rows`` rows are cut if the first column of ``order`` is a number (see :func:`cut_blocks`).
    """
    then = then or {}
    (t,) = spare(df, "")
    keys_safe = {f"{t}k{i}": F.struct(F.col(k)) for i, k in enumerate(keys)}  # a struct of null joins as equal
    k = [*keys_safe]
    values = {
        f"{t}e_{n}": F.lit(1).cast("bigint") if f.kind == "count" else F.when(f.value.isNotNull(), F.struct(F.struct(*order), f.value.alias("v"))) if f.kind == "last" else f.value
        for n, f in folds.items()
    }
    marked = df.withColumns(keys_safe | values | {f"{t}b": F.struct(block.alias("b"), F.lit(0).alias("p"))})
    marked = cut_blocks(marked, k, f"{t}b", order[0], split_rows or SPLIT_ROWS)
    inside = Window.partitionBy(*k, f"{t}b").orderBy(*order)

    def nothing(f: Fold, c: Column) -> Column:
        return F.coalesce(c, F.lit(0)) if f.kind in ("count", "sum") else c

    local = marked.withColumns({n: nothing(f, _HOW[f.kind](f"{t}e_{n}").over(inside.rowsBetween(Window.unboundedPreceding, -1 if f.before else 0))) for n, f in folds.items()})
    if then:
        local = local.withColumns({f"{t}e_{n}": x.value for n, x in then.items()})
        summed = local
        local = local.withColumns({n: _HOW[x.kind](f"{t}e_{n}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n, x in then.items()})
    else:
        summed = marked  # blocks add up without windows, and before the shuffle
    blocks = summed.groupBy(*k, f"{t}b").agg(*[_HOW[f.kind](f"{t}e_{n}").alias(f"{t}t_{n}") for n, f in (folds | then).items()])
    earlier = Window.partitionBy(*k).orderBy(f"{t}b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumns({n: nothing(f, _HOW[f.kind](f"{t}t_{n}").over(earlier)) for n, f in folds.items()})
    if then:
        offsets = offsets.withColumns({f"{t}s_{n}": x.shift for n, x in then.items()})
        offsets = offsets.withColumns({n: _HOW[x.kind](F.col(f"{t}t_{n}") + F.col(f"{t}s_{n}")).over(earlier) for n, x in then.items()})
    offsets = offsets.select(*k, f"{t}b", *[F.col(n).alias(f"{t}o_{n}") for n in (*folds, *then)], *[f"{t}s_{n}" for n in then])
    out = {}
    for n, f in (folds | then).items():
        here, before = F.col(n) + F.col(f"{t}s_{n}") if n in then else F.col(n), F.col(f"{t}o_{n}")
        both = here + before if f.kind in ("count", "sum") else (F.least if f.kind == "min" else F.greatest)(before, here)
        out[n] = both["v"] if f.kind == "last" else both
    return local.join(offsets, [*k, f"{t}b"]).withColumns(out).select(*[c for c in df.columns if c not in out], *out)


def input_bytes(df: DataFrame) -> int:
    """Bytes of what ``df`` reads, as the optimizer knows them without running anything."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def cut_blocks(marked: DataFrame, keys: Sequence[str], block: str, at: str, split_rows: int) -> DataFrame:
    """``marked`` with the piece ``p`` of its ``block`` (a struct of b and p) that each row belongs to.

    Blocks are counted with map-side combining. Those above ``split_rows`` are cut at quantiles of ``at`` into at most
    ``STEP`` squared pieces of about equal size, however unevenly their rows lie in time; equal values stay together. The
    cuts are small arrays joined back by key and block, where a hot block can be split; without such blocks the joins
    fall away at run time.
    """
    if dict(marked.dtypes)[at] not in ("tinyint", "smallint", "int", "bigint", "float", "double") or input_bytes(marked) < SPLIT_BYTES:
        return marked
    (q,) = spare(marked, "cuts")
    on = [*keys, block]
    hot = marked.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_rows).drop("n")
    points = F.array(*[F.lit((i + 1) / STEP**2) for i in range(STEP**2 - 1)])
    cuts = marked.join(hot, on, "left_semi").groupBy(*on).agg(F.array_distinct(F.percentile_approx(at, points, 10_000)).alias(q))
    # Coarse cuts first, then the fine ones between two of them: some 64 comparisons a row.
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(STEP)), lambda i: F.get(F.col(q), i * STEP - 1)), lambda x: x <= F.col(at)))
    fine = F.size(F.filter(F.slice(F.col(q), coarse * STEP + 1, F.lit(STEP)), lambda x: x <= F.col(at)))
    piece = F.when(F.col(q).isNull() | F.col(at).isNull(), F.lit(0)).otherwise(coarse * STEP + fine)
    return marked.join(cuts, on, "left").withColumn(block, F.struct(F.col(f"{block}.b").alias("b"), piece.cast("int").alias("p"))).drop(q)


def blocks_of(at: str | Column, length: int) -> Column:
    """Blocks of ``length`` units of an integer time."""
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.lit(length))


def rank_in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str = "position") -> DataFrame:
    """``row_number`` per key, from 1."""
    return prefix(df, keys, order, block, {out: Fold("count")})


def mark_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """``df`` with ``first``, the struct of ``order`` of the key's first row (for which ``where`` holds; null if none).

    The first rows are found by an aggregate with map-side combining and joined back, where a hot key can be split,
    as its one first row can be repeated. Null keys form one group.
    """
    at, t = spare(df, "at", "k")
    k = {f"{t}{i}": F.struct(F.col(x)) for i, x in enumerate(keys)}
    marked = df.withColumns(k | {at: F.struct(*order)})
    firsts = marked.groupBy(*k).agg(F.min(F.when(where, F.col(at)) if where is not None else F.col(at)).alias("first"))
    return marked.join(firsts, [*k]).select(*[c for c in marked.columns if c not in (*k, at, "first")], firsts["first"])
