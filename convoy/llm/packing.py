"""Filling containers of fixed capacity with items that are not split unless they exceed it."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.operators.ranking import rank_in_blocks
from convoy.sources.tables import scratch

#: Blocks into which equal sizes are spread for numbering.
BLOCKS = 1024


class Plan:
    """Which containers take the items of each size; its length depends on the capacity, not on the number of items.

    A run ``(size, first, container, each, n)`` puts the ``n`` items of ``size`` numbered from ``first`` into containers
    from ``container`` on, ``each`` to one.
    """

    def __init__(self, capacity: int, counts: Mapping[int, int]):
        self.capacity, self.containers = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self._left = {s: n for s, n in counts.items() if s > 0 and n > 0}
        self._given = dict.fromkeys(self._left, 0)
        self._gaps: list[int] = []
        self._open: dict[int, list[tuple[int, int]]] = {}
        self._match_large()
        self._fit_small()

    def _new(self, n: int) -> int:
        self.containers += n
        return self.containers - n

    def _put(self, size: int, container: int, each: int, n: int) -> None:
        self.runs.append((size, self._given[size], container, each, n))
        self._given[size] += n
        self._left[size] -= n

    def _gap(self, gap: int, container: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in self._open:
                self._open[gap] = []
                insort(self._gaps, gap)
            self._open[gap].append((container, n))

    def _match_large(self) -> None:
        """Items above a third of the capacity go at most two to a container: the largest with the largest that fits beside it."""
        large = sorted(s for s in self._left if 3 * s > self.capacity)
        while large:
            a = large[-1]
            if not self._left[a]:
                large.pop()
                continue
            b = a
            if 2 * a > self.capacity or self._left[a] < 2:
                at = bisect_left(large, self.capacity - a + 1, 0, len(large) - 1) - 1
                while at >= 0 and not self._left[large[at]]:
                    large.pop(at)
                    at -= 1
                b = large[at] if at >= 0 else 0
            n = self._left[a] // 2 if a == b else min(self._left[a], self._left[b]) if b else self._left[a]
            c = self._new(n)
            if a == b:
                self._put(a, c, 2, 2 * n)
            else:
                self._put(a, c, 1, n)
                if b:
                    self._put(b, c, 1, n)
            self._gap(self.capacity - a - b, c, n)

    def _fit_small(self) -> None:
        """The rest, from the largest, each into the smallest gap that takes it; a new container where none does."""
        for size in sorted((s for s in self._left if 3 * s <= self.capacity), reverse=True):
            while left := self._left[size]:
                at = bisect_left(self._gaps, size)
                if at < len(self._gaps):
                    gap = self._gaps[at]
                    container, n = self._open[gap].pop()
                    if not self._open[gap]:
                        del self._open[gap]
                        self._gaps.pop(at)
                else:
                    gap, n = self.capacity, -(-left // (self.capacity // size))
                    container = self._new(n)
                each = gap // size
                full = min(n, left // each)
                if full:
                    self._put(size, container, each, full * each)
                    self._gap(gap - each * size, container, full)
                rest, some = (self._left[size], 1) if full < n else (0, 0)
                if some and rest:
                    self._put(size, container + full, rest, rest)
                    self._gap(gap - rest * size, container + full, 1)
                    full += 1
                self._gap(gap, container + full, n - full)

    def lookup(self) -> tuple[np.ndarray, ...]:
        """Sizes, where each one's runs begin and end, then the runs by (size, first): first item, container, items to each.

        Numbers stay whole numbers of 64 bits and are never packed together, so sizes and counts have no common bound.
        """
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        sizes, begin = np.unique(runs[:, 0], return_index=True)
        return sizes, begin, np.append(begin[1:], len(runs)), runs[:, 1], runs[:, 2], runs[:, 3]


def containers_of(lookup: tuple[np.ndarray, ...], sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The containers of items of ``sizes`` (each one known to the plan) by their numbers among those of their size, from 0."""
    known, begin, end, first, container, each = lookup
    out = np.empty(len(sizes), dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        at = int(np.searchsorted(known, sizes[part[0]]))
        if at == len(known) or known[at] != sizes[part[0]]:
            raise ValueError(f"no item of size {sizes[part[0]]} was counted")
        run = begin[at] + np.searchsorted(first[begin[at] : end[at]], numbers[part], side="right") - 1
        out[part] = container[run] + (numbers[part] - first[run]) // each[run]
    return out


def sized_pieces(sizes: DataFrame, item_id: str, size: str, capacities: Sequence[tuple[int, int]]) -> DataFrame:
    """Items cut into pieces no larger than each capacity: ``cap_id, capacity, <item_id>, piece, n_tokens``."""
    caps = F.explode(F.array(*[F.struct(F.lit(i).alias("cap_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in capacities]))
    last = F.greatest(F.lit(0), F.floor((F.col("s") - 1) / F.col("capacity")))
    return (
        sizes.select(F.col(item_id), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("s"), caps.alias("c"))
        .select("*", "c.cap_id", "c.capacity")
        .select("cap_id", "capacity", item_id, "s", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .select("cap_id", "capacity", item_id, "piece", F.least("capacity", F.col("s") - F.col("piece") * F.col("capacity")).alias("n_tokens"))
    )


def pack(sizes: DataFrame, item_id: str, size: str, capacities: Sequence[tuple[int, int]]) -> DataFrame:
    """Assign every item to a container of each capacity: ``cap_id, <item_id>, piece, n_tokens, container``.

    ``capacities`` are (id, capacity) pairs. An item above the capacity fills containers of its own; only what remains
    (piece numbers count from 0) is packed. Items of null or no size take no space and are spread over the containers.
    Equal sizes are interchangeable, so the packing is worked out on counts per size - at most one per unit of capacity,
    however many items there are - and covers all items at once, with no shards that each leave a rest. Items then find
    their container by their number among the items of their size.
    """
    spark = sizes.sparkSession
    pieces = sized_pieces(sizes, item_id, size, capacities)
    counts = pieces.groupBy("cap_id", "n_tokens").count().collect()  # bounded by the capacities
    plans = {i: Plan(c, {r.n_tokens: r["count"] for r in counts if r.cap_id == i}) for i, c in capacities}
    known = spark.sparkContext.broadcast({i: (p.lookup(), p.containers) for i, p in plans.items()})

    @F.pandas_udf("bigint")
    def container(cap: pd.Series, tokens: pd.Series, number: pd.Series, spread: pd.Series) -> pd.Series:
        out, caps = np.zeros(len(cap), dtype=np.int64), cap.to_numpy()
        t, k, h = tokens.to_numpy(), number.to_numpy() - 1, spread.to_numpy()
        for one in np.unique(caps):
            plan, n = known.value[int(one)]
            here = np.flatnonzero((caps == one) & (t > 0))
            if len(here):
                out[here] = containers_of(plan, t[here], k[here])
            empty = np.flatnonzero((caps == one) & (t <= 0))
            out[empty] = h[empty] % max(1, n)
        return pd.Series(out)

    block = F.pmod(F.xxhash64(item_id, "piece"), F.lit(BLOCKS))
    numbered = rank_in_blocks(pieces, ["cap_id", "n_tokens"], [item_id, "piece"], block, "number")
    spread = F.shiftrightunsigned(F.xxhash64(item_id), 2)
    return numbered.select("cap_id", item_id, "piece", "n_tokens", container("cap_id", "n_tokens", "number", spread).alias("container"))


def measured(docs: DataFrame, item_id: str, tokens) -> DataFrame:
    """Item ids and sizes, worked out once and kept in the shared folder."""
    path = scratch(docs.sparkSession, "sizes")
    docs.select(item_id, tokens.alias("n_tokens")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)
