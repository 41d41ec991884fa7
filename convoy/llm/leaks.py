"""Passages of held-out test items inside a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.functions.columns import spare
from convoy.llm.words import placed_words, words

#: Consecutive words that make a passage.
WINDOW = 12
#: Characters of test items whose n-grams are held, and broadcast, at a time: some 70 bytes for each of about a million n-grams.
BLOCK_CHARS = 4_000_000
#: How often :func:`remove_leaks` looks at its own result again.
ROUNDS = 2


class NGrams:
    """The word n-grams of some items as flat arrays: sorted hashes, the words behind each, and the items that have it."""

    def __init__(self, items: list[tuple[int, str]], n: int = WINDOW):
        self.n, self.vocabulary = n, {}
        with np.errstate(over="ignore"):
            self.factors = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64))
        own, parts = [], []
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")], dtype=np.int32)
            if len(ids) >= n:
                parts.append(np.lib.stride_tricks.sliding_window_view(ids, n))
                own.append(np.full(len(parts[-1]), item, dtype=np.int64))
        table = np.concatenate(parts) if parts else np.empty((0, n), dtype=np.int32)
        item = np.concatenate(own) if own else np.empty(0, dtype=np.int64)
        hashes = self._hash(table)
        order = np.lexsort((item, *table.T, hashes))  # by hash, then words, then item
        table, item, hashes = table[order], item[order], hashes[order]
        new = np.ones(len(table), dtype=bool)
        new[1:] = (table[1:] != table[:-1]).any(axis=1)
        once = new.copy()  # an item that has the n-gram twice counts once
        once[1:] |= item[1:] != item[:-1]
        self.hashes, self.table = hashes[new], table[new]
        self.item, self.begin = item[once], np.flatnonzero(new[once])

    def items(self, gram: int) -> np.ndarray:
        return self.item[self.begin[gram] : self.begin[gram + 1] if gram + 1 < len(self.begin) else None]

    def _hash(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for column, factor in zip(windows.T, self.factors, strict=True):
                out += (column.astype(np.uint64) + np.uint64(1)) * factor
        return out

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text, place of the first word of the window, gram) for every window of a text that is a gram of an item."""
        get, n = self.vocabulary.get, self.n
        ids: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(ids))
            ids.extend([get(w, -1) for w in words(text)] if text else ())
            ids.append(-1)  # no window crosses texts
        a = np.array(ids, dtype=np.int32)
        if len(a) < n or not len(self.hashes):
            return []
        unknown = np.concatenate(([0], np.cumsum(a < 0)))
        at = np.flatnonzero(unknown[n:] == unknown[:-n])  # windows of words that all occur in items
        found = []
        for part in np.array_split(at, max(1, len(at) // 65536)):
            windows = a[part[:, None] + np.arange(n)]
            h = self._hash(windows)
            gram = np.searchsorted(self.hashes, h)
            while len(part):  # grams with equal hashes stand side by side; each hit is verified word by word
                live = gram < len(self.hashes)
                live[live] = self.hashes[gram[live]] == h[live]
                part, windows, h, gram = part[live], windows[live], h[live], gram[live]
                same = (self.table[gram] == windows).all(axis=1)
                text = np.searchsorted(starts, part[same], side="right") - 1
                found += [(t, p - starts[t], g) for t, p, g in zip(text.tolist(), part[same].tolist(), gram[same].tolist(), strict=True)]
                part, windows, h, gram = part[~same], windows[~same], h[~same], gram[~same] + 1
        return found


def item_blocks(items: DataFrame, item_id: str, text: str, n: int, block_chars: int = BLOCK_CHARS) -> list:
    """Broadcast sets of n-grams, one for each block of some ``block_chars`` of item text.

    A usual set of test items is one block. A larger one is taken block by block, each against the whole corpus, so what
    is held at a time is bounded whatever the number of items; what is found in all blocks is put together.
    """
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    out = []
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b)
        out.append(items.sparkSession.sparkContext.broadcast(NGrams([(r[0], r[1]) for r in part.select(item_id, text).collect() if r[0] is not None], n)))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", n: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row ``doc_id, item_id`` for each document that contains ``n`` consecutive words of an item.

    Words are runs of letters or digits without letter case; markup counts as blanks, entities as characters. Null and
    short texts leak nothing, as do items of fewer than ``n`` words; items without an id are left out. Documents are
    scanned where they are read; only hits leave a task. Rows repeat neither within a document row nor, after the final
    ``distinct`` over hits, across copies of a document id.
    """
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    result = None
    for grams in item_blocks(items, item_id, item_text, n, block_chars):
        part = source.mapInArrow(_scanner(grams), f"d {dict(source.dtypes)['d']}, i bigint")
        result = part if result is None else result.unionByName(part)
    return result.distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def _scanner(grams):
    """Ids pass as Arrow values, so that null ids do not turn their neighbours into floating point."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = grams.value
        for batch in batches:
            pairs = sorted({(t, int(i)) for t, _, g in own.hits(batch.column(1).to_pylist()) for i in own.items(g)})
            rows = pa.array([t for t, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([i for _, i in pairs], pa.int64())], names=["d", "i"])

    return scan


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (begin, end)."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            out.append(text[at : max(a, at)])
            at = b
    return "".join([*out, text[at:]])


def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "item_text", n: int = WINDOW, max_share: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with leaked passages cut out of ``text``, all other columns as they are, and ``n_cut`` (characters).

    A document of whose words more than ``max_share`` are leaked is left out. Null texts stay null. Passages are looked
    for in the whole text and for all items before anything is cut, so the result does not depend on ``block_chars``.
    What stood on both sides of a cut may form a passage anew; ``ROUNDS`` further looks at texts that were cut remove
    it, too.
    """
    cleaned = docs.withColumn("n_cut", F.lit(0).cast("bigint"))
    c, at = spare(cleaned, "c", "at")
    blocks = item_blocks(items, item_id, item_text, n, block_chars)
    cutter = F.pandas_udf(_cut_runs, "text string, cut bigint, share double").asNondeterministic()
    for look in range(1 + ROUNDS):
        now = F.when(F.lit(look == 0) | (F.col("n_cut") > 0), F.col(text))
        runs = F.array_compact(F.array(*[_finder(grams, n)(now) for grams in blocks]))
        cleaned = cleaned.withColumn(at, F.flatten(runs)).withColumn(c, F.when(F.size(at) > 0, cutter(text, at)))
        if look == 0:
            cleaned = cleaned.where(F.coalesce(F.col(f"{c}.share") <= max_share, F.lit(True)))
        cleaned = cleaned.withColumns({text: F.coalesce(f"{c}.text", text), "n_cut": F.col("n_cut") + F.coalesce(f"{c}.cut", F.lit(0))}).drop(c, at)
    return cleaned


def _finder(grams, n: int):
    """A vectorised function: runs (first and last word) of leaked words; null where there are none."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = grams.value
        for texts in batches:
            runs: dict[int, list[list[int]]] = {}
            for t, p, _ in sorted(own.hits(texts.tolist())):
                known = runs.setdefault(t, [])
                if known and p <= known[-1][1] + 1:
                    known[-1][1] = p + n - 1
                else:
                    known.append([p, p + n - 1])
            yield pd.Series([runs.get(t) for t in range(len(texts))], dtype=object)

    return F.pandas_udf(find, "array<array<int>>").asNondeterministic()  # evaluated once, not again wherever its column is used


def _cut_runs(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """Texts without the words of the runs, characters cut, share of words cut."""
    rows = []
    for text, own in zip(texts, runs, strict=True):
        if text is None or own is None or not len(own):
            rows.append((text, 0, 0.0))
            continue
        placed, spans, words_cut, done = placed_words(text), [], 0, -1
        for first, last in sorted(map(tuple, own)):
            first = max(first, done + 1)
            if first <= last:
                if first == done + 1 and spans:
                    spans[-1] = (spans[-1][0], placed[last][2])
                else:
                    spans.append((placed[first][1], placed[last][2]))
                words_cut, done = words_cut + last - first + 1, last
        short = cut(text, spans)
        rows.append((short, len(text) - len(short), words_cut / len(placed)))
    return pd.DataFrame(rows, columns=["text", "cut", "share"])
