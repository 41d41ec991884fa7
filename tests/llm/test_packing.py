"""Packing against a plain best fit over all items, and its rules."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.llm.packing import Plan, containers_of, measured, pack
from convoy.llm.tokens import VOCABULARY, encoding, token_counter


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def filled(plan):
    load, items = defaultdict(int), Counter()
    for size, first, container, each, n in plan.runs:
        assert first == items[size]
        items[size] += n
        for i in range(n):
            load[container + i // each] += size
    return load, items


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 500])
    sizes = [min(capacity, max(1, int(r.paretovariate(r.choice([0.5, 1.2])) * capacity / 20))) for _ in range(r.randint(1, 400))]
    plan = Plan(capacity, Counter(sizes))
    load, items = filled(plan)
    assert items == Counter(sizes) and max(load.values()) <= capacity and len(load) == plan.containers
    assert plan.containers <= best_fit(sizes, capacity) + 1
    large = Counter(c + i // each for s, _, c, each, n in plan.runs if 3 * s > capacity for i in range(n))
    assert max(large.values(), default=0) <= 2


def test_plan_length_does_not_grow_with_items():
    r = random.Random(1)
    counts = Counter(r.randint(1, 512) for _ in range(5000))
    many = Plan(512, {s: n * 1_000_000 for s, n in counts.items()})
    assert len(many.runs) < 20_000 and sum(n for *_, n in many.runs) == 5_000_000_000


def test_pack(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0, None, 5, 5, 5, 9, 33, 64, 65, 150])) for i in range(900)] + [(1, 5), (None, 9)]
    df = spark.createDataFrame([(*x, "c", 3) for x in rows], "doc_id bigint, n bigint, cap_id string, piece int").repartition(5)
    out = pack(df, "doc_id", "n", [(1, 64), (2, 100)]).collect()
    for cap, capacity in ((1, 64), (2, 100)):
        own = [x for x in out if x.cap_id == cap]
        load = Counter()
        for x in own:
            load[x.container] += x.n_tokens
        assert max(load.values()) <= capacity and set(load) == set(range(max(load) + 1))
        want = sorted(piece for _, n in rows for piece in ([n or 0] if (n or 0) <= capacity else [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)))
        assert sorted(x.n_tokens for x in own) == want
        whole = Counter(x.doc_id for x in own if x.doc_id not in (1, None))
        assert all(whole[i] == max(1, -(-(n or 0) // capacity)) for i, n in rows if i not in (1, None))
    assert pack(df.limit(0), "doc_id", "n", [(1, 64)]).count() == 0
    assert pack(df.where("n = 0"), "doc_id", "n", [(1, 64)]).count() == df.where("n = 0").count()


def test_tokens(spark):
    texts = ["", None, "Hello, world!", "naïve\r\n\t  ☎ <|endoftext|>", "x" * 20_000, " " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in measured(df, "doc_id", token_counter()("text")).collect()}
    assert got[0] == got[1] == 0
    own = encoding(VOCABULARY)
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i] == len(ids) and own.decode(ids) == (t or "")


def test_tokens_agree_with_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for s in ("It's 7 o'clock;  \n\n isn't it?", "Ärger mit 12345 Zeilen…", "a\u00a0b   c", "if x:\n    y()"):
        assert encoding(VOCABULARY).encode_ordinary(s) == t.encode(s, add_special_tokens=False).ids


def test_equal_sizes_spread_over_blocks(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(7).alias("n"))
    load = Counter(r.container for r in pack(df, "doc_id", "n", [(1, 64)]).collect())
    assert len(load) == -(-5000 // 9) and max(load.values()) == 9


@pytest.mark.parametrize("capacity", [600_000, 1_000_000, 2_000_000, 2**40])
def test_large_capacities(spark, capacity):
    r = random.Random(capacity)
    sizes = [r.choice([r.randint(1, capacity), r.randint(1, capacity // 50), capacity // 3 + 1, capacity // 2, 5]) for _ in range(400)]
    plan = Plan(capacity, Counter(sizes))
    _, items = filled(plan)
    s = np.array([x for x, n in items.items() for _ in range(n)])
    k = np.array([i for n in items.values() for i in range(n)])
    load = Counter()
    for c, x in zip(containers_of(plan.lookup(), s, k).tolist(), s.tolist(), strict=True):
        load[c] += x
    assert max(load.values()) <= capacity and len(load) == plan.containers <= best_fit(sizes, capacity) + 1
    with pytest.raises(ValueError):
        containers_of(plan.lookup(), np.array([capacity + 1]), np.array([0]))
    if capacity <= 2_000_000:
        df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n bigint").repartition(3)
        load = Counter()
        for x in pack(df, "doc_id", "n", [(1, capacity)]).collect():
            load[x.container] += x.n_tokens
        assert max(load.values()) <= capacity and len(load) == plan.containers and sum(load.values()) == sum(sizes)
