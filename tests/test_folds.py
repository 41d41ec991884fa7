"""Set forms against sequential models, on random inputs whose rows come in random order."""

from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from convoy.operators import admission, metrics, pacing, pools, ranking, routing
from convoy.operators.ranking import Fold, blocks_of, prefix, rank_in_blocks

QUEUES, N = ("a", "b", None), 60


def rows_of(seed):
    r = random.Random(seed)
    out, seq = [], 0
    for q in QUEUES:
        t = 0
        for _ in range(N):
            t += r.choice([0, 0, 3, 40, 200])  # same instants occur
            out.append((q, t, seq, r.randint(0, 90), r.choice([None, None, None, 0.1, 3.0, 50.0]), r.choice([None, 0, 2, 9]), r.choice(["failure"] * 3 + ["success", "heartbeat"]), r.choice(["", "", "enabled", "disabled"])))
            seq += 1
    return out


@pytest.fixture(scope="module", params=[1, 2])
def data(request, spark):
    rows = rows_of(request.param)
    shuffled = rows[:]
    random.Random(9).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "q string, t bigint, seq bigint, s bigint, h double, m int, kind string, mode string")
    return rows, df


def by_queue(rows):
    return {q: [r for r in rows if r[0] == q] for q in QUEUES}


def got(df, col):
    return {r.seq: r[col] for r in df.select("seq", F.col(col)).collect()}


def block():
    return blocks_of("t", 150)


def test_pacing(data):
    rows, df = data
    one = got(pacing.paced(df, ["q"], "t", ["t", "seq"], 50, block()), "dispatch_us")
    two = got(pacing.paced_serial(df, ["q"], "t", "s", ["t", "seq"], 50, block()), "dispatch_us")
    for part in by_queue(rows).values():
        assert [one[r[2]] for r in part] == models.paced([r[1] for r in part], 50)
        assert [two[r[2]] for r in part] == models.serial([r[1] for r in part], [r[3] for r in part], 50)


def test_multi_with_one_slot_is_serial(data):
    rows, df = data
    many = got(pacing.paced_multi(df.where("q is not null"), ["q"], "t", "s", ["t", "seq"], 50, 1), "dispatch_us")
    for q, part in by_queue(rows).items():
        if q:
            assert [many[r[2]] for r in part] == models.serial([r[1] for r in part], [r[3] for r in part], 50)


def test_rates_and_concurrency(data):
    rows, df = data
    rps = got(pacing.rate_trajectory(df, ["q"], ["t", "seq"], "h", 20.0, block()), "rps")
    conc = got(pacing.concurrency_trajectory(df, ["q"], ["t", "seq"], "m", 4, block()), "max_concurrent")
    for part in by_queue(rows).values():
        assert [rps[r[2]] for r in part] == pytest.approx(models.rates([r[4] for r in part], 20.0), abs=2e-6)
        assert [conc[r[2]] for r in part] == models.concurrency([r[5] for r in part], 4)


def test_reputation_and_eviction(data):
    rows, df = data
    rep = got(pools.reputation(df, ["q"], ["t", "seq"], block()), "reputation")
    gone = {r.q: r.evicted_us for r in pools.first_eviction(df, ["q"], "t", ["t", "seq"], block(), 300).collect()}
    for q, part in by_queue(rows).items():
        kinds, times = [r[6] for r in part], [r[1] for r in part]
        assert [rep[r[2]] for r in part] == pytest.approx(models.reputations(kinds), abs=1e-12)
        assert gone.get(q) == models.first_eviction(kinds, times, 300)
        again = pools.evictions(kinds, times, 300)
        assert (again[0] if again else None) == models.first_eviction(kinds, times, 300)


def test_isolation_is_sticky(data):
    rows, df = data
    on = got(routing.isolation_mode(df, "q", "mode", ["t", "seq"], block()), "isolated")
    for part in by_queue(rows).values():
        assert [on[r[2]] for r in part] == models.isolated([r[7] for r in part])


@pytest.mark.parametrize("base", [5, 0, 100])
def test_admission(spark, base):
    r = random.Random(base)
    rows = [(f"k{r.randint(0, 25)}", r.random() < 0.3) for _ in range(120)]
    df = spark.createDataFrame([(k, a, i) for i, (k, a) in enumerate(rows)], "k string, a boolean, seq bigint").repartition(3)
    done = admission.outcome(df, "k", ["seq"], F.col("a"))
    told = got(admission.retry_after(done.where("outcome <> 'duplicate'"), ["seq"], F.col("outcome") == "rejected", base, blocks_of("seq", 17)), "retry_after_s")
    outcome = got(done, "outcome")
    assert [(outcome[i], told.get(i)) for i in range(len(rows))] == models.admission(rows, base)


def test_rank_and_folds_do_not_depend_on_blocks(data):
    _, df = data
    for b in (F.lit(0), block(), F.col("t")):
        ranked = rank_in_blocks(df, ["q"], ["t", "seq"], b)
        assert {(r.q, r.position) for r in ranked.collect()} == {(q, i) for q in QUEUES for i in range(1, N + 1)}
    folds = {"hi": Fold("max", F.col("s")), "lo": Fold("min", F.col("s")), "prev": Fold("last", F.col("h"), before=True), "sum": Fold("sum", F.col("s"), before=True)}
    one = sorted(map(str, prefix(df, ["q"], ["t", "seq"], F.lit(0), folds).collect()))
    assert one == sorted(map(str, prefix(df, ["q"], ["t", "seq"], block(), folds).collect()))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, 7, 1)], "_k0 int, _b int, __t int, position int")
    assert rank_in_blocks(df, ["_k0"], ["_b"], F.col("_b")).collect()[0].asDict() == {"_k0": 1, "_b": 5, "__t": 7, "position": 1}


def test_as_of(spark):
    left = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), ("v", 9, 3)], "u string, t bigint, seq bigint")
    right = spark.createDataFrame([("u", 5, 2.0), ("u", 2, 1.0), ("v", 10, 3.0)], "u string, t bigint, x double")
    out = metrics.as_of(left, right, ["u"], "t", ["x"], "seq", blocks_of("t", 4))
    assert got(out, "x") == {1: 2.0, 2: None, 3: None}


def test_picks_match_virtual_time(spark):
    weights = {1: 100.0, 2: 25.0, 3: 7.5}
    df = spark.createDataFrame([("p", m, w) for m, w in weights.items()], "p string, m int, w double")
    out = [r.m for r in pools.round_robin(df, "p", "m", "w", 400).orderBy("pick").collect()]
    assert out == models.picks(weights, 400)
    share = {r.m: r.picks for r in pools.round_robin_share(df.where("m < 3"), "p", "m", "w", 2000).collect()}
    assert abs(share[1] - 1600) <= 1 and share[1] + share[2] == 2000


@pytest.mark.parametrize("split", [1, 7])
def test_cut_blocks_change_no_fold(data, split, monkeypatch):
    rows, df = data
    monkeypatch.setattr(ranking, "SPLIT_ROWS", split)
    monkeypatch.setattr(ranking, "SPLIT_BYTES", 0)
    wide = blocks_of("t", 10**9)  # one block a key, were it not cut
    one = got(pacing.paced(df, ["q"], "t", ["t", "seq"], 50, wide), "dispatch_us")
    rps = got(pacing.rate_trajectory(df, ["q"], ["t", "seq"], "h", 20.0, wide), "rps")
    number = got(rank_in_blocks(df, ["q"], ["t", "seq"], wide, "n"), "n")
    for part in by_queue(rows).values():
        assert [one[r[2]] for r in part] == models.paced([r[1] for r in part], 50)
        assert [rps[r[2]] for r in part] == pytest.approx(models.rates([r[4] for r in part], 20.0), abs=2e-6)
        assert [number[r[2]] for r in part] == list(range(1, len(part) + 1))


def test_a_hot_day_is_cut(spark, monkeypatch):
    """A hundred times the rows of other days in one, most of them in one hour: no piece holds more than a fortieth."""
    monkeypatch.setattr(ranking, "SPLIT_BYTES", 0)
    day = 86_400_000_000
    calm = spark.range(50 * 400).select((F.col("id") % 50 * day + F.col("id") * 977).alias("t"), F.col("id").alias("seq"))
    hot = spark.range(40_000).select((7 * day + F.when(F.col("id") % 10 > 0, F.col("id") * 90_000).otherwise(F.col("id") * 2_000_000)).alias("t"), (F.col("id") + 10**6).alias("seq"))
    both = calm.unionByName(hot).withColumns({"k": F.struct(F.lit("all")), "b": F.struct(blocks_of("t", day).alias("b"), F.lit(0).alias("p"))})
    cut = ranking.cut_blocks(both, ["k"], "b", "t", 2_000)
    sizes = {(r.b.b, r.b.p): r["count"] for r in cut.groupBy("b").count().collect()}
    assert sum(sizes.values()) == 60_000 and max(sizes.values()) <= 1_000 and len({p for b, p in sizes if b == 7}) > 500
    assert all(p == 0 for b, p in sizes if b != 7)
    numbered = rank_in_blocks(both.drop("k", "b").withColumn("k", F.lit(1)), ["k"], ["t", "seq"], blocks_of("t", day), "n")
    assert numbered.agg(F.count_distinct("n"), F.max("n")).first()[:] == (60_000, 60_000)


def test_text_orders_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SPLIT_ROWS", 1)
    monkeypatch.setattr(ranking, "SPLIT_BYTES", 0)
    df = spark.createDataFrame([(c,) for c in "cabd"], "s string")
    assert sorted((r.s, r.n) for r in rank_in_blocks(df.withColumn("k", F.lit(0)), ["k"], ["s"], F.lit(0), "n").collect()) == list(zip("abcd", range(1, 5), strict=True))
