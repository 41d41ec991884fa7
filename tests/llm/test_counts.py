"""Distinct counts by patterns and frequent values by lossy counting, against exact counts."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convoy.llm.distinct import distinct_counts, distinct_within, memberships, merge_memberships, pattern_totals
from convoy.llm.frequent import LossyCounter, frequent_exact, frequent_items

BY = [["day", "host"], ["day"], ["host"], []]


@pytest.fixture(scope="module")
def seen(spark):
    r = random.Random(2)
    rows = [(r.choice(["bot"] * 3 + ["", None] + [f"u{i}" for i in range(40)]), f"url{r.randint(0, 99)}", r.choice(["d1", "d2", None]), r.choice(["h1", "h2", "h3"]), 1, "x") for _ in range(900)]
    return rows, spark.createDataFrame(rows, "user string, url string, day string, host string, i1 int, n_ids string").repartition(6)


def exact(rows, field):
    out = {}
    for level, by in enumerate(BY):
        cells = {}
        for row in rows:
            if row[field]:
                cells.setdefault((level, row[2] if "day" in by else None, row[3] if "host" in by else None), set()).add(row[field])
        out |= {k: len(v) for k, v in cells.items()}
    return out


def test_counts_for_every_grouping(seen):
    rows, df = seen
    n = distinct_counts(pattern_totals(memberships(df, ["user", "url"], ["day", "host"])), BY)
    for name, at in (("user", 0), ("url", 1)):
        got = [((x.level, x.day, x.host), x.n_distinct) for x in n.where(F.col("field_name") == name).collect()]
        assert len(got) == len(dict(got)) and dict(got) == exact(rows, at)


def test_parts_merge_and_any_cells_can_be_asked(seen):
    rows, df = seen
    a, b = df.where("host = 'h1'"), df.where("host <> 'h1'")
    p = pattern_totals(merge_memberships(memberships(a, ["user"], ["day", "host"]), memberships(b, ["user"], ["day", "host"])))
    asked = (F.col("host") == "h1") | (F.col("day") == "d2")
    assert [x.n_distinct for x in distinct_within(p, asked).collect()] == [len({x[0] for x in rows if x[0] and (x[3] == "h1" or x[2] == "d2")})]
    assert distinct_counts(pattern_totals(memberships(df.limit(0), ["user"], ["day", "host"])), BY).count() == 0


def test_null_groups(spark):
    """Two nullable groups with the same values in both: ('a', null) and (null, 'a') are different cells."""
    r = random.Random(9)
    rows = [("u1", "", "a", None), ("u3", "", "a", None), ("u2", "", None, "a"), *((f"v{r.randint(0, 30)}", "", r.choice(["a", "b", None]), r.choice(["a", "b", None])) for _ in range(200))]
    df = spark.createDataFrame(rows, "user string, url string, day string, host string")
    for part in (df.where("user like 'u%'"), df):
        n = distinct_counts(pattern_totals(memberships(part, ["user"], ["day", "host"])), BY)
        own = [tuple(x) for x in part.collect()]
        want = {}
        for level, by in enumerate(BY):
            for user, _, day, host in own:
                want.setdefault((level, day if "day" in by else None, host if "host" in by else None), set()).add(user)
        assert {(x.level, x.day, x.host): x.n_distinct for x in n.collect()} == {k: len(v) for k, v in want.items()}


def test_patterns_are_fewer_than_identifiers(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("user"), F.explode(F.array(F.lit("d1"), F.lit("d2"))).alias("day"), F.lit("h").alias("host"))
    assert pattern_totals(memberships(df, ["user"], ["day", "host"])).count() == 2


@pytest.mark.parametrize("width", [2, 7, 50])
def test_lossy_bounds(width):
    r = random.Random(width)
    values = [r.choice(["a"] * 30 + ["b"] * 10 + [str(r.randint(0, 5000))]) for _ in range(3000)]
    c = LossyCounter(width)
    for i in range(0, len(values), 111):
        c.add(pa.array(values[i : i + 111]))
    entries, true = c.end(), Counter(values)
    assert c.buckets == len(values) // width
    for v, n in true.items():
        low, missed = entries.get(v, (0, c.buckets))
        assert low <= n <= low + missed and missed <= c.buckets


def test_frequent_items(spark):
    r = random.Random(8)
    rows = [(r.choice(["hot"] * 8 + ["warm"] + [None, ""] + [f"v{r.randint(0, 10**6)}"] * 10), "same") for _ in range(20_000)]
    df = spark.createDataFrame(rows, "v string, item_value string").repartition(7)
    true = Counter(x for x, _ in rows if x)
    out = {x.item_value: x for x in frequent_items(df, ["v"], 0.01, 0.002).collect()}
    assert {v for v, n in true.items() if n >= 200} <= set(out) and len(out) <= 125
    for v, x in out.items():
        assert x.count_low <= true[v] <= x.count_high <= x.count_low + 0.002 * len(rows)
    two = frequent_exact(df, ["v", "item_value"]).collect()
    assert {(x.field_name, x.item_value): x.n_rows for x in two} == {("v", v): n for v, n in true.items() if n >= 200} | {("item_value", "same"): 20_000}
    assert frequent_exact(df.limit(0), ["v"]).count() == 0
    assert frequent_items(df.where("v is null"), ["v"]).count() == 0
    with pytest.raises(ValueError):
        frequent_items(df, ["v"], 0.01, 0.01)


def test_bounded_memory():
    c = LossyCounter(100)
    for i in range(200):
        c.add(pa.array([f"{i}-{j}" for j in range(500)]))
        assert len(c.entries) <= 100
