"""Streams against the sequential models, over several batches."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import models
import pytest

from convoy.plans.problems import p1_sessions
from convoy.plans.streams import stream_sessions
from convoy.streaming.jobs import enable_state, first_only, lost_members, reputation



@pytest.fixture(autouse=True)
def _state(spark):
    with enable_state(spark):
        yield


BASE = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, build, mode="append"):
    """Feed the batches one at a time; all rows that came out, in order of batches."""
    seen, source = [], str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    return seen


def test_reputation_carries_over_batches(spark, tmp_path):
    r = random.Random(1)
    events = [(r.choice("ab"), r.choice(["failure", "success", "heartbeat"]), t, t) for t in range(60)]
    shuffled = [r.sample(events[:25], 25), r.sample(events[25:], 35)]
    out = run(spark, tmp_path, shuffled, "member_id string, kind string, at_us bigint, seq bigint", reputation, "update")
    last = {x.member_id: (x.reputation, x.n_events) for x in out}
    for m in "ab":
        kinds = [k for who, k, _, _ in events if who == m]
        assert last[m] == (pytest.approx(models.reputations(kinds)[-1]), len(kinds))


def test_lost_members(spark, tmp_path):
    beat = lambda m, s, every: ("p", m, s * 10**6, every * 10**6, datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=s))
    batches = [
        [beat("a", 1000, 10), beat("b", 1000, 10), beat("c", 1000, 0)],
        [beat("a", 1020, 10), beat("b", 1100, 10)],  # b was silent for over 30 s
        [beat("z", 3000, 10)],  # the watermark passes the deadlines of a and b
        [beat("z", 3010, 10)],
    ]
    schema = "pool_id string, member_id string, at_us bigint, interval_us bigint, at timestamp"
    out = run(spark, tmp_path, batches, schema, lambda s: lost_members(s, "at", "200 seconds"))
    assert sorted((x.member_id, x.at_us // 10**6, x.lost_us // 10**6) for x in out) == [("a", 1020, 1050), ("b", 1000, 1030), ("b", 1100, 1130)]


def test_first_only(spark, tmp_path):
    at = lambda k, m: (k, BASE + timedelta(minutes=m))
    out = run(spark, tmp_path, [[at("k", 0), at("k", 1)], [at("k", 5), at("l", 5)]], "k string, at timestamp", lambda s: first_only(s, "k", "at", "1 hour"))
    assert sorted(x.k for x in out) == ["k", "l"]


def test_stream_sessions_gives_all_sessions(spark, tmp_path):
    """In one batch and in several: late rows, repeated exports, rows without an id, and sessions open at the end."""
    r = random.Random(4)
    day, start = 86_400_000, 1_704_067_200_000
    jobs = [(r.choice([f"j{i}", f"j{i}", None]), r.choice(["a", "b", "c", "", None]), start + r.randint(0, 12 * day) // 200_000 * 200_000, r.randint(0, 8 * day)) for i in range(600)]
    jobs += [(f"k{i}", "d", start + 12 * day + 250_000 * i, 0) for i in range(20)]
    jobs += [(i, u, t, wait + day // 2) for i, u, t, wait in r.sample(jobs, 100) if i and wait < 8 * day]
    jobs.sort(key=lambda j: j[2] + j[3])  # as they arrive
    for k in range(3):
        part = [j[:3] for j in jobs[k * len(jobs) // 3 : (k + 1) * len(jobs) // 3]]
        spark.createDataFrame(part, "id string, user_id string, created_at bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "jobs.parquet"))
    want = sorted(map(tuple, p1_sessions(spark, str(tmp_path)).collect()))
    assert sorted(map(tuple, stream_sessions(spark, str(tmp_path)).collect())) == want
    assert sorted(map(tuple, stream_sessions(spark, str(tmp_path), files_per_batch=1).collect())) == want
