"""Sessions, deliveries and hot keys: dirty rows, ties, repeats, empty tables, extra columns, and brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import models
import pytest
from pyspark.sql import functions as F

from convoy.operators.delivery import first_deliveries, receipt_key
from convoy.operators.keys import heavy_keys, key_states, waiting_order
from convoy.operators.sessions import sessionize, sessionize_stream

GAP = 300_000
JOBS = "user_id string, at_ms bigint, id string, start_ms int, u string, t string, slot int"


def jobs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None, None) for r in rows], JOBS)


def test_sessions_match_brute_force(spark):
    r = random.Random(3)
    rows = [(u, r.randint(0, 40) * r.choice([1, GAP // 2, GAP, GAP + 1]), f"{u}{i}") for u in "abc" for i in range(150)]
    rows += [("hot", 1000 * i, f"h{i}") for i in range(2000)]
    rows += r.choices(rows, k=200)  # exported again
    r.shuffle(rows)
    got = {(x.user_id, x.start_ms, x.end_ms, x.n_events) for x in sessionize(jobs(spark, rows), event_id="id").collect()}
    want = {(u, *s) for u in {x[0] for x in rows} for s in models.sessions([t for v, t, _ in set(rows) if v == u], GAP)}
    assert got == want


def test_session_gap_is_inclusive(spark):
    out = sessionize(jobs(spark, [("a", 0, "1"), ("a", GAP, "2"), ("a", 2 * GAP + 1, "3")]), event_id="id").collect()
    assert sorted((x.start_ms, x.end_ms, x.duration_ms, x.n_events) for x in out) == [(0, GAP, GAP, 2), (2 * GAP + 1, 2 * GAP + 1, 0, 1)]


def test_session_nulls_and_repeats(spark):
    rows = [(None, 1, "a"), ("", 1, "b"), ("u", None, "c"), ("u", 5, None), ("u", 5, None), ("u", 5, "d"), ("u", 5, "d")]
    assert [(x.user_id, x.start_ms, x.n_events) for x in sessionize(jobs(spark, rows), event_id="id").collect()] == [("u", 5, 3)]
    assert [x.n_events for x in sessionize(jobs(spark, rows)).collect()] == [4]
    assert sessionize(jobs(spark, []), event_id="id").count() == 0


def test_session_stream_takes_late_events(spark, tmp_path):
    base = datetime(2024, 1, 1)
    batches = [[("u", 0), ("u", 10), ("v", 0)], [("u", 5), ("w", 600)], [("w", 20000), ("x", 40000)]]  # minutes; the second is late and joins two sessions
    seen = []
    source = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame([(u, base + timedelta(minutes=m)) for u, m in b], "user_id string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("user_id string, at timestamp").parquet(source)
        q = sessionize_stream(stream, "user_id", "at").writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    lengths = {(x.user_id, x.duration_ms // 60_000, x.n_events) for x in seen}
    assert ("u", 10, 3) in lengths and ("v", 0, 1) in lengths and not any(u == "x" for u, _, _ in lengths)


RECEIPTS = "rec_id bigint, received_at timestamp, job_id string, x_l8_timestamp string, x_l8_delivery_id string, body string, k string, f int, r int, n int"


def receipts(spark, path, rows, parts=3):
    spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], RECEIPTS).repartition(parts, "rec_id").write.parquet(path)
    return first_deliveries(spark, path, receipt_key(), ["received_at", "rec_id"])


def stamp(m):
    return datetime(2024, 1, 1) + timedelta(minutes=m)


def test_one_copy_of_each(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(3000):
        hot = r.random() < 0.35
        d = "HOT-1" if hot else r.choice([None, "", f"d{r.randint(0, 900)}"])
        rows.append((i, stamp(r.randint(0, 50)), r.choice([None, f"j{r.randint(0, 60)}"]), r.choice([None, "1", " 1"]), d and r.choice([d, d.lower(), f" {d}\t"]), "x" * 50))
    v = receipts(spark, str(tmp_path / "t"), rows)
    first = {}
    for row in sorted(rows, key=lambda x: (x[1], x[0])):
        d = (row[4] or "").strip().lower()
        key = ("d", d) if d else ("j", row[2], row[3]) if row[2] is not None and row[3] is not None else ("r", row[0])
        first.setdefault(key, row[0])
    keep = set(first.values())
    kept, surplus = v.kept(), v.surplus(["rec_id"])
    assert kept.columns == [c.split()[0] for c in RECEIPTS.split(", ")]
    assert sorted(x.rec_id for x in kept.collect()) == sorted(keep)
    assert sorted(x.rec_id for x in surplus.collect()) == sorted({x[0] for x in rows} - keep)
    v.drop()


def test_equal_copies_and_no_rows(spark, tmp_path):
    same = (1, None, "j", "1", None, None)
    v = receipts(spark, str(tmp_path / "a"), [same, same, same], parts=1)
    assert v.kept().count() == 1 and v.surplus().count() == 2
    none = receipts(spark, str(tmp_path / "b"), [])
    assert none.kept().count() == 0 and none.surplus().count() == 0
    unique = receipts(spark, str(tmp_path / "c"), [(1, stamp(1), None, None, None, None), (2, stamp(1), None, None, "  ", None)])
    assert unique.kept().count() == 2


def test_job_and_stamp_do_not_run_together(spark, tmp_path):
    v = receipts(spark, str(tmp_path / "t"), [(1, stamp(1), "a:1", "2", None, None), (2, stamp(1), "a", "1:2", None, None), (3, stamp(2), "a", "1:2", None, None)])
    assert [x.rec_id for x in v.surplus().collect()] == [3]


KEYED = "queue_key string, url string, at_ms bigint, id string, field_name int, p int, n_rows string"


@pytest.fixture(scope="module")
def keyed(spark):
    r = random.Random(7)
    rows = [(r.choice(["hot"] * 5 + [None, "", f"k{r.randint(0, 300)}"]), f"u{r.randint(0, 999)}", r.choice([None, r.randint(0, 10**8)]), f"i{i}", 1, 2, "c") for i in range(3000)]
    return rows, spark.createDataFrame(rows, KEYED).repartition(5)


def test_key_states(keyed):
    rows, df = keyed
    out = {(x.field_name, x.key_value): (x.n_rows, x.first_ms, x.last_ms) for x in key_states(df, ["queue_key", "url"]).collect()}
    for f, i in (("queue_key", 0), ("url", 1)):
        for k in {x[i] for x in rows if x[i]}:
            t = [x[2] for x in rows if x[i] == k and x[2] is not None]
            assert out.pop((f, k)) == (sum(x[i] == k for x in rows), min(t, default=None), max(t, default=None))
    assert not out


def test_heavy_keys(spark, keyed):
    rows, df = keyed
    assert {x.key_value for x in heavy_keys(df, ["queue_key", "url"]).collect()} == {"hot"}
    at_bound = spark.createDataFrame([("a",)] + [(None,)] * 19, "queue_key string").withColumn("at_ms", F.lit(1))
    assert [x.n_rows for x in heavy_keys(at_bound, ["queue_key"]).collect()] == [1]
    assert heavy_keys(df.limit(0), ["queue_key"]).count() == 0


def test_waiting_order(keyed):
    rows, df = keyed
    out = waiting_order(df, block_ms=10**6)
    assert set(df.columns) | {"position"} == set(out.columns)
    got = {x.id: x.position for x in out.collect()}
    for k in {x[0] for x in rows if x[0]}:
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[2] is not None, x[2] or 0, x[3]))
        assert [got.pop(x[3]) for x in own] == list(range(1, len(own) + 1))
    assert not got


def test_vectors_of_many_files(spark, tmp_path):
    """A reader opens one file of vectors, whatever the number of input files, and takes the row groups of its own file."""
    import glob

    for files in (20, 200):
        path = str(tmp_path / f"in{files}")
        rows = spark.range(files * 10).select(F.col("id").alias("rec_id"), F.concat(F.lit("d"), F.floor(F.col("id") / 3).cast("string")).alias("x_l8_delivery_id"), F.lit("j").alias("job_id"), F.lit("1").alias("x_l8_timestamp"), F.timestamp_seconds(F.col("id")).alias("received_at"))
        rows.repartition(files, "rec_id").write.parquet(path)
        n = len(spark.read.parquet(path).inputFiles())
        vectors = first_deliveries(spark, path, receipt_key(), ["received_at", "rec_id"])
        assert vectors.folders == -(-n // 32)
        per_folder = {f: len(glob.glob(f"{vectors.path.removeprefix('file://')}/folder={f}/*.parquet")) for f in range(vectors.folders)}
        assert max(per_folder.values()) == 1
        assert sorted(r.rec_id for r in vectors.kept(["rec_id"]).collect()) == list(range(0, files * 10, 3))
        assert vectors.surplus(["rec_id"]).count() == files * 10 - len(range(0, files * 10, 3))
        vectors.drop()
