"""Rules on rows: the published numbers, and cases the tables lack."""

from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from convoy.functions.columns import epoch_ms, url_host, utc_day
from convoy.operators import admission, attempts, pacing, pools, protocol, routing, scenario, store
from convoy.operators.ranking import blocks_of
from convoy.sources.sinks import append_once, config_rows, parse_records, read_requests
from convoy.sources.tables import scratch


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_urls(spark):
    urls = [("https://U:p@Api.Example:8443/x?y", "api.example:8443", "https://Api.Example:8443"), ("HTTP://h.test", "h.test", "http://h.test"), ("", None, "://"), (None, None, "://"), ("/only/path", None, "/only/path"), ("http://a@b@c.test/", "c.test", "http://c.test"), ("not a url", None, "not a url"), ("x:///p", "", "x://")]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "url string")
    assert values(df, url_host("url"), routing.upstream_key()) == [(h, k) for _, h, k in urls]


def test_times(spark):
    df = spark.createDataFrame([(1672619607,), (1672619607926,), (1672619607926999,), (None,)], "t bigint")
    assert values(df, epoch_ms("t")) == [(1672619607000,), (1672619607926,), (1672619607926,), (None,)]
    assert values(df.limit(1), utc_day(epoch_ms("t"))) == [("2023-01-02",)]


def test_validation_order(spark):
    full = {"user_id": "u", "idempotent_key": "k", "url": "x", "pool_id": "", "method": "GET", "webhook_url": "w"}
    cases = [full, full | {"webhook_url": ""}, full | {"method": None}, full | {"pool_id": "p"}, full | {"url": None}, full | {"idempotent_key": "", "url": ""}, dict.fromkeys(full)]
    df = spark.createDataFrame([tuple(c.values()) for c in cases], ", ".join(f"{k} string" for k in full))
    m = routing.MESSAGES
    assert [r[0] for r in values(df, routing.validation_message())] == ["", m[5], m[4], m[3], m[2], m[1], m[0]]


def test_api_key_and_tenant(spark):
    df = spark.createDataFrame([('{"Authorization":"","x-api-key":"a"}',), ('{"authorization":"b","api-key":"c"}',), ('{"broken',), (None,)], "h string")
    assert [r[0] for r in values(df, routing.api_key("h"))] == ["a", "c", "", ""]
    two = spark.createDataFrame([("u1", True), ("u2", True), ("u1", False)], "u string, on boolean").withColumn("h", F.lit("{}"))
    keys = [r[0] for r in values(two, routing.tenant_key("u", "h", F.col("on")))]
    assert keys[2] == routing.SHARED and len(set(keys)) == 3


def test_rate_limits(spark):
    cfg = config_rows(spark, {"defaults": {"rps": 0, "max_concurrent": -1}, "upstreams": {"a.test:1": {"rps": 0, "max_concurrent": 3}}})
    jobs = spark.createDataFrame([("http://a.test:1/x",), ("http://b.test",), ("",)], "url string")
    assert sorted(values(routing.rate_limits(jobs, cfg, routing.host_of()), "url", "rps", "max_concurrent")) == [("", 2.0, 1), ("http://a.test:1/x", 0.0, 3), ("http://b.test", 2.0, 1)]


def test_dedup_and_history(spark):
    df = spark.createDataFrame([("h", 2), ("h", 1), ("g", 3)], "h string, seq bigint")
    assert sorted(values(store.check_or_insert(df, "h", ["seq"]), "seq", "first_seq", "duplicate")) == [(1, 1, False), (2, 1, True), (3, 3, False)]
    known = spark.createDataFrame([("g", 99)], "h string, first_seq bigint")
    assert (3, 99, True) in values(store.check_or_insert(df, "h", ["seq"], known), "seq", "first_seq", "duplicate")


def test_expiry_boundary(spark):
    df = spark.createDataFrame([("a", "queued", 0, 100), ("b", "in_flight", -400_000, 101), ("c", "queued", 0, 99)], "id string, status string, created_ms bigint, expires_at bigint")
    assert values(store.visible(df, 100), "id") == [("b",)]
    assert values(store.sweep(df, 100), "id", "status") == [("a", "queued"), ("b", "queued")]
    assert values(store.counts(df.limit(0), 100), "total", "depth") == [(0, 0)]
    assert values(df, store.expiry_after(F.col("status"), F.lit(0).cast("bigint"))) == [(86_400_000,)] * 3


def test_recover(spark):
    df = spark.createDataFrame([("a", "in_flight", "q", 200), ("b", "in_flight", "q", 1), ("c", "in_flight", "r", 200), ("d", None, "q", 200)], "id string, status string, queue_key string, expires_at bigint")
    assert sorted(values(store.recover_in_flight(df, "q", 100), "id", "status", "returned"), key=str) == [("a", "queued", True), ("b", "queued", False), ("d", None, False)]


def test_latest_takes_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", None, None)], "id string, at bigint, s string")
    assert sorted(values(store.latest(df, "id", ["at", "s"]), "id", "at", "s")) == [("a", 1, "y"), ("b", None, None)]


def test_retry_after_published_sequence(spark):
    df = spark.range(1, 8).withColumnRenamed("id", "seq")
    told = admission.retry_after(df, ["seq"], F.lit(True), 5, blocks_of("seq", 3))
    assert [r.retry_after_s for r in told.orderBy("seq").collect()] == [5, 10, 20, 40, 60, 60, 60]


def test_decision_strict_and_memory_first(spark):
    df = spark.createDataFrame([(200.0, 5), (201.0, 11), (None, 11), (1.0, 10)], "m double, d bigint")
    out = values(df.select(admission.decision(F.col("m"), 200, F.col("d"), 10).alias("x")).select("x.*"), "allowed", "reason", "limit", "current")
    assert out == [(True, "", 0, 0), (False, "memory", 200, 201), (False, "database", 10, 11), (True, "", 0, 0)]
    assert values(df.select(admission.decision(F.col("m"), 0, F.col("d"), 0).alias("x")), "x.allowed") == [(True,)] * 4


def test_capacity_after_failure(spark):
    df = spark.createDataFrame([("p", 30.0, 1.0), ("p", 20.0, 1.0), ("q", 30.0, 0.5), ("q", 20.0, 1.0), ("z", 0.0, 1.0)], "pool string, d double, r double")
    assert sorted(values(pools.capacity(df, "pool", "d", "r"), "pool", "capacity_rps", "members")) == [("p", 50.0, 2), ("q", 35.0, 2), ("z", 0.001, 1)]


def test_eviction_after_five_failures():
    assert models.reputations(["failure", "failure", "success"]) == [0.5, 0.25, 0.375]
    s = 1_000_000
    assert pools.evictions(["failure"] * 6, [0, s, 2 * s, 3 * s, 4 * s, 16 * s]) == [16 * s]
    assert pools.evictions(["failure"] * 5 + ["success", "failure"], [0, s, 2 * s, 3 * s, 4 * s, 5 * s, 40 * s]) == []
    twice = pools.evictions(["failure"] * 6 + ["failure"] * 6, [i * 12 * s for i in range(12)])
    assert len(twice) == 2  # registered afresh in between


def test_three_missed_beats(spark):
    df = spark.createDataFrame([("p", "a", 0, 100, 1), ("p", "a", 300, 100, 2), ("p", "a", 601, 100, 3), ("p", "b", 0, 0, 4)], "pool string, m string, at bigint, iv bigint, id bigint")
    assert values(pools.heartbeat_gaps(df, "pool", "m", "at", "iv", "id"), "m", "at", "lost_us") == [("a", 300, 600)]
    last = pools.latest_members(df, "pool", "m", "at", "id")
    assert sorted(values(pools.alive(last, "at", "iv", 902), "m")) == [("b",)]
    assert sorted(values(pools.alive(last, "at", "iv", 901), "m")) == [("a",), ("b",)]


def test_fair_share(spark):
    df = spark.createDataFrame([("u", i, 10.0) for i in range(3)] + [("v", 9, 99.0)] + [("w", i, 10.0) for i in range(100)], "up string, i int, rps double")
    out = {(r.up, r.i): r.share_rps for r in pacing.fair_share(df, "up", "rps", 10.0).collect()}
    assert sum(v for (u, _), v in out.items() if u == "u") == pytest.approx(10) and out["v", 9] == 99.0 and out["w", 5] == 0.5


def test_headers(spark):
    df = spark.createDataFrame([("5", "2"), ("", "2"), (None, None), ("x", "2")], "a string, b string")
    assert values(df, pacing.rate_header(pacing.first_header("a", "b"))) == [(5.0,), (2.0,), (None,), (0.0,)]


def test_outcomes(spark):
    df = spark.createDataFrame([("a", 0, 500, None), ("a", 1, 200, None), ("b", 0, 429, None), ("c", 0, None, "refused"), ("d", 0, 503, ""), ("e", 0, 404, None)], "job string, n int, code int, err string")
    out = {r.job: tuple(r)[1:] for r in attempts.outcomes(df, "job", "n", "code", "err").collect()}
    assert out == {"a": ("completed", 200, None, 2), "b": ("completed", 429, None, 1), "c": ("failed", 0, "refused", 1), "d": ("failed", 503, "upstream returned 503", 1), "e": ("completed", 404, None, 1)}


def test_backoff(spark):
    df = spark.createDataFrame([(0,)], "t bigint")
    assert values(attempts.schedule(df, "t"), "backoff_s", "attempt_us") == [(0, 0), (1, 1_000_000), (2, 3_000_000), (4, 7_000_000), (8, 15_000_000)]


def remembered(uses, memory):
    """Verdicts of challenges in order of receipt by a table of nonces and when each is forgotten."""
    known, out = {}, {}
    for name, nonce, stamp, at in sorted(uses, key=lambda u: (u[3], u[0])):
        if stamp is None or abs(at - stamp) > 300:
            out[name] = "stale"
        elif nonce is not None and known.get(nonce, -1) >= at:
            out[name] = "replayed"
        else:
            out[name] = "ok"
            known[nonce] = at + memory
    return out


def test_nonces_are_forgotten(spark):
    minutes = [0, 4, 6, 9, 12, 12, 30]
    uses = [(f"u{i}", "n", 60 * m, 60 * m) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(uses, "id string, nonce string, ts bigint, r bigint")
    out = dict(values(protocol.replays(df, "nonce", F.col("ts"), F.col("r"), "id"), "id", "verdict"))
    assert out == remembered(uses, 300) == dict(zip([f"u{i}" for i in range(7)], ["ok", "replayed", "ok", "replayed", "ok", "replayed", "ok"], strict=True))


def test_replays_like_a_table_of_nonces(spark):
    r = random.Random(3)
    uses = [(f"u{i:04d}", r.choice(["hot", "hot", "a", "b", None]), t + r.choice([0, 0, 0, 400]) if r.random() < 0.9 else None, t) for i in range(600) for t in [r.randint(0, 9000)]]
    df = spark.createDataFrame([(*u, "x") for u in uses], "id string, nonce string, ts bigint, r bigint, _r string").repartition(5)
    for memory in (1, 60, 300, 5000):
        out = protocol.replays(df, "nonce", F.col("ts"), F.col("r"), "id", memory)
        assert dict(values(out, "id", "verdict")) == remembered(uses, memory) and out.columns == [*df.columns, "verdict"]
    assert protocol.replays(df.limit(0), "nonce", F.col("ts"), F.col("r"), "id").count() == 0


def test_replays(spark):
    df = spark.createDataFrame([("a", "n", 100, 100), ("b", "n", 200, 200), ("c", "n", 0, 301), ("d", None, 1, 1), ("e", None, 1, 1), ("f", "m", 900, 500), ("g", "m", 500, 501), ("h", "m", None, 502)], "id string, nonce string, ts bigint, r bigint")
    out = dict(values(protocol.replays(df, "nonce", F.col("ts"), F.col("r"), "id"), "id", "verdict"))
    assert out == {"a": "ok", "b": "replayed", "c": "stale", "d": "ok", "e": "ok", "f": "stale", "g": "ok", "h": "stale"}


def test_body_bytes(spark):
    df = spark.createDataFrame([("ä" * 3,), ("abc",), (None,)], "body string")
    assert values(admission.oversized(df, "body", 5), "body_bytes") == [(6,)]


def test_first_member_gates_the_queue(spark):
    jobs = spark.createDataFrame([("p", 1), ("p", 9), ("q", 1)], "pool string, t bigint")
    members = spark.createDataFrame([("p", 5), ("p", 7)], "pool string, first_us bigint")
    assert sorted(values(pacing.after_first_member(jobs, "pool", "t", members), "pool", "t", "ready_us"), key=str) == [("p", 1, 5), ("p", 9, 9), ("q", 1, None)]


def test_worker_overload():
    w = scenario.Worker("fragile", 2.0)
    statuses = [w.respond(1)[0] for _ in range(6)]
    assert statuses[:3] == [200, 200, 200] and statuses[-1] == 500 and w.crashed_until == 3
    assert w.respond(3)[0] == 500
    assert scenario.Worker("recovering", 5.0).respond(3)[:2] == (500, 1.0)
    r = random.Random(1)
    quiet = scenario.Worker("stable", 5.0)
    assert all(quiet.respond(s)[0] == 200 for s in sorted(r.choices(range(1000), k=20)))


def test_summary(spark):
    df = spark.createDataFrame([(1, 3, 0), (2, 8, 1), (3, 9, 1)], "second bigint, completed bigint, failed bigint")
    assert values(scenario.summary(df, F.lit(10)), "completed", "failed", "remaining", "drained_at") == [(9, 1, 0, 3)]
    assert values(scenario.summary(df, F.lit(11)), "remaining", "drained_at") == [(1, 0)]


def test_lenient_json(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id":"u","headers":{"a":"b"},"other":1}\nnot json\n')
    rows = read_requests(spark, str(tmp_path / "r.json")).collect()
    assert rows[0].user_id == "u" and rows[0].headers == {"a": "b"} and rows[1].bad_line == "not json"
    raw = spark.createDataFrame([('{"id":"a"}',), ("{oops",), (None,)], "v string")
    assert parse_records(raw, "v", "id string, _bad string").where("_bad is null").count() == 1


def test_batches_replace_themselves(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,)], "id int").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id int").parquet(str(tmp_path / "in"))
    for n in (1, 2):  # the second run starts over, as after a lost checkpoint
        append_once(source, str(tmp_path / "out"), str(tmp_path / f"state{n}"), "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    assert scratch(spark, "x") != scratch(spark, "x")
