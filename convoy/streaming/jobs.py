"""De-duplication, reputation and liveness over unbounded input.

The reference point is event time: a watermark, ``late`` behind the newest event, bounds state and says what is too late.
Deadlines are exact: a member is lost when its deadline passes, not at the next periodic look.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convoy.operators.pools import FAILURE, HEARTBEAT, MISSED, SUCCESS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def require(spark: SparkSession, setting: str, value: str) -> None:
    """Operators leave the settings of a session alone; they say what they need."""
    if spark.conf.get(setting, None) != value:
        raise ValueError(f"{setting} must be {value}")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (``__`` for dots) for the time of a query, put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def enable_state(spark: SparkSession):
    """Settings for stateful processors, which need this state store."""
    return settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB)


def first_only(requests: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first request seen of each key; copies up to ``late`` behind it are dropped, its state then forgotten."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


class _Reputation(StatefulProcessor):
    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reputation", "reputation double, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rep, n = self.state.get() if self.state.exists() else (1.0, 0)
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for kind in events["kind"]:
            rep = rep * FAILURE if kind == "failure" else min(1.0, rep * (SUCCESS if kind == "success" else HEARTBEAT))
        n += len(events)
        self.state.update((float(rep), int(n)))
        yield pd.DataFrame({"member_id": [key[0]], "reputation": [rep], "n_events": [n]})

    def close(self) -> None:
        pass


def reputation(events: DataFrame, order: Sequence[str] = ("at_us", "seq")) -> DataFrame:
    """``member_id, reputation, n_events`` after each batch of a member's events (member_id, kind and those of ``order``).

    Events are folded in order within a batch and batches in order of arrival. Within a batch a member's rows are gathered
    to be sorted; the reader's limits on a batch (``maxFilesPerTrigger``) bound them.
    """
    require(events.sparkSession, "spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(events.dtypes)
    return events.groupBy("member_id").transformWithStateInPandas(
        _Reputation(order), outputStructType=f"member_id {kinds['member_id']}, reputation double, n_events bigint", outputMode="Update", timeMode="None"
    )


class _Liveness(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us bigint, lost_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = pd.concat(list(rows)).sort_values("at_us", kind="stable")
        at, lost = self.last.get() if self.last.exists() else (None, None)
        out = []
        for b_at, interval in zip(beats["at_us"].tolist(), beats["interval_us"].tolist(), strict=True):
            if at is not None and b_at < at:
                continue  # an older beat changes nothing
            if at is not None and lost and b_at > lost:
                out.append((*key, at, lost))
            at, lost = b_at, b_at + MISSED * interval if interval > 0 else 0
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if lost and lost // 1000 > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(lost // 1000 + 1)
        if at is not None:
            self.last.update((int(at), int(lost)))
        yield pd.DataFrame(out, columns=["pool_id", "member_id", "at_us", "lost_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at, lost = self.last.get()
            self.last.clear()
            yield pd.DataFrame([(*key, at, lost)], columns=["pool_id", "member_id", "at_us", "lost_us"])

    def close(self) -> None:
        pass


def lost_members(beats: DataFrame, at: str, late: str) -> DataFrame:
    """``pool_id, member_id, at_us, lost_us`` whenever three intervals pass after a member's last beat (``at_us``).

    ``beats`` has pool_id, member_id, interval_us, at_us and the timestamp ``at``. A member without an interval is never
    lost. A silence is reported by the beat that ends it or, once the watermark passes the deadline, by a timer.
    """
    require(beats.sparkSession, "spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kept = beats.withWatermark(at, late).select("pool_id", "member_id", "at_us", "interval_us", at)
    return kept.groupBy("pool_id", "member_id").transformWithStateInPandas(
        _Liveness(), outputStructType="pool_id string, member_id string, at_us bigint, lost_us bigint", outputMode="Append", timeMode="EventTime"
    )
