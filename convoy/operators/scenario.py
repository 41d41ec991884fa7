"""The deterministic part of the worker simulator, and reports on its observations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Overload gained per request above capacity, by behaviour (fixed values).
SENSITIVITY = {"fragile": 1.4, "dynamic": 1.0, "flapping": 1.2, "recovering": 1.2}


def workers(spark: SparkSession, count: int) -> DataFrame:
    """``scenario, worker_id, behavior, capacity_rps`` of ``count`` workers in each of the seven scenarios."""
    i, last = F.col("worker_id"), F.lit(count)
    names = ["steady", "weighted", "flapping", "backpressure", "recovering", "mixed", "harsh"]
    s = F.col("scenario")
    kind = (
        F.when((s == "flapping") & (i == last), "flapping").when((s == "backpressure") & (i % 3 == 0), "dynamic").when((s == "recovering") & (i == last), "recovering")
        .when(s.isin("mixed", "harsh") & (i == last), "recovering").when(s.isin("mixed", "harsh") & (i == last - 1), "flapping")
        .when((s == "harsh") & (i % 3 == 0), "fragile").when(s.isin("mixed", "harsh") & (i % 4 == 0), "dynamic").otherwise("stable")
    )
    rate = F.when(s == "weighted", 1 + i % 5).when((s == "harsh") & ((i >= last - 1) | (i % 3 == 0)), 3).when(s == "harsh", 4).otherwise(5)
    base = spark.range(1, count + 1).select(F.col("id").cast("int").alias("worker_id"), F.explode(F.array(*map(F.lit, names))).alias("scenario"))
    return base.select("scenario", "worker_id", kind.alias("behavior"), rate.cast("double").alias("capacity_rps"))


class Worker:
    """One simulated worker; ``respond`` takes the second of a request and returns status, advertised rate and delay (ms).

    Of the random rate of a ``dynamic`` worker the middle is taken.
    """

    def __init__(self, behavior: str, capacity: float):
        self.behavior, self.capacity, self.overload = behavior, capacity, 0.0
        self.second, self.crashed_until, self.this_second = 0, 0, 0

    def respond(self, second: int) -> tuple[int, float, int]:
        if second != self.second:
            for _ in range(second - self.second):
                self.overload = self.overload * 0.65 if self.overload * 0.65 >= 0.1 else 0.0
            self.second, self.this_second = second, 0
        self.this_second += 1
        n, cap, whole = self.this_second, self.capacity, int(self.capacity)
        self.overload += max(0, n - whole) * SENSITIVITY.get(self.behavior, 0.7)
        status, rate, delay = 200, 0.0, 0
        match self.behavior:
            case "stable" if n > int(cap * 1.4):
                rate = max(1.0, cap * 0.7)
            case "dynamic":
                rate = max(1.0, cap)
                status = 429 if n > int(rate * 1.5) else 200
            case "flapping" if 5 <= second <= 10:
                status, rate = 500, 1.0
            case "recovering":
                status, rate = (500, 1.0) if second <= 5 else (200, 2.0) if second <= 10 else (200, cap)
            case "bad":
                status, rate = 500, 1.0
            case "fragile":
                rate = max(1.0, cap - self.overload / 2)
        if self.crashed_until >= second:
            status, rate, delay = 500, 1.0, 250
        if self.overload >= 8:
            status, rate, delay = 500, 1.0, 250
            self.crashed_until = max(self.crashed_until, second + 2)
        elif self.overload >= 5:
            status, rate, delay = 500, 1.0, max(delay, 150)
        elif self.overload >= 3:
            rate, delay = max(1.0, cap * 0.5), max(delay, 100)
        return status, rate, max(delay, 75) if n > int(cap * 2) else delay


def overload(requests: DataFrame) -> DataFrame:
    """Responses to ``requests`` (worker_id, behavior, capacity_rps, second, seq): adds status, advertised_rps, delay_ms, overload, crashed.

    Overload feeds back on itself, so a worker's requests are one group; a worker serves a few per second.
    """
    kept = requests.select("worker_id", "behavior", "capacity_rps", "second", "seq")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["second", "seq"], kind="stable")
        worker = Worker(pdf["behavior"].iloc[0], float(pdf["capacity_rps"].iloc[0]))
        rows = [(*worker.respond(int(s)), worker.overload, worker.crashed_until >= s) for s in pdf["second"]]
        return pdf.assign(**dict(zip(("status", "advertised_rps", "delay_ms", "overload", "crashed"), zip(*rows, strict=True), strict=True)))

    kinds = dict(kept.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept.columns) + ", status int, advertised_rps double, delay_ms int, overload double, crashed boolean"
    return kept.groupBy("worker_id").applyInPandas(run, schema)


def observations(responses: DataFrame) -> DataFrame:
    """One row per second and worker: ``requests, http_200, http_429, http_500``."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"http_{s}")
    return responses.groupBy("second", "worker_id").agg(F.count(F.lit(1)).alias("requests"), count(200), count(429), count(500))


def observations_pivot(observed: DataFrame, workers: list[int]) -> DataFrame:
    """Requests per second, a column ``w<id>`` per worker named; 0 where it had none."""
    wide = observed.groupBy("second").pivot("worker_id", workers).agg(F.sum("requests"))
    return wide.select("second", *[F.coalesce(F.col(str(w)), F.lit(0)).alias(f"w{w}") for w in workers])


def summary(observed: DataFrame, jobs: Column) -> DataFrame:
    """One row: ``completed, failed, remaining, drained_at`` - the first second by which ``jobs`` were done, else 0 - from
    rows of ``second, completed, failed`` that count up."""
    done = F.col("completed") + F.col("failed")
    return observed.agg(
        F.max("completed").alias("completed"), F.max("failed").alias("failed"),
        (jobs - F.max(done)).cast("bigint").alias("remaining"), F.coalesce(F.min(F.when(done >= jobs, F.col("second"))), F.lit(0)).cast("bigint").alias("drained_at"),
    )


def round_robin(numbered: DataFrame, workers: int, number: str = "n") -> DataFrame:
    """Adds ``worker_id`` to requests numbered from 1: each in turn."""
    return numbered.withColumn("worker_id", ((F.col(number) - 1) % workers + 1).cast("int"))


def csv_rows(observed: DataFrame) -> DataFrame:
    """Rates with two decimals and reputation with four, as text, as the CSV sink writes them."""
    two = lambda c: F.format_string("%.2f", F.col(c)).alias(c)
    own = {"advertised_rps": two("advertised_rps"), "overload": two("overload"), "capacity_rps": two("capacity_rps"), "reputation": F.format_string("%.4f", F.col("reputation")).alias("reputation")}
    return observed.select(*[own.get(c, F.col(c)) for c in observed.columns])
