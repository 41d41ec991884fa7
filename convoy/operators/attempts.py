"""Attempts of a job or webhook: schedule, outcome and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.operators.ranking import rank_in_blocks

#: Attempts per job and per webhook (fixed value); the wait before attempt n > 0 is 2 ** (n - 1) seconds.
ATTEMPTS = 5


def schedule(jobs: DataFrame, started_us: str, attempts: Column | int = ATTEMPTS) -> DataFrame:
    """One row per attempt: ``attempt`` from 0, ``backoff_s`` before it and ``attempt_us``, ``2**n - 1`` seconds after the start."""
    n = F.lit(attempts) if isinstance(attempts, int) else attempts
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("attempt")
    offset = F.expr("shiftleft(1, attempt)") - 1
    return jobs.select("*", at).withColumns({
        "backoff_s": F.when(F.col("attempt") == 0, 0).otherwise(F.expr("shiftleft(1, attempt - 1)")),
        "attempt_us": F.col(started_us) + offset.cast("bigint") * 1_000_000,
    })


def attempts_needed(http_status: Column, retry_all_but_2xx: bool = False) -> Column:
    """Attempts a target that keeps answering ``http_status`` (null or 0: no answer) is sent: one, or all five if it is retried."""
    answered = F.coalesce(http_status, F.lit(0))
    retried = ~answered.between(200, 299) if retry_all_but_2xx else (answered == 0) | (answered >= 500)
    return F.when(retried, ATTEMPTS).otherwise(1)


def outcomes(attempts: DataFrame, job: str, attempt: str, http_status: str, error: str) -> DataFrame:
    """One row per job from its attempts: ``status``, ``response_status``, ``reason``, ``n_attempts``.

    The last attempt decides. Below 500 - refusals included - the job is completed; at 500 or above, or without an answer
    (null or 0), it has failed. The reason of a failure is the error, or ``upstream returned N``.
    """
    last = F.max(F.struct(attempt, http_status, error)).alias("_l")
    code = F.coalesce(F.col(f"_l.{http_status}"), F.lit(0))
    failed = (code == 0) | (code >= 500)
    said = F.coalesce(F.nullif(F.col(f"_l.{error}"), F.lit("")), F.when(code == 0, "no answer").otherwise(F.concat(F.lit("upstream returned "), code.cast("string"))))
    return attempts.groupBy(job).agg(last, F.count(F.lit(1)).alias("n_attempts")).select(
        job, F.when(failed, "failed").otherwise("completed").alias("status"), code.cast("int").alias("response_status"), F.when(failed, said).alias("reason"), "n_attempts"
    )


def failover(attempts: DataFrame, job: str, attempt: str, member: str, http_status: str) -> DataFrame:
    """What each attempt tells of its member: ``kind`` failure (no answer, or 500 and above) or success."""
    code = F.coalesce(F.col(http_status), F.lit(0))
    return attempts.select(job, attempt, member, F.when((code == 0) | (code >= 500), "failure").otherwise("success").alias("kind"))


def failover_walk(answers: DataFrame, members: DataFrame, pool: str, job: str, attempt: str, http_status: str, member: str, block: Column) -> DataFrame:
    """Who was tried for each job and what it tells of them: ``pool, job, attempt, member, kind, reason``.

    ``answers`` has what each further try of a job would get (``attempt`` rises; null or 0 is no answer). Tries end with the
    first answer below 500, and after ``ATTEMPTS``. Each try goes to the pool's next member in turn: its tries are numbered
    by job and attempt in blocks, so a pool may hold any share of them. A failed try counts against the member tried, and
    the one that answered gets the credit. A pool without members fails its jobs at once. ``members``: pool and member.
    """
    code = F.coalesce(F.col(http_status), F.lit(0))
    failed = (code == 0) | (code >= 500)
    ended = answers.where(~failed).groupBy(job).agg(F.min(attempt).alias("_end"))
    tried = answers.join(ended, job, "left").where(F.col("_end").isNull() | (F.col(attempt) <= F.col("_end")))
    tried = rank_in_blocks(tried, [job], [attempt], F.lit(0), "_try").where(F.col("_try") <= ATTEMPTS)
    numbered = rank_in_blocks(tried, [pool], [job, attempt], block, "_n")
    ranked = members.select(F.col(pool).alias("_p"), F.col(member).alias("_m")).distinct()
    ranked = ranked.withColumns({"_k": F.row_number().over(Window.partitionBy("_p").orderBy("_m")) - 1, "_of": F.count(F.lit(1)).over(Window.partitionBy("_p"))})
    sizes = ranked.select("_p", "_of").distinct().withColumnsRenamed({"_p": "_q", "_of": "_c"})
    placed = numbered.join(sizes, F.col(pool) == F.col("_q"), "left").withColumn("_at", F.expr("(_n - 1) % _c"))
    out = placed.join(ranked, (F.col(pool) == F.col("_p")) & (F.col("_at") == F.col("_k")), "left").where(F.col("_c").isNotNull() | (F.col("_try") == 1))
    reason = F.when(F.col("_c").isNull(), "no pool members registered").when(code == 0, "no answer").when(code >= 500, F.concat(F.lit("upstream returned "), code.cast("string")))
    return out.select(pool, job, attempt, F.col("_m").alias(member), F.when(F.col("_c").isNotNull(), F.when(failed, "failure").otherwise("success")).alias("kind"), reason.alias("reason"))
