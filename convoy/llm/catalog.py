"""Queries p4 to p8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.columns import epoch_ms, url_host, utc_day
from convoy.llm.distinct import distinct_counts, memberships, pattern_totals
from convoy.llm.frequent import frequent_exact, frequent_items
from convoy.llm.leaks import find_leaks, remove_leaks
from convoy.llm.packing import measured, pack
from convoy.llm.redact import Redaction, redact, stand_in_norms
from convoy.llm.tokens import token_counter
from convoy.sources.tables import spread, table

GROUPINGS = [["utc_day", "host"], ["utc_day"], ["host"], []]


def _placed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of jobs with their UTC day and host; rows without either are left out."""
    jobs = table(spark, sf, "jobs").withColumns({"utc_day": utc_day(epoch_ms("created_at")), "host": url_host("url")})
    return jobs.where("utc_day is not null and host is not null")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    patterns = pattern_totals(memberships(_placed_jobs(spark, sf), ["id", "user_id"], ["utc_day", "host"]))
    n = distinct_counts(patterns, GROUPINGS[:1])
    return (
        n.groupBy("utc_day", "host")
        .agg(F.sum(F.expr("if(field_name = 'id', n_distinct, 0)")).alias("jobs"), F.sum(F.expr("if(field_name = 'user_id', n_distinct, 0)")).alias("users"))
        .where("jobs >= 20 and users * 2 >= jobs")
        .select("utc_day", "host")
    )


def p4_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users and urls by day, host, both and neither; null stands for all."""
    patterns = pattern_totals(memberships(_placed_jobs(spark, sf), ["user_id", "url"], ["utc_day", "host"]))
    n = distinct_counts(patterns, GROUPINGS)
    count = lambda f: F.sum(F.when(F.col("field_name") == f, F.col("n_distinct")).otherwise(0)).alias(f"n_{f}s")
    return n.groupBy("level", "utc_day", "host").agg(count("user_id"), count("url")).withColumnsRenamed({"n_user_ids": "n_users"}).drop("level")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_exact(table(spark, sf, "jobs"), ["url", "user_id"]).select("field_name", "item_value")


def p5_frequent(spark: SparkSession, sf: str) -> DataFrame:
    """Count intervals of the values that may hold 1 % of the rows; bounds depend on how files are split."""
    return frequent_items(table(spark, sf, "jobs"), ["url", "user_id"])


def p5_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """The values that hold 1 % of the rows with their exact counts, from the intervals, and how many intervals miss the count,
    are wider than 0.1 % of the rows, or leave such a value out."""
    jobs = table(spark, sf, "jobs")
    intervals = frequent_items(jobs, ["url", "user_id"])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("item_value")) for f in ("url", "user_id")]))
    exact = jobs.select(pairs.alias("p")).select("p.*").where("item_value <> ''").groupBy("field_name", "item_value").agg(F.count(F.lit(1)).alias("n_rows"))
    n = jobs.agg(F.count(F.lit(1))).scalar()
    both = exact.join(intervals, ["field_name", "item_value"], "left").withColumn("wrong", F.when(F.col("count_low").isNull(), F.col("n_rows") * 100 >= n).otherwise(~F.col("n_rows").between(F.col("count_low"), F.col("count_high")) | ((F.col("count_high") - F.col("count_low")) * 1000 > n)))
    return both.groupBy("field_name").agg(F.count_if(F.col("n_rows") * 100 >= n).alias("n_values"), F.sum(F.when(F.col("n_rows") * 100 >= n, F.col("n_rows"))).alias("n_rows"), F.count_if("wrong").alias("wrong"))


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    caps = [(r.cap_id, r.capacity_tokens) for r in table(spark, sf, "pack_capacity").collect()]  # a fixed, tiny table
    sizes = measured(_posts(spark, sf), "doc_id", token_counter()("text"))
    return pack(sizes, "doc_id", "n_tokens", caps)


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any packing, for each capacity: posts, containers above it, posts split without need, tokens lost,
    and whether there are at most 2 % (and one) more containers than the tokens fill."""
    caps = table(spark, sf, "pack_capacity")
    sizes = measured(_posts(spark, sf), "doc_id", token_counter()("text"))
    packed = pack(sizes, "doc_id", "n_tokens", [(r.cap_id, r.capacity_tokens) for r in caps.collect()])
    loads = packed.groupBy("cap_id", "container").agg(F.sum("n_tokens").alias("load")).join(caps, "cap_id")
    by_cap = loads.groupBy("cap_id").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("over_full"), F.sum("load").alias("tokens"), F.count_if(F.col("load") > 0).alias("containers"), F.max("capacity_tokens").alias("c"))
    posts = packed.groupBy("cap_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("size")).join(caps, "cap_id")
    by_post = posts.groupBy("cap_id").agg(F.count(F.lit(1)).alias("n_posts"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("split_without_need"))
    total = sizes.agg(F.sum("n_tokens")).scalar()
    return by_cap.join(by_post, "cap_id").select("cap_id", "n_posts", "over_full", "split_without_need", (total - F.col("tokens")).alias("tokens_lost"), (F.col("containers") * 50 <= F.ceil(F.col("tokens") / F.col("c")) * 51 + 50).alias("tight"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(_posts(spark, sf), table(spark, sf, "eval_items"))


def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return remove_leaks(_posts(spark, sf), table(spark, sf, "eval_items"))


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any removal, as counts: posts that leak nothing and are as they were, and leaks left in what comes out."""
    posts, items = _posts(spark, sf), table(spark, sf, "eval_items")
    cleaned, leaks = remove_leaks(posts, items), find_leaks(posts, items).select("doc_id").distinct()
    same = cleaned.where("n_cut = 0").join(posts.withColumnRenamed("text", "old"), "doc_id").where(F.col("text").eqNullSafe(F.col("old"))).join(leaks, "doc_id", "left_anti")
    return same.agg(F.lit("untouched").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(find_leaks(cleaned, items).agg(F.lit("leaks left").alias("what"), F.count(F.lit(1)).alias("n")))


#: It would come from a secret store; here it is a fixed one so that runs agree.
KEY = "test key"


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """What the redaction found and gave a stand-in of its own."""
    return Redaction(_posts(spark, sf), KEY).findings()


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with stand-ins."""
    return redact(_posts(spark, sf), KEY)


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any redaction, as counts: posts, posts changed without a finding or not changed with one, values that
    still stand in a post they were found in, units of one role that share a stand-in, and stand-ins that are units themselves."""
    posts = _posts(spark, sf)
    done = Redaction(posts, KEY)
    new, found = done.documents(), done.findings()
    both = new.join(posts.withColumnRenamed("text", "old"), "doc_id")
    changed = F.col("text").isNotNull() & (F.col("text") != F.col("old"))
    left = found.join(new, "doc_id").where(F.col("kind").isin("email", "phone", "id_number") & (F.length("pii_value") > 6) & F.col("text").contains(F.col("pii_value")))
    stand = stand_in_norms(done)
    norms = stand.select("role", F.col("norm").alias("stand_in"))
    counts = {
        "posts": new.agg(F.count(F.lit(1)).alias("n")),
        "changed otherwise": both.agg(F.count_if(changed != (F.col("n_replaced") > 0)).alias("n")),
        "values left": left.agg(F.count(F.lit(1)).alias("n")),
        "stand-ins shared": stand.groupBy("role", "stand_in").count().agg(F.count_if(F.col("count") > 1).alias("n")),
        "stand-ins that occur": stand.join(norms, ["role", "stand_in"], "left_semi").agg(F.count(F.lit(1)).alias("n")),
    }
    out = None
    for name, df in counts.items():
        one = df.select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_PLACED = """
    with timed as (select *, case when created_at < 100000000000 then created_at * 1000 when created_at >= 100000000000000 then created_at // 1000 else created_at end as t,
        regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#]*@)?([^/?#]*)', 1) as h from jobs),
    placed as (select *, strftime(epoch_ms(t), '%Y-%m-%d') as utc_day, lower(h) as host from timed
        where regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://') and t is not null)"""
_EITHER = " union all ".join(f"select '{f}' as field_name, {f} as item_value from jobs where {f} <> ''" for f in ("url", "user_id"))

#: Entities are read as blanks here: those in the test tables stand for no letters or digits.
_TAG = r"<[/!?]?[a-zA-Z][^<>]*>|\[/?(?:[a-zA-Z][a-zA-Z0-9]*|\*)(?:=[^\[\]]*)?\]"
_WORDS = rf"regexp_extract_all(lower(nfc_normalize(regexp_replace(regexp_replace({{}}, '{_TAG}', ' ', 'g'), '&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);', ' ', 'g'))), '[\p{{{{L}}}}\p{{{{N}}}}]+')"
_GRAMS = "select distinct {id}, unnest([array_to_string(ws[i:i + 11], ' ') for i in range(1, len(ws) - 10)]) as gram from (select {id}, " + _WORDS + " as ws from {table})"
_LEAKS = "with d as (" + _GRAMS.format("text", id="doc_id", table="documents") + "), i as (" + _GRAMS.format("item_text", id="item_id", table="eval_items") + ") select distinct doc_id, item_id from d join i using (gram)"

QUERIES = {f.__name__: f for f in (p4_found, p4_distinct, p5_found, p5_frequent, p5_invariants, p6_packed, p6_invariants, p7_found, p7_cleaned, p7_invariants, p8_found, p8_redacted, p8_invariants)}
SQL = {
    "p4_found": f"{_PLACED} select utc_day, host from placed group by all having count(distinct id) >= 20 and 2 * count(distinct nullif(user_id, '')) >= count(distinct id)",
    "p4_distinct": f"{_PLACED} select utc_day, host, count(distinct nullif(user_id, '')) as n_users, count(distinct nullif(url, '')) as n_urls from placed group by cube (utc_day, host)",
    "p5_invariants": f"with e as (select field_name, item_value, count(*) as n from ({_EITHER}) group by all), t as (select count(*) as total from jobs) select field_name, count(*) filter (n * 100 >= total) as n_values, cast(sum(n) filter (n * 100 >= total) as bigint) as n_rows, 0::bigint as wrong from e, t group by field_name",
    "p6_invariants": "select cap_id, (select count(*) from documents) as n_posts, 0::bigint as over_full, 0::bigint as split_without_need, 0::bigint as tokens_lost, true as tight from pack_capacity",
    "p7_invariants": f"select 'untouched' as what, (select count(*) from documents) - count(distinct doc_id) as n from ({_LEAKS}) union all select 'leaks left', 0",
    "p8_invariants": "select 'posts' as what, count(*) as n from documents union all select what, 0 from (values ('changed otherwise'), ('values left'), ('stand-ins shared'), ('stand-ins that occur')) v(what)",
    "p7_found": _LEAKS,
    "p5_found": f"select field_name, item_value from ({_EITHER}) group by all having count(*) * 100 >= (select count(*) from jobs)",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
