"""Finding personal information in whole corpora, and writing stand-ins in its place."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoy.functions.columns import spare
from convoy.llm.pii import NAME, Detector
from convoy.llm.surrogates import Surrogates, units
from convoy.sources.tables import scratch, shared_dir

#: Learned given names, and units whose stand-in needed more than one try, up to which their list is broadcast; beyond, documents are joined to it.
BROADCAST_UNITS = 200_000
#: Different names that must teach a given name where their place or form proves that they are names.
LESSONS = 2
SPANS = "array<struct<a: int, b: int, kind: string, value: string, key: string, lesson: string>>"


def detected(docs: DataFrame, text: str, spans: str, given_names: Sequence[str] = ()) -> DataFrame:
    """``docs`` with the candidates of each text in ``spans`` (null if none), written once to the shared folder.

    Texts are scanned where they are read, in whole; what follows reads the candidates and scans nothing again. Only
    ``text`` goes to Python.
    """

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Detector(given_names)
        for texts in batches:
            yield pd.Series([[{"a": a, "b": b, "kind": k, "value": t[a:b], "key": key, "lesson": lesson} for a, b, k, key, lesson in own.candidates(t)] or None if t else None for t in texts], dtype=object)

    path = scratch(docs.sparkSession, "spans")
    docs.withColumn(spans, F.pandas_udf(scan, SPANS).asNondeterministic()(text)).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def learned_names(candidates: DataFrame) -> DataFrame:
    """Given names (``key``) that at least ``LESSONS`` different names teach, from candidates (``s``, one struct a row).

    A title, a closing, a signature line, an e-mail address or a verb of speech beside it proves a name whatever its given
    name; that given name is then known everywhere in the corpus, in small letters and before or after a comma, too.
    """
    taught = candidates.where((F.col("s.kind") == NAME) & F.col("s.key").isNull() & F.col("s.lesson").isNotNull())
    return taught.select(F.col("s.lesson").alias("key"), F.lower("s.value").alias("v")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LESSONS).select("key")


def settled_candidates(candidates: DataFrame, learned: DataFrame) -> DataFrame:
    """The candidates that count: those that are sure, and those whose given name was learned."""
    sure = candidates.where("s.key is null")
    # No hint: learned names are one row each, and joined as their measured size says.
    other = candidates.where("s.key is not null").join(learned, F.col("s.key") == learned["key"], "left_semi")
    return sure.unionByName(other)


def _exploded(source: DataFrame, spans: str, *more: str) -> DataFrame:
    return source.where(F.col(spans).isNotNull()).select(*more, F.explode(spans).alias("s"))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", given_names: Sequence[str] = ()) -> DataFrame:
    """One row ``doc_id, kind, pii_value`` for each document, kind and distinct value, as written in the text.

    Values come from whole texts wherever they stand (quotes, markup and logs included); null and empty texts have none.
    Copies of a document id are taken together. Numbers inside URLs are nobody's.
    """
    source = detected(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), "t", "f", given_names).select("d", "f")
    candidates = _exploded(source, "f", "d")
    return settled_candidates(candidates, learned_names(candidates)).select(F.col("d").alias(doc_id), F.col("s.kind").alias("kind"), F.col("s.value").alias("pii_value")).distinct()


def stand_ins(found: DataFrame, key: str, kind: str = "kind", value: str = "pii_value", tries: int = 40, history: DataFrame | None = None) -> DataFrame:
    """Settle which try gives each unit a stand-in of its own: ``role, norm, attempt``.

    A unit is what values are told apart by: a given name, a family name, a number, an address. A candidate is refused if
    it is itself a unit of the corpus (of any role), or if another unit has it; of several units the first (those of ``history`` before
    others, then by norm) keeps it, and the rest try again. Stand-ins are so many, whatever the size of the corpus, that
    few collide, and groups stay small; where a format allows too few, later tries are longer, so that all are settled.
    ``history`` is an earlier result, whose units keep their attempts: stand-ins of a corpus that grows do not change.
    """
    shared_dir(found.sparkSession)

    @F.pandas_udf("array<struct<role: string, norm: string>>")
    def parts(kinds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([[{"role": r, "norm": n} for r, n in units(k, v)] for k, v in zip(kinds, values, strict=True)])

    @F.pandas_udf("string")
    def candidate(roles: pd.Series, norms: pd.Series, attempts: pd.Series) -> pd.Series:
        own = Surrogates(key)
        return pd.Series([own.canonical(r, x, int(a)) for r, x, a in zip(roles, norms, attempts, strict=True)], dtype=object)

    fresh = found.select(kind, value).distinct().select(F.explode(parts(kind, value)).alias("u")).select("u.*").distinct()
    if history is None:
        all_units = fresh.withColumns({"attempt": F.lit(0), "fixed": F.lit(False)})
    else:
        known = history.select("role", "norm", "attempt", F.lit(True).alias("fixed"))
        all_units = known.unionByName(fresh.join(known, ["role", "norm"], "left_anti").withColumns({"attempt": F.lit(0), "fixed": F.lit(False)}))
    settled = all_units.withColumn("candidate", candidate("role", "norm", "attempt")).checkpoint()
    occurs = settled.select(F.col("norm").alias("c")).distinct().checkpoint()
    place = Window.partitionBy("role", "candidate").orderBy(F.col("fixed").desc(), "attempt", "norm")
    for _ in range(tries):
        clash = settled.join(occurs, F.col("candidate") == F.col("c"), "left").withColumn("rank", F.row_number().over(place) - 1)
        move = ~F.col("fixed") & (F.col("c").isNotNull() | (F.col("rank") > 0))
        judged = clash.select("role", "norm", "attempt", "fixed", "candidate", F.when(move, F.greatest(F.lit(1), "rank")).otherwise(0).alias("more")).checkpoint()
        if judged.where("more > 0").isEmpty():
            return judged.select("role", "norm", "attempt")
        moved = judged.where("more > 0").withColumn("attempt", F.col("attempt") + F.col("more"))
        settled = judged.where("more = 0").drop("more").unionByName(moved.drop("more", "candidate").withColumn("candidate", candidate("role", "norm", "attempt")))
    raise RuntimeError("stand-ins still collide")


class Redaction:
    """One pass of detection over ``docs``, the given names it teaches, and the stand-ins of all that was found.

    :meth:`findings` and :meth:`documents` read the same candidates. ``history`` and :attr:`settled` carry stand-ins from
    one corpus to the next.
    """

    def __init__(self, docs: DataFrame, key: str, text: str = "text", given_names: Sequence[str] = (), tags: bool = False, history: DataFrame | None = None):
        self.columns, self.text, self.key, self.tags = docs.columns, text, key, tags
        self.spans, self.row = spare(docs, "spans", "row")
        self.stored = detected(docs.withColumn(self.row, F.monotonically_increasing_id()), text, self.spans, given_names)
        candidates = _exploded(self.stored, self.spans)
        shared_dir(docs.sparkSession)
        self.learned = learned_names(candidates).checkpoint()
        self.settled = None if tags else stand_ins(settled_candidates(candidates, self.learned).select(F.col("s.kind").alias("kind"), F.col("s.value").alias("pii_value")), key, history=history)

    def _again(self) -> DataFrame:
        return self.settled.where("attempt > 0") if self.settled is not None else self.learned.select(F.col("key").alias("role"), F.col("key").alias("norm"), F.lit(0).alias("attempt")).limit(0)

    def findings(self, doc_id: str = "doc_id") -> DataFrame:
        """One row ``doc_id, kind, pii_value`` for each document, kind and distinct value, as written in the text."""
        found = settled_candidates(_exploded(self.stored, self.spans, doc_id), self.learned)
        return found.select(doc_id, F.col("s.kind").alias("kind"), F.col("s.value").alias("pii_value")).distinct()

    def documents(self, broadcast_units: int = BROADCAST_UNITS) -> DataFrame:
        """The documents with every finding in the text replaced, all other columns as they are, and ``n_replaced``."""
        spark, key, tags = self.stored.sparkSession, self.key, self.tags
        again = self._again()
        few = again.limit(broadcast_units + 1).count() <= broadcast_units and self.learned.limit(broadcast_units + 1).count() <= broadcast_units

        def write(to: Surrogates, text: str, spans) -> tuple[str, int]:
            out, at, n = [], 0, 0
            for s in spans:
                out += [text[at : s["a"]], f"[{s['kind'].upper()}]" if tags else to.replace(s["kind"], text[s["a"] : s["b"]])]
                at, n = s["b"], n + 1
            return "".join([*out, text[at:]]), n

        source = self.stored
        if few:
            known = spark.sparkContext.broadcast(({(u.role, u.norm): u.attempt for u in again.collect()}, frozenset(x.key for x in self.learned.collect())))

            def by_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
                attempts, learned = known.value
                to = Surrogates(key, attempts)
                for texts, lists in batches:
                    yield pd.DataFrame([(t, 0) if spans is None else write(to, t, [s for s in spans if s["key"] is None or s["key"] in learned]) for t, spans in zip(texts, lists, strict=True)], columns=["text", "n"])

            written = F.pandas_udf(by_text, "text string, n bigint").asNondeterministic()(self.text, self.spans)
        else:
            # Long lists: each document gets the spans that count and the attempts of its own units, joined by its number.
            counted = settled_candidates(_exploded(source, self.spans, self.row), self.learned).select(self.row, "s")

            @F.pandas_udf("array<struct<role: string, norm: string>>")
            def parts(kinds: pd.Series, values: pd.Series) -> pd.Series:
                return pd.Series([[{"role": r, "norm": n} for r, n in units(k, v)] for k, v in zip(kinds, values, strict=True)])

            own = counted.select(self.row, F.explode(parts("s.kind", "s.value")).alias("u")).select(self.row, "u.*").distinct().join(again, ["role", "norm"])
            tried = own.groupBy(self.row).agg(F.collect_list(F.struct("role", "norm", "attempt")).alias("tried"))
            spans = counted.groupBy(self.row).agg(F.sort_array(F.collect_list("s")).alias("counted")).join(tried, self.row, "left")
            names = spare(source, "n", "c", "t")
            spans = spans.select(F.col(self.row).alias(names[0]), F.col("counted").alias(names[1]), F.col("tried").alias(names[2]))
            source = source.join(spans, F.col(self.row) == F.col(names[0]), "left")

            def by_row(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
                for texts, lists, tried_lists in batches:
                    rows = []
                    for t, spans, tried in zip(texts, lists, tried_lists, strict=True):
                        rows.append((t, 0) if spans is None else write(Surrogates(key, {(u["role"], u["norm"]): u["attempt"] for u in (tried if tried is not None else ())}), t, spans))
                    yield pd.DataFrame(rows, columns=["text", "n"])

            written = F.pandas_udf(by_row, "text string, n bigint").asNondeterministic()(self.text, names[1], names[2])
        (r,) = spare(source, "r")
        kept = [F.col(f"{r}.text").alias(c) if c == self.text else F.col(c) for c in self.columns if c != "n_replaced"]
        return source.withColumn(r, written).select(*kept, F.col(f"{r}.n").alias("n_replaced"))


def redact(docs: DataFrame, key: str, text: str = "text", given_names: Sequence[str] = (), tags: bool = False, broadcast_units: int = BROADCAST_UNITS, history: DataFrame | None = None) -> DataFrame:
    """The documents with every finding in ``text`` replaced, all other columns as they are, and ``n_replaced``.

    ``tags`` writes ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[NAME]``. Otherwise each value gets its
    keyed stand-in: the same throughout the corpus for the same person, number or place however it is spelled, of the same
    kind, gender, script and format, never one that another value has and never a value that occurs. Over several corpora
    stand-ins agree if each gets what was settled before as ``history`` (see :class:`Redaction`); without it all agree but
    the few that clashed in one of them. Null texts stay null with 0 replacements.
    """
    return Redaction(docs, key, text, given_names, tags, history).documents(broadcast_units)


def stand_in_norms(done: Redaction) -> DataFrame:
    """``role, norm, stand_in``: what tells each unit's stand-in apart, for checks."""
    key = done.key

    @F.pandas_udf("string")
    def own(roles: pd.Series, norms: pd.Series, attempts: pd.Series) -> pd.Series:
        to = Surrogates(key)
        return pd.Series([to.canonical(r, x, int(a)) for r, x, a in zip(roles, norms, attempts, strict=True)], dtype=object)

    return done.settled.select("role", "norm", own("role", "norm", "attempt").alias("stand_in"))
