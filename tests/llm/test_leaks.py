"""Leaked passages: markup, brute force, blocks of items, and removal."""

from __future__ import annotations

import random

import pytest

from convoy.llm.leaks import NGrams, cut, find_leaks, remove_leaks
from convoy.llm.words import placed_words, words

ITEM = "Choose the correct option. The frozen sluice of the lagoon collects gravel for most of the year and 21 crates."


def found(docs, items, **more):
    return {(r.doc_id, r.item_id) for r in find_leaks(docs, items, **more).collect()}


@pytest.mark.parametrize(
    "text, leaked",
    [
        ("so: choose THE correct, option -- the *frozen* sluice of the lagoon collects gravel", True),
        ("choose the correct option the frozen sluice of the lagoon gathers gravel for most of the year", False),
        ("<p>Choose the [i]correct[/i] option.<br/>The&nbsp;frozen\u00a0sluice [url=http://x]of[/url] the\n> lagoon collects gravel</p>", True),
        ("choose the correct option the frozen sluice of the", False),
        ("the frozen sluice of the lagoon collects gravel for most of the year and", True),
        ("choose the correct option the fro&#122;en sluice of the lagoon collects gravel", True),
        (None, False),
        ("", False),
    ],
)
def test_one(text, leaked):
    assert bool(NGrams([(1, ITEM)]).hits([text])) == leaked


def test_words():
    assert words("A&amp;B <b>c</b>[quote=x]d[/quote] e_f É&eacute; 3.5 < 4 e\u0301") == ["a", "b", "c", "d", "e", "f", "éé", "3", "5", "4", "é"]
    for t in ("x &amp; <i>Y</i> É&eacute;z e\u0301t [b]q[/b] 1.5 &unknown; ümlaut", "plain text"):
        assert [w for w, _, _ in placed_words(t)] == words(t)
    t = "ab &eacute;x cd"
    assert [t[a:b] for _, a, b in placed_words(t)] == ["ab", "&eacute;x", "cd"]


def test_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, make(r.randint(0, 20))) for i in range(30)] + [(99, None), (None, make(14))]
    docs = [(i, make(r.randint(0, 300))) for i in range(60)] + [(None, items[0][1]), (7, make(200))]
    want = {(d, i) for d, t in docs for i, s in items if s and i is not None for k in range(len(s.split()) - 5) if f" {' '.join(s.split()[k : k + 6])} " in f" {t} "}
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int").repartition(4)
    e = spark.createDataFrame(items, "item_id bigint, item_text string")
    assert found(d, e, n=6) == want
    assert found(d, e, n=6, block_chars=100) == want  # many blocks of items
    assert found(d.limit(0), e) == set() and found(d, e.limit(0)) == set()


def test_large_ids_beside_null_ids(spark):
    d = spark.createDataFrame([(2**53 + 1, ITEM), (None, "x")], "doc_id bigint, text string").coalesce(1)
    e = spark.createDataFrame([(1, ITEM)], "item_id bigint, item_text string")
    assert found(d, e) == {(2**53 + 1, 1)}


def test_removal(spark):
    rows = [(1, f"Before {'very ' * 40} <b>{ITEM}</b> and after"), (2, ITEM), (3, "nothing here"), (4, None)]
    d = spark.createDataFrame([(*x, "keep", 5) for x in rows], "doc_id bigint, text string, _c string, n_cut int")
    e = spark.createDataFrame([(1, ITEM)], "item_id bigint, item_text string")
    out = {r.doc_id: r for r in remove_leaks(d, e).collect()}
    assert set(out) == {1, 3, 4} and out[3].n_cut == 0 and out[4].text is None and out[1]["_c"] == "keep"
    assert "sluice" not in out[1].text and out[1].text.startswith("Before very") and out[1].text.endswith(".</b> and after")
    assert out[1].n_cut == len(rows[0][1]) - len(out[1].text)
    assert cut("abcdef", [(1, 3), (2, 4)]) == "aef"


def test_removal_does_not_depend_on_blocks(spark):
    """A share that only all items together exceed, passages of several items that overlap, and one that a cut makes anew."""
    r = random.Random(5)
    word = lambda i: f"w{i}"
    a, b = [word(i) for i in range(30)], [word(i) for i in range(20, 60)]
    items = [(1, " ".join(a)), (2, " ".join(b)), *((i, " ".join(f"x{r.randint(0, 9)}" for _ in range(30))) for i in range(3, 20))]
    filler = lambda k: [f"f{k}{i}" for i in range(40)]
    rows = [
        (1, filler(1) + a[:30] + ["and"] + b[10:40]),  # 60 of 101 words
        (2, filler(2) + a[:20] + b + filler(3)),  # 60 of 140 words, overlapping
        (3, filler(4) + a[:6] + b[20:40] + a[6:16] + filler(5)),  # what is left is a passage of item 1
        (4, filler(6) + items[5][1].split()[:12] + filler(7)),
        (5, ["plain"]),
    ]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, item_text string")
    out = {k: {x.doc_id: (x.text, x.n_cut) for x in remove_leaks(d, e, block_chars=k).collect()} for k in (10**6, 1000, 300)}
    assert all(o == out[10**6] for o in out.values()) and set(out[300]) == {2, 3, 4, 5}
    assert out[300][2][0].split() == filler(2) + filler(3) and out[300][3][0].split() == filler(4) + filler(5) and out[300][4][0].split() == filler(6) + filler(7)
    assert found(spark.createDataFrame([(i, t) for i, (t, _) in out[300].items()], "doc_id bigint, text string"), e) == set()


def test_grams_are_flat(spark):
    """Memory of the set: some 70 bytes an n-gram; repeats within and across items count once each."""
    grams = NGrams([(7, "a b c a b c a b c"), (8, "b c a x"), (7, "a b c")], 3)
    assert {tuple(grams.table[g]): grams.items(g).tolist() for g in range(len(grams.hashes))} == {(0, 1, 2): [7], (1, 2, 0): [7, 8], (2, 0, 1): [7], (2, 0, 3): [8]}
    assert grams.hits(["c a x", None, "b c a b"]) == [(0, 0, g) for g in range(4) if tuple(grams.table[g]) == (2, 0, 3)] + sorted((2, i, g) for i, w in enumerate([(1, 2, 0), (2, 0, 1)]) for g in range(4) if tuple(grams.table[g]) == w)
