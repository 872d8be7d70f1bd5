import random

import brute
import pytest

from tessera.llm import ngram_join, queries, suffix
from tessera.llm.graph import components


def family(seed=1, n=30, words=60, edits=3):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        mine = list(base)
        for _ in range(r.randrange(edits + 1)):
            mine[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(mine))
    return out


ODD = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (None, None), (6, "é" * 30), (7, "a" * 900), (8, "ab" * 300)]


def rows_of(spark, data, extra):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    return docs + extra


@pytest.mark.parametrize("size", [40, 100])
def test_repeats_match_brute_force(spark, data, size):
    rows = rows_of(spark, data, ODD) if size == 100 else ODD + list(enumerate(family(2, 12), 100))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, did string")
    got = sorted(map(str, (tuple(r) for r in suffix.digest_repeats(df, size).collect())))
    want = sorted(str((i, *x)) for (i, _), x in zip(rows, brute.repeats([t for _, t in rows], size), strict=True))
    assert got == want


def test_op2_on_whole_table(spark, data):
    rows = rows_of(spark, data, [])
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_suffix_dedup(spark, data).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute.repeats([t for _, t in rows], 400), strict=True)}


def test_small_chunks_and_columns(spark, monkeypatch):
    """Several classes of one chunk, strings that end early, several chunks."""
    strings = [(1, 2, b"xxABCDEFzz"), (1, 1, b"xABCDEFqq"), (1, 0, b"ABCDEF"), (2, 0, b"ABCDEF")]
    spans = suffix.Columns(strings, 6).repeated(__import__("numpy").array([1, 1, 1, 1]))
    assert spans == [[(1, 8)], [(0, 7)], [(0, 6)], []]


def test_hot_anchors_are_divided(spark, monkeypatch):
    """Anchors of more strings than a task takes are cut finer, twice; nothing is lost or added."""
    monkeypatch.setattr(suffix, "HOT_STRINGS", 3)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(r.randrange(5, 25))) + passage + (" x" * (i % 3)) + " ".join(word() for _ in range(r.randrange(5, 25)))) for i in range(40)]
    rows += [(100 + i, passage[i : 120 + i]) for i in range(0, 30, 3)] + [(200, "ab" * 200), (201, "ab" * 90 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    finer = suffix._finer
    monkeypatch.setattr(suffix, "_finer", lambda *a: seen.append(a[2]) or finer(*a))
    got = sorted(tuple(x) for x in suffix.digest_repeats(df, 60).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(rows, brute.repeats([t for _, t in rows], 60), strict=True))
    assert seen == [16, 1]


def test_remove_repeats_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"first {text} one", "en", "a", 9), (2, f"second {text} two", "en", "b", 9), (3, "alone", None, None, 5), (4, None, None, None, None)], "doc_id long, text string, lang string, __row string, n_chars long")
    got = {r.doc_id: r for r in suffix.remove_repeats(df, 60).collect()}
    assert list(got[1].asDict()) == df.columns
    assert got[1].text == "firstone" and got[1].n_chars == 8 and got[2]["__row"] == "b"
    assert got[3].text == "alone" and got[4].text is None


def test_repeats_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.digest_repeats(df, 50).count() == 0


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_components_match_brute_force(spark, data, n, num, den):
    rows = rows_of(spark, data, ODD + list(enumerate(family(3), 1000)) + list(enumerate(family(4, 25, 40, 8), 2000)))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, sid int")
    got = sorted(map(str, (tuple(r) for r in ngram_join.ngram_components(df, n, num, den).collect())))
    assert got == sorted(map(str, brute.components(rows, n, num, den)))


def test_large_family_is_cut(spark, monkeypatch):
    """Families over the bound are joined by pairs of blocks; nothing is lost."""
    monkeypatch.setattr(ngram_join, "FAMILY_TOKENS", 400)
    rows = list(enumerate(family(5, 60, 50, 4) + family(6, 40, 90, 6)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in ngram_join.ngram_components(df, 4, 85, 100).collect())))
    assert got == sorted(map(str, brute.components(rows, 4, 85, 100)))


def test_frequent_tokens_are_marked(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 3)
    rows = list(enumerate(family(7, 60, 30, 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(str, (tuple(r) for r in ngram_join.ngram_components(df, 4, 85, 100).collect())))
    assert got == sorted(map(str, brute.components(rows, 4, 85, 100)))


def test_op6_and_empty_table(spark, data):
    rows = rows_of(spark, data, [])
    got = sorted(tuple(r) for r in queries.op6_ngram_jaccard(spark, data).collect())
    assert got == sorted(brute.components(rows, 4, 85, 100))
    assert ngram_join.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 60), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50}
