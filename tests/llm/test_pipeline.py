import brute
import corpus_pipeline
import pytest
from test_rows import check_packing

from tessera.llm import ngram_join, packing, quality
from tessera.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, f in corpus_pipeline.STAGES:
        made = f(spark, docs, sf)
        if name != "best_fit_packing":
            assert made.schema.simpleString() == docs.schema.simpleString()
        rows = made.collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, made.schema)
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]


def test_language_keeps_what_has_one(stages):
    before, after = stages[0], {r.doc_id: r for r in stages[1]}
    for r in before:
        if sum(c.isalpha() for c in r.text) > 100:
            assert after[r.doc_id] == r


def test_quality_rejects_the_bad(stages, spark):
    before, after = stages[1], {r.doc_id for r in stages[2]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    checked = [(r.doc_id in after, labels[r.doc_id]) for r in before if r.doc_id in labels and not brute.quality(r.text)[-1]]
    assert all(not brute.quality(r.text)[-1] for r in stages[2])
    assert sum(kept == bool(q) for kept, q in checked) >= 0.97 * len(checked)


def test_one_of_each_group_stays(stages):
    want = brute.components([(r.doc_id, r.text) for r in stages[2]], 5, 80, 100)
    assert sorted(r.doc_id for r in stages[3]) == sorted(d for d, n, c, _ in want if d == c or n == 0)


def test_passages_are_cut(stages):
    want = brute.repeats([r.text for r in stages[3]], corpus_pipeline.PASSAGE_BYTES)
    got = {r.doc_id: r for r in stages[4]}
    assert len(got) == len(stages[3])
    for r, (n, gone, _, _) in zip(stages[3], want, strict=True):
        assert got[r.doc_id].n_chars == len(got[r.doc_id].text)
        assert abs(len(got[r.doc_id].text.encode()) - (n - gone)) <= 8 * (gone > 0)


def test_packing(stages):
    check_packing([(r.doc_id, r.text) for r in stages[4]], stages[5], packing.encoder(tokenizer_path("byte_bpe_50k.json")))


def test_odd_rows_stay_or_go_as_told(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, ""), (3, ""), (4, None), (5, "one two"), (6, "one two")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, did string")
    got = sorted(str(r.doc_id) for r in ngram_join.one_of_each(df).collect())
    assert got == ["1", "3", "3", "4", "5"]
    assert sorted(str(r.doc_id) for r in quality.keep_good(df).collect()) == ["1", "1", "2", "None"]
    assert quality.keep_good(df.limit(0)).count() == ngram_join.one_of_each(df.limit(0)).count() == 0


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
