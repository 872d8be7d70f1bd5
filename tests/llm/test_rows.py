import hashlib
import math
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, langid, packing, quality, queries, topk

TOKENIZER = queries.tokenizer_path("byte_bpe_50k.json")


# packing


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_encoder_is_the_tokenizer(text):
    enc = packing.encoder(TOKENIZER)
    assert enc.fast is not None
    assert enc.ids(text).tolist() == enc.slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plan_holds_every_piece(counts):
    made = packing.plan_bins(counts, 64, (4, 8), (4,))
    got = defaultdict(int)
    for held, bins, room in made:
        assert bins > 0 and sum(k * c for k, c in held.items()) == 64 - room <= 64
        for k, c in held.items():
            got[k] += c * bins
    assert dict(got) == counts


def test_plan_is_near_the_bound():
    r = np.random.default_rng(3)
    for lengths in (r.integers(1, 1025, 20_000), r.integers(300, 700, 20_000), np.minimum(1024, r.lognormal(6, 1, 20_000).astype(int) + 1)):
        counts = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
        made = packing.plan_bins(counts)
        bins = sum(b[1] for b in made)
        first_fit, rooms = 0, np.zeros(1025, dtype=int)  # best fit decreasing, by room
        for k in sorted(counts, reverse=True):
            for _ in range(counts[k]):
                fit = np.flatnonzero(rooms[k:])
                if len(fit):
                    rooms[k + fit[0]] -= 1
                    rooms[fit[0]] += 1
                else:
                    first_fit += 1
                    rooms[1024 - k] += 1
        assert bins <= 1.003 * max(first_fit, math.ceil(lengths.sum() / 1024)) + 1, (bins, first_fit)
        assert len(made) < 6000


def test_plans_come_from_groups(monkeypatch):
    """Each plan puts the large lengths into configurations of rounded sizes first; it is near the bound."""
    r = np.random.default_rng(4)
    lengths = np.minimum(1023, r.lognormal(6, 0.8, 30_000).astype(int) + 1)
    counts = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    seen = []
    real = packing.configurations
    monkeypatch.setattr(packing, "configurations", lambda sizes, demand, capacity: seen.append((len(sizes), int(demand.sum()))) or real(sizes, demand, capacity))
    bins = sum(b[1] for b in packing.plan_bins(counts))
    assert bins <= 1.005 * math.ceil(lengths.sum() / 1024)
    assert [n for _, n in seen] == [int((lengths > 1024 // limit).sum()) for _ in range(2) for limit in (4, 3)] and all(2 <= g <= 256 for g, _ in seen)
    sizes = packing._groups([(9, 5), (7, 3), (4, 4)], 4)
    assert sizes == {9: [[9, 3], [9, 2], [7, 1]], 7: [[7, 2], [4, 1]], 4: [[4, 3]]}


def test_batches_are_tried_against_the_tokenizer(monkeypatch):
    enc = packing.Encoder(TOKENIZER)
    texts = [f"text {i}" for i in range(70)]
    want = [enc.slow.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.batch(texts)] == want
    enc.fast = type("Wrong", (), {"encode_ordinary": staticmethod(lambda t: [1])})()
    assert [x.tolist() for x in enc.batch(texts)] == want


def check_packing(rows, got, enc, capacity=1024):
    by, used = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in rows:
        ids = np.append(enc.slow.encode(text or "", add_special_tokens=False).ids, 2).astype("<u4")
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert sum(r.length for r in mine) == len(ids) and all(r.length == capacity for r in mine[1:])
        assert len(mine) == -(-len(ids) // capacity)
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length


def test_op3(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op3_best_fit_packing(spark, data).collect()
    check_packing(rows, got, packing.encoder(TOKENIZER))
    assert len({r.sequence_id for r in got}) <= 1.02 * math.ceil(sum(r.length for r in got) / 1024) + 1


def test_packing_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 3000), (4, "<|endoftext|> a"), (5, "a " * 1023), (6, "a " * 1024)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    check_packing(rows, packing.pack_documents(df, TOKENIZER).collect(), packing.encoder(TOKENIZER))
    same = spark.createDataFrame([(1, "a b")] * 50, "doc_id long, text string")
    got = packing.pack_documents(same, TOKENIZER).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 50
    assert packing.pack_documents(same.limit(0), TOKENIZER).count() == 0


# language


def test_language_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert len(got) == len(docs) and {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    with_letters = [d for d in held if any(c.isalpha() for c in d.text)]
    right = sum(got[d.doc_id].lang_pred == d.lang for d in with_letters)
    assert right >= 0.97 * len(with_letters)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "123 !!", "fr"), (None, "der Hund", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.labels == ["en", "fr"]
    got = [tuple(r) for r in langid.predict(df, model).collect()]
    assert [g[1] for g in got[:4]] == ["en", "fr", "und", "und"] and got[4][1] in ("en", "fr") and got[2][2] == 0
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_scores_are_those_of_plain_counts():
    """The vectorised n-grams of a block are those of each text alone."""
    import pyarrow as pa

    from tessera.llm.bytesops import blocks

    texts = ["Ab, c", "", "été 12", "İx"]
    whole = next(blocks(pa.array(texts)))
    ids, text, letters = langid.features(whole)
    for i, t in enumerate(texts):
        alone, _, n = langid.features(next(blocks(pa.array([t]))))
        assert sorted(ids[text == i]) == sorted(alone) and n[0] == letters[i] == sum(c.isalpha() for c in t)


# quality


def test_op9_counts_and_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(d.text), d.doc_id
        assert not (r.kept and r.base_failed)
    labels = [x for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if not got[x.doc_id].base_failed]
    right = sum(got[x.doc_id].kept == bool(x.quality) for x in labels)
    assert right >= 0.95 * len(labels)


def test_quality_odd_rows(spark):
    texts = [None, "", " \n\n", "a b a b a b", "same line\nsame line\nsame line\n", "é " * 60, "\n".join(["x"] * 60), "word " * 20_000]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, pattern double")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), t
    assert quality.judge(df.limit(0)).count() == 0


def test_expectation_maximisation_finds_the_rules():
    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.8
    votes = np.zeros((8, 20_000), dtype=int)
    for j in range(8):
        right = r.random(20_000) < (0.95 if j < 6 else 0.6)
        votes[j] = np.where(r.random(20_000) < 0.2, 0, np.where(right == good, 1, -1))
    patterns, counts = np.unique(quality.pattern_of(votes), return_counts=True)
    post, share, table = quality.expectation_maximisation(patterns, counts)
    assert abs(share - 0.8) < 0.03
    assert abs(table[1, 0, 2] / (table[1, 0, 0] + table[1, 0, 2]) - 0.95) < 0.03
    verdict = dict(zip(patterns.tolist(), post >= 0.5))
    assert np.mean([verdict[p] for p in quality.pattern_of(votes).tolist()] == good) > 0.97


# search


def search_plainly(rows, k, asks):
    usable = [(i, np.floor(1024 * np.array(v, dtype=float))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if asks(q):
            scored = sorted((-int(a @ b), i) for i, b in usable if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).tolist()) for i in range(600)] + [(i, [0.5] * 8) for i in range(600, 640)]
    rows += [(700, None), (800, [None] * 8), (900, [float("nan")] * 8), (1000, [float("inf")] * 8), (1100, [1.0] * 3), (1101, [2.0] * 3), (1200, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    for block, shard in ((2048, 8192), (3, 50)):
        got = topk.top_k(df, df.vec_id % 100 == 0, 10, 1024.0, block, shard)
        as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        assert sorted(map(tuple, got.collect())) == search_plainly(as_float, 10, lambda q: q % 100 == 0)
    assert topk.top_k(df.limit(0), df.vec_id % 100 == 0).count() == 0


def test_ball_tree_skips():
    r = np.random.default_rng(6)
    x = np.floor(r.normal(size=(4000, 3)) * 100)
    best = topk.Best(np.array([-1]), 5, np.full(1, -(2**62)))
    tree = topk.BallTree(x, 32)
    read = topk.search(tree, np.arange(4000), np.array([[50.0, 10.0, -20.0]]), best, np.array([0]))
    assert read < len([n for n in tree.nodes if n[3] is None]) / 4
    s = x @ np.array([50.0, 10.0, -20.0])
    assert [v for v, _ in best.kept[0]] == sorted(s.astype(int).tolist(), reverse=True)[:5]


# chat


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ausi\n\\<|", max_size=6), st.text("a\n\\<|im_start>end", max_size=30)), max_size=5))
def test_format_is_reversible(turns):
    text, spans = chat.format_turns([*turns, ("assistant", "<|im_end|>\n<\\|")])
    assert chat.parse_formatted(text) == [*turns, ("assistant", "<|im_end|>\n<\\|")]
    assert chat.masked_text(text, spans) == "".join(t for r, t in [*turns, ("assistant", "<|im_end|>\n<\\|")] if r == "assistant")


def test_reply_tree_branches(spark):
    tree = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 2, "user", "c", 9.0), ("t", 5, 3, "user", "d", 1.0), ("t", 6, 5, "assistant", None, None), (None, 1, None, None, "alone", 0.0), ("u", 9, 77, "user", "orphan", 0.0)]
    df = spark.createDataFrame([(*r, "x") for r in tree], "tree_id string, msg_id long, parent_id long, role string, text string, score double, leaf string")
    got = {(r.tree_id, r.leaf): [t for _, t in chat.parse_formatted(r.formatted)] for r in chat.format_paths(df).collect()}
    assert got == {("t", 4): ["q", "a", "c"], ("t", 6): ["q", "b", "d", ""], (None, 1): ["alone"], ("u", 9): ["orphan"]}
    assert sorted(str(r.leaf) for r in chat.format_paths(df, best=1).collect()) == ["1", "4", "9"]


def test_reply_trees_odd_rows(spark):
    """Cycles, with leaves below them, own parents, doubled and unnamed messages, a deep chain, equal scores."""
    rows = [("c", 1, 2, 0.0), ("c", 2, 1, 0.0), ("c", 3, 2, 9.0), ("c", 4, 3, 0.0), ("c", 5, 5, 0.0), ("c", 6, 5, 0.0), ("c", 7, None, 1.0)]
    rows += [("d", 1, None, 0.0)] * 3 + [("d", 2, 1, 1.0), ("d", 2, 1, 1.0), ("d", 3, 2, 1.0), ("d", None, 2, 5.0), ("d", 3, 1, 1.0)]
    rows += [("deep", i, i - 1 if i else None, 1.0) for i in range(300)] + [("deep", 1000 + i, 100, 1.0) for i in range(3)] + [("e", 1, None, None), ("e", 3, 1, 2.0), ("e", 2, 1, 2.0), ("e", 4, 1, 1.0)]
    df = spark.createDataFrame([(t, m, p, "user", f"m{m}", s, 0) for t, m, p, s in rows], "tree_id string, msg_id long, parent_id long, role string, text string, score double, back int")
    got = {(r.tree_id, r.leaf): [t for _, t in chat.parse_formatted(r.formatted)] for r in chat.format_paths(df).collect()}
    chain = [f"m{i}" for i in range(300)]
    want = {("c", 7): ["m7"], ("d", 2): ["m1", "m2"], ("d", 3): ["m1", "m3"], ("deep", 299): chain} | {("deep", 1000 + i): [*chain[:101], f"m{1000 + i}"] for i in range(3)} | {("e", i): ["m1", f"m{i}"] for i in (2, 3, 4)}
    assert got == want
    first = lambda n: sorted((r.tree_id, r.leaf) for r in chat.format_paths(df, best=n).collect())
    assert first(1) == [("c", 7), ("d", 2), ("deep", 299), ("e", 2)]
    assert first(2) == [("c", 7), ("d", 2), ("d", 3), ("deep", 299), ("deep", 1000), ("e", 2), ("e", 3)]


def test_conversations_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, "assistant", None), (None, 3, None, "x"), (2, 5, "assistant", "<|im_end|>")] + [(3, i, "user", str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest_formatted(chat.format_paths(chat.linear_tree(df))).collect()}
    assert got[1].n_turns == 3 and got[3].n_turns == 40 and got[None].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"assistant\n\nuser\nhi\nuser\nhi\n").hexdigest()
    assert got[3].turns_sha256 == hashlib.sha256("".join(f"user\n{i}\n" for i in range(40)).encode()).hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"<|im_end|>").hexdigest()
    assert chat.format_paths(chat.linear_tree(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op7_topk_search", "op10_chat_format"])
def test_sql_agrees(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, data).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
