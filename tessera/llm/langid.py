"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams over a bounded, documented sample of the labelled rows (``train_rows``,
20,000 at most in expectation, chosen by a hash of the id). The log-probability matrix
(buckets x languages) is broadcast: it has ``buckets`` rows and a column per label of the sample,
whatever the size of the corpus. Scoring reads every whole text in batches in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any
training row every text is ``und``; null labels teach nothing; a null id is not held out; repeated rows count as often as
they occur; further columns are ignored. The score is the posterior probability of the winner;
ties go to the smaller label.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytesops import Block, blocks
from tessera.llm.common import tune_arrow

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Code point -> lower-case letter's code point, or 32 where it's no letter."""
    global _letters
    if _letters is None:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for cp in (*range(0xD800), *range(0xE000, 0x110000)):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                out[cp] = ord(low[0]) if low else cp
        _letters = out
    return _letters


def features(block: Block, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text index of each n-gram, in order of the texts per n; letters per text."""
    cps = np.frombuffer(block.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    heads = np.concatenate(([0], np.cumsum((block.buf & 0xC0) != 0x80)))
    edges = heads[block.edges]
    mapped = letter_table()[cps]
    text = np.repeat(np.arange(block.n), np.diff(edges))
    solid = mapped != 32
    letters = np.bincount(text[solid], minlength=block.n)
    # a run of other characters counts as one space
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    mapped, text = mapped[keep].astype(np.uint64), text[keep]
    ids, texts = [], []
    for n in ORDERS:
        m = len(mapped) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h *= np.uint64(0x100000001B3)
            h ^= mapped[k : k + m]
        h *= np.uint64(0x9E3779B97F4A7C15)
        same = text[:m] == text[n - 1 :]
        if n == 1:
            same = same & (mapped != 32)
        ids.append((h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)[same])
        texts.append(text[:m][same])
    if not ids:
        return np.empty(0, np.int64), np.empty(0, np.int64), letters
    return np.concatenate(ids), np.concatenate(texts), letters


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass
class Model:
    labels: list[str]
    logp: np.ndarray  # buckets x labels
    prior: np.ndarray

    def score(self, block: Block) -> tuple[list[str], np.ndarray]:
        """Label and posterior of each text of a block."""
        ids, text, letters = features(block, len(self.logp))
        total = np.tile(self.prior, (block.n, 1))
        for j in range(len(self.labels)):
            total[:, j] += np.bincount(text, weights=self.logp[ids, j], minlength=block.n)
        if not self.labels:
            return ["und"] * block.n, np.zeros(block.n)
        top = total.argmax(axis=1)
        post = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        none = letters == 0
        return [("und" if x else self.labels[t]) for t, x in zip(top.tolist(), none.tolist(), strict=True)], np.where(none, 0.0, post)


def fit(labelled: DataFrame, train_rows: int = 20_000, buckets: int = BUCKETS, smooth: float = 0.5) -> Model:
    """Fit on (doc_id, text, lang): at most about ``train_rows`` rows, by a hash of the id."""
    spark = labelled.sparkSession
    tune_arrow(spark)
    usable = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = usable.select("doc_id").count()
    if n > train_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * train_rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            for block in blocks(b.column(0)):
                ids, text, _ = features(block, buckets)
                own = langs[block.first : block.first + block.n]
                for lang in set(own.tolist()):
                    hit = own == lang
                    rows[lang] = rows.get(lang, 0) + int(hit.sum())
                    sums[lang] = sums.get(lang, 0) + np.bincount(ids[hit[text]], minlength=buckets)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.concatenate(([-1], at)), pa.int64()), pa.array(np.concatenate(([rows[lang]], c[at])), pa.int64())],
                names=["lang", "bucket", "n"],
            )

    got = usable.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs, at, c = (np.array(got.column(i).to_pylist(), dtype=object if i == 0 else np.int64) for i in range(3))
    labels = sorted(set(langs.tolist()))
    counts, docs = np.zeros((buckets, len(labels))), np.zeros(len(labels))
    for j, lang in enumerate(labels):
        hit = langs == lang
        docs[j] = c[hit & (at == -1)].sum()
        grams = hit & (at >= 0)
        counts[at[grams], j] = c[grams]
    logp = np.log(counts + smooth) - np.log((counts + smooth).sum(axis=0))
    return Model(labels, logp, np.log(docs / docs.sum()) if len(labels) else np.zeros(0))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (doc_id if None), with lang_pred and score. Reads text only."""
    tune_arrow(docs.sparkSession)
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for block in blocks(b.column("__text")):
                found, score = sent.value.score(block)
                langs += found
                scores.append(score)
            got = [b.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(got, names=[*keep, "lang_pred", "score"])

    return docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text")).mapInArrow(run, f"{fields}, lang_pred string, score double")


def train_split(docs: DataFrame) -> DataFrame:
    """The rows that may teach: those not held out, with a label."""
    return docs.where(~held_out_column() & F.col("lang").isNotNull())


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose language is found with a posterior of ``least`` or more."""
    tune_arrow(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok: list[np.ndarray] = [np.empty(0, bool)]
            for block in blocks(b.column("text")):
                found, score = sent.value.score(block)
                ok.append((score >= least) & (np.array(found, dtype=object) != "und"))
            yield pa.RecordBatch.from_arrays(list(b.filter(pa.array(np.concatenate(ok))).columns), names=names)

    return docs.mapInArrow(run, docs.schema)
