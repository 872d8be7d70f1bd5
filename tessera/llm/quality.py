"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a text. Expectation-maximisation over the
vote patterns of all documents estimates how often each rule votes which way on good and on bad
texts; a document is kept by its posterior probability of being good, not by passing all rules.
The number of distinct vote patterns is bounded by 3**rules, whatever the corpus; only their
counts reach the driver.

Defined results: a null text has no words; texts under ``MIN_WORDS`` words, or with over half of
their words in repeated windows, fail the base check and are never kept; repeated rows each get
their row; an empty table gives no rows; further columns are ignored (or kept by ``judge``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytesops import Block, blocks, per_text, span_hash
from tessera.llm.common import materialize, tune_arrow

MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbols", "marked_words", "upper", "repeats", "dup_lines", "letters", "word_length", "bars")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True


def _twice(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, hash): whether it occurs twice or more; whether it has occurred before."""
    order = np.lexsort((np.arange(len(h)), h, text))
    t, k = text[order], h[order]
    same = (t[1:] == t[:-1]) & (k[1:] == k[:-1])
    again, seen = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[1:]] |= same
    seen[order[1:]] = same
    again[order[:-1]] |= same
    return again, seen


def measure(block: Block) -> dict[str, np.ndarray]:
    """Counts of each text of a block, over whole texts."""
    n, buf = block.n, block.buf
    starts, ends, text = block.words()
    out = {"n_words": per_text(text, n)}
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[block.edges]).astype(np.int64)
    heads = (buf & 0xC0) != 0x80
    space = np.isin(buf, np.array([0x20, 9, 10, 11, 12, 13], dtype=np.uint8))
    out["word_chars"] = sums(heads & ~space)
    out["n_symbols"] = sums(_SYMBOL[buf])
    out["n_bars"] = sums(buf == ord("|"))
    out["n_upper"], out["n_lower"] = sums(_UPPER[buf]), sums(_LOWER[buf])
    out["n_letters"] = out["n_upper"] + out["n_lower"] + sums((buf >= 0xC0))
    marks = np.concatenate(([0], np.cumsum(_SYMBOL[buf] | (buf == ord("!")))))
    out["n_marked"] = per_text(text[marks[ends] > marks[starts]], n)
    # lines with a word: of each, the span between its line breaks
    breaks = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate((block.edges[:-1], breaks + 1)))
    line_start = line_start[line_start < len(buf)]
    line_end = np.concatenate((line_start[1:], [len(buf)])) if len(line_start) else line_start
    line_end = np.where((line_end > line_start) & (buf[np.maximum(line_end - 1, 0)] == 10), line_end - 1, line_end) if len(line_start) else line_end
    solid = np.concatenate(([0], np.cumsum(~space)))
    with_word = solid[line_end] > solid[line_start]
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_text = block.text_of(line_start)
    _, seen = _twice(line_text, span_hash(buf, line_start, line_end))
    out["n_lines"] = per_text(line_text, n)
    out["n_dup_lines"] = per_text(line_text[seen], n)
    covered = np.zeros(len(starts), dtype=bool)
    if len(starts) >= 3:
        w = span_hash(buf, starts, ends)
        m = len(w) - 2
        h = (w[:m] * np.uint64(3) + w[1 : m + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]
        inside = np.flatnonzero(text[:m] == text[2:])
        again, _ = _twice(text[inside], h[inside])
        hit = inside[again]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = per_text(text[covered], n)
    return out


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Rules x texts: +1 good, -1 bad, 0 abstains."""
    words = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["word_chars"], 1)
    few = m["n_words"] < 5

    def rule(value: np.ndarray, good: float, bad: float) -> np.ndarray:
        out = np.where(value <= good, 1, np.where(value >= bad, -1, 0))
        return np.where(few, 0, out)

    cased = np.maximum(m["n_upper"] + m["n_lower"], 1)
    length = m["word_chars"] / words
    return np.stack([
        rule(m["n_symbols"] / chars, 0.01, 0.05),
        rule(m["n_marked"] / words, 0.05, 0.3),
        rule(m["n_upper"] / cased, 0.15, 0.4),
        rule(m["n_repeat_words"] / words, 0.15, 0.35),
        np.where(m["n_lines"] < 2, 0, rule(m["n_dup_lines"] / np.maximum(m["n_lines"], 1), 0.1, 0.3)),
        rule(-m["n_letters"] / chars, -0.8, -0.6),
        rule(np.abs(length - 6.0), 3.0, 6.0),
        rule(m["n_bars"] / words, 0.05, 0.25),
    ]).astype(np.int8)


def pattern_of(v: np.ndarray) -> np.ndarray:
    """Votes of a text as one number in base 3."""
    return ((v.astype(np.int64) + 1) * (3 ** np.arange(len(v)))[:, None]).sum(axis=0)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, rules: int = len(RULES)) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of each pattern being good; share of good texts; P(vote | class), 2 x rules x 3.

    Starts from the majority of votes and a small Dirichlet prior that expects a rule to be right
    more often than wrong, so that the class called good is the one the rules vote for.
    """
    v = (patterns[:, None] // (3 ** np.arange(rules))) % 3
    weight = counts.astype(float)
    lead = (v == 2).sum(axis=1) - (v == 0).sum(axis=1)
    post = np.clip(0.5 + 0.15 * lead, 0.02, 0.98)
    prior = np.ones((2, rules, 3))
    prior[0, :, 0] = prior[1, :, 2] = 4.0
    share, table = 0.5, prior / prior.sum(axis=2, keepdims=True)
    for _ in range(rounds):
        was = post
        good = weight * post
        share = (good.sum() + 1) / (weight.sum() + 2)
        table = prior.copy()
        for j in range(rules):
            table[1, j] += np.bincount(v[:, j], weights=good, minlength=3)
            table[0, j] += np.bincount(v[:, j], weights=weight - good, minlength=3)
        table /= table.sum(axis=2, keepdims=True)
        spoke = v != 1  # an abstention says nothing of the class
        log = [np.where(spoke, np.log(table[c, np.arange(rules), v] / (table[c, np.arange(rules), 0] + table[c, np.arange(rules), 2])), 0).sum(axis=1) for c in (0, 1)]
        odds = log[1] - log[0] + np.log(share) - np.log1p(-share)
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if len(post) == 0 or np.abs(post - was).max() < 1e-9:
            break
    return post, float(share), table


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern long"


def _measured(column: pa.Array) -> list[np.ndarray]:
    """Counts, base check and pattern of votes of each text."""
    parts: list[list[np.ndarray]] = []
    for block in blocks(column):
        m = measure(block)
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        parts.append([*(m[c] for c in COUNTS), failed, pattern_of(votes(m))])
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 5 + [np.empty(0, bool), np.empty(0, np.int64)]


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with the counts, the base check and the pattern of votes."""
    tune_arrow(docs.sparkSession)
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = _measured(b.column("__text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x) for x in flat)], names=[*keep, *COUNTS, "base_failed", "pattern"])

    return docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text")).mapInArrow(run, f"{fields}{FEATURES}")


def _verdicts(measured: DataFrame) -> dict[int, float]:
    """Posterior of each pattern of votes that occurs (3**rules at most)."""
    # texts that fail the base check are told apart already; the rules learn from the others
    seen = measured.where(~F.col("base_failed")).groupBy("pattern").count().toArrow()
    patterns = np.array(seen.column(0).to_pylist(), dtype=np.int64)
    post, _, _ = expectation_maximisation(patterns, np.array(seen.column(1).to_pylist(), dtype=np.int64))
    return dict(zip(patterns.tolist(), post.tolist(), strict=True))


def judge(docs: DataFrame, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Columns ``keep`` (doc_id if None), counts, base_failed, posterior and kept of each row."""
    spark = docs.sparkSession
    measured = materialize(features(docs, keep or ["doc_id"]), "quality")
    verdict = spark.createDataFrame(sorted(_verdicts(measured).items()), "pattern long, posterior double")
    joined = measured.join(F.broadcast(verdict), "pattern", "left")  # 3**rules rows at most
    return joined.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= threshold)).drop("pattern")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, with all columns. Reads the texts twice, and stores none of them."""
    post = _verdicts(features(docs, []))
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *_, failed, pattern = _measured(b.column("text"))
            good = np.array([post.get(x, 0.0) >= threshold for x in pattern.tolist()], dtype=bool)
            yield pa.RecordBatch.from_arrays(list(b.filter(pa.array(~failed & good)).columns), names=names)

    return docs.mapInArrow(run, docs.schema)
