"""Exact removal of byte strings that occur more than once, by column-wise construction.

A collection's Burrows-Wheeler order and common-prefix lengths are built one symbol per string
and round, from the last column to the first (``Columns``): a round reads one column of symbols
from a sequential file, reorders the suffixes by it and updates the lengths. Whole documents would
need as many rounds as the longest has bytes, so they are first cut into strings of bounded length
that keep every comparison that matters: each window of ``size`` bytes belongs to its anchor, the
least-hashed ``size // 2`` bytes inside it (leftmost on ties). Equal windows have equal anchors at
equal offsets, so only strings of one anchor, aligned at it, need to be compared, and a string is at
most 1.5 times ``size`` long. Anchors that occur once are left out by a count over the corpus, and
equal strings (64-bit hashes of anchor and string) are built once, with a weight. Otherwise hashes
only bring strings together; what is removed is decided by the common prefixes.

Defined results: a null text is empty; empty and short texts lose nothing; a repeated row is a
repetition of its text; ids may be null or repeated; an empty table gives no rows; very long texts
are read whole; further columns are ignored (``remove_repeats`` keeps them).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytesops import Block, blocks, mix, span_hash, window_hash
from tessera.llm.common import discard, materialize, partitions, tune_arrow, worker_temp

U64 = np.uint64
CHUNK = 24 << 20  # bytes of strings that a task builds at a time
HOT_STRINGS = 20_000  # different strings around one anchor, beyond which it is divided
STEPS = (16, 1)  # window starts of the shorter strings it is divided into


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values (two running minima over tiles of w)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    tiles = -(-len(x) // w)
    padded = np.full(tiles * w, np.iinfo(np.uint64).max, dtype=U64)
    padded[: len(x)] = x
    square = padded.reshape(tiles, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(block: Block, size: int) -> tuple[np.ndarray, ...]:
    """Of each anchor of each text: key, hash of its whole string and the anchor's place in it, text
    index, anchor, first and last window start.

    Positions are relative to the text.
    """
    gram = size // 2
    w = size - gram + 1
    prefix = block.prefix()
    h = window_hash(prefix, gram)
    ranked = ((h >> U64(32)) << U64(32)) | np.arange(len(h), dtype=U64)
    at = (_sliding_min(ranked, w) & U64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(block.edges)
    long = np.flatnonzero(lengths >= size)
    if not len(long):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty, empty
    counts = lengths[long] - size + 1
    text = np.repeat(long, counts)
    begin = block.edges[long]
    p = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    a = at[p]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(p)])) - 1
    base = block.edges[text[first]]
    content = mix(span_hash(block.buf, p[first], p[last] + size) ^ (a[first] - p[first]).astype(U64))
    return h[a[first]].view(np.int64), content.view(np.int64), text[first], a[first] - base, p[first] - base, p[last] - base


class Columns:
    """Column-wise construction over strings in classes, each aligned at its anchor.

    ``rows``: (class, left, string) with the anchor at offset ``left`` of the string; sorted by
    class. The symbols are laid out by column in a file of the task; a round reads one column.
    State between rounds: the order of the suffixes within their classes, and the length of the
    common prefix of each with the one before.
    """

    def __init__(self, rows: list[tuple[int, int, bytes]], size: int):
        self.size, self.m = size, len(rows)
        self.lefts = np.array([r[1] for r in rows], dtype=np.int64)
        lengths = np.array([len(r[2]) for r in rows], dtype=np.int64)
        self.left = int(self.lefts.max(initial=0))
        self.width = self.left + int((lengths - self.lefts).max(initial=0))
        classes = np.array([r[0] for r in rows], dtype=np.int64)
        self.klass = np.concatenate(([0], np.cumsum(classes[1:] != classes[:-1]))) if self.m else classes
        self.file = tempfile.TemporaryFile(dir=worker_temp())
        # symbol 0 is "no symbol here"; a byte b is b + 1
        step = max(1, (4 << 20) // max(1, self.width))
        self.file.truncate(2 * self.width * self.m)
        for lo in range(0, self.m, step):
            some = rows[lo : lo + step]
            tile = np.zeros((len(some), self.width), dtype=np.uint16)
            for i, (_, left, body) in enumerate(some):
                tile[i, self.left - left : self.left - left + len(body)] = np.frombuffer(body, dtype=np.uint8)
                tile[i, self.left - left : self.left - left + len(body)] += 1
            across = np.ascontiguousarray(tile.T)
            if lo == 0 and len(some) == self.m:
                self.file.seek(0)
                self.file.write(across.tobytes())
            else:
                for c in range(self.width):
                    self.file.seek(2 * (c * self.m + lo))
                    self.file.write(across[c].tobytes())
        self.ends = self.left - self.lefts + lengths

    def column(self, c: int) -> np.ndarray:
        self.file.seek(2 * c * self.m)
        return np.frombuffer(self.file.read(2 * self.m), dtype=np.uint16)

    def rounds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, order, common prefix with the one before) after each round, last column first."""
        order = np.arange(self.m)
        common = np.zeros(self.m + 1, dtype=np.int32)
        inside = np.zeros(self.m, dtype=bool)  # same class as the one before, in any order
        inside[1:] = self.klass[1:] == self.klass[:-1]
        heads = np.flatnonzero(~inside)
        for c in range(self.width - 1, -1, -1):
            symbol = self.column(c)[order]
            differs = inside.copy()
            differs[1:] &= symbol[1:] != symbol[:-1]
            common[:-1] += 1
            if differs.any():
                mixed = np.add.reduceat(differs, heads) > 0
                touched = np.flatnonzero(mixed[self.klass])
                s = symbol[touched].astype(np.int64)
                moved = touched[np.argsort((self.klass[touched] << 9) | s, kind="stable")]
                # lengths between suffixes that are neighbours now: the least between their old places
                before, after = moved[:-1], moved[1:]
                alike = (symbol[before] == symbol[after]) & (self.klass[before] == self.klass[after])
                fresh = np.zeros(len(moved), dtype=np.int32)
                lo, hi = before[alike] + 1, after[alike] + 1
                if len(lo):
                    fresh[1:][alike] = np.minimum.reduceat(common, np.stack([lo, hi], axis=1).ravel())[::2]
                order[touched] = order[moved]
                symbol[touched] = symbol[moved]
                common[touched] = fresh
            common[:-1][~inside] = 0
            common[:-1][symbol == 0] = 0
            yield c, order, common

    def repeated(self, weights: np.ndarray) -> list[list[tuple[int, int]]]:
        """Of each string, the byte ranges that windows found elsewhere cover."""
        marks = tempfile.TemporaryFile(dir=worker_temp())
        alone = weights >= 2
        for c, order, common in self.rounds():
            if c > self.left:
                continue
            mark = np.zeros(self.m, dtype=bool)
            long = common[:-1] >= self.size
            mark[order[long]] = True
            mark[order[np.flatnonzero(long) - 1]] = True
            mark |= alone & (c >= self.left - self.lefts) & (c + self.size <= self.ends)
            marks.write(np.packbits(mark).tobytes())
        self.file.close()
        stride, n = -(-self.m // 8), min(self.left + 1, self.width)
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.m)]
        marks.seek(0)
        found = np.frombuffer(marks.read(), dtype=np.uint8).reshape(n, stride)[::-1]
        marks.close()
        for lo in range(0, self.m, 1 << 16):
            hi = min(self.m, lo + (1 << 16))
            flags = np.unpackbits(found[:, lo // 8 : -(-hi // 8)], axis=1)[:, : hi - lo].T
            edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            for (i, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
                off = int(self.left - self.lefts[lo + i])
                out[lo + i].append((a - off, b - 1 + self.size - off))
        return out


def row_keys() -> tuple[Column, Column]:
    """A row's identity (did, tid): its id, or its text's hash without one, and a hash of its text."""
    text = F.coalesce("text", F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("did"), F.hash(text).alias("tid")


_STRING = "key long, content long, left int, weight long, body binary"
_RANGE = "key long, content long, start int, stop int"


def repeated_spans(docs: DataFrame, size: int = 400) -> DataFrame:
    """(did, tid, start, stop): byte ranges covered by windows that also start elsewhere.

    Equal strings of an anchor are counted before any text moves: one of them is built, with the
    count as its weight, and its ranges go back to all.
    """
    spark = docs.sparkSession
    tune_arrow(spark)
    keyed = docs.select(*row_keys(), F.coalesce("text", F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, tid = b.column(0).to_numpy(), b.column(1).to_numpy()
            for block in blocks(b.column(2)):
                key, content, text, a, first, last = anchors(block, size)
                where = (first << 24) | ((last - first) << 12) | (a - first)
                rows = text + block.first
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(did[rows]), pa.array(tid[rows]), pa.array(where)], names=["key", "content", "did", "tid", "place"])

    found = materialize(keyed.where(F.octet_length("text") >= size).mapInArrow(find, "key long, content long, did long, tid int, place long"), "anchors")
    again = materialize(found.groupBy("key").count().where("count >= 2").select("key"), "again", found.rows // 8)
    # both sides are dealt by key for this join alone, so that Spark can split a hot key
    shared = materialize(found.join(again, "key"), "shared", found.rows // 8)
    discard(found)
    discard(again)
    strings = materialize(shared.groupBy("key", "content").agg(F.count("*").alias("weight"), F.min(F.struct("did", "tid", "place")).alias("rep")), "strings", shared.rows)
    wanted = strings.groupBy("rep.did", "rep.tid").agg(F.collect_list(F.struct("key", "content", "weight", "rep.place")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(0)[i].as_py().encode()
                items = b.column(1)[i].values
                place = items.field(3).to_numpy()
                first, span, left = place >> 24, (place >> 12) & 0xFFF, place & 0xFFF
                bodies = [data[f : f + n + size] for f, n in zip(first.tolist(), span.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([items.field(0), items.field(1), pa.array(left, pa.int32()), items.field(2), pa.array(bodies, pa.binary())], names=["key", "content", "left", "weight", "body"])

    pieces = keyed.join(wanted, ["did", "tid"]).select("text", "wanted").mapInArrow(cut, _STRING)
    ranges = _repeated_ranges(pieces, strings, size, STEPS)
    back = shared.join(ranges, ["key", "content"])
    first = F.shiftright("place", 24).cast("int")
    out = materialize(back.select("did", "tid", (first + F.col("start")).alias("start"), (first + F.col("stop")).alias("stop")), "spans", shared.rows)
    for gone in (shared, strings, ranges):
        discard(gone)
    return out


def _repeated_ranges(strings: DataFrame, index: DataFrame, size: int, steps: tuple[int, ...]) -> DataFrame:
    """(key, content, start, stop): ranges of each string that repeated windows cover.

    ``index`` has the (key, content) of all ``strings``. An anchor with more than ``HOT_STRINGS``
    different strings is no single task's: its strings are cut again into shorter ones that share
    more than the anchor (``_finer``), down to single windows.
    """
    hot = index.groupBy("key").count().where(F.col("count") > HOT_STRINGS).select("key")
    if not steps or not hot.head(1):
        return materialize(_build(strings, size), "ranges", 4 * index.rows)
    kept = materialize(strings, "bodies")
    hot = materialize(hot, "hot", index.rows // HOT_STRINGS)
    plain = _build(kept.join(hot, "key", "left_anti"), size)
    finer = materialize(_finer(kept.join(hot, "key"), size, steps[0]), "finer")
    several = finer.groupBy("key", "content").agg(F.sum("weight").alias("weight"), F.first("left").alias("left"), F.first("body").alias("body")).select("key", "content", "left", "weight", "body")
    several = materialize(several, "several")
    inner = _repeated_ranges(several, several, size, steps[1:])
    back = finer.join(inner, ["key", "content"]).select(F.col("of_key").alias("key"), F.col("of_content").alias("content"), (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop"))
    out = materialize(plain.unionByName(back), "ranges", 4 * index.rows)
    for gone in (kept, hot, finer, several, inner):
        discard(gone)
    return out


def _finer(strings: DataFrame, size: int, step: int) -> DataFrame:
    """Strings of ``step`` window starts each, keyed by all the bytes that these windows share.

    of_key, of_content and at tell where a string was cut from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, content, left, weight, body in zip(*(b.column(c).to_pylist() for c in ("key", "content", "left", "weight", "body")), strict=True):
                starts = len(body) - size + 1
                for back in range((left - starts + 1) // step, left // step + 1):  # steps of the distance to the anchor
                    lo, hi = max(0, left - back * step - step + 1), min(starts - 1, left - back * step)
                    if lo > hi:
                        continue
                    core = left - back * step
                    own = body[lo : hi + size]
                    name = hashlib.blake2b(f"{key}:{back}:".encode() + body[core : core - step + 1 + size], digest_size=8).digest()
                    what = hashlib.blake2b(f"{core - lo}:".encode() + own, digest_size=8).digest()
                    out.append((int.from_bytes(name, "little", signed=True), int.from_bytes(what, "little", signed=True), core - lo, weight, own, key, content, lo))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out[i : i + 20_000]], kinds[j]) for j in range(8)], names=["key", "content", "left", "weight", "body", "of_key", "of_content", "at"])

    return strings.select("key", "content", "left", "weight", "body").mapInArrow(run, _STRING + ", of_key long, of_content long, at int")


def _build(strings: DataFrame, size: int) -> DataFrame:
    """Column-wise construction of whole classes, as many at a time as ``CHUNK`` bytes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        names: list[tuple[int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            spans = Columns(rows, size).repeated(np.array([w for _, w in names], dtype=np.int64))
            out = [(k, c, a, b) for (k, _, _), (c, _), s in zip(rows, names, spans, strict=True) for a, b in s]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kinds[j]) for j in range(4)], names=["key", "content", "start", "stop"])

        for b in batches:
            for key, content, left, weight, body in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if held > CHUNK and rows[-1][0] != key:  # a class stays whole
                    yield flush()
                    rows, names, held = [], [], 0
                rows.append((key, left, body))
                names.append((content, weight))
                held += len(body)
        if rows:
            yield flush()

    dealt = strings.select("key", "content", "left", "weight", "body").repartition(partitions(strings.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, _RANGE)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _with_spans(docs: DataFrame, size: int, keep: list[Column]) -> DataFrame:
    spans = repeated_spans(docs, size).groupBy("did", "tid").agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))
    return docs.select(*row_keys(), *keep, F.col("text").alias("__text")).join(spans, ["did", "tid"], "left")


def _spans_of(value) -> list[tuple[int, int]]:
    return merge_spans([(s["start"], s["stop"]) for s in value or []])


def digest_repeats(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, runs, digest = [], [], [], []
            for text, value in zip(b.column("__text").to_pylist(), b.column("__spans").to_pylist(), strict=True):
                data, spans = (text or "").encode(), _spans_of(value)
                total.append(len(data))
                gone.append(sum(y - x for x, y in spans))
                runs.append(len(spans))
                digest.append(hashlib.sha256(without(data, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, size, [F.col("doc_id")]).select("doc_id", "__text", "__spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = 400) -> DataFrame:
    """The rows with the repeated bytes cut from ``text`` (and split characters dropped).

    ``n_chars``, where there is one, is set anew; a null text stays null.
    """
    others = [F.col(c) for c in docs.columns if c != "text"]
    whole = _with_spans(docs, size, [F.struct(*others, F.lit(0).alias("__at")).alias("__row")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if t is None else (without(t.encode(), _spans_of(s)).decode("utf-8", "ignore") if s else t) for t, s in zip(b.column("__text").to_pylist(), b.column("__spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(made, pa.string())], names=["__row", "__text"])

    slim = whole.select("__row", "__text", "__spans")
    kind = slim.schema["__row"].dataType.simpleString()
    made = slim.mapInArrow(run, f"__row {kind}, __text string")
    set_anew = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return made.select(*[set_anew[c].alias(c) if c in set_anew else F.col("__row")[c].alias(c) for c in docs.columns])
