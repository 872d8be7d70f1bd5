"""Packing of tokenised documents into sequences of a fixed length, by a linear grouping scheme.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There the
large lengths are put in groups of equal cardinality and rounded up to their group's largest; the
packing of the few sizes is optimised over configurations (column generation, then rounding);
actual lengths take the places of the rounded ones, and the small lengths go in by best fit. The
plan counts bins, not documents: its size depends on the capacity, not on the corpus. Pieces find
their place by their ordinal among the pieces of their length, dealt over buckets by row (not by content) so
that a length, or a text, that most pieces have is no single group.

Defined results: a null or empty text is the end id alone; only documents over the capacity are cut,
the first piece being the short one; very long texts are read whole; repeated rows and ids are separate
documents; ids may be null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, tune_arrow

CAPACITY, END_ID = 1024, 2
TRIED = 64
Batch = tuple[dict[int, int], int, int]  # lengths of a bin with their counts, number of such bins, room left


class Encoder:
    """ids of a ``tokenizers`` file. Byte-level BPE files whose ids are merge ranks are run by
    tiktoken on the same vocabulary, which gives the same ids several times as fast. Whether it
    does is tried at the start and on the first and each ``TRIED``-th text of every batch; a batch with a
    difference, and texts with added tokens, go through ``tokenizers`` alone."""

    PROBE = "It's 12 o'clock,\n\n  naïve Ünïcode — 漢字 \t ok!! x y  "

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if spec["model"]["type"] == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer"):
            self.fast = self._ranks(spec["model"]["vocab"])
            try:
                same = self.fast.encode_ordinary(self.PROBE) == self.slow.encode(self.PROBE, add_special_tokens=False).ids
            except Exception:  # noqa: BLE001  the panics of the backend are no subclass of a common error
                same = False
            self.fast = self.fast if same else None

    def _ranks(self, vocab: dict[str, int]):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        out = [self.ids(t) for t in texts]
        if self.fast is not None and any(self.slow.encode(texts[i], add_special_tokens=False).ids != out[i].tolist() for i in range(0, len(texts), TRIED)):
            return [np.array(self.slow.encode(t, add_special_tokens=False).ids, dtype="<u4") for t in texts]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id if None), piece, start, length, ids_crc32 of each piece, and ``__deal``, a
    number by which the rows are dealt evenly."""
    tune_arrow(docs.sparkSession)
    keep = keep or ["doc_id"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, dealt = encoder(tokenizer), TaskContext.get().partitionId() << 33
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, found in enumerate(enc.batch([t or "" for t in b.column("__text").to_pylist()])):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                total = len(ids)
                at, n = 0, 0
                while at < total:
                    take = min(capacity, (total - at) if at or total <= capacity else (total % capacity or capacity))
                    row.append(i)
                    piece.append(n)
                    start.append(at)
                    length.append(take)
                    crc.append(zlib.crc32(ids[at : at + take].tobytes()))
                    at, n = at + take, n + 1
            pick = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in keep), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(dealt, dealt + len(row)))], names=[*keep, "piece", "start", "length", "ids_crc32", "__deal"])
            dealt += len(row)

    return docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text")).mapInArrow(run, f"{fields}, piece int, start long, length long, ids_crc32 long, __deal long")


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value (sizes may repeat)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], value[order]
    for c in range(int(s[0]), capacity + 1):
        fit = np.searchsorted(s, c, side="right")
        got = best[c - s[:fit]] + v[:fit]
        j = int(got.argmax())
        if got[j] > best[c - 1] + 1e-12:
            best[c], pick[c] = got[j], j
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations with how many bins use each: column generation, rounded down, the rest first fit."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        try:
            dual = np.linalg.solve(basis.T, np.ones(k))
        except np.linalg.LinAlgError:
            break
        value, column = _knapsack(sizes, dual, capacity)
        if value <= 1 + 1e-7:
            break
        x, move = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column.astype(float))
        ok = move > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, np.maximum(x, 0) / np.where(ok, move, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    left, out = demand.astype(np.int64).copy(), []
    try:
        x = np.linalg.solve(basis, demand.astype(float))
    except np.linalg.LinAlgError:
        x = np.zeros(k)
    for j in np.argsort(-x):
        column = basis[:, j].astype(np.int64)
        used = column > 0
        times = int(min(np.floor(max(0.0, x[j]) + 1e-9), (left[used] // column[used]).min(initial=0))) if used.any() else 0
        if times > 0:
            out.append((column, times))
            left -= column * times
    order = np.argsort(-sizes)
    while left.any():
        column, room = np.zeros(k, dtype=np.int64), capacity
        for j in order:
            take = min(int(left[j]), room // int(sizes[j]))
            column[j], room = take, room - take * int(sizes[j])
        used = column > 0
        times = int((left[used] // column[used]).min())
        out.append((column, times))
        left -= column * times
    return out


def _substitute(groups: list[list[list[int]]], made: list[tuple[np.ndarray, int]], capacity: int) -> list[Batch]:
    """Bins of actual lengths: each place of a group takes the group's next length, in runs."""
    out: list[Batch] = []
    for column, times in made:
        slots = [j for j in np.flatnonzero(column) for _ in range(int(column[j]))]
        done = 0
        while done < times:
            # as many equal bins as every group still has of the lengths that come next
            need: dict[tuple[int, int], int] = {}
            chosen: dict[int, int] = {}
            taken: dict[int, int] = {}
            for j in slots:
                skip, at = taken.get(j, 0), 0
                while skip >= groups[j][at][1]:
                    skip -= groups[j][at][1]
                    at += 1
                taken[j] = taken.get(j, 0) + 1
                need[j, at] = need.get((j, at), 0) + 1
                chosen[groups[j][at][0]] = chosen.get(groups[j][at][0], 0) + 1
            run = min(times - done, *(groups[j][at][1] // c for (j, at), c in need.items()))
            for (j, at), c in need.items():
                groups[j][at][1] -= c * run
            for j in {j for j, _ in need}:
                groups[j][:] = [r for r in groups[j] if r[1]]
            out.append((chosen, run, capacity - sum(k * c for k, c in chosen.items())))
            done += run
    return out


def _best_fit(batches: list[Batch], counts: dict[int, int], capacity: int) -> list[Batch]:
    """Small lengths, longest first, into the bins with the least room that holds them."""
    rooms: dict[int, list[Batch]] = {}
    for b in batches:
        rooms.setdefault(b[2], []).append(b)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fit = min((r for r in rooms if r >= size and rooms[r]), default=None)
            if fit is None:
                per = capacity // size
                rooms.setdefault(capacity, []).append(({}, max(1, left // per), capacity))
                continue
            held, bins, room = rooms[fit].pop()
            per = room // size
            if left < per:
                per = left
            run = min(bins, left // per)
            if run < bins:
                rooms[fit].append((held, bins - run, room))
            now = held | {size: held.get(size, 0) + per}
            rooms.setdefault(room - per * size, []).append((now, run, room - per * size))
            left -= per * run
    return [b for bs in rooms.values() for b in bs if b[0]]


def _groups(large: list[tuple[int, int]], n_groups: int) -> dict[int, list[list[int]]]:
    """Lengths, longest first, in groups of equal cardinality: runs [length, count] by the group's largest."""
    each = -(-sum(c for _, c in large) // n_groups)
    sizes: dict[int, list[list[int]]] = {}
    top, held = 0, each
    for k, c in large:
        while c:
            if held == each:
                top, held = k, 0
            take = min(c, each - held)
            sizes.setdefault(top, []).append([k, take])  # groups whose largest length is the same are one size
            held, c = held + take, c - take
    return sizes


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, group_counts: tuple[int, ...] = (128, 256), limits: tuple[int, ...] = (4, 3)) -> list[Batch]:
    """Bins for a histogram of lengths. Tries a few numbers of groups and limits between small and
    large (capacity // limit), and returns the plan of fewest bins. Every plan groups its large lengths."""
    full = [({capacity: 1}, counts[capacity], 0)] if counts.get(capacity) else []
    rest = {k: c for k, c in counts.items() if 0 < k < capacity and c}
    best: list[Batch] | None = None
    for n_groups in group_counts:
        for limit in limits:
            large = sorted(((k, c) for k, c in rest.items() if k > capacity // limit), reverse=True)
            made: list[Batch] = []
            if large:
                sizes = _groups(large, n_groups)
                order = sorted(sizes, reverse=True)
                demand = np.array([sum(c for _, c in sizes[s]) for s in order])
                made = _substitute([sizes[s] for s in order], configurations(np.array(order), demand, capacity), capacity)
            made = _best_fit(made, {k: c for k, c in rest.items() if k <= capacity // limit}, capacity)
            if best is None or sum(b[1] for b in made) < sum(b[1] for b in best):
                best = made
    return full + (best or [])


def places(batches: list[Batch]) -> np.ndarray:
    """The plan by length: rows (length, first ordinal, first sequence, pieces a bin, offset), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for held, bins, _ in batches:
        offset = 0
        for size in sorted(held, reverse=True):
            rows.append((size, used.get(size, 0), sequence, held[size], offset))
            used[size] = used.get(size, 0) + held[size] * bins
            offset += size * held[size]
        sequence += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 20_000) -> DataFrame:
    """``cut`` (materialised pieces, with a length and ``__deal``) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = places(plan_bins(counts, capacity))
    sent = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan))
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    dealt = cut.withColumn("__bucket", F.pmod(F.xxhash64("__deal"), F.lit(buckets)).cast("int"))
    tally = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    before = tally.withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("length", "__bucket").orderBy("__deal")
    ranked = dealt.withColumn("__at", F.row_number().over(within)).join(before.select("length", "__bucket", F.coalesce("__before", F.lit(0)).alias("__before")), ["length", "__bucket"])
    names = [c for c in cut.columns if c != "__deal"]
    ready = ranked.select(*names, (F.col("__before") + F.col("__at") - 1).cast("long").alias("__ordinal"))
    fields = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, plan = sent.value
        for b in batches:
            length, ordinal = b.column("length").to_numpy(), b.column("__ordinal").to_numpy()
            p = plan[np.searchsorted(keys, length << 44 | ordinal, side="right") - 1]
            k = ordinal - p[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p[:, 2] + k // p[:, 3]), pa.array(p[:, 4] + (k % p[:, 3]) * length)], names=[*names, "sequence_id", "offset"])

    return ready.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep: list[str] | None = None) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id, keep), "pieces"), capacity)
