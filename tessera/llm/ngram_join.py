"""Exact Jaccard self-join of word n-gram sets, with connected components.

1. Every whole text becomes a set of shingle hashes; equal sets collapse to one set with a weight.
2. Prefix filter in a rare-first order. Two sets with J >= t share one of their first
   n - ceil(t n) + 1 tokens in any common order. The order is: tokens of the selected hash range
   that one set alone has, then those of few sets, then those of many, then the other tokens.
   Only tokens of the selected range (a little more than a prefix of each set) are counted
   over the corpus. A set whose prefix is full of tokens of its own is linked with nothing.
   A token that is frequent within a batch is sent once, with a mark, in place of its sets.
3. Sets that share prefix tokens and have compatible sizes form families (connected components
   over stars of tokens and size classes). A set only has links inside its family.
4. Each family is joined exactly. A large one is cut into bounded blocks by size class and hash,
   and a task gets one pair of blocks of compatible sizes. In a task the inverted lists are cut
   into blocks by size class, sorted by position, and what positions rule out is skipped; the answers
   of a set are derived from those of a similar set (``FamilyJoin``). A task returns a row per set,
   never its pairs.

Defined results: a null or empty text has the empty set, no links, and its own id as component;
a text of fewer words is one shingle; very long texts are read whole; rows with equal sets are linked;
an id may be null (its component is the smallest id reached, or null); an empty table gives no rows;
further columns are ignored. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bytesops import LOWER, Block, blocks, mix, per_text, shingle_hash, span_hash
from tessera.llm.common import materialize, partitions, tune_arrow
from tessera.llm.graph import components
from tessera.llm.suffix import row_keys

U64 = np.uint64
HOT = 64
FAMILY_TOKENS = 200_000  # of a family that one task joins whole
BLOCK_TOKENS = (100_000, 750_000)  # of a block of a larger family, which has about 32 blocks
WHOLE = ":whole"  # ends the name of a task that has all of its family


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of the distinct shingles of each text, sorted."""
    starts, ends, text = block.words()
    words = span_hash(LOWER[block.buf], starts, ends)
    h, t = shingle_hash(words, text, n)
    count = per_text(text, block.n)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        few = np.isin(text, short)
        place = np.arange(len(text)) - np.concatenate(([0], np.cumsum(count)))[text]
        folded = mix(words[few] + place[few].astype(U64) * U64(0x9E3779B97F4A7C15))
        sums = np.zeros(block.n, dtype=U64)
        np.add.at(sums, text[few], folded)
        h, t = np.concatenate((h, mix(sums[short] ^ U64(0x5851F42D4C957F2D)))), np.concatenate((t, short))
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return t[new], h[new]


def set_ids(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit id of each text's set, equal for equal sets."""
    sums = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix(h ^ U64(0xA0761D6478BD642F)), dtype=U64)))
    cuts = np.searchsorted(text, np.arange(n + 1))
    total = sums[cuts[1:]] - sums[cuts[:-1]]
    return mix(total + np.diff(cuts).astype(U64)).view(np.int64)


class Threshold:
    """Jaccard >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        share = 1 - num / den + 0.25
        self.limit = U64(min(1.0, share) * (2**64 - 2**11))  # of the selected hash range

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return size - -(-self.num * size // self.den) + 1

    def least(self, size: np.ndarray) -> np.ndarray:
        """The smallest size of a set that can be linked with one of ``size``."""
        return -(-self.num * size // self.den)

    def linked(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * overlap >= self.num * (a + b - overlap)

    def band_column(self, size: str) -> Column:
        return F.floor(F.log(size) / F.lit(math.log(self.den / self.num)) + F.lit(1e-9)).cast("long")

    def band(self, size: np.ndarray) -> np.ndarray:
        """Size class; linked sets are in the same or in neighbouring classes."""
        return np.floor(np.log(np.maximum(size, 1)) / math.log(self.den / self.num) + 1e-9).astype(np.int64)


class FamilyJoin:
    """The sets of one task, and the answers of each (the sets that it is linked with).

    Tokens are numbered rare first, so that a set is a sorted array and a token has a position in it. The
    index has the first tokens of each set; the list of a token is cut into blocks by size class, sorted by
    position. Two sets whose first common token stands at positions i and j share no more tokens than
    follow in either, so of a block a set reads the entries up to a position, and skips the rest.

    A set that is read from the index is a leader: its lists are read for a lower overlap than a link
    needs, low enough for every set linked with a set that is linked with the leader itself. The
    answers of those sets, which are very similar, are then derived from the leader's overlaps: only
    the lists of the tokens that differ are read.
    """

    def __init__(self, sets: list[np.ndarray], at: Threshold):
        self.at = at
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        m = len(sets)
        flat = np.concatenate(sets) if sets else np.empty(0, U64)
        _, named, often = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(often), dtype=np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        owner = np.repeat(np.arange(m), self.size)
        token = rank[named]
        order = np.lexsort((token, owner))
        self.token = token[order]
        self.edges = np.concatenate(([0], np.cumsum(self.size)))
        place = np.arange(len(flat)) - self.edges[owner]
        # whole lists, for tokens that differ
        by_token = np.argsort(self.token, kind="stable")
        self.holder = owner[by_token]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(self.token, minlength=len(often)))))
        # the index
        band = at.band(self.size)
        self.low = int(band.min(initial=0))
        self.width = int(band.max(initial=0)) - self.low + 1
        self.largest = np.array([self.size[band == self.low + b].max(initial=0) for b in range(self.width)])
        first = place <= self.size[owner] - self.reach(self.size, at.least(self.size))[owner]
        cell = (self.token * self.width + (band - self.low)[owner])[first]
        inside = np.lexsort((place[first], cell))
        self.entry, self.place = owner[first][inside], place[first][inside]
        self.block = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=len(often) * self.width))))
        self.spot = np.full(m, -1, dtype=np.int64)
        self.mine = np.zeros(len(often), dtype=bool)

    def slack(self, size: np.ndarray) -> np.ndarray:
        """The most tokens in which a set and one linked with it differ."""
        return (self.at.den - self.at.num) * 2 * size // self.at.num + 1

    def reach(self, size: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Overlap of a leader with every set that may be linked with a set linked with the leader. Such a set
        differs in up to slack tokens, and has up to slack more."""
        d = self.slack(size)
        need = -(-(self.at.num * (size + other + d)) // (self.at.num + self.at.den)) - d
        return np.maximum(need, 1)

    def near(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets in reach of a leader, with their overlaps."""
        size = int(self.size[x])
        mine = self.token[self.edges[x] : self.edges[x + 1]]
        bands = np.arange(self.width)
        other = np.minimum(self.largest, size * self.at.den // self.at.num + self.slack(np.int64(size)) * 2)
        smallest = np.ceil(((self.at.den / self.at.num) ** (bands + self.low)) - 1e-6).astype(np.int64)
        need = self.reach(np.int64(size), np.minimum(smallest, self.largest))
        use = np.flatnonzero((need <= self.largest) & (need <= size) & (self.largest > 0))
        found = []
        for b in use.tolist():
            tokens = mine[: size - int(need[b]) + 1]
            lo, hi = self.block[tokens * self.width + b], self.block[tokens * self.width + b + 1]
            last = int(other[b]) - int(self.reach(np.int64(size), other[b]))  # the position up to which entries can matter
            at = _ranges(lo, hi)
            found.append(self.entry[at[self.place[at] <= last]] if last < int(self.largest[b]) else self.entry[at])
        near = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        self.mine[mine] = True
        overlap = np.empty(len(near), dtype=np.int64)
        for i in range(0, len(near), 2000):
            some = near[i : i + 2000]
            held = self.mine[self.token[_ranges(self.edges[some], self.edges[some + 1])]]
            overlap[i : i + 2000] = np.add.reduceat(held.astype(np.int64), np.concatenate(([0], np.cumsum(self.size[some])[:-1])))
        self.mine[mine] = False
        return near, overlap

    def derive(self, leader: int, x: int, n: int) -> np.ndarray:
        """What to add to the overlaps of the leader's ``n`` sets for those of ``x``."""
        a, b = (self.token[self.edges[i] : self.edges[i + 1]] for i in (leader, x))
        out = np.zeros(n, dtype=np.int64)
        for tokens, sign in ((np.setdiff1d(b, a, assume_unique=True), 1), (np.setdiff1d(a, b, assume_unique=True), -1)):
            at = self.spot[self.holder[_ranges(self.start[tokens], self.start[tokens + 1])]]
            out += sign * np.bincount(at[at >= 0], minlength=n)
        return out

    def answers(self, asks: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(set, sets it is linked with) of every set, or of those in a mask."""
        left = np.ones(len(self.size), dtype=bool) if asks is None else asks.copy()
        for leader in np.argsort(-self.size, kind="stable").tolist():
            if not left[leader]:
                continue
            near, overlap = self.near(leader)
            linked = self.at.linked(overlap, self.size[leader], self.size[near])
            self.spot[near] = np.arange(len(near))
            for x in [leader, *near[linked & left[near] & (near != leader)].tolist()]:
                mine = overlap if x == leader else overlap + self.derive(leader, x, len(near))
                ok = near[self.at.linked(mine, self.size[x], self.size[near])]
                left[x] = False
                yield x, ok[ok != x]
            self.spot[near] = -1


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers lo..hi - 1 of each pair, end to end."""
    counts = hi - lo
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)


class Groups:
    """Sets that are linked, as labels: joined without a step per pair."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: list[np.ndarray | None] = [np.array([i]) for i in range(n)]

    def join(self, x: int, others: np.ndarray) -> None:
        found = self.label[others]
        if len(found) == 0 or (found == self.label[x]).all():
            return
        parts = np.unique(np.append(found, self.label[x])).tolist()
        keep = max(parts, key=lambda p: len(self.members[p]))
        for p in parts:  # the smaller ones take the label of the largest
            if p != keep:
                self.label[self.members[p]] = keep
        self.members[keep] = np.concatenate([self.members[p] for p in parts])
        for p in parts:
            if p != keep:
                self.members[p] = None


def _measure(docs: DataFrame, n: int, at: Threshold) -> DataFrame:
    """doc_id, did, tid, n_shingles, n_chosen, sid of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for block in blocks(b.column(3)):
                text, h = shingle_sets(block, n)
                parts.append((per_text(text, block.n), per_text(text[h < at.limit], block.n), set_ids(text, h, block.n)))
            flat = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x) for x in flat)], names=["doc_id", "did", "tid", "n_shingles", "n_chosen", "sid"])

    return docs.select("doc_id", *row_keys(), "text").mapInArrow(run, f"doc_id {kind}, did long, tid int, n_shingles long, n_chosen long, sid long")


def _prefix_tokens(docs: DataFrame, n: int, at: Threshold, sets: DataFrame) -> DataFrame:
    """(token, sid, band): the prefix tokens of each set that other sets have, too."""
    spark = docs.sparkSession
    buckets = partitions(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens packed by bucket. kind 0: token of a set (+1: outside the chosen range); 2: mark of
        a frequent token (+1); 4: passed on, a frequent token's set (+1)."""
        known: set[int] = set()
        for b in batches:
            tokens, owners, kinds = [], [], []
            for block in blocks(b.column(0)):
                text, h = shingle_sets(block, n)
                size = per_text(text, block.n)
                sid = set_ids(text, h, block.n)
                chosen = per_text(text[h < at.limit], block.n)
                place = np.arange(len(h)) - np.concatenate(([0], np.cumsum(size)))[text]
                new = np.zeros(block.n, dtype=bool)
                for i, s in enumerate(sid.tolist()):
                    if size[i] and s not in known:
                        new[i] = True
                        if len(known) < 500_000:
                            known.add(s)
                # hashes are sorted within a text: the chosen range comes first, then the least others
                send_to = np.maximum(chosen, at.prefix(size))
                take = new[text] & (place < send_to[text])
                tokens.append(h[take])
                owners.append(sid[text[take]])
                kinds.append((h[take] >= at.limit).astype(np.uint8))
            if not tokens:
                continue
            token, owner, kind = np.concatenate(tokens), np.concatenate(owners), np.concatenate(kinds)
            _, back, count = np.unique(token, return_inverse=True, return_counts=True)
            bucket = (mix(token) % U64(buckets)).astype(np.int64)
            hot = count[back] >= HOT
            if hot.any():
                marks, first = np.unique(token[hot], return_index=True)
                mark_kind = kind[hot][first] + 2
                bucket = np.concatenate((np.where(hot, np.arange(len(token)) % buckets, bucket), (mix(marks) % U64(buckets)).astype(np.int64)))
                kind = np.concatenate((kind + hot * np.uint8(4), mark_kind)).astype(np.uint8)
                token, owner = np.concatenate((token, marks)), np.concatenate((owner, np.zeros(len(marks), np.int64)))
            order = np.argsort(bucket, kind="stable")
            token, owner, kind, bucket = token[order], owner[order], kind[order], bucket[order]
            if not len(bucket):
                continue
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            last = [*first[1:], len(bucket)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[i]) for i in first], pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary()) for x in (token, owner, kind))],
                names=["bucket", "tokens", "owners", "kinds"],
            )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens that several sets have, to each of them: (sid, rarity class, token)."""
        held = [[], [], []]
        for b in batches:
            for j, kind in enumerate((U64, np.int64, np.uint8)):
                held[j] += [np.frombuffer(x, dtype=kind) for x in b.column(j + 1).to_pylist()]
        if not held[0]:
            return
        token, owner, kind = (np.concatenate(x) for x in held)
        passed = kind >= 4
        out = [(owner[passed], np.where(kind[passed] & 1, 3, 2), token[passed])]
        marked = np.unique(token[(kind == 2) | (kind == 3)])
        plain = kind < 2
        token, owner, kind = token[plain], owner[plain], kind[plain]
        order = np.lexsort((owner, token))
        token, owner, kind = token[order], owner[order], kind[order]
        if len(token):
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
            token, owner, kind = token[new], owner[new], kind[new]
            _, back, count = np.unique(token, return_inverse=True, return_counts=True)
            mark = np.isin(token, marked)
            tell = (count[back] >= 2) | mark
            rarity = np.where(kind == 1, 3, np.where((count[back] >= HOT) | mark, 2, 1))
            out.append((owner[tell], rarity[tell], token[tell]))
        for o, r, t in out:
            for i in range(0, len(o), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(o[s]), pa.array(r[s].astype(np.int32)), pa.array(t[s].view(np.int64))], names=["sid", "rarity", "token"])

    packed = docs.select("text").mapInArrow(send, "bucket int, tokens binary, owners binary, kinds binary")
    told = packed.repartition(buckets, "bucket").mapInArrow(shared, "sid long, rarity int, token long")
    per_set = told.groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("rarity", "token"))).alias("told"))
    room = F.expr(f"n_shingles - (({at.num} * n_shingles + {at.den - 1}) div {at.den}) + 1 - (n_chosen - size(filter(told, x -> x.rarity < 3)))").cast("int")
    first = per_set.join(sets, "sid").withColumns({"room": room, "band": at.band_column("n_shingles")}).where("room > 0")
    return first.select("sid", "band", F.explode(F.slice("told", F.lit(1), F.col("room"))).alias("x")).select(F.col("x.token").alias("token"), "sid", "band")


def _resolve(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their set ids; sets with root, component_id and n_links."""
    spark = docs.sparkSession
    tune_arrow(spark)
    at = Threshold(num, den)
    rows = materialize(_measure(docs, n, at), "rows")
    sets = rows.where("n_shingles > 0").groupBy("sid").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.first("n_shingles").alias("n_shingles"), F.first("n_chosen").alias("n_chosen"), F.min(F.struct("did", "tid")).alias("rep")
    )
    sets = materialize(sets, "sets", rows.rows)
    prefixes = materialize(_prefix_tokens(docs, n, at, sets), "prefixes", rows.rows)
    stars = _stars(prefixes)
    families = components(stars, prefixes.rows // 8)
    members = materialize(families.join(sets, F.col("node") == F.col("sid")).select("sid", F.col("root").alias("family"), "weight", "n_shingles", "rep"), "members", rows.rows)
    totals = materialize(members.groupBy("family").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("n")).where("n > 1"), "totals", members.rows)
    several = members.join(totals.select("family", "total"), "family")
    alone = F.array(F.struct(F.concat(F.col("family").cast("string"), F.lit(WHOLE)).alias("task"), F.lit(0).alias("side")))
    wanted = several.where(F.col("total") <= FAMILY_TOKENS).select("sid", "weight", "rep", alone.alias("tasks"))
    any_large = bool(totals.where(F.col("total") > FAMILY_TOKENS).head(1))
    if any_large:
        tasks = _tasks(several.where(F.col("total") > FAMILY_TOKENS), at)
        cut = members.join(tasks, "sid").groupBy("sid").agg(F.first("weight").alias("weight"), F.first("rep").alias("rep"), F.collect_list(F.struct("task", "side")).alias("tasks"))
        wanted = wanted.unionByName(cut)
    did, tid = row_keys()
    texts = docs.select(did, tid, F.coalesce("text", F.lit("")).alias("text"))
    full = wanted.select("sid", "weight", "tasks", F.col("rep.did").alias("did"), F.col("rep.tid").alias("tid")).join(texts, ["did", "tid"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for block in blocks(b.column(2)):
                text, h = shingle_sets(block, n)
                cuts = np.searchsorted(text, np.arange(block.n + 1))
                out += [h[cuts[i] : cuts[i + 1]].tobytes() for i in range(block.n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(out, pa.binary())], names=["sid", "weight", "tasks", "tokens"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def flush() -> pa.RecordBatch:
            once = {h[0]: h for h in held}  # a set may stand on both sides
            ids = list(once)
            sides = np.array([once[i][3] for i in ids])
            weights = np.array([once[i][1] for i in ids], dtype=np.int64)
            join = FamilyJoin([np.frombuffer(once[i][2], dtype=U64) for i in ids], at)
            groups, links = Groups(len(ids)), np.zeros(len(ids), dtype=np.int64)
            cross = len(set(sides.tolist())) > 1
            for i, near in join.answers(sides == 0 if cross else None):
                if cross:
                    near = near[sides[near] == 1]
                    links[near] += weights[i]
                links[i] += int(weights[near].sum())
                groups.join(i, near)
            roots = [ids[i] for i in groups.label.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64()), pa.array(links), pa.array([task.endswith(WHOLE)] * len(ids))], names=["sid", "lead", "n_links", "whole"])

        for b in batches:
            for row in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if row[0] != task and held:
                    yield flush()
                    held = []
                task = row[0]
                held.append((row[1], row[2], row[3], row[4]))
        if held:
            yield flush()

    tokens = full.select("sid", "weight", "text", "tasks").mapInArrow(to_sets, "sid long, weight long, tasks array<struct<task:string,side:int>>, tokens binary")
    placed = tokens.select("sid", "weight", "tokens", F.explode("tasks").alias("at")).select("at.task", "sid", "weight", "tokens", "at.side").repartition(partitions(spark), "task").sortWithinPartitions("task")
    answers = materialize(placed.mapInArrow(solve, "sid long, lead long, n_links long, whole boolean"), "answers", 80 * members.rows)
    # a family that one task has joined needs no more than that task's roots
    linked = answers.where("whole").select("sid", F.col("lead").alias("root"), F.col("n_links").alias("others"))
    if any_large:
        pairs = answers.where("not whole")
        roots = components(pairs.select(F.col("sid").alias("a"), F.col("lead").alias("b"))).select(F.col("node").alias("sid"), "root")
        linked = linked.unionByName(pairs.groupBy("sid").agg(F.sum("n_links").alias("others")).join(roots, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "others"))
    grouped = sets.select("sid", "least", "weight").join(linked, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    per_set = grouped.join(least, "root").select("sid", "root", "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows, per_set


def ngram_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row, for Jaccard >= num / den.

    ``component_id`` is the smallest doc_id reachable by links; ``n_links`` counts the rows that a
    row is linked with itself.
    """
    rows, per_set = _resolve(docs, n, num, den)
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sid")).alias("sid")).join(per_set.drop("root"), "sid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _stars(prefixes: DataFrame) -> DataFrame:
    """Edges (a, b) that hold together the sets of a token, where sizes allow a link: each set and the
    leader of its size class, and leaders of neighbouring classes."""
    leaders = materialize(prefixes.groupBy("token", "band").agg(F.min("sid").alias("lead"), F.max("sid").alias("most")), "leaders", prefixes.rows // 8)
    near = leaders.select("token", (F.col("band") + 1).alias("band"), F.col("lead").alias("under"))
    between = leaders.join(near, ["token", "band"]).select(F.col("lead").alias("a"), F.col("under").alias("b"))
    several = leaders.where("lead != most").select("token", "band", "lead")
    return prefixes.join(several, ["token", "band"]).select(F.col("sid").alias("a"), F.col("lead").alias("b")).unionByName(between)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows, with all columns, of which one stays of each component (the smallest id; of equal
    rows one). Rows without words stay."""
    rows, per_set = _resolve(docs, n, num, den)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "did", "tid"))
    first = rows.where("n_shingles > 0").join(per_set.select("sid", "root"), "sid").groupBy("root").agg(least.alias("x"))
    stay = first.select("x.did", "x.tid", F.lit(True).alias("once")).unionByName(rows.where("n_shingles = 0").select("did", "tid").distinct().withColumn("once", F.lit(False)))
    did, tid = row_keys()
    others = [F.col(c) for c in docs.columns]
    kept = docs.select(did, tid, F.struct(*others).alias("row")).join(stay, ["did", "tid"])
    again = F.row_number().over(Window.partitionBy("did", "tid").orderBy("once"))
    return kept.withColumn("again", again).where(~F.col("once") | (F.col("again") == 1)).select("row.*")


def _tasks(members: DataFrame, at: Threshold) -> DataFrame:
    """(task, sid, side): where each set of a large family is joined: a task for each pair of blocks of
    the same or neighbouring size classes."""
    large = members.select("family", "sid", "n_shingles", "total", at.band_column("n_shingles").alias("band"))
    block = F.least(F.lit(BLOCK_TOKENS[1]), F.greatest(F.lit(BLOCK_TOKENS[0]), F.max("total") / 32))
    cells = large.groupBy("family", "band").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / block)).cast("int").alias("salts"))
    up = cells.select("family", (F.col("band") - 1).alias("band"), F.col("salts").alias("above"))
    under = cells.select("family", (F.col("band") + 1).alias("band"), F.col("salts").alias("below"))
    cells = cells.join(up, ["family", "band"], "left").join(under, ["family", "band"], "left")
    own = large.join(cells, ["family", "band"]).withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int"))
    name = lambda a, i, b, j: F.concat_ws(":", F.col("family").cast("string"), *(x.cast("string") for x in (a, i, b, j)))
    band, salt = F.col("band"), F.col("salt")
    same = own.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("j")).select(
        name(band, F.least(salt, F.col("j")), band, F.greatest(salt, F.col("j"))).alias("task"), "sid", F.when(salt <= F.col("j"), 0).otherwise(1).alias("side")
    )
    lower = own.where("above is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("above") - 1)).alias("j")).select(name(band, salt, band + 1, F.col("j")).alias("task"), "sid", F.lit(0).alias("side"))
    upper = own.where("below is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("below") - 1)).alias("j")).select(name(band - 1, F.col("j"), band, salt).alias("task"), "sid", F.lit(1).alias("side"))
    return same.unionByName(lower).unionByName(upper)
