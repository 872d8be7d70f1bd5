"""Chat formatting of reply trees.

Messages form trees (``msg_id``, ``parent_id``). A table of jumps is joined with itself, so that each round
doubles the reach: log2(depth) rounds give every message its depth and the score sum of its path. The
branches of a tree are ranked by these sums, and the paths of the chosen ones are listed by the stored
jumps, longest first, which names each message of a path once. Each path becomes one formatted
conversation with a loss mask.

Defined results: a null text or role is empty; a null ``score`` counts 0; a tree id may be null
(one tree of its own); rows whose parent doesn't exist are roots; of rows with one id in a tree the
smallest (parent, role, text, score; nulls first) is the message; rows without an id are in no path;
repeated rows of a linear conversation are separate turns, ordered by turn, role, text; very long texts
and paths are formatted whole, a path in one task; of branches with equal sums those of smaller leaf ids
go first; an empty table gives an empty result; further columns are ignored. Messages on a cycle, and
those below one, have no root and are in no path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, tune_arrow

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """One more backslash inside each ``<\\...|``: no ``<|`` is left, and it can be undone."""
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the code point spans that the loss covers."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse_formatted(formatted: str) -> list[tuple[str, str]]:
    """The turns again."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def masked_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def linear_tree(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Messages of plain conversations as trees of one branch: each turn replies to the one before, and
    counts as many characters as it has."""
    order = Window.partitionBy(conv).orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return rows.select(F.col(conv).alias("tree_id"), at.alias("msg_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).select(
        "tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.length("text").cast("double").alias("score")
    )


def unique_messages(messages: DataFrame) -> DataFrame:
    """key, msg_id, tree_id, parent_id, role, text, score: one row per id and tree."""
    said = messages.where("msg_id is not null").select(
        F.to_json(F.struct("tree_id")).alias("key"), "msg_id", "tree_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")
    )
    one = F.min(F.struct("parent_id", "role", "text", "score", "tree_id")).alias("m")
    return said.groupBy("key", "msg_id").agg(one).select("key", "msg_id", "m.tree_id", "m.parent_id", "m.role", "m.text", "m.score")


def reply_paths(said: DataFrame, best: int | None = None) -> DataFrame:
    """(key, leaf, msg_id, back): the messages of each chosen path, ``back`` steps above the leaf.

    ``said`` has key, msg_id (unique in its tree), parent_id, score. ``best`` keeps that many branches of
    each tree; None keeps all. No text is carried here.
    """
    edges = materialize(said.select("key", "msg_id", "parent_id", "score"), "edges")
    here = edges.select("key", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    parents = edges.where("parent_id is not null").select("key", F.col("parent_id").alias("msg_id")).distinct()
    linked = edges.join(here, ["key", "parent_id"], "left").select("key", "msg_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), F.col("score").alias("total"))
    # total: the sum of scores from a message to below ``up``, which is 2**round messages above it; a round
    # has the messages that still had one, so that a few long paths don't rewrite all others
    rounds, left = [materialize(linked, "jump", edges.rows)], None
    while True:
        last = rounds[-1].where("up is not null")
        now = last.count()
        if not now or now == left:  # a round that ends no message leaves only those of cycles
            break
        left, ended = now, [r.where("up is null") for r in rounds]
        above = reduce(DataFrame.unionByName, ended, last).select("key", F.col("msg_id").alias("up"), F.col("up").alias("top"), F.col("total").alias("more"))
        further = last.join(above, ["key", "up"]).select("key", "msg_id", F.col("top").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        rounds.append(materialize(further, "jump", now))
    whole = reduce(DataFrame.unionByName, [r.where("up is null") for r in rounds])
    ends = whole.join(parents, ["key", "msg_id"], "left_anti").select("key", F.col("msg_id").alias("leaf"), "total")
    if best is not None:
        order = Window.partitionBy("key").orderBy(F.desc("total"), "leaf")
        ends = ends.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= best)
    paths = ends.select("key", "leaf", F.col("leaf").alias("msg_id"), F.lit(0).cast("long").alias("back"))
    for round_ in reversed(range(len(rounds) - 1)):
        at = materialize(paths, "paths")
        jump = rounds[round_].where("up is not null").select("key", "msg_id", "up")
        paths = at.unionByName(at.join(jump, ["key", "msg_id"]).select("key", "leaf", F.col("up").alias("msg_id"), (F.col("back") + (1 << round_)).alias("back")))
    return paths


_FORMATTED = "tree_id {kind}, leaf long, n_turns long, formatted string, loss_spans array<struct<start:long,stop:long>>"


def format_paths(messages: DataFrame, best: int | None = None, trained: str = "assistant") -> DataFrame:
    """One row per chosen path: tree_id, leaf, n_turns, formatted text and its loss spans."""
    tune_arrow(messages.sparkSession)
    kind = messages.schema["tree_id"].dataType.simpleString()
    said = materialize(unique_messages(messages), "said")
    whole = (
        reply_paths(said, best)
        .join(said.select("key", "msg_id", "tree_id", "role", "text"), ["key", "msg_id"])
        .groupBy("key", "leaf")
        .agg(F.first("tree_id").alias("tree_id"), F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"))
        .select("tree_id", F.col("leaf").cast("long").alias("leaf"), "turns.role", "turns.text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turns(list(zip(r, t, strict=True)), trained) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            spans = [[{"start": x, "stop": y} for x, y in s] for _, s in made]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(r) for r in b.column(2).to_pylist()], pa.int64()), pa.array([f for f, _ in made], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["tree_id", "leaf", "n_turns", "formatted", "loss_spans"],
            )

    return whole.mapInArrow(run, _FORMATTED.format(kind=kind))


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted text and its loss spans."""
    kind = formatted.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {"conv_id": b.column("tree_id"), "n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns = parse_formatted(text)
                loss = masked_text(text, [(s["start"], s["stop"]) for s in spans])
                rows["n_turns"].append(len(turns))
                rows["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                rows["loss_chars"].append(len(loss))
                rows["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                rows["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("conv_id", b.column("tree_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.select("tree_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
