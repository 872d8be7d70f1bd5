"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here (wire format only): pieces with scores and types, the trainer's
model type and byte fallback, and the normaliser. From it the normaliser, the marker of spaces, and a
unigram or BPE model are rebuilt. Texts are normalised whole; the words of a batch that aren't known
yet are encoded in one multithreaded batch, and known words come from a table bounded in bytes. That is
exact if no piece has a marker after another character, which is looked up in the model: no piece then
lies in two words. Else whole texts are encoded.

Parity with the sentencepiece library covers every text: its normalised form is compared with the
library's, and so are the ids of each word when it comes into the table. A text with a word that differs,
or that says nothing about its neighbours (unknown characters, which the library fuses; no marker), is
encoded whole by the library, whose ids are the result where they differ; parity is false there. Round
trips are tried by word in the same way, and by text where a word fails.

Defined results: a null or empty text has no ids; texts that decode to something else than their
normalised form are shown as such; very long texts and words are encoded whole (a word over the table's
bound is not kept); repeated rows are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import tune_arrow

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KNOWN_BYTES = 160 << 20  # of the table of words, with ENTRY bytes for what Python holds of each
ENTRY = 240


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; messages and strings are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            at += n
            yield key >> 3, data[at - n : at]
        else:
            raise ValueError(f"wire type {kind}")


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk(self) -> int:
        return self.types.index(UNKNOWN)


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in wire(data):
        if number == 1:
            piece = dict(wire(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
            m.types.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(wire(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(wire(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.squeeze, m.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, better pieces first."""
    ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t in (NORMAL, USER)}
    found = []
    for p, i in ids.items():
        for cut in range(1, len(p)):
            a, b = ids.get(p[:cut]), ids.get(p[cut:])
            if a is not None and b is not None:
                found.append((-m.scores[i], i, a, b))
    return [(m.pieces[a], m.pieces[b]) for _, _, a, b in sorted(found)]


class Backend:
    """Encoder and decoder of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from tokenizers import Regex, Tokenizer, models, normalizers

        with open(path, "rb") as f:
            self.model = m = parse_model(f.read())
        if m.kind == UNIGRAM:
            core = models.Unigram(list(zip(m.pieces, m.scores, strict=True)), unk_id=m.unk, byte_fallback=m.byte_fallback)
        elif m.kind == BPE:
            core = models.BPE(vocab={p: i for i, p in enumerate(m.pieces)}, merges=merges_of(m), unk_token=m.pieces[m.unk], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
        self.core = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.chars = normalizers.Sequence(steps) if steps else None
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.by_word = not any(MARK in p.lstrip(MARK) for p, t in zip(m.pieces, m.types, strict=True) if t in (NORMAL, USER)) and m.escape and USER not in m.types
        self.known: dict[str, bytes] = {}
        self.weight = 0
        self.odd: set[str] = set()  # known words that don't settle parity and round trip of a text by themselves
        self.opens = np.array([p.startswith(MARK) for p in m.pieces])  # pieces that begin a word
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw = [self._bytes(p, t) for p, t in zip(m.pieces, m.types, strict=True)]

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        if self.chars is not None:
            text = self.chars.normalize_str(text)
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def keys(self, ready: str) -> list[str]:
        """The words of a normalised text: "▁word" as "word", any other word behind a marker."""
        if ready.startswith(MARK) and MARK + MARK not in ready:
            return ready.split(MARK)[1:]
        return [w[1:] if w[0] == MARK and w[1:2] != MARK else MARK + w for w in self.words.findall(ready)]

    def learn(self, new: list[str]) -> None:
        """Ids of words, compared with the library's. Plain words go in groups, as texts; where a group
        differs in anything, its words are tried alone."""
        plain = [k for k in new if k and k[0] != MARK] if self.model.dummy_prefix else []
        alone = new if not plain else [k for k in new if not k or k[0] == MARK]
        groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        texts = [MARK + MARK.join(g) for g in groups]
        for group, text, made in zip(groups, texts, self.core.encode_batch(texts, add_special_tokens=False), strict=True):
            ids = made.ids
            begin = np.flatnonzero(self.opens[ids]).tolist()
            spaced = " ".join(group)
            if len(begin) != len(group) or self.model.unk in ids or self.library.encode(spaced) != ids or self.library.normalize(spaced) != text or b"".join([self.raw[i] for i in ids]) != (" " + spaced).encode():
                alone = alone + group
                continue
            data = np.array(ids, dtype="<u4").tobytes()
            self.known |= {k: data[4 * x : 4 * y] for k, x, y in zip(group, begin, [*begin[1:], len(ids)], strict=True)}
            self.weight += len(text) + len(data) + ENTRY * len(group)
        words = [k[1:] if k.startswith(MARK) else MARK + k for k in alone]
        for key, word, made in zip(alone, words, self.core.encode_batch(words, add_special_tokens=False), strict=True):
            ids = made.ids
            self.known[key] = array("I", ids).tobytes()
            self.weight += len(key) + 4 * len(ids) + ENTRY
            bare = word[1:] if self.model.dummy_prefix else word
            settled = key and key[0] != MARK and self.model.unk not in ids and self.library.encode(bare) == ids and self.library.normalize(bare) == word
            if not settled or b"".join([self.raw[i] for i in ids]) != word.replace(MARK, " ").encode():
                self.odd.add(key)

    def ids_of(self, ready: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of normalised texts, and whether all their words are settled."""
        if not self.by_word:
            return [np.array(e.ids, dtype="<u4") for e in self.core.encode_batch(ready, add_special_tokens=False)], [False] * len(ready)
        cut = [self.keys(t) for t in ready]
        if self.weight > KNOWN_BYTES:
            self.known.clear()
            self.odd.clear()
            self.weight = 0
        self.learn(list(set().union(*cut) - self.known.keys()))
        find = self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, ks)), dtype="<u4") for ks in cut], [not self.odd or self.odd.isdisjoint(ks) for ks in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.ids_of([self.normalise(t) for t in texts])[0]

    def verified(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Ids, parity and round trip of each text; ids that differ are the library's."""
        ready = [self.normalise(t) for t in texts]
        ids, settled = self.ids_of(ready)
        parity, trip = [], []
        for i, (text, norm) in enumerate(zip(texts, ready, strict=True)):
            if settled[i] and self.library.normalize(text) == norm:
                parity.append(True)
                trip.append(True)
                continue
            want = np.array(self.library.encode(text), dtype="<u4")
            parity.append(np.array_equal(want, ids[i]))
            ids[i] = want
            shown = norm.replace(MARK, " ")
            trip.append(self.decode(want) == (shown[1:] if self.model.dummy_prefix else shown))
        return ids, parity, trip

    def _text(self, ids: np.ndarray) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")

    def decode(self, ids: np.ndarray) -> str:
        text = self._text(ids)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_backends: dict[str, Backend] = {}


def backend(path: str) -> tuple[Backend, object]:
    """The backend, and the sentencepiece processor it's tried against."""
    if path not in _backends:
        _backends[path] = Backend(path)
    return _backends[path], _backends[path].library


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id if None), ids, n_tokens, ids_crc32, round_trip, parity (of every text)."""
    tune_arrow(docs.sparkSession)
    keep = keep or ["doc_id"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = backend(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids, same, trip = enc.verified([t or "" for t in b.column("__text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(i) for i in ids]))), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in keep), lists, pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array(trip, pa.bool_()), pa.array(same, pa.bool_())],
                    names=[*keep, "ids", "n_tokens", "ids_crc32", "round_trip", "parity"],
                )

    from pyspark.sql import functions as F

    return docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text")).mapInArrow(run, f"{fields}, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")
