"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a text once. At each position its output links name every
piece that ends there, and each of them may relax the best way to reach that
position. What "best" means depends on the kind of model:

* unigram models: the largest sum of piece scores (Viterbi);
* BPE models: the one segmentation that merging by score would give. A sequence
  of pieces is that segmentation exactly if each two neighbours, merged on their
  own, stay apart; so a piece relaxes a position only if it is compatible with
  the last piece of the (unique) segmentation before it.

No piece has a word-start mark after another character (checked when the model
is read), so a text falls apart before each run of marks and the ids of a chunk
are remembered per task in a table of bounded size. No BPE piece is made across
two characters that stand beside each other in no piece, so chunks end there too
(where letters meet punctuation, say), which leaves far fewer different ones.

Characters that no piece covers become byte pieces (or the unknown piece, in
models without them), as in the published library.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE = 256
#: Chunks remembered by a task, and the longest chunk worth remembering.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
#: Groups of characters that chunks are told apart by; smaller ones count as one.
GROUPS = 16
#: Fixed values of the published model format (piece types, model types, field numbers).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: No piece, or a way that a piece does not improve.
NONE = -1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze_spaces: bool = True

    @staticmethod
    def parse(data: bytes) -> Model:
        m = Model([], [], [])
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                m.pieces.append(f[1].decode())
                m.scores.append(struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0])
                m.types.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                m.kind, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2, b""):
                    raise ValueError("only models without a character map are supported")
                m.dummy_prefix, m.squeeze_spaces = bool(f.get(3, 1)), bool(f.get(4, 1))
        if m.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
        return m


class _Known(dict):
    """Chunks and their ids as 32-bit integers, found when first asked for."""

    def __init__(self, ids: Callable[[str], list[int]]):
        super().__init__()
        self.ids = ids

    def __missing__(self, chunk: str) -> bytes:
        ids = array("i", self.ids(chunk)).tobytes()
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


def _groups(pieces: Iterable[str]) -> list[str]:
    """Characters in groups, the largest first: those of one piece are in one group; characters that never have a neighbour are in none."""
    above: dict[str, str] = {}

    def top(c: str) -> str:
        while (up := above.setdefault(c, c)) != c:
            above[c] = c = above.setdefault(up, up)
        return c

    for p in pieces:
        first, *more = p.lstrip(MARK) or MARK
        for c in more:
            above[top(c)] = top(first)
    found: dict[str, list[str]] = {}
    for c in above:
        found.setdefault(top(c), []).append(c)
    sizes = sorted(map("".join, found.values()), key=len, reverse=True)
    return sizes[: GROUPS - 1] + ["".join(sizes[GROUPS - 1 :])] * (len(sizes) >= GROUPS)


class Codec:
    """Encodes and decodes texts with one model."""

    def __init__(self, model: Model):
        self.model = model
        self.unknown = model.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == BYTE}
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t in (NORMAL, USER_DEFINED)}
        self.chunked = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.chunks = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.S)
        if model.kind == BPE and (groups := [re.escape(g) for g in _groups(self.ids)]):
            runs = "|".join(f"[{g}]+" for g in groups)
            self.chunks = re.compile(f"{MARK}*(?:{runs}|[^{MARK}{''.join(groups)}])|{MARK}+")
        self.known = _Known(self._ids)
        self.apart: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            #: Merging gives only pieces that it makes of their own characters; others stay out of the automaton.
            if model.kind == UNIGRAM or self._merge(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.lowest = min((s for s, t in zip(model.scores, model.types) if t == NORMAL), default=0.0) - 10.0
        plain = [t in (NORMAL, USER_DEFINED) for t in model.types]
        self.plain = np.array(plain)
        self.texts = [p.replace(MARK, " ") for p in model.pieces]
        kinds = {BYTE: lambda i: bytes([int(model.pieces[i][3:5], 16)]), UNKNOWN: lambda i: " \u2047 ".encode(), CONTROL: lambda i: b""}
        self.decoded = pa.array([kinds.get(t, lambda i: self.texts[i].encode())(i) for i, t in enumerate(model.types)], pa.binary())

    def _merge(self, text: str) -> list[str]:
        """Plain merging: again and again the neighbours whose join scores best, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.model.scores[j] > best):
                    best, at = self.model.scores[j], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            pair = [self.model.pieces[left], self.model.pieces[right]]
            known = self.apart[key] = self._merge(pair[0] + pair[1]) == pair
        return known

    def merged(self, text: str) -> list[int]:
        """BPE ids, NONE for each character without a piece: the only way to each position wins."""
        n, pieces = len(text), self.model.pieces
        last = [NONE] * (n + 1)
        apart, compatible = self.apart.get, self._compatible
        for at, (i, length) in self.automaton.iter(text):
            if last[at + 1] == NONE:
                before = last[at + 1 - length]
                if before == NONE or (apart(before << 32 | i) or compatible(before, i)):
                    last[at + 1] = i
        out = []
        while n:
            out.append(last[n])
            n -= 1 if last[n] == NONE else len(pieces[last[n]])
        return out[::-1]

    def likeliest(self, text: str) -> list[int]:
        """Unigram ids of the greatest summed score, NONE for each character without a piece."""
        n, score = len(text), self.model.scores
        total, last, one = [0.0] + [-np.inf] * n, [(NONE, 1)] * (n + 1), [False] * (n + 1)

        def close(end: int) -> None:
            if not one[end] and (way := total[end - 1] + self.lowest) > total[end]:
                total[end], last[end] = way, (NONE, 1)

        done = 0
        for at, (i, length) in self.automaton.iter(text):
            while done < at:
                done += 1
                close(done)
            way = total[at + 1 - length] + score[i]
            one[at + 1] |= length == 1
            if way > total[at + 1]:
                total[at + 1], last[at + 1] = way, (i, length)
        for end in range(done + 1, n + 1):
            close(end)
        out = []
        while n:
            out.append(last[n][0])
            n -= last[n][1]
        return out[::-1]

    def _ids(self, text: str) -> list[int]:
        found = self.merged(text) if self.model.kind == BPE else self.likeliest(text)
        if NONE not in found:
            return found
        out: list[int] = []
        at = 0
        for i in found:
            if i != NONE:
                out.append(i)
            elif self.bytes and self.model.byte_fallback:
                out += [self.bytes[b] for b in text[at].encode()]
            elif not out or out[-1] != self.unknown or self.model.kind == BPE:
                out.append(self.unknown)
            at += 1 if i == NONE else len(self.model.pieces[i])
        return out

    def normalised(self, text: str) -> str:
        if self.model.squeeze_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK)

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit integers; null and empty texts have none."""
        text = self.normalised(text or "")
        if not self.chunked:
            return np.array(self._ids(text), dtype=np.int32).tobytes()
        return b"".join(map(self.known.__getitem__, self.chunks.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        m, ids = self.model, np.asarray(ids, dtype=np.int32)
        if self.plain[ids].all():
            text = "".join(map(self.texts.__getitem__, ids.tolist()))
        else:
            out = bytearray()
            for i in ids.tolist():
                kind = m.types[i]
                if kind == BYTE:
                    out.append(int(m.pieces[i][3:5], 16))
                elif kind == UNKNOWN:
                    out += " \u2047 ".encode()
                elif kind != CONTROL:
                    out += self.texts[i].encode()
            text = out.decode(errors="replace")
        return text[1:] if m.dummy_prefix and text.startswith(" ") else text


    def round_trips(self, lists: pa.ListArray, texts: pa.Array) -> list[bool]:
        """Whether lists of ids (null: none) decode to ``texts`` (null: empty). Bytes are compared in whole columns; where they differ, the text is decoded by itself."""
        texts = pc.fill_null(texts, "")
        same = [False] * len(texts)
        if texts.nbytes < 1 << 30:
            joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.decoded.take(lists.values)), b"")
            held = texts.cast(pa.binary())
            same = pc.equal(joined, pc.binary_join_element_wise(b" ", held, b"") if self.model.dummy_prefix else held).to_pylist()
        for i, found in enumerate(same):
            if not found:
                same[i] = self.decode(np.asarray(lists[i].values) if lists[i].is_valid else []) == texts[i].as_py()
        return same


@lru_cache(maxsize=4)
def codec_of(data: bytes) -> Codec:
    return Codec(Model.parse(data))


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: bytes, decode: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, n_tokens, and round_trip: whether the ids decode to the text.

    The driver reads the model file (under 1 MB) and ships it with the task, so
    executors need no tokenizer files. Null texts give null ids, 0 tokens and a
    true round trip; empty texts give no ids. The word-start mark itself
    (U+2581) in a text decodes to a space, so such texts do not round-trip, as in
    the published library. Very long texts are read whole; ties between ways of
    one score go to the one found first; repeated rows stay; an empty table gives
    no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = part.column("text").to_pylist()
                ids = [codec.packed(t) for t in texts]
                sizes = [len(x) // 4 for x in ids]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([t is None for t in texts]))
                same = codec.round_trips(lists, part.column("text")) if decode else [True] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(sizes, pa.int64()), pa.array(same)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode_ids(rows: DataFrame, model: bytes) -> DataFrame:
    """One row per row of ``rows`` (doc_id, ids): doc_id and the decoded text; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = [None if x is None else codec.decode(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, with their count and whether they decode to the text again."""
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_bytes())
