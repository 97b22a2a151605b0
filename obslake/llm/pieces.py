"""SentencePiece encoding and decoding for merge-type (BPE) models, by backtracking over dictionary matches.

The library merges the best-scored adjacent pair again and again. The same ids come out of a left-to-right walk: an
automaton (Aho-Corasick) gives the pieces that match at each position; the walk takes the longest whose pair with the piece
before is compatible, which means that merging the two pieces' text again gives just these two; where no piece fits, it
steps back one piece, and a bitfield keeps the positions that failed, so each is left at most once.

No piece holds the space mark after another character, so merges never cross from a non-mark to a mark: texts are cut
there, and a bounded cache keeps the ids of chunks that were seen while a task runs.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import releasing, small_batches

MARK = "▁"
#: Chunks that a task remembers in each of two generations, and pairs that a process remembers. Neither changes results.
CHUNKS, PAIRS = 100_000, 250_000
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_NEVER = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class _Chunks(dict):
    """Packed ids of the chunks seen, made on demand. A full one becomes the older generation, which is asked before making."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CHUNKS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(chunk)
        if ids is None:
            ids = array("i", self.pieces.chunk(chunk)).tobytes()
        self[chunk] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Pieces:
    """A model file's pieces; encodes and decodes."""

    def __init__(self, model: bytes) -> None:
        self.text: list[str] = []
        self.kind: list[int] = []
        self.score: list[float] = []
        rules: dict[int, int | bytes] = {}
        for n, value in _fields(model):
            if n == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                self.score.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kind.append(piece.get(3, _NORMAL))
            elif n == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("not a merge-type model")
            elif n == 3:
                rules = dict(_fields(value))
        if rules.get(1) != b"identity" or rules.get(2) or rules.get(4, 1):
            raise ValueError("only models that leave characters and white space as they are")
        if set(self.kind) - {_NORMAL, _UNKNOWN, _BYTE, 3}:
            raise ValueError("user-defined and unused pieces are not covered")
        if any(MARK in t.lstrip(MARK) for t, k in zip(self.text, self.kind) if k == _NORMAL):
            raise ValueError("pieces hold the space mark inside")
        self.prefix = MARK if rules.get(3, 1) else ""
        self.unknown = self.kind.index(_UNKNOWN)
        self.id = {t: k for k, t in enumerate(self.text) if self.kind[k] == _NORMAL}
        self.cost = {t: -self.score[k] for t, k in self.id.items()}
        self.bytes = {int(t[3:5], 16): k for k, t in enumerate(self.text) if self.kind[k] == _BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.plain = [t.replace(MARK, " ") for t in self.text]
        for k, kind in enumerate(self.kind):
            if kind == 3:
                self.plain[k] = ""
            elif kind == _UNKNOWN:
                self.plain[k] = " ⁇ "
        self.size = [len(t) for t in self.text]
        self.known = {t for t in self.id if len(t) == 1}
        self.find = ahocorasick.Automaton()
        for t, k in self.id.items():
            if len(t) > 1 and self._merge(t) == [t]:
                self.find.add_word(t, (len(t) - 1, k))
        self.find.make_automaton()
        #: The next shorter piece at the same place; none: -1. A single character comes last.
        self.shorter = [-1] * len(self.text)
        for t, (_, k) in self.find.items():
            self.shorter[k] = next((self.find.get(t[:n])[1] for n in range(len(t) - 1, 1, -1) if self.find.exists(t[:n])), self.id.get(t[0], -1))
        self.fits: dict[int, bool] = {}
        self.cache = _Chunks(self)
        self.byte_ids = np.isin(np.arange(len(self.text)), list(self.byte_of))
        self.plain_of = np.array(self.plain, object)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text by repeated merging of the best-scored, then leftmost, pair."""
        parts, find = list(text), self.cost.get
        costs = [find(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < _NEVER:
            k = costs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = find(parts[k - 1] + parts[k], _NEVER)
            if k < len(costs):
                costs[k] = find(parts[k] + parts[k + 1], _NEVER)
        return parts

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' text again gives just these two."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        x, y = self.text[a], self.text[b]
        out = self.fits[a << 16 | b] = self._merge(x + y) == [x, y]
        return out

    def _walk(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces.

        A prefix has one valid piece sequence at most, so the piece before a position is always the same one, and what
        was tried there need not be tried again.
        """
        n, sizes, fits, one, shorter = len(text), self.size, self.fits.get, self.id, self.shorter
        # matches come in the order of their ends, so the longest of a start is the last
        longest = {last - before: k for last, (before, k) in self.find.iter(text)}
        failed = at = before = 0
        ids: list[int] = []
        k = longest.get(0) or one[text[0]]
        while True:
            while k >= 0:
                end = at + sizes[k]
                if not failed >> end & 1:
                    if not at:
                        break
                    fit = fits(before << 16 | k)
                    if fit or fit is None and self._fit(before, k):
                        break
                k = shorter[k]
            if k >= 0:
                ids.append(k)
                if end == n:
                    return ids
                at, before = end, k
                k = longest.get(at) or one[text[at]]
            else:
                failed |= 1 << at
                if not ids:
                    raise ValueError("no encoding")
                k = ids.pop()
                at -= sizes[k]
                before = ids[-1] if ids else 0
                k = shorter[k]

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk; characters that are no piece become their bytes."""
        if self.known.issuperset(text):
            return self._walk(text)
        ids: list[int] = []
        for known, run in groupby(text, self.known.__contains__):
            if known:
                ids += self._walk("".join(run))
            else:
                ids += [k for c in run for k in ([self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown])]
        return ids

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.cache.__getitem__, self.cut.findall(self.prefix + text.replace(" ", MARK))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if self.byte_ids[ids].any():
            out, run = [], bytearray()
            for k in ids.tolist():
                b = self.byte_of.get(k)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run = bytearray()
                out.append(self.plain[k])
            text = "".join([*out, _utf8(bytes(run))])
        else:
            text = "".join(self.plain_of[ids].tolist())
        return text[1:] if self.prefix and text[:1] == " " and self._leads(ids.tolist()) else text

    def _leads(self, ids: list[int]) -> bool:
        """Whether the first piece with a text begins with the space mark."""
        first = next((k for k in ids if self.kind[k] != 3), self.unknown)
        return self.kind[first] == _NORMAL and self.text[first].startswith(MARK)


def _utf8(data: bytes) -> str:
    """data as text; each byte that is no valid UTF-8 becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_LOADED: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    """The model's pieces, built once a process."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def _forget() -> None:
    for pieces in _LOADED.values():
        pieces.cache.forget()


def _encoded(pieces: Pieces, texts: pa.Array) -> pa.Array:
    packed = [pieces.packed(x or "") for x in texts.to_pylist()]
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _decoded(pieces: Pieces, lists: pa.Array) -> pa.Array:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    return pa.array([pieces.decode(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.string())


def encode(docs: DataFrame, model_file: str, out: str = "ids") -> DataFrame:
    """docs with a column of token ids of the whole text, array<int>; null and empty text: an empty array.

    model_file is read once, on the driver, and travels with the tasks (a model is a fixed file of well under 2 MB).
    A column of the same name is replaced; no other column is touched.
    """
    return _mapped(docs, model_file, "text", {out: "array<int>"}, lambda pieces, x: [_encoded(pieces, x)])


def decode(docs: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of a column of ids; null: the empty text."""
    return _mapped(docs, model_file, ids, {out: "string"}, lambda pieces, x: [_decoded(pieces, x)])


def encode_decode(docs: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """decode(encode(docs)): both columns from one pass over the texts, so that one Python worker a task does it."""

    def both(pieces: Pieces, texts: pa.Array) -> list[pa.Array]:
        lists = _encoded(pieces, texts)
        return [lists, _decoded(pieces, lists)]

    return _mapped(docs, model_file, "text", {ids: "array<int>", out: "string"}, both)


def _mapped(docs: DataFrame, model_file: str, source: str, made: dict[str, str], call: Callable[[Pieces, pa.Array], list[pa.Array]]) -> DataFrame:
    """docs with the columns `made` (name: type) that call() gives for the column `source`."""
    with open(model_file, "rb") as f:
        model = f.read()
    if len(model) > 1 << 24:
        raise ValueError("the model file is over 16 MB")
    new = {c.lower() for c in made}
    names = [c for c in docs.columns if c.lower() not in new]
    labels = [*(f"c{k}" for k in range(len(names))), *(f"m{k}" for k in range(len(made)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{k}") for k in range(len(names))), *call(pieces, batch.column("x"))], labels)

    rows = small_batches(docs).select(*(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(names)), docs[f"`{source}`"].alias("x"))
    schema = ", ".join([*(f"c{k} {rows.schema[k].dataType.simpleString()}" for k in range(len(names))), *(f"m{k} {t}" for k, t in enumerate(made.values()))])
    return rows.mapInArrow(releasing(run, _forget), schema).toDF(*names, *made)
