"""Language identification in two steps: the family, then the language within it.

Texts are described by hashed character 1- to 3-grams of their letters, words bounded by spaces. One-versus-one linear support
vector machines first choose among the language families, then among the languages of the chosen family; votes decide, ties
by the summed margins. All machines are trained here on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, sample, small_batches

#: Labelled rows that the fit uses at most: those with the smallest hash of doc_id.
SAMPLE_ROWS = 4_000
DIMS = 4096
#: ISO 639-1 codes by family. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "celtic": "ga cy gd br",
    "indic": "hi ur bn pa mr gu ne",
    "semitic": "ar he mt am",
}
UNKNOWN = "und"


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.array([chr(k).isalpha() for k in range(0x110000)])


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram counts; no letter: None."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    codes = np.r_[np.uint64(32), codes[np.r_[True, letter[1:] | letter[:-1]]], np.uint64(32)]
    two = codes[:-1] * np.uint64(0x9E3779B1) + codes[1:]
    three = two[:-1] * np.uint64(0x85EBCA77) + codes[2:]
    hashed = [(x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64) for x in (codes, two + np.uint64(1 << 40), three + np.uint64(1 << 41))]
    x = np.sqrt(np.bincount(np.concatenate(hashed), minlength=DIMS))
    return x / np.sqrt((x * x).sum())


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with hinge loss; y in {-1, 1}. Dual coordinate ascent, the bias as one more dimension."""
    x = np.c_[x, np.ones(len(x))]
    norm, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


@dataclass
class Chooser:
    """One-versus-one machines over some names."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, names: np.ndarray) -> Chooser:
        known = sorted(set(names.tolist()))
        pairs = list(combinations(range(len(known)), 2))
        made = []
        for a, b in pairs:
            at = np.flatnonzero((names == known[a]) | (names == known[b]))
            made.append(svm(x[at], np.where(names[at] == known[a], 1.0, -1.0)))
        return Chooser(known, pairs, np.array([w for w, _ in made]).reshape(-1, x.shape[1]), np.array([b for _, b in made]))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name and confidence for each row."""
        margins = x @ self.weights.T + self.bias
        chance = 1 / (1 + np.exp(-np.clip(3 * margins, -50, 50)))
        votes, sums, least = (np.zeros((len(x), len(self.names))) for _ in range(3))
        least += 1.0
        for k, (a, b) in enumerate(self.pairs):
            for name, p, m in ((a, chance[:, k], margins[:, k]), (b, 1 - chance[:, k], -margins[:, k])):
                votes[:, name] += m > 0
                sums[:, name] += m
                least[:, name] = np.minimum(least[:, name], p)
        best = np.array([np.lexsort((np.arange(len(v)), -s, -v))[0] for v, s in zip(votes, sums)], np.int64) if len(x) else np.empty(0, np.int64)
        return best, least[np.arange(len(x)), best]


@dataclass
class Model:
    family: Chooser | None
    within: dict[str, Chooser]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [features(t) for t in texts]
        at = [k for k, x in enumerate(found) if x is not None]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not at or self.family is None:
            return names, scores
        x = np.stack([found[k] for k in at])
        family, sure = self.family.choose(x)
        for f, name in enumerate(self.family.names):
            rows = np.flatnonzero(family == f)
            if len(rows):
                chooser = self.within[name]
                best, sure_within = chooser.choose(x[rows])
                for r, b, s in zip(rows, best, sure_within):
                    names[at[r]], scores[at[r]] = chooser.names[b], sure[r] * s
        return names, scores


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes.split()), lang)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, languages: list[str] | None = None) -> Model:
    """Machines from rows of docs (doc_id, text, lang) with a language, outside the held-out quarter.

    The sample is the SAMPLE_ROWS rows with the smallest hash of doc_id and one row of each language, so that every
    language is learned. Rows whose text has no letter teach nothing. No usable row: every text is `und`.
    """
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out("doc_id"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(0).to_pylist()]
            made = pa.array([None if v is None else v.astype(np.float16).tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([made, batch.column(1)], ["x", "lang"])

    wide = sample(rows.select("text", "lang", "doc_id"), "doc_id", "text", n=SAMPLE_ROWS)
    some = rows.groupBy("lang").agg(F.min_by("text", F.struct(F.xxhash64("doc_id"), "doc_id", "text")).alias("text")).select("text", "lang")
    table = wide.select("text", "lang").unionByName(some).mapInArrow(described, "x binary, lang string").filter("x is not null").toArrow()
    if not table.num_rows:
        return Model(None, {})
    x = np.stack([np.frombuffer(b, np.float16).astype(np.float64) for b in table.column("x").to_pylist()])
    langs = np.array(table.column("lang").to_pylist(), object)
    families = np.array([family_of(n) for n in langs], object)
    return Model(Chooser.fit(x, families), {f: Chooser.fit(x[families == f], langs[families == f]) for f in set(families.tolist())})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id long, held_out boolean, lang_pred string, score double) of every row of docs (doc_id, text).

    Null text, or one without a letter: `und` with score 0. Ties of votes go to the larger sum of margins, then to the first name.
    Very long texts are counted whole. Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                names, scores = model.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    found = small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
