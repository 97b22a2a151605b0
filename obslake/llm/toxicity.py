"""Toxicity by fuzzy lexicon matching and context windows.

The lexicon is what labelled rows show to be telling: whole terms, and beginnings of which a toxic text holds several different words (compounds
of an insult). Only where there are no labels of both classes does a short fixed list stand in. The terms are a trie, intersected with the
Levenshtein automata of its terms: a state is the set of (trie node, edits so far) that a word's characters can reach, and
states are built as words ask for them, so a known word start costs one look-up a character. A hit counts as abuse
or as quotation by a window around it: quotation marks that enclose it, or words of reporting near it, against words of
address. A logistic regression over the counted evidence gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, sample, small_batches

#: Label ids, and labelled rows that differ, that the fit uses at most: those with the smallest hash. All terms that pass the bounds below are learned from them.
SAMPLE_ROWS = 20_000
#: A learned term stands after at least so many different words in toxic rows (copies of one row teach nothing new), and the
#: lower 99 % confidence bound of its log-odds is at least so high.
MIN_NEIGHBOURS, MIN_LOG_ODDS, Z = 4, 1.0, 2.58
#: A beginning of so many letters is learned if rows that hold at least two different words with it are toxic more often than others by this much evidence: the
#: exponent of Chernoff's bound on the chance of that many.
BEGINNING, MIN_EVIDENCE = (4, 8), 5.5
FEATURES = 9
#: Insults known without labels, used only where there are none.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "arschloch", "dummkopf", "connard", "salaud", "cabrón", "gilipollas")
#: Words of reporting and of address.
REPORTING = frozenset("said says wrote called quote quoted cited word term reported sagte schrieb zitat wort dit écrit cité mot dijo escribió cita palabra".split())
ADDRESS = frozenset("you your you're youre u du dich dein ihr tu toi ton vous votre tú eres usted".split())
_QUOTES = re.compile(r"[\"“”„«»]")
#: What hides a letter inside a word.
MASKS = frozenset("*@$#_0123456789")
#: Runs of letters, with at most two masks at a time between them.
_WORDS = re.compile(r"[^\W\d_]+(?:[*@$#_0-9]{1,2}[^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words on each side that tell quotation from abuse; words and automaton states that a task remembers (no result depends on them).
WINDOW, SEEN, STATES = 6, 50_000, 50_000
#: Weight of a term of the fixed list; learned terms weigh the lower bound of their log-odds.
SEED_WEIGHT = 2.0


def allowed(term: str) -> int:
    """Edits within which a word counts as the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class FuzzyLexicon:
    """A trie of terms, walked by its Levenshtein automaton made deterministic on demand. A mask stands for any one letter."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]
        for t in weights:
            at, edits = 0, allowed(t)
            self.most[0] = max(self.most[0], edits)
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.term)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], edits)
            self.term[at] = t
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.step: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """Number of the state of these (node, edits), closed under leaving out characters of the term; none: -1."""
        todo, best = list(items), dict[int, int]()
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values() if e + 1 <= self.most[child]]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            ends = [(e, self.term[n]) for n, e in best.items() if self.term[n] is not None and e <= allowed(self.term[n])]
            self.found.append(min(ends)[::-1] if ends else None)
        return self.number[key]

    def _next(self, state: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if e + 1 <= self.most[node]:
                items.add((node, e + 1))  # c is one too many
            for k, child in self.children[node].items():
                cost = e + (k != c and c not in MASKS)
                if cost <= self.most[child]:
                    items.add((child, cost))
        out = self.step[state][c] = self._state(items)
        return out

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, and the edits."""
        state, step = self.start, self.step
        for c in word:
            known = step[state].get(c)
            state = self._next(state, c) if known is None else known
            if state < 0:
                return None
        return self.found[state]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    slopes: list[float]
    mean: list[float]
    scale: list[float]
    beginnings: dict[str, float] = field(default_factory=dict)
    _lexicon: FuzzyLexicon | None = field(default=None, repr=False, compare=False)
    _seen: dict = field(default_factory=dict, repr=False, compare=False)
    _starts: frozenset = field(default=frozenset(), repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lexicon": None, "_seen": {}}

    def _match(self, word: str) -> tuple[str, int] | None:
        """The term that a word is, and its edits (a masked letter counts as one); a masked word may also hold a term between its masks."""
        found, plain = self._lexicon.match(word), word.isalpha()
        if found or plain:
            return found if plain else (found[0], max(1, found[1]))
        return next((m for m in map(self._lexicon.match, _LETTERS.findall(word)) if m), None)

    def _begins(self, word: str) -> str | None:
        """The shortest learned beginning of a word."""
        if word[: BEGINNING[0]] not in self._starts:
            return None
        return next((word[:n] for n in range(BEGINNING[0], min(BEGINNING[1], len(word)) + 1) if word[:n] in self.beginnings), None)

    def features(self, text: str | None) -> list[float]:
        """Evidence in a whole text: exact, fuzzy and quoted hits, different terms, hits a hundred words, address near a hit, all hits; weight and number of different words of learned beginnings, from the second on."""
        if self._lexicon is None:
            self._lexicon = FuzzyLexicon(self.weights)
            self._starts = frozenset(b[: BEGINNING[0]] for b in self.beginnings)
        elif len(self._lexicon.sets) > STATES:
            self._lexicon = FuzzyLexicon(self.weights)
        seen, low = self._seen, (text or "").lower()
        if len(seen) > SEEN:
            seen.clear()
        words = _WORDS.findall(low)
        hits, begun = [], {}
        for w in set(words):
            if w not in seen:
                seen[w] = (self._match(w), self._begins(w))
            found, begins = seen[w]
            if found:
                hits.append(w)
            if begins:
                begun.setdefault(begins, []).append(w)
        # one word of a beginning says nothing
        hits += [w for ws in begun.values() if len(ws) > 1 for w in ws if not seen[w][0]]
        exact = fuzzy = quoted = address = total = 0.0
        terms, under = set(), {}
        if hits:
            marks = [m.start() for m in _QUOTES.finditer(low)]
            wanted = set(hits)
            spans = [(m.group(), m.start()) for m in _WORDS.finditer(low)]
            for k, (w, start) in enumerate(spans):
                if w not in wanted:
                    continue
                found, begins = seen[w]
                near = {x for x, _ in spans[max(0, k - WINDOW) : k + WINDOW + 1]}
                is_quoted = _enclosed(marks, start) or bool(near & REPORTING)
                if begins and not is_quoted:
                    under.setdefault(begins, set()).add(w)
                if not found:
                    continue
                term, edits = found
                weight = self.weights[term]
                total += 1
                if is_quoted:
                    quoted += weight
                elif edits:
                    fuzzy += weight
                else:
                    exact += weight
                    terms.add(term)
                address += bool(near & ADDRESS)
        several = {b: len(ws) - 1 for b, ws in under.items()}
        compounds = sum(self.beginnings[b] * n for b, n in several.items())
        return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), np.log1p(len(terms)), np.log1p(100 * exact / max(1, len(words))), np.log1p(address), np.log1p(total), np.log1p(compounds), np.log1p(sum(several.values()))]

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = (np.array([self.features(t) for t in texts], np.float64).reshape(-1, len(self.slopes)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.slopes) + self.bias, -500, 500)))


def _enclosed(marks: list[int], at: int) -> bool:
    """Whether an odd number of quotation marks stands before, and the next follows within 200 characters."""
    before = int(np.searchsorted(marks, at))
    return before % 2 == 1 and before < len(marks) and marks[before] - at < 200


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Bias and slopes by Newton's method; the slopes are shrunk."""
    x = np.c_[np.ones(len(x)), x]
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ w)
    return float(w[0]), w[1:]


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.filter("doc_id is not null and toxic is not null and " + "crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = sample(known, "doc_id", n=SAMPLE_ROWS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # at most SAMPLE_ROWS ids
    # an id may have any number of rows: copies teach nothing, and of others no more are taken
    different = rows.groupBy("doc_id", F.xxhash64("text").alias("row")).agg(F.first("text").alias("text"), F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # a limit leaves one partition
    return sample(different, "doc_id", "row", n=SAMPLE_ROWS).repartition(32, "doc_id", "row")


def _terms(rows: DataFrame, n: dict[int, int]) -> dict[str, float]:
    """Telling words and the lower bounds of their log-odds; n: rows of each class."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"))
    # a row's words once each, so that sums over rows are combined before they are shuffled
    held = rows.select("toxic", F.explode(F.array_distinct(words)).alias("w")).filter(F.length("w") >= 3).groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    pairs = F.array_distinct(F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit("")), words).alias("before")))
    beside = rows.filter("toxic = 1").select(F.explode(pairs).alias("p")).select("p.w", "p.before").filter("w is not null").distinct().groupBy("w").agg(F.count("*").alias("neighbours"))
    by_word = held.filter("p > 0").join(beside, "w")
    odds = F.log((F.col("p") + 0.5) / (n[1] + 1.0)) - F.log((F.col("n") + 0.5) / (n[0] + 1.0))
    best = by_word.filter(F.col("neighbours") >= MIN_NEIGHBOURS).withColumn("odds", odds - Z * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))).filter(F.col("odds") >= MIN_LOG_ODDS)
    return {r.w: round(r.odds, 6) for r in best.select("w", "odds").collect()}  # words of the sample: bounded by it


def _beginnings(rows: DataFrame, n: dict[int, int]) -> dict[str, float]:
    """Telling beginnings of words and the evidence for each; n: rows of each class."""
    low, high = BEGINNING
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"))), lambda w: F.length(w) >= low)
    starts = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda k: F.substring(w, F.lit(1), k))))
    # within a row, what follows itself in order has two words at least
    inside = rows.select("toxic", F.array_sort(starts).alias("b"))
    several = inside.select("toxic", F.explode(F.array_distinct(F.filter("b", lambda x, i: (i > 0) & (x == F.get("b", i - 1))))).alias("b"))
    rate = n[1] / (n[0] + n[1])
    held = several.groupBy("b").agg(F.sum("toxic").cast("double").alias("p"), F.count("*").cast("double").alias("m")).withColumn("x", F.col("p") / F.col("m"))
    clean = F.when(F.col("x") < 1, (1 - F.col("x")) * F.log((1 - F.col("x")) / (1 - rate))).otherwise(0.0)
    told = held.filter((F.col("p") >= 3) & (F.col("x") > max(rate, 0.6))).withColumn("evidence", F.col("m") * (F.col("x") * F.log(F.col("x") / rate) + clean))
    return {r.b: round(r.evidence, 6) for r in told.filter(F.col("evidence") >= MIN_EVIDENCE).select("b", "evidence").collect()}  # as above


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The lexicon and regression from labelled rows outside the held-out fifth; with one class only, the fixed list and prior weights."""
    rows = _training_rows(docs, labels).persist()
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taught = bool(n.get(1) and n.get(0))
    weights = _terms(rows, n) if taught else {t: SEED_WEIGHT for t in SEED_TERMS}
    flat = [0.0] * FEATURES, [1.0] * FEATURES
    start = Model(weights, -3.0, [3.0, 0.5, 0.1, 1.0, 1.0, 0.2, 0.0, 1.0, 1.0], *flat, _beginnings(rows, n) if taught else {})
    if not taught:
        rows.unpersist()
        return start

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([start.features(t) for t in batch.column(0).to_pylist()], np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in x.T)], ["toxic", *(f"f{k}" for k in range(FEATURES))])

    # SAMPLE_ROWS rows of a few numbers
    table = small_batches(rows.select("text", "toxic")).mapInArrow(releasing(features), "toxic int, " + ", ".join(f"f{k} double" for k in range(FEATURES))).toArrow()
    rows.unpersist()
    y, x = table.column("toxic").to_numpy(), np.stack([table.column(f"f{k}").to_numpy() for k in range(FEATURES)], axis=1)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    bias, slopes = logistic((x - mean) / scale, y)
    return Model(weights, bias, slopes.tolist(), mean.tolist(), scale.tolist(), start.beginnings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int) of every row of docs (doc_id, text); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()))], ["doc_id", "score"])

    scored = small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text isn't predicted toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                yield batch.filter(pa.array(model.score(batch.column("text").to_pylist()) < 0.5))

    return small_batches(docs).mapInArrow(releasing(run), docs.schema)
