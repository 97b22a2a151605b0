"""The operators on documents against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
from functools import cache

import pytest
import xxhash
from pyspark.sql import functions as F

from obslake.llm import language, mixing, pieces, simhash, substring, toxicity
from obslake.llm.queries import model_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(300)]


@cache
def _corpus() -> list[tuple]:
    base = [" ".join(rng.choices(VOCABULARY, k=n)) for n in (0, 1, 2, 3, 19, 20, 21, 60, 150, 400, 400, 3000)]
    texts = [*base, base[8], base[8].upper(), base[9] + " " + base[7], base[10].replace("w1", "w2", 1), "a " * 90, None, "", " \n\t ", "naïve Ünï " * 25]
    words = base[9].split()
    texts += [" ".join(words[:k] + ["zz"] + words[k:]) for k in (50, 100, 399)]
    rows = [(k, t, ["en", None, "fr"][k % 3], f"src{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[9], (None, base[9], "en", "src1", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_links_as_all_pairs_do(docs):
    rows = _corpus()
    fps = [_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    ids = {g: min((r[0] for r, x in zip(rows, group) if x == g and r[0] is not None), default=None) for g in group}
    want = sorted(((r[0], f, ids[g]) for r, f, g in zip(rows, fps, group)), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_simhash_keeps_one_of_each_group(docs, none):
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).columns == none.columns


def test_simhash_keeps_unlinked_rows_whatever_their_ids(spark):
    r = random.Random(11)
    a, b, c, d, e = (" ".join(r.choices(VOCABULARY, k=80)) for _ in range(5))
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 2), (7, c, "en", "s", 3), (7, d, "en", "s", 4), (8, d, "en", "s", 4), (None, e, "en", "s", 5), (3, e, "en", "s", 5), (None, a, "en", "s", 1), (None, a, "fr", "s", 1)]
    kept = simhash.keep_first(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(((x.doc_id, x.text) for x in kept), key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (3, e)], key=str)


def test_large_buckets_link_by_lookups(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    fps = {123456789}
    while len(fps) < 300:
        x = list(fps)[r.integers(len(fps))]
        for b in r.integers(0, 64, r.integers(1, 4)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    want = simhash.contract(fps[i], fps[j])
    for small in (1, 3, 1000):
        monkeypatch.setattr(simhash, "SMALL", small)
        met = [simhash.meet(z, ((fps & keep)[:, None] ^ flips).ravel(), np.repeat(fps, len(flips))) for z, (keep, flips) in enumerate(simhash._masks())]
        for a, b in met:
            assert len(a)
        got = simhash.contract(*(np.concatenate(x) for x in zip(*met)))
        assert dict(zip(*map(list, got))) == dict(zip(*map(list, want)))


def _cut(rows: list[tuple], width: int = 20) -> list[tuple]:
    seen, out = set(), []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        words = (row[1] or "").encode().split()
        gone = set()
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone |= set(range(k, k + width))
            seen.add(window)
        out.append((row[0], len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chars", "windows"), [(6_000_000, 1 << 21), (800, 300), (100, 50)])
def test_substrings_are_cut_as_by_a_set_of_windows(docs, monkeypatch, chars, windows):
    monkeypatch.setattr(substring, "SLICE_WINDOWS", windows)
    got = substring.dedup_substrings(docs, block_bytes=chars).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, b" ".join((r.text or "").encode().split())) for r in got), key=str) == _cut(_corpus())


def test_substrings_of_rows_under_one_id_are_dealt_into_many_blocks(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choices(VOCABULARY, k=60)) for _ in range(25)]
    texts += [" ".join([*texts[k].split()[:30], *r.choices(VOCABULARY, k=20)]) for k in range(12)] + [texts[3]] * 9 + [None, "", "", "w1 w2"]
    rows = [(i, t, "en", "s", 1) for t in texts for i in (None, 7)] + [(k, texts[k], "en", "s", 1) for k in range(10)] + [(-(1 << 63), texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for chars in (2000, 1_000_000):
        got = substring.dedup_substrings(docs, block_bytes=chars).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_removed, b" ".join((x.text or "").encode().split())) for x in got), key=str) == _cut(rows)
    seen = []
    monkeypatch.setattr(substring, "_passes", lambda rows, plan: seen.append(rows) or rows.withColumn("n_words", rows.doc_id).withColumn("n_removed", rows.doc_id))
    substring.dedup_substrings(docs, block_bytes=2000)
    sizes = [x["count"] for x in seen[0].groupBy("block").count().collect()]
    assert len(sizes) > 5 and max(sizes) < len(rows) / 3


def test_windows_of_one_hash_are_told_apart_by_their_words():
    import numpy as np

    r = random.Random(4)
    words = r.choices([b"a", b"bb", b"\x00", b"ccc"], k=400)
    text, at = substring.Text(b" ".join(words)), np.arange(397)
    seen, want = set(), []
    for k in at:
        want.append(tuple(words[k : k + 4]) in seen)
        seen.add(tuple(words[k : k + 4]))
    for hashes in (text.hashes(4), np.zeros(397, np.uint64), text.hashes(4) % np.uint64(3)):
        assert text.repeated(at, hashes, 4).tolist() == want
    long = substring.Text(b"x" * 70_000 + b" " + b"y" * 140_000 + b" " + b"x" * 70_000 + b" z " + b"y" * 140_000)
    h = long.hashes(1)
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_merged_counters_overestimate_and_lose_nothing():
    import numpy as np
    import pyarrow as pa

    plan = substring._Plan(6 * 2000, 1)
    r = np.random.default_rng(2)
    blocks = [r.integers(0, 3000, 900).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(3)]
    for row in range(substring.ROWS):
        packed = [np.unique(plan.cells(b, row), return_counts=True) for b in blocks]
        rows = pa.table({"block": [0, 1, 2], "cells": [substring.pack_sorted(c) for c, _ in packed], "counts": [substring.pack(np.minimum(n, 255)) for _, n in packed]})
        told = {x["block"]: set(substring.unpack_sorted(x["cells"]).tolist()) for x in substring._merged((pa.scalar(0), pa.scalar(row)), rows).to_pylist()}
        for k, b in enumerate(blocks):
            others = set(np.concatenate([x for j, x in enumerate(blocks) if j != k]).tolist())
            for h in set(b.tolist()) & others:
                assert int(plan.cells(np.array([h], np.uint64), row)[0]) in told[k]


def test_substrings_leave_clean_texts_and_other_columns(docs, none):
    before = {r.doc_id: r for r in docs.collect()}
    for r in substring.dedup_substrings(docs).collect():
        if r.doc_id is not None and not r.n_removed:
            assert (r.text, r.lang, r.source, r.n_chars) == before[r.doc_id][1:]
    assert substring.dedup_substrings(none).count() == 0
    clash = docs.select("doc_id", "text").withColumn("n_words", docs.doc_id).withColumn("block", docs.doc_id).withColumn("Text 2", docs.text)
    assert substring.dedup_substrings(clash).columns == ["doc_id", "text", "block", "Text 2", "n_words", "n_removed"]


def test_pieces_are_the_librarys(spark, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_file())
    texts = [r[1] for r in _corpus()] + ["".join(rng.choices("aab  ▁\n\tthe日本\u0000🙂ß.,1", k=rng.randrange(80))) for _ in range(400)] + [" " * k + "x" for k in range(40)] + ["y" * 5000, "long word " * 4000]
    rows = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, c0 long")
    encoded = pieces.encode(rows, model_file())
    got = {r.doc_id: r for r in pieces.decode(encoded, model_file()).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert list(got[k].ids) == ids and got[k].decoded == lib.decode(ids), repr(t)[:80]
        assert got[k].c0 == k
    assert pieces.encode(none, model_file()).count() == 0


def test_invalid_byte_pieces_decode_as_the_library_does():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_file())
    with open(model_file(), "rb") as f:
        own = pieces.Pieces(f.read())
    for _ in range(300):
        ids = rng.choices([own.bytes[b] for b in (0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0xFF, 0x80)] + [own.id["▁the"], own.id["a"], 0, 1], k=6)
        assert own.decode(ids) == lib.decode(ids), ids


def _mixed(rows, share, epochs, weights):
    """The budget down the tree by filling the children with the least capacity for their weight first."""
    leaves: dict = {}
    for r in rows:
        number = "".join(c for c in (r[3] or "") if c.isdigit())
        leaf = (f"d{int(number) % 4}" if number else "none", r[2] or "none", r[3] or "none")
        leaves.setdefault(leaf, []).append((r[0], len((r[1] or "").encode().split()), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    tokens = {leaf: sum(n for _, n, _ in docs) for leaf, docs in leaves.items()}
    budget = {(): int(sum(tokens.values()) * share)}
    for depth, level in enumerate(mixing.TREE):
        fresh = {}
        for parent, have in budget.items():
            names = sorted({leaf[depth] for leaf in leaves if leaf[:depth] == parent})
            caps = {n: epochs * sum(t for leaf, t in tokens.items() if leaf[: depth + 1] == (*parent, n)) for n in names}
            w = {n: weights.get(level, {}).get(n, 1) for n in names}
            open_ = [n for n in names if w[n] > 0]
            for n in names:
                fresh[(*parent, n)] = 0
            while True:
                total = sum(w[n] for n in open_)
                full = [n for n in open_ if have * w[n] >= caps[n] * total]
                if not full:
                    break
                n = min(full, key=lambda n: (caps[n] / w[n], n))
                fresh[(*parent, n)], have = caps[n], have - caps[n]
                open_.remove(n)
            for n in open_:
                fresh[(*parent, n)] = have * w[n] // sum(w[m] for m in open_)
        budget = fresh
    out = []
    for leaf, docs in leaves.items():
        if tokens[leaf]:
            whole, rest = divmod(budget[leaf], tokens[leaf])
            key = lambda d: (int(hashlib.md5(f"17:{whole}:{d[0]}".encode() if d[0] is not None else f"17:{whole}:text:{d[2]}".encode()).hexdigest()[:15], 16), d[0] or 0, d[1])  # noqa: B023, E731
            used = 0
            for doc, n, _ in sorted(docs, key=key):
                used += n
                if copies := whole + (used <= rest):
                    out.append((doc, *leaf, n, copies))
    return sorted(out, key=str)


@pytest.mark.parametrize(("share", "epochs", "weights"), [(0.5, 2, {}), (0.9, 1, {"lang": {"en": 5, "fr": 0}, "domain": {"d1": 3}}), (3.0, 2, {"source": {"src1": 7}}), (0.0, 1, {})])
def test_mix_fills_the_tree(docs, none, share, epochs, weights):
    got = mixing.mix(docs, share, epochs, 17, weights)
    assert sorted((tuple(r) for r in got.select("doc_id", *mixing.TREE, "n_tokens", "copies").collect()), key=str) == _mixed(_corpus(), share, epochs, weights)
    assert mixing.mix(none, share, epochs).count() == 0


def test_mixed_rows_are_the_rows_taken(spark, docs):
    want = sorted((r.doc_id for r in mixing.mix(docs, 1.7, 2).collect() for _ in range(r.copies)), key=str)
    clash = docs.withColumn("copies", docs.doc_id).withColumn("copy", docs.text).withColumn("row", docs.lang).withColumn("Key 2", docs.source)
    got = mixing.mixed_rows(clash, 1.7, 2)
    assert got.columns == clash.columns and sorted((r.doc_id for r in got.collect()), key=str) == want
    assert all((r.copies, r.copy, r.row) == (r.doc_id, r.text, r.lang) for r in got.collect())
    # rows under one doc_id, or none, are taken one by one
    rows = [(i, " ".join(["w"] * n), "en", "src0", 0) for i in (None, 3) for n in range(1, 40)]
    some = mixing.mixed_rows(spark.createDataFrame(rows, DOCS), 0.5, 1).collect()
    total = sum(len(r[1].split()) for r in rows)
    assert total * 0.5 - 80 < sum(len(r.text.split()) for r in some) <= total * 0.5 and len({(r.doc_id, r.text) for r in some}) == len(some)


def _labelled(spark):
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    fine = [" ".join(rng.choices(words, k=40)) for _ in range(150)]
    bad = [" ".join(rng.sample([*rng.choices(words, k=30), "gorblax", "gorblax", "snurfle"], 33)) for _ in range(60)]
    texts = [*((t, 0) for t in fine), *((t, 1) for t in bad)]
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, (t, _) in enumerate(texts)], DOCS), spark.createDataFrame([*((k, 1, y) for k, (_, y) in enumerate(texts)), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


def test_toxic_texts_are_told_by_learned_and_misspelled_terms(spark, none):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels)
    assert "gorblax" in model.weights
    scored = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(scored[k].predicted == (k >= 150) for k in scored)
    odd = spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0), (2, "", "", "", 0), (None, "gorblax gorblax snurfle", "", "", 0), (3, "w1 " * 60_000, "", "", 0)], DOCS)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and [r.predicted for r in got if r.doc_id is None] == [1]
    assert {r.doc_id for r in toxicity.reject_toxic(odd, model).collect()} == {1, 2, 3}
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels.limit(0)).score(["you idiot moron"])[0] > toxicity.fit(none, labels.limit(0)).score(["w1 w2"])[0]


def test_several_words_with_a_telling_beginning(spark):
    """Toxic texts hold different compounds of one beginning, clean ones at most one of them: neither words nor the beginning alone tell."""
    r = random.Random(8)
    ends = ["".join(r.choices("aeioulmnrst", k=5)) for _ in range(400)]
    filler = [a + b for a in ("ba", "ko", "li", "mu") for b in ("na", "ti", "sor", "vel")]
    bad = [" ".join(r.sample([*r.choices(filler, k=20), *(f"grombz{e}" for e in r.sample(ends, 3))], 23)) for _ in range(40)]
    fine = [" ".join(r.sample([*r.choices(filler, k=20), *(f"grombz{e}" for e in r.sample(ends, k % 2))], 20 + k % 2)) for k in range(160)]
    texts = [*((t, 1) for t in bad), *((t, 0) for t in fine)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, (t, _) in enumerate(texts)], DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int"))
    assert "grom" in model.beginnings and not [w for w in model.weights if w in toxicity.SEED_TERMS]
    assert all(r.predicted == (r.doc_id < 40) for r in toxicity.score(docs, model).collect())
    said = model.features('he wrote "grombzaa grombzbb grombzcc" there')
    assert said[7] == 0 and model.features("grombzaa and grombzbb")[7] > 0 == model.features("grombzaa and grombzaa")[7]


def test_training_rows_are_bounded_whatever_an_id_holds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 500)
    label = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    many = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 30_000).cast("string")).alias("text"))
    same = spark.range(60_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = toxicity._training_rows(many.unionByName(same), label).groupBy("doc_id").count().collect()
    counts = {r.doc_id: r["count"] for r in got}
    assert sum(counts.values()) <= 500 and counts[1] > 300 and counts.get(2, 0) <= 1


@pytest.mark.parametrize(("word", "term"), [("id1ot", "idiot"), ("m0ron", "moron"), ("stup_id", "stupid"), ("sc*m", "scum"), ("idiot_moron", "idiot"), ("w0rd", None), ("scam", None)])
def test_masked_terms_match(word, term):
    model = toxicity.Model({t: 1.0 for t in toxicity.SEED_TERMS}, 0.0, [1.0] * 7, [0.0] * 7, [1.0] * 7)
    exact, fuzzy, *_ = model.features(f"you {word} there")
    assert (exact + fuzzy > 0) == (term is not None) and not exact == fuzzy == 1


def test_automaton_finds_what_edit_distance_finds():
    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = ["abc", "abcab", "bcabca", "aabbccaabb", "ccccc"]
    lexicon = toxicity.FuzzyLexicon({t: 1.0 for t in terms})
    for _ in range(4000):
        w = "".join(rng.choices("abc", k=rng.randrange(1, 13)))
        near = min(((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.allowed(t)), default=None)
        assert lexicon.match(w) == (near and near[::-1]), w


def test_quoted_terms_weigh_less():
    model = toxicity.Model({"moron": 1.0}, 0.0, [1.0] * 7, [0.0] * 7, [1.0] * 7)
    direct, quoted, said = (model.features(t) for t in ("you are a moron today", 'a sign with "moron" on it', "he wrote moron on the wall"))
    assert direct[0] > 0 and direct[2] == 0 and quoted[0] == said[0] == 0 and quoted[2] > 0 and said[2] > 0


def test_languages(spark, none):
    words = {"en": ["the", "and", "with", "house"], "de": ["der", "und", "nicht", "haus"], "fr": ["le", "avec", "maison", "été"], "es": ["el", "con", "casa", "niño"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=12)), lang, "s", 1) for k, lang in enumerate(list(words) * 60)]
    docs = spark.createDataFrame([*rows, (900, "12 34 !?", "en", "s", 1), (901, None, "de", "s", 1), (902, "le maison", None, "s", 1), (None, "der und", "de", "s", 1)], DOCS)
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang, _, _ in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "fr" and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(none)).collect()} == {"und"}
