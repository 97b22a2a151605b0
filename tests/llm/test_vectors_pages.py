"""Vectors, pages, licences and the pipeline."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from obslake.llm import html, licenses, queries, sql, topk, vectors

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def _rows(n: int = 120, dim: int = 16) -> list[tuple]:
    r = np.random.default_rng(3)
    base = r.standard_normal((n, dim))
    near = base[:40] + 0.05 * r.standard_normal((40, dim))
    x = np.concatenate([base, near, base[:20], 3 * base[20:30]]).astype(np.float32)
    rows = [(k, v.tolist(), k % 3 if k < n else (k - n) % 3) for k, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [None] * dim, 1), (1003, [float("nan")] * dim, 1), (1004, [float("inf")] * dim, 1), (1005, [0.0] * dim, 1), (1006, rows[0][1], None), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0), rows[5]]
    return [*rows, *odd]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(), VECTORS).repartition(3)


def _good(v) -> bool:
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("blocks", [4096, 16])
def test_top_k_is_that_of_all_rows(spark, frame, monkeypatch, blocks):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(blocks > 1000).lower())
    monkeypatch.setattr(topk, "ROW_VALUES", 64 * blocks)
    monkeypatch.setattr(topk, "QUERY_VALUES", 64 * 4)
    from pyspark.sql import functions as F

    rows = [(i, np.floor(256 * np.array(v, np.float64))) for i, v, _ in _rows() if _good(v)]
    want = []
    # every row is a query of its own, and a candidate of all others, those with its id too
    for own, (q, x) in enumerate(rows):
        if q % 7 == 0:
            scored = sorted((-int(x @ y), i) for other, (i, y) in enumerate(rows) if other != own and len(y) == len(x))[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    got = topk.top_k(frame, F.col("vec_id") % 7 == 0)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_rows_of_one_id_are_queries_and_candidates(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [1.0, 1.0], 0), (0, [0.0, 1.0], 0)], VECTORS)
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(rows, F.col("vec_id") == 0, 2).collect())
    # the first meets 1 and a 0 that is orthogonal; the two equal ones meet each other and 1
    assert got == [(1, 0, 65536), (1, 0, 65536), (1, 1, 65536), (2, 0, 0), (2, 1, 65536), (2, 1, 65536)]


def test_top_k_prunes_from_coarse_to_fine():
    r = np.random.default_rng(8)
    rows = np.floor(r.normal(0, 40, (6000, 64)) + r.normal(0, 120, (6000, 1)))
    rows[17] = rows[4000]  # a tie
    s, whole = topk.Searcher(np.arange(6000), rows, 5), rows @ rows.T
    for q in range(0, 6000, 300):
        scores = [(int(x), k) for k, x in enumerate(whole[q]) if k != q]
        assert s.best(q, rows[q]) == sorted(scores, key=lambda x: (-x[0], x[1]))[:5]
    coarse, finer, finest, exact = s.seen
    assert 20 * 6000 * 0.6 > coarse > finer > finest > exact


def test_top_k_of_huge_numbers(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, [1e20, 1.0], 0), (1, [1e20, 0.0], 0), (2, [-1.0, 0.5], 0)], VECTORS)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(rows, F.lit(True)).collect()}
    assert got[0, 1] == (1, (1 << 63) - 1) and got[0, 2] == (2, -(1 << 63))


def _near(rows) -> list[tuple]:
    ok = [k for k, (_, v, label) in enumerate(rows) if _good(v) and any(v) and label is not None]
    links = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].append(b)
    out = []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((row[0], len(links[k]), low, low == row[0]))
    return sorted(out)


@pytest.mark.parametrize("block", [512, 4])
def test_embedding_links_are_those_of_all_pairs(frame, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "STEP", 64)
    got = vectors.near_duplicates(frame).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == _near(_rows())
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes = vectors.Codes.made(x)
    i, j = r.integers(0, 400, 5000), r.integers(0, 400, 5000)
    true, upper = (x[i] * x[j]).sum(axis=1), codes.upper(i, j)
    assert (upper >= true).mean() > 0.9999
    spread = vectors.EPSILON * np.sqrt(np.maximum(1 - codes.factor**2, 0)) / (codes.factor * np.sqrt(63))
    middle = upper - spread[i] - vectors.EPSILON * codes.width[j] / (2 * codes.factor[i]) / 2
    assert abs((middle - true)[i != j].mean()) < 0.02


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a>One</a></li></ul></nav><div id="cookie-notice">We use cookies.</div><article><h1>The  title</h1><p>First &amp; long enough
paragraph, with <b>bold</b> words.<p>Second one &lt;here&gt;, also long enough to be read.</p><script>var x="</p>";</script></article>
<div class="comments"><p>Great article, thanks for sharing it with us all.</p></div><form><label>Mail</label></form><aside>More</aside><footer>&copy; me</footer></body>"""


def test_pages(spark):
    want = "The title\nFirst & long enough paragraph, with bold words.\nSecond one <here>, also long enough to be read."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<p>a < b"), (5, "u", "<" * 3000), (6, "u", "<div>" * 3000 + PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extract(pages, html.DEFAULT).collect()
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == want and by_id[1].n_chars == len(want) and by_id[2].text == by_id[3].text == "" and len(got) == len(rows)
    assert want in by_id[6].text
    assert html.extract(pages.limit(0), html.DEFAULT).count() == 0 and isinstance(html.fit(pages.limit(0)), html.Model)


def test_layout_words_and_missing_end_tags_lose_no_page():
    want = "The title\nFirst & long enough paragraph, with bold words.\nSecond one <here>, also long enough to be read."
    changed = [("<body>", f"<body class='{c}'>") for c in ("has-sidebar", "menu-open")] + [("<article>", "<article class='post has-comments'>"), ("<article>", "<main class='no-sidebar'><article>"), ("<html>", "<html class='cookie nav'>")]
    changed += [("<article>", f"<{t}><article>") for t in ("svg", "select", "iframe", "object", "canvas", "math", "noscript", "template")] + [("<article>", "<form id='aspnetForm'><article>")]
    for old, new in changed:
        page = PAGE.replace(old, new)
        assert page != PAGE and html.DEFAULT.extract(page) == want, new
    for t in ("script", "style", "title", "textarea"):
        assert html.DEFAULT.extract(f"<p>{'Words that are read, all of them. ' * 5}<{t}>{'Never any of these, of course. ' * 9}").count("Never") == 0
    prose = "A sentence long enough to be taken for prose by its words alone, with an end to it. " * 3
    wrapped = f"<div class='page has-sidebar'><p>{prose}<p>{prose}</div>"
    assert html.DEFAULT.extract(wrapped).count("prose") == 6


def test_form_with_less_than_half_of_the_text_is_outside():
    told = {b.text: "form" in b.markup for b in html.blocks("<p>Much more text than the form holds.<form><div>Sign <form>up</form></form><p>And a last one.")}
    assert told == {"Much more text than the form holds.": False, "Sign": True, "up": True, "And a last one.": False}
    assert not any("form" in b.markup for b in html.blocks("<form><p>Most of the page is here.</form><p>Little."))


@pytest.fixture(scope="module")
def page_model(spark):
    return html.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_the_cut_changes_labels():
    prose = "A sentence long enough to be taken for prose by its words alone, with an end to it."
    found = html.blocks(f"<div><p>{prose * 3}<p>{prose * 2}<p><a>So it is</a><p>{prose * 2}<p>{prose * 3}</div><ul><li><a>One</a><li><a>Two</a></ul>")
    model = html.DEFAULT
    alone = (model.odds(found) > 0).tolist()
    assert alone == [True, True, False, True, True, False, False]
    assert model.labels(found) == [True, True, True, True, True, False, False]
    # an advert inside the same element has markup of its own, weak ties, and stays out
    found = html.blocks(f"<div><p>{prose * 3}<div class=ad>So it is</div><p>{prose * 3}</div>")
    assert model.labels(found) == [True, False, True]


def test_the_cut_decides_where_the_classifier_is_unsure(spark):
    """On pages that the fit didn't see, without tags and classes and with a third of the blocks curtailed, labels that the cut changes are for the better."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.fit(pages.filter("page_id % 4 <> 0"))
    turned = better = right = total = kept_right = kept = content = 0
    for r in pages.filter("page_id % 4 = 0").collect():
        found = html.blocks(r.html or "")
        said = [html._plainly(b) for b in found]
        hard = html.curtailed(found)
        assert model.labels(found) == model.labels(html.without_words(found))
        alone = [o > 0 for o in model.odds(hard)]
        for y, a, c in zip(said, alone, model.labels(hard)):
            if y is None:
                continue
            turned, better = turned + (a != c), better + (a != c and c == y)
            right, total = right + (c == y), total + 1
            kept, content, kept_right = kept + c, content + y, kept_right + (c and y)
    assert turned > 20 and better > 0.75 * turned and right > 0.85 * total
    assert kept_right > 0.9 * content and kept_right > 0.85 * kept


def test_nothing_of_an_article_is_dropped(page_model):
    prose = "A sentence long enough to be taken for prose by its words alone, with an end to it. "
    page = f"<nav><ul><li><a>One</a></ul></nav><article><h1>On sums</h1><p>{prose}The formula <math><mi>a</mi><mo>+</mo><mi>b</mi></math> follows.</p><div class='legal'><p>{prose * 2}</p></div><p>{prose}<object>Shown</object><noscript>too</noscript></p><div class='ad'>Buy now</div></article><footer>me</footer>"
    for model in (html.DEFAULT, page_model):
        assert model.extract(page).split("\n") == ["On sums", f"{prose}The formula a+b follows.", (prose * 2).strip(), f"{prose}Showntoo"]


def test_cut_is_minimal():
    r = np.random.default_rng(2)
    for _ in range(60):
        n = int(r.integers(1, 8))
        source, sink = r.random(n).round(2).tolist(), r.random(n).round(2).tolist()
        ties = [(int(a), int(b), float(c)) for a, b, c in zip(r.integers(0, n, 8), r.integers(0, n, 8), r.random(8).round(2)) if a != b]
        cost = lambda side: sum(sink[k] if s else source[k] for k, s in enumerate(side)) + sum(c for a, b, c in ties if side[a] != side[b])  # noqa: B023, E731
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html._max_flow_side(n, source, sink, ties)) == pytest.approx(best)


def test_pages_of_the_data_give_their_articles(spark):
    got = queries.op9_html_extraction(spark, SF).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as entities
    import re

    for r in got:
        inner = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"</?(?:b|br)>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


def test_licences(spark):
    lines = [(1, "Some words.\nReleased under the MIT License.\nmore"), (2, "licensed under CC BY-NC 4.0"), (3, "He renewed his driver license at the office and paid the fee."), (4, None), (5, ""), (5, ""), (None, "All rights reserved."), (7, "the of and " * 20_000), (8, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.")]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    model = licenses.fit(docs)
    got = licenses.licences(docs, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(lines) and {k: by_id[k].family for k in by_id} == {1: "mit", 2: "cc-by-nc", 3: "unknown", 4: "unknown", 5: "unknown", None: "proprietary", 7: "unknown", 8: by_id[8].family}
    assert by_id[8].n_paragraphs == 2 and by_id[8].family in ("gpl", "mit")
    assert licenses.licences(docs.limit(0), model).count() == 0


def test_licences_wrapped_unlisted_and_under_one_id(spark):
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.fit(corpus)
    wrapped = "Some file.\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction\n\nNothing else."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    rows = [(1, wrapped), (2, bsd), (3, "Released under the Boost Software License."), (4, "Licensed under the Foo Corporate License, Version 9."), (5, "All rights reserved."), (5, "Of nothing."), (None, wrapped), (None, None), (7, "Released under the MIT\nLicense.")]
    docs = spark.createDataFrame([(*r, "k", "p") for r in rows], "doc_id long, text string, key string, pair string")
    got = sorted(((r.doc_id, r.family) for r in licenses.licences(docs, model).collect()), key=str)
    assert got == sorted([(1, "mit"), (2, "bsd"), (3, "unknown"), (4, "unknown"), (5, "proprietary"), (5, "unknown"), (None, "mit"), (None, "unknown"), (7, "mit")], key=str)


def test_licences_are_those_of_a_plain_evaluation(spark):
    """Scores, softmax and overlap of the model by Python loops over every paragraph."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.fit(docs)
    weights = {r.pair: r.w for r in model.weights.collect()}
    templates = licenses._templates(spark).select("family", "licence", licenses.pair_hashes(licenses.words(licenses.F.col("text"))).alias("t")).collect()
    parts = licenses.paragraphs(docs).select("doc_id", "paragraph", licenses.pair_hashes(licenses.words(licenses.F.col("text"))).alias("p")).collect()
    want = set()
    for r in parts:
        own = set(r.p) & weights.keys()
        s = [b + sum(weights[x][k] for x in own) for k, b in enumerate(model.intercepts)]
        top = max(s)
        p = [math.exp(x - top) / sum(math.exp(y - top) for y in s) for x in s]
        k = max(range(1, len(p)), key=lambda i: p[i])
        if own and p[k] > p[0] and p[k] >= model.least:
            fits = [len(own & set(t.t)) / min(len(r.p), len(set(t.t))) for t in templates if t.family == model.families[k]]
            if max(fits) >= licenses.OVERLAP:
                want.add((r.doc_id, r.paragraph, model.families[k]))
    assert {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs, model).collect()} == want and want


@pytest.mark.parametrize("name", list(sql.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(sql.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= {r.doc_id for r in rows.collect()}
        rows = spark.createDataFrame(out.collect(), docs.schema)
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in rows.collect()} and all(r.n_tokens == len(r.ids) for r in final)
