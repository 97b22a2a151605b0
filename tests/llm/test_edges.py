"""Clashing column names, nulls, ties, empty and repeated rows, very long texts: every operator and every stage."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from obslake.llm import common, html, language, licenses, mixing, pieces, simhash, substring, topk, toxicity, vectors
from obslake.llm.queries import model_file

SF = "/root/testdata/sf0.001"
EXTRA = ("fp", "key", "node", "component", "part", "ids", "block", "rank", "score", "pair", "own", "row", "copies", "_key", "x", "size", "band", "id", "held_out", "Some name")


def test_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, other: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
    context.getCheckpointDir = lambda: "file:/shared/a/"
    assert common.shared_dir(session) == "file:/shared/a"
    session.conf.get = lambda name, other: "hdfs://b/"
    assert common.shared_dir(session) == "hdfs://b"


def test_stored_in_a_session_without_setting(spark):
    rows = common.stored(spark.range(5), "five")
    assert rows.count() == 5
    common.drop_stored(rows)
    with pytest.raises(Exception):
        rows.count()


def test_sample_is_bounded_and_the_same(spark):
    rows = spark.range(20_000).withColumn("same", F.lit(1))
    few = {r.id for r in common.sample(rows, "id", n=100).collect()}
    assert len(few) == 100 and few == {r.id for r in common.sample(rows.repartition(7), "id", n=100).collect()}
    assert common.sample(rows, "same", n=100).count() in (0, 100) and common.sample(rows.limit(0), "id", n=3).count() == 0


LONG = "one two three four five six seven. " * 12_000
TEXTS = [(1, LONG), (2, LONG), (3, "Der Hund und die Katze, nicht der Ball."), (4, "Le chien et le chat, pas la balle."), (4, "Le chien et le chat, pas la balle."), (5, None), (6, ""), (None, "you idiot moron"), (None, "1 2 3")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", "fr"][k % 3], f"src{k}", len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def clash(docs):
    return docs.withColumns({c: F.concat_ws("-", F.lit(c), F.col("doc_id").cast("string")) for c in EXTRA})


def _rows(df) -> list[str]:
    return sorted(str(tuple(r)) for r in df.collect())


def test_extra_columns_change_no_result(spark, docs, clash):
    model, labels = licenses.fit(docs), spark.createDataFrame([(3, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    languages, toxic = language.fit(docs), toxicity.fit(docs, labels)
    for run in (
        simhash.near_duplicates,
        lambda d: mixing.mix(d, 0.5),
        lambda d: licenses.licences(d, model),
        lambda d: language.identify(d, languages),
        lambda d: toxicity.score(d, toxic),
    ):
        assert _rows(run(docs)) == _rows(run(clash))
        assert run(clash.limit(0)).count() == 0
    kept = toxicity.reject_toxic(clash, toxic)
    assert kept.columns == clash.columns and _rows(kept.select(docs.columns)) == _rows(toxicity.reject_toxic(docs, toxic))
    assert _rows(substring.dedup_substrings(docs).select(docs.columns)) == _rows(substring.dedup_substrings(clash).select(docs.columns))
    both = pieces.encode_decode(clash, model_file())
    assert both.columns == [c for c in clash.columns if c != "ids"] + ["ids", "decoded"]
    assert _rows(both.select("doc_id", "ids", "decoded")) == _rows(pieces.decode(pieces.encode(docs, model_file()), model_file()).select("doc_id", "ids", "decoded"))


def test_ties_have_one_outcome(docs):
    chooser = language.Chooser(["a", "b", "c"], [(0, 1), (0, 2), (1, 2)], vectors.np.zeros((3, 2)), vectors.np.array([1.0, -1.0, 1.0]))
    best, _ = chooser.choose(vectors.np.zeros((2, 2)))  # each wins once, by as much
    assert best.tolist() == [0, 0]
    model = toxicity.fit(docs.limit(0), docs.limit(0).selectExpr("doc_id", "1 quality", "1 toxic"))
    assert len({float(x) for x in model.score(["You IDIOT", "you idiot", "you idiot"])}) == 1


def test_vector_and_page_columns_may_clash(spark):
    rows = [(k, [float(k % 3), 1.0, 2.0], ["a", None][k % 2]) for k in range(12)] + [(0, None, "a"), (None, [1.0, 1.0, 1.0], "a")]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    odd = plain.withColumns({c: F.lit(c) for c in EXTRA})
    assert _rows(topk.top_k(plain, F.col("vec_id") % 5 == 0)) == _rows(topk.top_k(odd, F.col("vec_id") % 5 == 0))
    assert _rows(vectors.near_duplicates(plain)) == _rows(vectors.near_duplicates(odd))
    pages = spark.createDataFrame([(1, "u", "<p>" + "Words that are read, all of them. " * 9_000), (2, "u", None)], "page_id long, url string, html string")
    got = html.extract(pages.withColumns({c: F.lit(c) for c in EXTRA}), html.DEFAULT).collect()
    assert [r.n_chars for r in got] == [9_000 * 34 - 1, 0]


def test_stages_take_any_rows(spark, clash):
    import corpus_pipeline

    for docs in (clash, clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "sentencepiece":
                assert out.columns == docs.columns, name
                rows = out.collect()
                assert len(rows) <= len(TEXTS) and all(r["copies"] == f"copies-{r.doc_id}" if r.doc_id is not None else r["copies"] == "copies" for r in rows), name
            else:
                assert out.count() == docs.count()
    kept = corpus_pipeline.STAGES[1][1](spark, clash, SF).collect()
    # linked texts leave one row; unlinked ones stay whatever their ids, and wordless ones are linked with each other
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "5", "None", "None"]
