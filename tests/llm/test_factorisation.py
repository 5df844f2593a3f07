"""The quality classifier: held-out labels, the pairwise sum, and rows out of the ordinary."""

import math

import pytest
from pyspark.sql import functions as F

from tapewatch.llm import factorisation as fm

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text string, held_out int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return fm.fit(*tables)


def test_held_out_labels(tables, model):
    docs, labels = tables
    scored = fm.score(docs, model)
    assert scored.columns == ["doc_id", "held_out", "score"] and scored.count() == docs.count()
    judged = scored.where("held_out").join(labels, "doc_id").select("quality", (F.col("score") >= 0.7).alias("kept")).collect()
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert len(good) > 50 and sum(good) >= 0.97 * len(good)
    assert len(bad) > 10 and sum(bad) <= 0.15 * len(bad)
    assert not scored.where("score < 0 or score > 1 or score is null").count()


def test_labels_of_held_out_rows_are_not_learned_from(tables):
    docs, labels = tables
    given = fm.training_rows(docs, labels, "quality", 10 ** 6, ("n_chars",))
    assert given.count() == labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).count()
    assert set(given.columns) == {"label", "words", "statistics", "metadata"}
    assert fm.training_rows(docs, labels, "quality", 30, ("n_chars",)).count() == 30


def test_scores_are_sums_over_all_pairs(tables, model):
    machine = model.machine()
    linear, factors = machine.linear.toArray(), machine.factors.toArray()
    rows = model.stages.transform(fm.features(tables[0].limit(12))).select("doc_id", "features").collect()
    scores = {r.doc_id: r.score for r in fm.score(tables[0], model).collect()}
    for r in rows:
        x = list(zip(r.features.indices.tolist(), r.features.values.tolist(), strict=True))
        total = machine.intercept + sum(v * linear[i] for i, v in x)
        total += sum(a * b * float(factors[i] @ factors[j]) for n, (i, a) in enumerate(x) for j, b in x[n + 1:])
        assert scores[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "no id"), (3, " \t\n"), (4, "word " * 200_000), (5, "ünï 😀"), (5, "ünï 😀"), (6, "### $$$")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", 7) for i, t in rows], DOCS)
    found = fm.score(docs, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in rows)
    by_id = {r.doc_id: r.score for r in found}
    assert all(0 <= s <= 1 for s in by_id.values()) and by_id[1] == by_id[2] and by_id[6] < 0.7
    assert not any(r.held_out for r in found if r.doc_id is None)
    assert fm.score(docs.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, "some text", "en", "s", 9, "x", 7) for i in (1, 1, 2, 3)], DOCS)
    for labels, want in (([], 0.5), ([(i, 1) for i in range(9)] + [(1, None), (None, 0)], 1.0)):
        model = fm.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r.score for r in fm.score(docs, model).collect()] == [want] * 4
