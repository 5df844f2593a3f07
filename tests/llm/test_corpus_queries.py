"""Queries over the given tables against DuckDB, and the pipeline against a plain version of its rules."""

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, normal
from tapewatch.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    want = con.sql(queries.ORACLE[name])
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage of the pipeline kept, by name."""
    docs, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch(spark, "stage")
        stage(spark, docs, FOLDER).write.parquet(path)
        kept[name] = docs = spark.read.parquet(path)
    return kept


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_stages(spark, stages):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    good = {r.doc_id for r in queries.QUERIES["op4_quality_rules"](spark, FOLDER).where("kept").collect()}
    assert {r.doc_id for r in stages["quality rules"].collect()} == good
    single = {r.doc_id for r in stages["simhash near-dedup"].collect()}
    sets = {i: _shingles(docs[i]) for i in good}
    similar = {(a, b) for a in good for b in good if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert not any(a in single and b in single for a, b in similar)
    components = {r.doc_id: r.component_id for r in queries.QUERIES["op1_simhash"](spark, FOLDER).collect()}
    for i in good - single:  # what went has a smaller copy
        assert any(b == i for _, b in similar) or any(components[j] == components[i] and j < i for j in good)
    clean = {r.doc_id for r in stages["benchmark decontamination"].collect()}
    leaks = {r.doc_id for r in queries.QUERIES["op7_decontamination"](spark, FOLDER).collect()}
    assert clean == single - leaks
    mixed, sharded = stages["mixing sources"].collect(), stages["sharding"].collect()
    assert {r.doc_id for r in mixed} <= clean
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in sharded)
    sizes = [sorted(r.slot for r in sharded if r.shard == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(stages[name].columns == columns for name, _ in corpus_pipeline.STAGES[:-1])
    assert stages["sharding"].columns == [*columns, "shard", "slot"]


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
