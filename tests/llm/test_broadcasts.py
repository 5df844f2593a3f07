"""What is broadcast: sides that were counted, never what Spark's estimates take for small."""

import random

import pytest

from tapewatch.llm import mixing, near_copies, simhash, templates
from tapewatch.session import small_side


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin"), plan


def test_tables_and_probes_of_fingerprints_are_not_broadcast(spark, tmp_path):
    # each fingerprint makes some twenty rows, which Spark's estimates leave out
    draw = random.Random(5)
    prints = [draw.getrandbits(64) - (1 << 63) for _ in range(400)]
    crowd = [prints[0] ^ 1 << i for i in range(40)]
    spark.createDataFrame([(p,) for p in prints + crowd], "fp long").write.parquet(f"{tmp_path}/prints")
    merged, hashed, plan = joins(simhash.links(spark.read.parquet(f"{tmp_path}/prints"), hot=16))
    # the crowd's two joins, there twice, are with the counted segment values
    assert (merged, hashed) == (3, 4), plan
    found = simhash.components(simhash.links(spark.read.parquet(f"{tmp_path}/prints"), hot=16)).collect()
    assert {r.node for r in found} == {prints[0], *crowd} and len({r.root for r in found}) == 1


@pytest.mark.parametrize("limit, kind", [(9, "SortMergeJoin"), (10, "BroadcastHashJoin")])
def test_a_side_that_counts_too_many_rows_is_not_broadcast(spark, limit, kind):
    both = spark.range(100).join(small_side(spark.range(10), limit), "id")
    assert kind in joins(both)[2] and both.count() == 10


def test_first_frequent_shingles_are_the_most_frequent(spark, monkeypatch):
    texts = [f"one two three four five {'six' if i < 6 else 'seven'} {i}" for i in range(10)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    h = [near_copies.shingle_set(t)[0] for t in (b"one two three four five", b"two three four five six", b"two three four five seven")]
    hashes, counts = near_copies.frequent_shingles(docs, "text")
    assert dict(zip(hashes.tolist(), counts.tolist())) == {h[0]: 10, h[1]: 6, h[2]: 4} and (hashes[:-1] < hashes[1:]).all()
    monkeypatch.setattr(near_copies, "MOST_FREQUENT", 2)
    assert set(near_copies.frequent_shingles(docs, "text")[0].tolist()) == {h[0], h[1]}
    assert [len(x) for x in near_copies.frequent_shingles(docs.limit(0), "text")] == [0, 0]


def test_wide_sides_are_broadcast_up_to_fewer_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a text of source {i % 3} number {i}", f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mixed(docs).collect()))
    items = spark.createDataFrame([(1, "a text of source 2 number 8")], "item_id long, text string")
    left = sorted(r.doc_id for r in templates.without_leaks(docs, items).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", 0)
    assert joins(mixing.mixed(docs))[:2] == (1, 0) and sorted(map(tuple, mixing.mixed(docs).collect())) == want
    found = templates.leaks(docs, items)
    assert joins(found)[:2] == (1, 0)
    assert sorted(r.doc_id for r in templates.without_leaks(docs, items).collect()) == left


def test_rows_of_shared_keys_are_not_broadcast(spark, tmp_path):
    # files of rows that repeat keys or signatures are far smaller than the rows
    spark.range(2000).selectExpr("id % 100 as key", "id as t").write.parquet(f"{tmp_path}/members")
    pairs = near_copies._pairs(spark.read.parquet(f"{tmp_path}/members"))
    assert joins(pairs)[:2] == (1, 0) and pairs.count() == 100 * 190
