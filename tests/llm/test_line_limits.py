"""What line dedup moves and compares: less than all, and yet the whole result."""

import random

import pytest
from pyspark.sql import functions as F

from tapewatch.llm import line_chunks


def text_of(seed, n):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(n))


def removed(docs):
    return sorted((r.row._0, r.row._1, r.n_removed_lines) for r in line_chunks.remove_repeats(docs).collect())


@pytest.mark.parametrize("collide", [False, True])
def test_line_chunks_with_one_hash_are_compared(spark, monkeypatch, collide):
    passages = ["\n".join(text_of(10 * p + i, 6) for i in range(12)) for p in range(3)]
    rows = [(i, f"{text_of(500 + i, 60)}\n{passages[i % 3]}\n{text_of(600 + i, 55)}") for i in range(9)] + [(9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(docs)
    assert sum(n for _, _, n in want) >= 6 * 4 and not any(n for _, _, n in want[:3])
    if collide:
        monkeypatch.setattr(line_chunks, "_key", lambda chunk: F.length(chunk) % 2)
    assert removed(docs) == want


def test_line_chunks_shuffle_no_documents_that_lose_nothing(spark):
    passage = "\n".join(text_of(i, 6) for i in range(30))
    docs = spark.createDataFrame([(i, text_of(100 + i, 60) + ("\n" + passage if i % 50 == 0 else "")) for i in range(300)], "doc_id long, text string")
    gone = line_chunks._written(spark, line_chunks.repeats(docs), "gone")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"))
    marked = line_chunks.Filter(gone, F.xxhash64("doc_id", "t")).mark(keyed, F.xxhash64("doc_id", "t"))
    assert marked.count() == 300 and 5 <= marked.where("marked").count() < 60
    assert marked.where("marked").join(gone, ["doc_id", "t"]).count() == gone.count() == 5
