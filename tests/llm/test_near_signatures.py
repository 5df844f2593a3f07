"""Which shingles the near-dedup stage fetches: less than all, and yet every group is found."""

import random

import numpy as np

from tapewatch.llm import near_copies


def text_of(seed, n):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(n))


def test_signatures_pass_over_no_similar_pair():
    draw = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 300, 3000):
        one = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
        for share in (0.0, 0.05, 0.1, 0.2, 0.5, 1.0):
            more = np.unique(draw.integers(0, 1 << 64, round(n * share), dtype=np.uint64))
            for other in (np.union1d(one, more), np.union1d(one[len(more):], more)):
                common = len(np.intersect1d(one, other))
                passed = near_copies.may_be_similar(len(one), len(other), near_copies.signature(one), near_copies.signature(other))
                assert passed or common < 0.8 * (len(one) + len(other) - common)
                if n >= 60 and share == 1.0 and common < 0.3 * n:
                    assert not passed


def test_shingles_of_texts_that_only_meet_are_not_fetched(spark, monkeypatch):
    # both texts of a pair have words of their own between passages that they share, so that they meet and aren't similar
    texts = [" ".join(text_of(10 * g + p, 12) + " " + text_of(1000 + 100 * g + 10 * i + p, 8) for p in range(10)) for g in range(20) for i in range(2)]
    texts.append(texts[0] + " and this is new")
    asked, sets = [], near_copies._Checker.sets
    monkeypatch.setattr(near_copies._Checker, "sets", lambda self, wanted: asked.append(wanted.count()) or sets(self, wanted))
    kept = near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    assert 2 <= max(asked) <= 10
