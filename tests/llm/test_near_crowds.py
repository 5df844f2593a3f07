"""Crowds of texts that nearly are near copies: few pairs become rows, and every group is found."""

import random

import pytest

from tapewatch.llm import near_copies, simhash


def edited(words, n, draw):
    words = list(words)
    for place in draw.sample(range(len(words)), n):
        words[place] = f"edit{draw.randrange(10 ** 9)}"
    return words


def texts_of(n, edits, seed):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10 ** 6)}" for _ in range(150)]
    return [" ".join(edited(base, draw.choice(edits), draw)) for _ in range(n)]


def brute_kept(texts):
    sets = [{tuple(words[i:i + 5]) for i in range(len(words) - 4)} for words in map(str.split, texts)]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            bits = ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count()
            if bits <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return sorted(set(root))


def kept(spark, texts, **more):
    found = near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more)
    return sorted(r.doc_id for r in found.collect())


def test_pairs_of_a_crowd_are_no_rows(spark, monkeypatch):
    texts, rows, written = texts_of(160, [2, 5, 6], 1), {}, near_copies._Checker.written
    draw = random.Random(2)
    texts += [" ".join(edited(t.split(), 1, draw)) for t in texts[:160:8]]

    def counted(self, df, name):
        back = written(self, df, name)
        rows[name] = rows.get(name, 0) + back.count()
        return back

    monkeypatch.setattr(near_copies._Checker, "written", counted)
    assert kept(spark, texts, hot=8) == brute_kept(texts), rows
    assert rows["sized-pairs"] + rows["near-pairs"] < 10 * len(texts), rows  # of some 16,000 pairs


@pytest.mark.parametrize("block", [7, 4096])
def test_blocks_and_passes_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "BEST", (1, 2))
    texts = texts_of(50, [1, 2, 3, 4], 3)
    assert kept(spark, texts, hot=4) == brute_kept(texts)


def test_signatures_of_long_texts_are_folded():
    draw = random.Random(4)
    one = near_copies.shingle_set(" ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(40_000)).encode())
    assert len(near_copies._folded(near_copies.signature(one))) == near_copies.BLOCK_BITS // 8
