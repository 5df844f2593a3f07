"""Vector codes against plain rounds over all pairs, and the trees' own laws."""

import math
import random

import numpy as np
import pytest

from tapewatch.llm import metric_trees as mt

SCHEMA = "vec_id long, embedding array<float>, label int, Label string, code string"


def brute(rows, entries, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width:(p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(v, p), []).append(part(v, p))
            for e, group in groups.items():
                new[p][e] = [sum(x) // len(group) for x in zip(*group, strict=True)]
        books = new
    out = []
    for i, v, label in kept:
        code = [nearest(v, p) for p in range(4)]
        out.append((i, label, "".join(f"{c:02x}" for c in code), sum(far(part(v, p), books[p][code[p]]) for p in range(4))))
    return out, books


def made(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA).repartition(3)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


@pytest.mark.parametrize("entries, block", [(256, 4096), (9, 40), (2, 7)])
def test_codes_equal_plain_rounds(spark, entries, block, monkeypatch):
    monkeypatch.setattr(mt, "LEAF_POINTS", 4)
    draw = random.Random(entries)
    middles = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + draw.gauss(0, 0.1) for x in draw.choice(middles)], draw.choice([1, 2, None])) for i in range(150)]
    # ties, copies, repeated and null ids, vectors that are left out
    rows += [(i, [float(i % 3 - 1)] * 8, 1) for i in range(150, 180)] + [(7, rows[3][1], 2), (None, rows[4][1], None), (None, [0.5] * 8, None)]
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 7, 1), (-3, [math.nan] + [0.0] * 7, 1), (-4, [0.0] * 7 + [-math.inf], 1), (-5, [], 1), (-6, [1.0] * 4, 1)]
    want, books = brute([r for r in rows if r[0] != -6], entries, 4)
    codes, found = mt.compressed(made(spark, rows), entries=entries, block_rows=block)
    assert [b.tolist() for b in found] == books
    assert order(tuple(r) for r in codes.collect()) == order(want)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    told = mt.with_label_error(codes)
    assert order((r.vec_id, r.label_error) for r in told.collect()) == order((i, sums[label]) for i, label, _, _ in want)


def test_frequent_and_rare_labels(spark, monkeypatch):
    monkeypatch.setattr(mt, "HOT_LABEL", 100)
    rows = [(i, None if i % 3 == 0 else i % 11 if i % 3 == 1 else i, i) for i in range(20_000)]
    codes = spark.createDataFrame(rows, "vec_id long, label long, error long")
    sums = {}
    for _, label, error in rows:
        sums[label] = sums.get(label, 0) + error
    found = mt.with_label_error(codes).collect()
    assert len(found) == len(rows) and all(r.label_error == sums[r.label] for r in found)


def test_tables_without_codes(spark):
    for rows in ([], [(1, None, 1), (2, [], 1)]):
        codes, books = mt.compressed(made(spark, rows))
        assert codes.count() == 0 and books == [] and mt.with_label_error(codes).count() == 0
    with pytest.raises(ValueError, match="length 6"):
        mt.compressed(made(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(Exception, match="not coded"):
        mt.compressed(made(spark, [(1, [1e9] * 8, 1)]))


def test_balls_hold_their_points():
    points = np.random.default_rng(3).integers(-50, 50, (900, 4))
    points[::3] = points[0]
    t = mt.flat(mt.tree(points))
    pivots, totals = t["pivot"].reshape(-1, 4), t["total"].reshape(-1, 4)
    assert sorted(t["order"].tolist()) == list(range(900))
    for i in range(len(t["first"])):
        inside = points[t["order"][t["first"][i]:t["last"][i]]]
        assert mt.squares(inside, pivots[i]).max() == t["radius"][i] and (inside.sum(0) == totals[i]).all()
        if t["left"][i] >= 0:
            a, b = t["left"][i], t["right"][i]
            assert {int(t["first"][a]), int(t["first"][b])} >= {int(t["first"][i])} and t["last"][b] == t["last"][i]


def test_owned_balls_take_no_look_at_points(monkeypatch):
    """Well-parted clouds are assigned by their balls' sums."""
    draw = np.random.default_rng(1)
    middles = draw.integers(-20_000, 20_000, (6, 4))
    points = middles[draw.integers(0, 6, 3000)] + draw.integers(-9, 9, (3000, 4))
    looked = []
    plain = mt.nearest
    monkeypatch.setattr(mt, "nearest", lambda book, among, rows: looked.append(len(rows)) or plain(book, among, rows))
    book, t = mt.Codebook.of(middles), mt.flat(mt.tree(points))
    sums, counts = np.zeros((6, 4), np.int64), np.zeros(6, np.int64)
    found = mt.assign(book, points, t, sums, counts)
    assert sum(looked) < 300
    assert (found == plain(book, np.arange(6), points)).all()
    assert (counts == np.bincount(found, minlength=6)).all() and (sums[2] == points[found == 2].sum(0)).all()
