"""The conversation trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tapewatch.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, Role string, key int"


def brute(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(r, t), len(t.encode())))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole) == d))
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(found) - 1) * (node[-1][1] if node else 0)
    first = {node: min(c for c, _ in found) for node, found in members.items()}
    return sorted((
        first[node], len(node), first[node[:-1]] if node else None, len(found), children[node], leaves[node], saved[node],
        hashlib.sha256(",".join(str(c) for c, ends in sorted(found) if ends).encode()).hexdigest()) for node, found in members.items())


def found(spark, rows, size):
    df = pt.nodes(pt.rebuilt(spark.createDataFrame(rows, SCHEMA)), size)
    assert df.columns == pt.COLUMNS
    return sorted(map(tuple, df.collect()))


def talks(seed, n, words):
    draw, rows = random.Random(seed), []
    for c in draw.sample(range(3 * n), n):
        rows += [(c, i, "ab"[i % 2], draw.choice(words), "x", 1) for i in range(draw.choice([1, 2, 3, 5, 12]))]
    return rows


@pytest.mark.parametrize("size", [1, 3, 50, pt.ROWS_PER_PIECE])
def test_trie_equals_all_prefixes(spark, size, monkeypatch):
    monkeypatch.setattr(pt, "IDS_PER_ROW", 2)
    rows = talks(1, 60, ["hi", "who?", "ünï 😀"])
    # copies, a conversation that another one starts with, and very long ones that part late
    rows += [(1000 + 5 * i, t, "a", f"same {t}", None, 0) for i in range(12) for t in range(3)]
    rows += [(2000, t, "a", f"same {t}", None, 0) for t in range(5)]
    rows += [(3000 + 5 * k, t, "a", f"t{t}" if t < 150 else f"{k} {t}", None, 0) for k in range(3) for t in range(200)]
    assert found(spark, rows, size) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "a", "left out", "", 0), (7, None, "a", "first", "", 0), (7, 0, None, None, "", 0), (7, 0, "", "", "", 0), (7, 1, "a", "tie", "", 0),
        (7, 1, "b", "tie", "", 0), (7, 1, "b", "tie", "", 0), (11, 3, "a", "long " * 50_000, "", 0), (-4, 1, "a", "negative", "", 0)]
    rows = [r for r in rows if r[0] is None or r[0] >= 0] + [(40, 0, "a", "x", "", 0)]
    assert found(spark, rows, 2) == brute(rows)
    assert found(spark, [], 2) == [] and found(spark, rows[:1], 2) == []
    only = [(c, 0, "a", "x", "", 0) for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9]  # all without turns
    nodes = found(spark, only, 4)
    assert nodes == brute(only) and [n[:6] for n in nodes] == [(only[0][0], 0, None, len(only), 0, 1)]


def test_range_minima():
    values = np.random.default_rng(2).integers(0, 6, 77)
    table = pt.Minima(values)
    for at in range(77):
        for least in range(7):
            left = min(x for x in range(at + 1) if all(values[x + 1:at + 1] >= least))
            right = max(x for x in range(at, 77) if all(values[at + 1:x + 1] >= least))
            one, d = np.array([at]), np.array([least])
            assert table.left(one, d)[0] == left and table.right(one, d)[0] == right
        assert table.of(np.array([at]), np.array([76]))[0] == values[at:].min()
