"""Codes of vectors by parts, fitted and assigned with metric trees from anchors.

A vector is cut into PARTS parts and each part is named by the nearest of a codebook's entries.  The
codebooks are improved in rounds: all parts go to their nearest entry, which then becomes their mean.
Everything is in whole numbers, so the result depends neither on the order of sums nor on how rows are dealt.

Rows lie in blocks, and every block has a metric tree over the parts of each position, built once.  The
tree is made middle-out: about sqrt(n) anchors are chosen, each the point farthest from the anchor that
owns it, and take over the points that are nearer to them (the triangle inequality tells which need no look);
anchors are merged upwards, the pair with the smallest ball first, and split downwards by the same
means.  Each ball has its pivot, radius, sum and count.  In a round a ball inherits the entries that
may be nearest for its points from the ball above, and drops those that another entry beats all over
the ball.  A ball with one entry left is wholly owned: its sum and count go to the entry at once.  What
one round needs from all blocks is a sum and a count per entry.

Rows whose vector is null, empty or holds null or non-finite components are left out, as are those that are
not as long as most rows' vectors (ties: the longer).  That length must be a multiple of PARTS, and components
lie within +-LARGEST, so that distances are exact; other tables raise an error.  Rows with null ids are coded, and seed a
codebook only when there are no others left; rows of equal id are ordered by their vectors.  With fewer rows
than ENTRIES the codebooks have as many entries as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapewatch.llm.columns import pick, same
from tapewatch.session import scratch, ship_package

# Fixed values of the contract.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

LARGEST = 1 << 16      # components beyond would make squared distances inexact
BLOCK_ROWS = 4096      # vectors under one tree
LEAF_POINTS = 64       # balls up to this size are not split
HOT_LABEL = 100_000    # labels with as many rows are joined by broadcast: there are at most rows / HOT_LABEL


def whole_numbers(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and v, the components as floor(SCALE * x); rows without a proper vector are left out."""
    rows = pick(embeddings, vec_id=vec_id, label=label, v=embedding).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    scaled = F.transform("v", lambda x: F.when(F.abs(x) <= LARGEST, F.floor(x * SCALE)).otherwise(
        F.raise_error(F.lit(f"components beyond {LARGEST} are not coded"))).cast("int"))
    return rows.where((F.size("v") > 0) & finite).withColumn("v", scaled)


# ---------------------------------------------------------------- trees
def squares(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Squared distances of all points from one."""
    gap = points - one
    return np.einsum("ij,ij->i", gap, gap)


def anchors(points: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Groups of points around anchors, each with the farthest point first."""
    far = squares(points, points[0])
    order = np.argsort(-far, kind="stable")
    pivots, owned, away = [points[0]], [order], [far[order]]
    radius = np.array([far[order[0]]])
    while len(pivots) < wanted and radius.max() > 0:
        new = points[owned[int(radius.argmax())][0]]
        between = squares(np.array(pivots), new)
        taken, their = [], []
        for a in np.flatnonzero(4 * radius >= between).tolist():  # others are nearer to their anchor throughout
            look = int(np.searchsorted(-away[a], -(between[a] / 4), "right"))
            d = squares(points[owned[a][:look]], new)
            go = d < away[a][:look]
            if go.any():
                taken.append(owned[a][:look][go])
                their.append(d[go])
                stay = np.concatenate((~go, np.ones(len(owned[a]) - look, bool)))
                owned[a], away[a] = owned[a][stay], away[a][stay]
                radius[a] = away[a][0] if len(away[a]) else 0
        taken, their = np.concatenate(taken), np.concatenate(their)
        order = np.argsort(-their, kind="stable")
        pivots.append(new)
        owned.append(taken[order])
        away.append(their[order])
        radius = np.append(radius, their[order[0]])
    return [g for g in owned if len(g)]


@dataclass
class Ball:
    rows: np.ndarray
    total: np.ndarray
    pivot: np.ndarray
    radius: int  # squared
    children: tuple["Ball", ...] = ()


def _ball(points: np.ndarray, rows: np.ndarray, children: tuple[Ball, ...] = ()) -> Ball:
    total = children[0].total + children[1].total if children else points[rows].sum(0)
    pivot = total // len(rows)
    return Ball(rows, total, pivot, int(squares(points[rows], pivot).max()), children)


def _merged(points: np.ndarray, balls: list[Ball]) -> Ball:
    """One ball over all, by merging the pair that makes the smallest ball."""
    balls = list(balls)
    centre = np.array([b.pivot for b in balls], dtype=float)
    reach = np.sqrt([b.radius for b in balls])

    def sizes(i: int) -> np.ndarray:
        found = (np.sqrt(squares(centre, centre[i])) + reach + reach[i]) / 2
        found = np.maximum(found, np.maximum(reach, reach[i]))
        found[gone] = np.inf
        found[i] = np.inf
        return found

    gone = np.zeros(len(balls), bool)
    cost = np.array([sizes(i) for i in range(len(balls))])
    for _ in range(len(balls) - 1):
        i, j = sorted(divmod(int(cost.argmin()), len(balls)))
        balls[i] = _ball(points, np.concatenate((balls[i].rows, balls[j].rows)), (balls[i], balls[j]))
        centre[i], reach[i] = balls[i].pivot, np.sqrt(balls[i].radius)
        gone[j] = True
        cost[j], cost[:, j] = np.inf, np.inf
        cost[i] = cost[:, i] = sizes(i)
    return balls[int(np.flatnonzero(~gone)[0])]


def tree(points: np.ndarray, rows: np.ndarray | None = None) -> Ball:
    """The ball over all points (or those ``rows``) and the balls within it."""
    rows = np.arange(len(points)) if rows is None else rows
    groups = anchors(points[rows], int(np.ceil(np.sqrt(len(rows))))) if len(rows) > LEAF_POINTS else []
    if len(groups) < 2:
        return _ball(points, rows)
    return _merged(points, [tree(points, rows[g]) for g in groups])


FIELDS = ("first", "last", "left", "right", "radius")


def flat(root: Ball) -> dict[str, np.ndarray]:
    """A tree as arrays: balls from the top, their points as ranges of ``order``."""
    nodes: list[list[int]] = []
    totals, pivots, order = [], [], []

    def add(ball: Ball) -> int:
        me, begin = len(nodes), len(order)
        nodes.append([begin, 0, -1, -1, ball.radius])
        totals.append(ball.total)
        pivots.append(ball.pivot)
        if ball.children:
            nodes[me][2:4] = [add(c) for c in ball.children]
        else:
            order.extend(ball.rows.tolist())
        nodes[me][1] = len(order)
        return me

    add(root)
    columns = dict(zip(FIELDS, np.array(nodes, dtype=np.int64).T, strict=True))
    return columns | {"order": np.array(order), "total": np.array(totals).ravel(), "pivot": np.array(pivots).ravel()}


# ---------------------------------------------------------------- assignment
@dataclass(frozen=True)
class Codebook:
    entries: np.ndarray  # k x width, whole numbers
    apart: np.ndarray    # distances between entries

    @staticmethod
    def of(entries: np.ndarray) -> "Codebook":
        return Codebook(entries, np.sqrt(np.array([squares(entries, e) for e in entries], dtype=float)))


def contenders(book: Codebook, among: np.ndarray, pivot: np.ndarray, radius: int) -> np.ndarray:
    """Those of ``among`` (ascending) that may be nearest to a point of the ball.

    How much farther entry j is than entry b, in squares, changes by at most twice their distance per unit of way.  The
    comparison errs to the side of keeping an entry; of equal entries the first stays.
    """
    far = squares(book.entries[among], pivot)
    best = int(far.argmin())
    if radius == 0:
        return among[best:best + 1]
    apart = book.apart[among[best]][among]
    beaten = (far - far[best] > 2 * np.sqrt(radius) * apart * (1 + 1e-9) + 1e-3) | ((apart == 0) & (among > among[best]))
    return among[~beaten]


def nearest(book: Codebook, among: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of ``among`` for each point; the lowest of equally near ones."""
    entries = book.entries[among]
    size = max(int(np.abs(points).max()), int(np.abs(entries).max()))
    kind = float if 4 * size * size * points.shape[1] < 1 << 53 else np.int64  # doubles are exact up to there
    # the point's own square is the same for all entries
    far = np.einsum("ij,ij->i", entries, entries).astype(kind) - 2 * (points.astype(kind) @ entries.astype(kind).T)
    return among[far.argmin(1)]


def assign(book: Codebook, points: np.ndarray, t: dict[str, np.ndarray], sums: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """The entry of each point; adds to ``sums`` and ``counts`` per entry if given."""
    width, order = points.shape[1], t["order"]
    pivot, total = t["pivot"].reshape(-1, width), t["total"].reshape(-1, width)
    out = np.empty(len(points), dtype=np.int64)
    waiting = [(0, np.arange(len(book.entries)))]
    while waiting:
        ball, among = waiting.pop()
        among = contenders(book, among, pivot[ball], int(t["radius"][ball]))
        rows = order[t["first"][ball]:t["last"][ball]]
        if len(among) == 1:
            out[rows] = among[0]
            if sums is not None:
                sums[among[0]] += total[ball]
                counts[among[0]] += len(rows)
        elif t["left"][ball] < 0:
            found = nearest(book, among, points[rows])
            out[rows] = found
            if sums is not None:
                np.add.at(sums, found, points[rows])
                np.add.at(counts, found, 1)
        else:
            waiting += [(int(t["left"][ball]), among), (int(t["right"][ball]), among)]
    return out


# ---------------------------------------------------------------- over all blocks
TREE = (*FIELDS, "order", "total", "pivot")


def _listed(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of vectors: ids, labels, components and the trees of all positions, written out."""
    spark = rows.sparkSession
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = ", ".join([f"vec_id array<{kinds['vec_id']}>", f"label array<{kinds['label']}>", "v array<int>", "balls array<long>"]
                       + [f"{c} array<long>" for c in TREE])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat_v = batch.column("v").flatten()
        v = flat_v.to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
        trees = [flat(tree(part)) for part in np.split(v, PARTS, axis=1)]
        arrays = [_listed(batch.column("vec_id")), _listed(batch.column("label")), _listed(flat_v),
                  _listed(pa.array([len(t["first"]) for t in trees], pa.int64()))]
        arrays += [_listed(pa.array(np.concatenate([t[c] for t in trees]), pa.int64())) for c in TREE]
        return pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "v", "balls", *TREE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in batches:
            left.append(batch)
            together = pa.Table.from_batches(left)
            while together.num_rows >= block_rows:
                yield block(together.slice(0, block_rows).combine_chunks().to_batches()[0])
                together = together.slice(block_rows)
            left = together.to_batches()
        if any(b.num_rows for b in left):
            yield block(pa.Table.from_batches(left).combine_chunks().to_batches()[0])

    path = scratch(spark, "vector-blocks")
    rows.select("vec_id", "label", "v").mapInArrow(run, schema).write.parquet(path)
    return spark.read.parquet(path)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray], list[dict[str, np.ndarray]]]]:
    """Of each block: its batch and place there, the parts and the tree of each position."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("v", "balls", *TREE)}
            n = len(row["order"]) // PARTS
            v = row["v"].astype(np.int64).reshape(n, -1)
            at = np.concatenate(([0], np.cumsum(row["balls"])))
            width = v.shape[1] // PARTS
            trees = []
            for p in range(PARTS):
                s = slice(at[p], at[p + 1])
                wide = slice(at[p] * width, at[p + 1] * width)
                trees.append({c: row[c][s] for c in FIELDS} | {
                    "order": row["order"][p * n:(p + 1) * n], "total": row["total"][wide], "pivot": row["pivot"][wide]})
            yield batch, i, np.split(v, PARTS, axis=1), trees


def _improved(rows: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The codebooks after one round over all blocks."""
    spark = rows.sparkSession
    shipped, width = spark.sparkContext.broadcast(books), books[0].entries.shape[1]
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shipped.value
        sums = [np.zeros(b.entries.shape, np.int64) for b in books]
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        for _, _, parts, trees in _parts(batches):
            for p in range(PARTS):
                assign(books[p], parts[p], trees[p], sums[p], counts[p])
        for p in range(PARTS):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[p][used], pa.int64())]
                + [pa.array(sums[p][used, i], pa.int64()) for i in range(width)], ["part", "entry", "n", *names])

    wanted = rows.select("v", "balls", *TREE).mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
    together = wanted.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names])
    entries = [b.entries.copy() for b in books]
    for r in together.collect():  # PARTS * ENTRIES rows at most
        entries[r.part][r.entry] = [int(r[c]) // r.n for c in names]
    return [Codebook.of(e) for e in entries]


def seeds(rows: DataFrame, entries: int = ENTRIES) -> list[Codebook]:
    """The parts of the rows with the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    return [Codebook.of(e) for e in np.split(np.array([r.v for r in first], dtype=np.int64), PARTS, axis=1)]


def coded(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error (squared distance) of the blocks' rows."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(books)
    kinds = {c: rows.schema[c].dataType.elementType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shipped.value
        for batch, i, parts, trees in _parts(batches):
            found = [assign(books[p], parts[p], trees[p]) for p in range(PARTS)]
            gaps = [parts[p] - books[p].entries[found[p]] for p in range(PARTS)]
            error = sum(np.einsum("ij,ij->i", g, g) for g in gaps)
            codes = [row.tobytes().hex() for row in np.stack(found, axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(codes, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds label_error, the sum of ``error`` over the rows of equal label, nulls together."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    path = scratch(rows.sparkSession, "label-errors")
    sums.write.parquet(path)
    sums = rows.sparkSession.read.parquet(path)
    # few labels can be frequent, and those that aren't make no hot key
    hot, cold = (sums.where(c).drop("n") for c in (F.col("n") >= HOT_LABEL, F.col("n") < HOT_LABEL))
    if sums.count() <= 10_000:
        return same(rows, F.broadcast(sums.drop("n")), ["label"])
    frequent = F.broadcast(hot.withColumn("frequent", F.lit(True)))
    both = same(rows, frequent, ["label"], "left")
    rest = same(both.where("frequent is null").drop("label_error", "frequent"), cold, ["label"])
    return both.where("frequent").drop("frequent").unionByName(rest)


def compressed(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """The coded rows (vec_id, label, code, error) and the codebooks."""
    spark = embeddings.sparkSession
    ship_package(spark)
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: at most 256 entries")
    rows = whole_numbers(embeddings)
    length = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).head()
    if length is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    if length.length % PARTS:
        raise ValueError(f"vectors of length {length.length} cannot be cut into {PARTS} equal parts")
    rows = rows.where(F.size("v") == length.length)
    books = seeds(rows, entries)
    lying = blocks(rows, block_rows)
    for _ in range(rounds):
        books = _improved(lying, books)
    path = scratch(spark, "vector-codes")
    coded(lying, books).write.parquet(path)
    return spark.read.parquet(path), [b.entries for b in books]


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in codebooks for x in b.ravel().tolist()).encode()).hexdigest()
