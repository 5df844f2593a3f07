"""The trie of conversation prefixes, from sorted conversations and range minima.

Conversations become keys, one digest per turn.  Sorted, those that start alike lie side by side,
and the prefix of depth d of a row reaches as far to both sides as the common prefixes of neighbours
(LCPs) don't fall below d.  So each candidate prefix finds its left and its right extent by
bisection over a sparse table of range minima, independently of all others, and what the trie has
to tell about it (members, leaves, shared bytes, smallest id) are sums and minima over that interval.

The sorted rows lie in pieces of bounded size.  A prefix that reaches over the border of a piece
goes on with a second sparse table, over the least LCP of each whole piece; such nodes
are put together from what each piece has of them.  At most LCP + 1 nodes cross a border, so these are
few.  All others are found within their piece.

Rows without conv_id are left out.  A null turn comes first; turns of equal number are ordered by
the digest of role and text, and repeated rows are repeated turns.  Null roles and texts are empty.  An empty
table has no nodes.  A conversation's turns (24 bytes each, not their texts) are held as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tapewatch.llm.columns import pick
from tapewatch.session import scratch, ship_package

# What one task holds of the sorted conversations.
ROWS_PER_PIECE, BYTES_PER_PIECE = 1 << 18, 64 << 20
LEAST_ROWS = 512       # smaller pieces are not worth a task
IDS_PER_ROW = 1024     # ids hashed together where a node's ids lie in several pieces
CROSSING_BROADCAST = 1_000_000  # nodes over borders up to which all pieces get all of them
ROWS_PER_BATCH = 1 << 16
DIGEST = 16            # bytes of a turn in a key
NO_IDS = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
COLUMNS = [c.split()[0] for c in NODE.split(", ")]
PIECE = "piece long, n long, inside long, first_key binary, last_key binary, conv array<long>, size array<long>, length array<long>, lcp array<long>"
PART = ("a long, d long, piece long, from_left boolean, to_right boolean, n_rows long, shared long, leaves long, "
        "conv long, n_equal long, n_ends long, head long, parent_a long, ids array<string>")


class Minima:
    """A sparse table: least values of all runs whose length is a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.size, self.runs = len(values), [values]
        step = 1
        while 2 * step <= self.size:
            self.runs.append(np.minimum(self.runs[-1][:-step], self.runs[-1][step:]))
            step *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first..last], for each pair."""
        level = np.floor(np.log2(last - first + 1)).astype(np.int64)
        out = np.empty(len(first), dtype=self.runs[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.runs[k][first[at]], self.runs[k][last[at] - (1 << k) + 1])
        return out

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest l for which values[l + 1..at] are all ``least`` or more."""
        at = at.copy()
        for k in reversed(range(len(self.runs))):
            can = at >= 1 << k
            first = np.where(can, at - (1 << k) + 1, 0)
            at -= (can & (self.runs[k][first] >= least)).astype(np.int64) << k
        return at

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest r for which values[at + 1..r] are all ``least`` or more."""
        at = at.copy()
        for k in reversed(range(len(self.runs))):
            can = at + (1 << k) < self.size
            first = np.where(can, at + 1, 0)
            at += (can & (self.runs[k][first] >= least)).astype(np.int64) << k
        return at


# ---------------------------------------------------------------- sorted conversations
def rebuilt(conversations: DataFrame, stride: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, key (the digests of its turns), size (bytes of each text) of every rebuilt conversation.

    Conversation c starts with the first h turns of conversation c - c % stride, h = crc32(c) % heads, and goes
    on with its own turns after its first h.
    """
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    role, text, c = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text", "conv_id"))
    c = F.col("conv_id")
    turns = rows.where(c.isNotNull()).select(
        c.cast("long").alias("conv_id"), (c - c % stride).cast("long").alias("base"), "turn",
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST).alias("digest"),
        F.octet_length(text).cast("long").alias("size"))
    # what belongs to a base lies in one partition, so the join with the heads needs no further shuffle
    own = turns.repartition("base").groupBy("base", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("own"))
    head = own.where("conv_id = base").select("base", F.slice("own", 1, heads - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    whole = own.join(head, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h.cast("int")),
        F.slice("own", h.cast("int") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("turns"))
    return whole.select(
        "conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("key"), F.col("turns.size").alias("size"))


def shared(a: bytes, b: bytes) -> int:
    """How many turns two keys start with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // DIGEST


def _one_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sorted rows as one row, with the LCP of each row and the one before; -1 for the first."""
    first = last = None
    conv, sizes, lengths, lcp = [], [], [], []
    for batch in batches:
        conv.append(batch.column("conv_id").to_numpy())
        column = batch.column("size")
        sizes.append(column.flatten().to_numpy(zero_copy_only=False))
        for key in batch.column("key").to_pylist():
            lcp.append(-1 if last is None else shared(last, key))
            lengths.append(len(key) // DIGEST)
            first, last = key if first is None else first, key
    if last is None:
        return
    inside = min(lcp[1:], default=np.iinfo(np.int64).max)
    whole = [np.concatenate(conv), np.concatenate(sizes), np.array(lengths, np.int64), np.array(lcp, np.int64)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([len(lcp)], pa.int64()), pa.array([int(inside)], pa.int64()),
         pa.array([first], pa.binary()), pa.array([last], pa.binary())]
        + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in whole],
        [c.split()[0] for c in PIECE.split(", ")])


def sorted_pieces(conversations: DataFrame, rows_per_piece: int, bytes_per_piece: int) -> DataFrame:
    spark = conversations.sparkSession
    path = scratch(spark, "trie-conversations")
    conversations.write.parquet(path)
    rows = spark.read.parquet(path)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).head()
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS))
    pieces = max(1, tasks, -(-n // rows_per_piece), -(-size // bytes_per_piece))
    out = scratch(spark, "trie-pieces")
    rows.repartitionByRange(pieces, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_one_piece, PIECE).write.parquet(out)
    return spark.read.parquet(out)


# ---------------------------------------------------------------- borders of pieces
@dataclass(frozen=True)
class Borders:
    """Per piece, in order: the LCP of its first row with the piece before, and the least LCP within.

    One small row per piece: as many as tasks, whatever the number of conversations.
    """

    pieces: np.ndarray
    start: np.ndarray
    inside: np.ndarray

    def around(self, piece: int) -> tuple[int, int, int]:
        """Place of a piece, LCP at its start and at its end (-1 where nothing follows)."""
        at = int(np.searchsorted(self.pieces, piece))
        return at, int(self.start[at]), int(self.start[at + 1]) if at + 1 < len(self.start) else -1

    def crossings(self) -> int:
        """At least as many as there are nodes at all borders."""
        return int((self.start + 1).sum())


def borders(pieces: DataFrame) -> Borders:
    @F.pandas_udf("long")
    def lcp(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if y is None else shared(x, y) for x, y in zip(a, b, strict=True)])

    in_order = Window.orderBy("piece")  # one row per piece
    rows = pieces.select("piece", "inside", "last_key", F.lead("first_key").over(in_order).alias("next_key")).select(
        "piece", "inside", lcp("last_key", "next_key").alias("end")).orderBy("piece").collect()
    ends = [r.end for r in rows]
    return Borders(*(np.array(x, dtype=np.int64) for x in ([r.piece for r in rows], [-1, *ends][:len(rows)], [r.inside for r in rows])))


class Piece:
    """The arrays of a piece and what both kinds of nodes need of them."""

    def __init__(self, row: dict, start: int, end: int) -> None:
        self.conv, size, self.length, self.lcp = (row[c] for c in ("conv", "size", "length", "lcp"))
        self.start, self.end, self.n = start, end, len(self.conv)
        self.lcp = np.concatenate(([start], self.lcp[1:]))
        self.after = np.concatenate((self.lcp[1:], [end]))  # LCP with the next row
        # bytes of the first k texts of row i are so_far[offset[i] + k]
        self.offset = np.concatenate(([0], np.cumsum(self.length + 1)))[:-1]
        total = np.concatenate(([0], np.cumsum(size)))
        before = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        place = np.arange(len(size) + self.n) - np.repeat(np.arange(self.n), self.length + 1)
        self.so_far = total[place] - np.repeat(total[before], self.length + 1)
        self.shared = np.concatenate(([0], np.cumsum(self.so_far[self.offset + np.maximum(self.lcp, 0)])))
        self.leaves = np.concatenate(([0], np.cumsum(self.after < self.length)))
        self.minima, self.least_conv = Minima(self.lcp), Minima(self.conv)

    def bytes_before(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of the texts above depth ``depth`` of the rows."""
        return self.so_far[self.offset[row] + np.maximum(depth - 1, 0)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, list | None]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("conv", "size", "length", "lcp")}
            known = batch.column("known")[i].as_py() if "known" in batch.schema.names else None
            yield batch.column("piece")[i].as_py(), row, known


def _counter(values: np.ndarray):
    """A function that counts, for each (value, first, last), the values equal to it in first..last."""
    n = len(values)
    keys = np.sort(values * n + np.arange(n))

    def count(value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.searchsorted(keys, value * n + last, "right") - np.searchsorted(keys, value * n + first, "left")

    return count


def _parts(piece: Piece, at: int, number: int, whole: Minima) -> pa.RecordBatch:
    """What this piece has of each node that reaches over one of its borders."""
    d = np.arange(max(piece.start, piece.end) + 1, dtype=np.int64)
    last = np.full(len(d), piece.n - 1)
    right = piece.minima.right(np.zeros(len(d), np.int64), d)
    left = piece.minima.left(last, d)
    from_left, to_right = d <= piece.start, d <= piece.end
    middle = from_left & to_right & (right == last)
    begins = to_right & ~middle
    place = np.full(len(d), at - 1)
    leftmost = whole.left(np.maximum(place, 0), d)  # of nodes that come from the left
    kinds = [(from_left, np.zeros(len(d), np.int64), np.where(middle, last, right), middle), (begins, left, last, begins)]
    count_lcp, count_length = _counter(np.maximum(piece.lcp, 0)), _counter(piece.length)
    columns: dict[str, list] = {c.split()[0]: [] for c in PART.split(", ")}
    for k, (wanted, first, to, ends_right) in enumerate(kinds):
        i = np.flatnonzero(wanted)
        x, y, depth = first[i], to[i], d[i]
        entry = x + k  # a node that begins here has no LCP with the row before it
        n_ends = count_length(depth, x, y)
        n_equal = np.where(entry <= y, count_lcp(depth, entry, y), 0)
        up = np.maximum(depth - 1, 0)
        goes_left = (piece.minima.left(y, up) == 0) & (piece.start >= up)
        above = np.where(goes_left, whole.left(np.full(len(i), max(at - 1, 0)), up), at)
        columns["a"].append(np.full(len(i), at) if k else leftmost[i])
        columns["d"].append(depth)
        columns["piece"].append(np.full(len(i), number))
        columns["from_left"].append(np.full(len(i), not k))
        columns["to_right"].append(ends_right[i])
        columns["n_rows"].append(y - x + 1)
        columns["shared"].append(piece.shared[y + 1] - piece.shared[entry])
        columns["leaves"].append(piece.leaves[y + 1] - piece.leaves[x])
        columns["conv"].append(piece.least_conv.of(x, y))
        columns["n_equal"].append(n_equal)
        columns["n_ends"].append(n_ends)
        columns["head"].append(piece.bytes_before(x, depth) if k else np.zeros(len(i), np.int64))
        columns["parent_a"].append(above if k else np.full(len(i), -1))
        columns["ids"].append([
            [",".join(map(str, piece.conv[p:min(p + IDS_PER_ROW, f + e)].tolist())) for p in range(f, f + e, IDS_PER_ROW)]
            for f, e in zip(x.tolist(), n_ends.tolist(), strict=True)])
    types = {"from_left": pa.bool_(), "to_right": pa.bool_()}
    arrays = [
        pa.array(sum(v, []), pa.list_(pa.string())) if c == "ids" else pa.array(np.concatenate(v), types.get(c, pa.int64()))
        for c, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def crossing_parts(pieces: DataFrame, edges: Borders) -> DataFrame:
    spark = pieces.sparkSession
    shipped = spark.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shipped.value
        whole = Minima(np.minimum(edges.inside, edges.start))
        for number, row, _ in _rows(batches):
            at, start, end = edges.around(number)
            if max(start, end) >= 0:
                yield _parts(Piece(row, start, end), at, number, whole)

    path = scratch(spark, "trie-parts")
    pieces.select("piece", "conv", "size", "length", "lcp").mapInArrow(run, PART).write.parquet(path)
    return spark.read.parquet(path)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, whose rows come one after another and in order."""
    node, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], ["a", "d", "ends"])

    for batch in batches:
        for a, d, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "d", "ids")), strict=True):
            if (a, d) != node:
                if node is not None:
                    yield done()
                node, digest = (a, d), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield done()


def crossing_nodes(parts: DataFrame) -> DataFrame:
    """The nodes over borders, each with the key (a, d): its first piece and its depth."""
    spark = parts.sparkSession
    nodes = parts.groupBy("a", "d").agg(
        F.min("conv").alias("conv_id"), F.sum("n_rows").alias("n_convs"), F.sum("shared").alias("shared"),
        F.sum("leaves").alias("n_leaves"), F.sum("n_equal").alias("n_equal"), F.sum("n_ends").alias("n_ends"),
        F.max("head").alias("head"), F.max("parent_a").alias("parent_a"))
    path = scratch(spark, "trie-crossing")
    nodes.write.parquet(path)
    nodes = spark.read.parquet(path)
    ids = parts.where("n_ends > 0").select("a", "d", "piece", F.posexplode("ids").alias("place", "ids"))
    # a node's ids are hashed one after another by one task, which holds a batch of them only
    ends = ids.repartition("a", "d").sortWithinPartitions("a", "d", "piece", "place").select("a", "d", "ids").mapInArrow(
        _hashed, "a long, d long, ends string")
    parents = nodes.select(F.col("a").alias("parent_a"), (F.col("d") + 1).alias("d"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, ["parent_a", "d"], "left").join(ends, ["a", "d"], "left").select(
        "a", "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs",
        (1 + F.col("n_equal") - F.col("n_ends")).alias("n_children"), "n_leaves",
        (F.col("shared") - (F.col("n_convs") - 1) * F.col("head")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))


# ---------------------------------------------------------------- nodes within a piece
def _local(piece: Piece, known: dict[tuple[bool, int], int]) -> Iterator[pa.RecordBatch]:
    """Nodes whose members all lie in the piece; ``known`` has the smallest ids of those that cross its borders."""
    rows = np.arange(piece.n)
    # candidates: each row's own end, and each LCP of neighbours
    alone = rows[piece.length > np.maximum(piece.lcp, piece.after)]
    at, v = rows[1:], piece.lcp[1:]
    l, r = piece.minima.left(at, v), piece.minima.right(at, v)  # noqa: E741
    inside = ~(((l == 0) & (piece.start >= v)) | ((r == piece.n - 1) & (piece.end >= v)))
    wide = int(piece.length.max()) + 1
    codes, first, n_equal = np.unique((l * wide + v)[inside], return_index=True, return_counts=True)
    l, r, v = l[inside][first], r[inside][first], v[inside][first]  # noqa: E741
    ended, counts = np.unique(piece.minima.left(rows, piece.length) * wide + piece.length, return_counts=True)
    place = np.minimum(np.searchsorted(ended, codes), len(ended) - 1)
    n_ends = np.where(ended[place] == codes, counts[place], 0)

    l, r, v = np.concatenate((l, alone)), np.concatenate((r, alone)), np.concatenate((v, piece.length[alone]))  # noqa: E741
    n_equal = np.concatenate((n_equal, np.zeros(len(alone), np.int64)))
    n_ends = np.concatenate((n_ends, np.ones(len(alone), np.int64)))
    above = np.maximum(piece.lcp[l], piece.after[r])  # depth of the last node with more members
    conv = piece.least_conv.of(l, r) if len(l) else l
    up_l, up_r = piece.minima.left(l, above), piece.minima.right(r, above)
    from_left, to_right = (up_l == 0) & (piece.start >= above), (up_r == piece.n - 1) & (piece.end >= above)
    parent = piece.least_conv.of(up_l, up_r) if len(l) else l
    for i in np.flatnonzero((from_left | to_right) & (above >= 0)).tolist():
        parent[i] = known[bool(from_left[i]), int(above[i])]
    ends = [NO_IDS] * len(l)
    for i in np.flatnonzero(n_ends).tolist():
        ends[i] = hashlib.sha256(",".join(map(str, piece.conv[l[i]:l[i] + n_ends[i]].tolist())).encode()).hexdigest()

    deep = v - above
    done = 0
    for cut in _cuts(deep):
        s = slice(done, cut)
        done = cut
        node = np.repeat(np.arange(s.start, s.stop), deep[s])
        step = np.arange(len(node)) - np.repeat(np.cumsum(deep[s]) - deep[s], deep[s])
        depth = above[node] + 1 + step
        top, bottom = step == 0, depth == v[node]
        x, y = l[node], r[node]
        yield pa.RecordBatch.from_arrays([
            pa.array(conv[node], pa.int64()), pa.array(depth, pa.int64()),
            pa.array(np.where(top, parent[node], conv[node]), pa.int64(), mask=depth == 0),
            pa.array(y - x + 1, pa.int64()),
            pa.array(np.where(bottom, 1 + n_equal[node] - n_ends[node], 1), pa.int64()),
            pa.array(piece.leaves[y + 1] - piece.leaves[x], pa.int64()),
            pa.array(piece.shared[y + 1] - piece.shared[x + 1] - (y - x) * piece.bytes_before(x, depth), pa.int64()),
            pa.array([ends[i] if b else NO_IDS for i, b in zip(node.tolist(), bottom.tolist(), strict=True)], pa.string())], COLUMNS)


def _cuts(deep: np.ndarray) -> Iterator[int]:
    """Ends of runs of chains with about ROWS_PER_BATCH nodes together."""
    total, so_far = np.cumsum(deep), 0
    at = 0
    while at < len(deep):
        at = max(at + 1, int(np.searchsorted(total, so_far + ROWS_PER_BATCH, "right")))
        so_far = total[at - 1]
        yield at


def nodes(rows: DataFrame, rows_per_piece: int = ROWS_PER_PIECE, bytes_per_piece: int = BYTES_PER_PIECE) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, key, size): COLUMNS."""
    spark = rows.sparkSession
    ship_package(spark)
    pieces = sorted_pieces(rows, rows_per_piece, bytes_per_piece)
    edges = borders(pieces)
    parts = crossing_parts(pieces, edges)
    path = scratch(spark, "trie-over-borders")
    crossing_nodes(parts).write.parquet(path)
    crossing = spark.read.parquet(path)
    smallest = crossing.select("a", F.col("depth").alias("d"), F.col("conv_id").alias("least"))
    known = parts.join(smallest, ["a", "d"]).groupBy("piece").agg(
        F.collect_list(F.struct("from_left", "to_right", "d", "least")).alias("known"))
    if edges.crossings() <= CROSSING_BROADCAST:
        known = F.broadcast(known)
    shipped = spark.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, row, listed in _rows(batches):
            _, start, end = shipped.value.around(number)
            by_side = {}
            for one in listed or []:
                for side, there in ((True, one["from_left"]), (False, one["to_right"])):
                    if there:
                        by_side[side, one["d"]] = one["least"]
            yield from _local(Piece(row, start, end), by_side)

    local = pieces.select("piece", "conv", "size", "length", "lcp").join(known, "piece", "left").mapInArrow(run, NODE)
    return local.unionByName(crossing.select(*COLUMNS))


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations: one row per distinct sequence of first turns."""
    return nodes(rebuilt(conversations))
