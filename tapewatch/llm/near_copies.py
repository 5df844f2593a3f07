"""Near copies beyond a few bits: fingerprints find the closest, five-word shingles all others, exactly.

Two texts with a similarity of 0.8 in five-word shingles may differ in a dozen bits of a 64-bit
fingerprint, too many for small Hamming balls.  So candidates come from the shingles themselves.  All
shingles have one order, and of n shingles a text has the first n // 5 + 1 as its keys (a prefix): of
two texts that share 0.8 of their shingles, both have the first one they share among their
keys, so they meet, whatever the edit was, appended and cut parts included.  Any order does; shingles that are frequent in a sample come
last, so boilerplate is rarely a key.  Pairs that meet and are not too different in size are compared by signatures first, the
parities of how many shingles fall on each of some bits: two texts have at least as many shingles that they don't share as there are bits
in which their signatures differ.  So that passes over no similar pair, and only those left are compared by all their shingles.

Where many texts meet (a crowd), their pairs are no rows of a table.  First all are compared with one of them, the one that is in most
crowds, as the original of many copies is.  Texts that are tied together by then, if by chains, are not compared with each other.
The others' signatures are compared with those of all in the crowd, block by block within tasks, and the ``best`` pairs of each text
are compared by all their shingles; so again, with more of them, until no pair that may be similar is left out.  So no link that joins two
groups is passed over.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapewatch.llm import simhash
from tapewatch.llm.columns import Carried, pick, same
from tapewatch.llm.components import components
from tapewatch.llm.storage import Tables
from tapewatch.session import ship_package, shuffled, small_side

WORDS = 5
SIMILARITY = 0.8
# Distinct texts in which frequent shingles are counted, from how many of them on a shingle is frequent, and how many of these are kept.
SAMPLE_TEXTS, FREQUENT, MOST_FREQUENT = 5_000, 3, 1 << 18
# Texts that meet from which on they are a crowd.
HOT = 16
# Texts on either side of a block of a crowd, the bits of their signatures, and those of them that are unpacked at once.
BLOCK, BLOCK_BITS, STRIPE = 4_096, 1 << 14, 256
# Pairs of a text within a block that go on, with its crowd's largest group and with others: in the first passes; in the last one all.
BEST = (4, 64)


def shingle_set(text: bytes) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order."""
    return np.unique(simhash.shingle_hashes(text, WORDS))


def signature(shingles: np.ndarray) -> bytes:
    """Bits, a power of two and as many as shingles at least, each telling whether an odd number of shingles falls on it."""
    width = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(x: int, y: int, one: bytes, other: bytes) -> bool:
    """Whether texts of x and y shingles with these signatures may be similar; True for all that are."""
    a, b = np.frombuffer(one, dtype="<u8"), np.frombuffer(other, dtype="<u8")
    while len(a) != len(b):  # the longer one is folded: what falls on both halves' bits falls on one
        if len(a) > len(b):
            a = a[:len(a) // 2] ^ a[len(a) // 2:]
        else:
            b = b[:len(b) // 2] ^ b[len(b) // 2:]
    most_common = (x + y - int(np.bitwise_count(a ^ b).sum())) // 2
    return most_common >= SIMILARITY * (x + y - most_common) - 1e-9


def frequent_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of shingles that several texts of a sample share.

    They only decide which shingles are keys; whether texts meet that are similar does not depend on them.
    """
    ship_package(docs.sparkSession)
    rows = pick(docs, text=text).where("text is not null")
    share = max(1, -(-rows.count() // SAMPLE_TEXTS))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select(F.encode("text", "UTF-8").alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py()).view("<i8"))], ["h"])

    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    # as Arrow, the first ones are picked in a task; a collect would merge those of every task in the driver
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    hashes, n = found["h"].to_numpy().view("<u8"), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The keys of a text: its first shingles by (count if frequent, hash), as many as similar texts must share one of."""
    hashes, counts = frequent
    n = len(shingles)
    order = np.zeros(n, dtype=np.int64)
    if n and len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        order = np.where(hashes[at] == shingles, counts[at], 0)
    # of n, ceil(SIMILARITY * n) shingles at least are shared
    return shingles[np.lexsort((shingles, order))][:n - math.ceil(SIMILARITY * n - 1e-9) + 1]


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, t (hash of the text), fp, n (shingles), sig (signature), keys of each row; a null text is empty."""
    ship_package(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text))
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shipped.value
        for batch in batches:
            prints, sizes, sigs, keys = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                shingles = shingle_set(text)
                prints.append(simhash.fingerprint(text))
                sizes.append(len(shingles))
                sigs.append(signature(shingles))
                keys.append(prefix(shingles, frequent).view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "t", "fp", "n", "sig", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t long, fp long, n int, sig binary, keys array<long>")


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


class _Checker:
    """Compares pairs of texts by the shingles of the documents' table."""

    def __init__(self, docs: DataFrame, texts: DataFrame, tables: Tables, doc_id: str, text: str) -> None:
        self._docs, self._texts, self._tables, self._doc_id, self._text = docs, texts, tables, doc_id, text
        self._spark = docs.sparkSession
        # of equal texts the row with the smallest id is read; only if ids repeat, too, several rows may be
        self._repeats = not texts.where("n_first > 1").isEmpty()

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return self._tables.written(df, name)

    def removed(self, *frames: DataFrame) -> None:
        self._tables.remove(*frames)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """t, shingles (hashes, each once) of the wanted texts."""
        ship_package(self._spark)
        rows = pick(self._docs, doc_id=self._doc_id, text=self._text).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
        firsts = self._texts.select("t", F.col("first").alias("doc_id")).join(wanted, "t", "left_semi")
        found = same(rows, small_side(firsts), ["t", "doc_id"], "left_semi")
        if self._repeats:
            found = found.dropDuplicates(["t"])
        found = found.select("t", F.encode("text", "UTF-8").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_set(x.as_py()).view("<i8") for x in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(sets, pa.list_(pa.int64()))], ["t", "shingles"])

        return self.written(found.mapInArrow(run, "t long, shingles array<long>"), "shingles")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs a < b that are similar."""
        sizes, signs = self._texts.select("t", "n"), self._texts.select("t", "sig")
        alike = F.least("x", "y") >= SIMILARITY * F.greatest("x", "y") - 1e-9
        sized = self.written(
            pairs.join(sizes.toDF("a", "x"), "a").join(sizes.toDF("b", "y"), "b").where(alike).select("a", "b", "x", "y"), "sized-pairs")
        signed = sized.join(signs.toDF("a", "u"), "a").join(signs.toDF("b", "v"), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("x", "y", "u", "v"))
                passed = [may_be_similar(*row) for row in zip(*columns, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

        near = self.written(signed.select("a", "b", "x", "y", "u", "v").mapInArrow(run, "a long, b long"), "near-pairs")
        self.removed(sized)
        return self.exactly(near)

    def exactly(self, near: DataFrame) -> DataFrame:
        """Those of the written pairs a < b that are similar, by all their shingles.  ``near`` is removed."""
        # the shingles of the texts of those pairs alone go on
        sets = self.sets(near.select(F.col("a").alias("t")).union(near.select(F.col("b").alias("t"))).distinct())
        joined = near.join(sets.withColumnsRenamed({"t": "a", "shingles": "x"}), "a").join(
            sets.withColumnsRenamed({"t": "b", "shingles": "y"}), "b")
        common = F.size(F.array_intersect("x", "y"))
        good = joined.where((common > 0) & (common >= SIMILARITY * (F.size("x") + F.size("y") - common)))
        found = self.written(good.select("a", "b"), "similar")
        self.removed(near, sets)
        return found

    def signed(self, members: DataFrame) -> DataFrame:
        """The rows (key, t) with the texts' n, sig (folded to ``BLOCK_BITS`` at most) and how many of the rows they have (shared)."""
        fold = F.udf(lambda sig: _folded(sig), "binary")
        own = members.groupBy("t").agg(F.count("*").alias("shared")).join(self._texts.select("t", "n", "sig"), "t")
        short = F.when(F.length("sig") <= BLOCK_BITS // 8, F.col("sig")).otherwise(fold("sig"))
        return members.join(own.select("t", "n", short.alias("sig"), "shared"), "t")


def _folded(sig: bytes) -> bytes:
    bits = np.frombuffer(sig, dtype="<u8")
    while len(bits) > BLOCK_BITS // 64:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits.tobytes()


def block_pairs(probes: dict[str, np.ndarray], others: dict[str, np.ndarray], best: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places among ``probes`` and ``others`` (t, root, n, main, sig: rows of words of one width) of pairs in different groups that may
    be similar, ``best`` of each probe at most with the main group and with others; whether more are left out."""
    (p, width), q = probes["sig"].shape, others["sig"].shape[0]
    rows, places, left = [], [], False
    for begin in range(0, p, STRIPE):
        some = {k: v[begin:begin + STRIPE] for k, v in probes.items()}
        apart = np.zeros((len(some["t"]), q), dtype=np.int32)
        for i in range(width):
            apart += np.bitwise_count(some["sig"][:, i, None] ^ others["sig"][None, :, i])
        sizes = some["n"][:, None].astype(np.int32) + others["n"][None, :]
        common = (sizes - apart) // 2
        passed = (common >= SIMILARITY * (sizes - common) - 1e-9) & (some["root"][:, None] != others["root"][None, :])
        passed &= np.minimum(some["n"][:, None], others["n"][None, :]) >= SIMILARITY * np.maximum(some["n"][:, None], others["n"][None, :]) - 1e-9
        row, place = np.nonzero(passed)
        if best is not None and len(row):
            order = np.lexsort((-(common[row, place] / np.maximum(1, sizes[row, place])), others["main"][place], row))
            row, place = row[order], place[order]
            part = 2 * row + others["main"][place]
            begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            rank = np.arange(len(part)) - np.repeat(begins, np.diff(np.append(begins, len(part))))
            left |= bool((rank >= best).any())
            row, place = row[rank < best], place[rank < best]
        rows.append(row + begin)
        places.append(place)
    return _joined(rows), _joined(places), left


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=np.int64), *parts])


def _compare_block(best: int | None, table: pa.Table) -> pa.Table:
    """a < b of the pairs of one block that may be similar, and in each row whether more are left out."""
    column = {k: table.column(k).to_numpy() for k in ("t", "root", "n", "main", "probe", "other")}
    sigs = table.column("sig").to_pylist()
    widths = np.array([len(sig) // 8 for sig in sigs], dtype=np.int64)

    def chosen(at: np.ndarray, width: int) -> dict[str, np.ndarray]:
        bits = np.frombuffer(b"".join(sigs[i] for i in at.tolist()), dtype="<u8").reshape(len(at), -1)
        if bits.shape[1] > width:
            bits = bits[:, :width] ^ bits[:, width:]
        return {k: column[k][at] for k in ("t", "root", "n", "main")} | {"sig": bits}

    ones, twos, left = [], [], False
    for x in np.unique(widths[column["probe"]]).tolist():
        for y in (x // 2, x, 2 * x):  # sizes farther apart are of no similar texts
            probes, others = np.flatnonzero(column["probe"] & (widths == x)), np.flatnonzero(column["other"] & (widths == y))
            if y and len(others):
                i, j, more = block_pairs(chosen(probes, min(x, y)), chosen(others, min(x, y)), best)
                ones.append(column["t"][probes[i]])
                twos.append(column["t"][others[j]])
                left |= more
    one, two = _joined(ones), _joined(twos)
    return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two), "left": np.full(len(one), left)})


def _crowds(members: DataFrame, checker: _Checker, known: DataFrame) -> DataFrame:
    """Similar pairs from the rows (key, t) of frequent keys, as many as tie together all that are similar;
    ``known`` are similar pairs found before."""
    opened, found = checker.written(checker.signed(members), "crowd"), [known]
    for best in (0, *BEST, None):
        # texts tied together already need no comparing with each other
        roots = components(functools.reduce(DataFrame.union, found)).withColumnRenamed("node", "t")
        members = opened
        rooted = checker.written(members.select("key", "t", "n", "sig", "shared").join(roots, "t", "left").withColumn("root", F.coalesce("root", "t")), "rooted")
        shares = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.max(F.struct("shared", "t")).alias("first"))
        crowds = shares.groupBy("key").agg(
            F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("main"), F.max(F.struct("first", "root")).alias("leader"))
        opened = checker.written(
            rooted.join(shuffled(crowds.where("main.n < size").withColumn("n_main", F.col("main.n")).withColumn("main", F.col("main.root"))), "key"), "open-crowds")
        checker.removed(rooted, members)
        if opened.isEmpty():
            break
        if best == 0:
            tied = opened.where("root != leader.root").select(F.col("leader.first.t").alias("a"), F.col("t").alias("b"))
            found.append(checker.similar(_ordered(tied)))
        else:
            pairs = checker.written(_block_pairs(opened, best), "block-pairs")
            left = not pairs.where("left").isEmpty()
            found.append(checker.exactly(checker.written(pairs.select("a", "b").distinct(), "near-pairs")))
            checker.removed(pairs)
            if not left:
                break
    checker.removed(opened)
    return functools.reduce(DataFrame.union, found)


def _block_pairs(opened: DataFrame, best: int | None) -> DataFrame:
    """a, b, left from the blocks of crowds, each of some that aren't of the main group (probe) and some of all (other)."""
    outside = F.col("root") != F.col("main")
    n_probes, n_others = (F.ceil(n / F.lit(BLOCK)) for n in (F.col("size") - F.col("n_main"), F.col("size")))
    at = opened.withColumns({
        "i0": F.pmod(F.xxhash64("t"), n_probes).cast("int"), "j0": F.pmod(F.xxhash64("t", F.lit(1)), n_others).cast("int"),
        "n_probes": n_probes.cast("int"), "n_others": n_others.cast("int"), "outside": outside})
    as_other = F.transform(F.sequence(F.lit(0), F.col("n_probes") - 1), lambda i: F.struct(i.alias("i"), F.col("j0").alias("j")))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("n_others") - 1), lambda j: F.struct(F.col("i0").alias("i"), j.alias("j")))
    cells = F.when(F.col("outside"), F.array_union(as_other, as_probe)).otherwise(as_other)
    rows = at.withColumn("cell", F.explode(cells)).select(
        "key", "cell", "t", "root", "n", "sig", (~F.col("outside")).alias("main"),
        (F.col("outside") & (F.col("cell.i") == F.col("i0"))).alias("probe"), (F.col("cell.j") == F.col("j0")).alias("other"))

    def run(table: pa.Table) -> pa.Table:
        return _compare_block(best, table)

    return rows.groupBy("key", "cell").applyInArrow(run, "a long, b long, left boolean")


def _pairs(members: DataFrame) -> DataFrame:
    """All pairs of texts that meet under a key, each once."""
    left = members.select("key", F.col("t").alias("a"))
    right = members.select(F.col("key").alias("k"), F.col("t").alias("b"))
    return left.join(shuffled(right), (F.col("key") == F.col("k")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def similar_texts(docs: DataFrame, texts: DataFrame, held: DataFrame, tables: Tables, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Pairs a < b of similar texts among (t, n, sig, first, n_first) with the keys ``held`` (t, key), each there once; of texts that very many
    others are like, enough pairs to tie them all together.  ``held`` is removed once it is used."""
    checker = _Checker(docs, texts, tables, doc_id, text)
    # most keys are of one text alone
    shared = checker.written(held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    meets = checker.written(held.join(small_side(shared), "key"), "meets")
    checker.removed(shared, held)
    pairs = checker.written(_pairs(meets.where(F.col("n") < hot)), "candidates")
    crowd = meets.where(F.col("n") >= hot).select("key", "t")
    found = checker.similar(pairs)
    checker.removed(pairs)
    if not crowd.isEmpty():
        found = _crowds(crowd, checker, found)
    return found


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row of each group of near copies, with all columns: the one with the smallest id (null ids last).

    Texts are of one group if a chain of links leads from one to the other, each between texts that are equal, have
    fingerprints within two bits, or have a similarity of 0.8 in five-word shingles.  Of rows equal
    in id and text, any one stays.  Null texts are empty ones, which are one group.
    """
    tables = Tables(docs.sparkSession)
    sketched = tables.written(sketches(docs, doc_id, text), "sketches")
    rows = tables.written(sketched.select("doc_id", "t"), "rows")
    firsts = rows.groupBy("t", "doc_id").agg(F.count("*").alias("n_first")).groupBy("t").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n_first")).alias("f"))
    # of equal texts, which have equal sketches, one goes on
    one = sketched.groupBy("t").agg(F.any_value("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    texts = tables.written(one.join(firsts, "t").select("t", "fp", "n", "sig", F.col("f.doc_id").alias("first"), "f.n_first"), "texts")
    keyed = same(sketched, texts.select("t", F.col("first").alias("doc_id")), ["t", "doc_id"], "left_semi").select("t", F.explode("keys").alias("key"))
    held = tables.written(keyed if texts.where("n_first > 1").isEmpty() else keyed.distinct(), "held")
    tables.remove(sketched)
    prints = tables.written(texts.groupBy("fp").agg(F.min("t").alias("t")), "prints")
    one_print = texts.select("t", "fp").join(prints.withColumnRenamed("t", "b"), "fp").where("t != b").select(F.col("t").alias("a"), "b")
    by_print = (
        simhash.links(prints.select("fp"))
        .join(prints.withColumnsRenamed({"fp": "a", "t": "x"}), "a").join(prints.withColumnsRenamed({"fp": "b", "t": "y"}), "b")
        .select(F.col("x").alias("a"), F.col("y").alias("b")))
    edges = tables.written(one_print.union(by_print).union(similar_texts(docs, texts, held, tables, doc_id, text, hot)), "edges")
    roots = components(edges).withColumnRenamed("node", "t")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    grouped = tables.written(
        rows.groupBy("doc_id", "t").agg(F.count("*").alias("n"))
        .join(roots, "t", "left").select("doc_id", "t", "n", F.coalesce("root", "t").alias("root")), "groups")
    first = grouped.groupBy("root").agg(F.min(place).alias("first"))
    judged = tables.written(
        grouped.join(first, "root").select("doc_id", "t", "n", (place != F.col("first")).alias("goes")).where("goes or n > 1"), "losers")
    tables.remove_all_but(judged)
    table = Carried(docs)
    marked = table.df.withColumns({"doc_id": table[doc_id], "t": F.xxhash64(F.coalesce(table[text], F.lit("")))})
    # the sides are small if few documents have copies; if not, these are ordinary joins
    clean = same(marked, small_side(judged.select("doc_id", "t")), ["doc_id", "t"], "left_anti")
    twice = same(marked, small_side(judged.where("not goes").select("doc_id", "t")), ["doc_id", "t"], "left_semi")
    return table.back(clean.union(twice.dropDuplicates(["doc_id", "t"])))
