"""Near duplicates by SimHash and multi-index hashing.

A fingerprint holds, bit by bit, the majority among the hashes of a text's shingles.  Two
fingerprints within ``distance`` bits agree on one of ``SEGMENTS`` segments up to few bits, so each
fingerprint enumerates the Hamming ball around its value in a segment, fetches the fingerprints
that the table of this segment holds there, and compares them in full.

Equal fingerprints are one entry of the tables.  A segment value that very many different
fingerprints share would give pairs with the square of their number; from ``hot`` entries on, such a
value is left to an exact second way: two fingerprints are within two bits if, and only if, they have
a common neighbour within one bit, and a 64-bit value has just 65 such neighbours.  So
fingerprints meet at their neighbours, where each is linked to the smallest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.llm.columns import pick
from tapewatch.llm.components import components
from tapewatch.session import scratch, ship_package, shuffled, small_side

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 2
SEGMENT_BITS = 32
# Different fingerprints with one value of a segment from which on the second way is taken.
HOT = 64

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PIECE = 255 << 8  # shingles whose bits are unpacked at once


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()  # split() knows the same six separators


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned hashes of all runs of ``words`` words of an UTF-8 text, repeats included.

    A text with fewer words is one run; one without words has none.
    """
    joined = b" ".join(words_of(text))
    if not joined:
        return np.empty(0, dtype="<u8")
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    begin = np.concatenate(([0], gaps + 1))
    end = np.concatenate((gaps, [len(joined)]))
    if len(begin) > words:
        begin, end = begin[: 1 - words or None], end[words - 1:]
    else:
        begin, end = begin[:1], end[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], seed) for i, j in zip(begin.tolist(), end.tolist())], dtype="<u8")  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if over half of the hashes have it set; as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _PIECE):
        bits = np.unpackbits(hashes[i:i + _PIECE].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        # eight counters of one byte each are added at once, for 255 hashes without overflow
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (hash of the text), fp of each row; a null text has fingerprint zero, as an empty one."""
    ship_package(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", F.xxhash64("text").alias("t"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words, seed) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(found, pa.int64())], ["doc_id", "t", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t long, fp long")


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _radii(distance: int) -> list[int]:
    """How far to look in each segment.  If every segment were farther off than its radius, the
    distances would add up to more than ``distance``."""
    least, more = divmod(distance, SEGMENTS)
    radii = [least if s <= more else least - 1 for s in range(SEGMENTS)]
    if max(radii) > 1:
        raise ValueError("balls beyond one bit are not enumerated: at most 3 bits of distance")
    return radii


def _table(prints: DataFrame) -> DataFrame:
    """The tables of all segments: s, key, fp."""
    entries = F.array(*(F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), s).alias("key")) for s in range(SEGMENTS)))
    return prints.select("fp", F.explode(entries).alias("e")).select("e.s", "e.key", "fp")


def _other_than(own: Column) -> Callable[[Column], Column]:
    return lambda e: e["key"] != own


def _probes(prints: DataFrame, distance: int) -> DataFrame:
    """Where each fingerprint looks: s, key, a, and whether key is its own value.

    Of two values that differ in one bit, only the one without the bit looks for the other.
    """
    balls = []
    for s, radius in enumerate(_radii(distance)):
        own = _segment(F.col("fp"), s)
        if radius >= 0:
            balls.append(F.array(F.struct(F.lit(s).alias("s"), own.alias("key"), F.lit(True).alias("own"))))
        if radius == 1:
            flips = (F.struct(F.lit(s).alias("s"), own.bitwiseOR(F.lit(1 << b)).alias("key"), F.lit(False).alias("own"))
                     for b in range(SEGMENT_BITS))
            balls.append(F.filter(F.array(*flips), _other_than(own)))
    return prints.select(F.col("fp").alias("a"), F.explode(F.concat(*balls)).alias("e")).select("e.s", "e.key", "a", "e.own")


def links(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Edges a, b between fingerprints of (fp), each there once, that tie together all within ``distance``.

    Pairs from segment values with fewer than ``hot`` entries all come; from the others come
    as many as keep every two fingerprints within the distance connected.

    Tables and probes have many rows for each fingerprint, which Spark's estimates leave out, so these joins
    broadcast nothing but a counted side.
    """
    if distance > 2:
        raise ValueError("common neighbours within one bit reach two bits")
    table = _table(prints)
    full = table.groupBy("s", "key").agg(F.count("*").alias("n"))
    many = small_side(full.where(F.col("n") >= hot).select("s", "key"))
    probes = _probes(prints, distance)
    few = table.join(shuffled(full.where(F.col("n") < hot).select("s", "key")), ["s", "key"])
    pairs = probes.join(shuffled(few), ["s", "key"]).where(
        (_apart(F.col("a"), F.col("fp")) <= distance) & (~F.col("own") | (F.col("a") < F.col("fp"))))
    crowd = (
        table.join(many, ["s", "key"]).select("fp")
        .union(probes.join(many, ["s", "key"]).select("a")).distinct())
    around = F.concat(F.array("fp"), F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64))))
    meeting = crowd.select("fp", F.explode(around).alias("at"))
    smallest = meeting.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("largest")).where("b != largest").select("at", "b")
    met = meeting.join(shuffled(smallest), "at").where((F.col("fp") != F.col("b")) & (_apart(F.col("fp"), F.col("b")) <= distance))
    return pairs.select("a", F.col("fp").alias("b")).union(met.select(F.col("fp").alias("a"), "b"))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def groups(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED, distance: int = DISTANCE,
           doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, t (hash of the text), fp and component of each row.

    component is the smallest doc_id among all that chains of links reach; null if all those
    are null.  Repeated ids and rows each keep their row.  Texts without words share
    fingerprint zero.  An empty table has no rows.
    """
    spark = docs.sparkSession
    path = scratch(spark, "fingerprints")
    fingerprints(docs, words, seed, doc_id, text).write.parquet(path)
    rows = spark.read.parquet(path)
    path = scratch(spark, "prints")
    rows.groupBy("fp").agg(F.min("doc_id").alias("least")).write.parquet(path)
    prints = spark.read.parquet(path)
    roots = components(links(prints.select("fp"), distance, hot))
    path = scratch(spark, "roots")
    (prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
     .select("fp", "least", F.coalesce("root", "fp").alias("root")).write.parquet(path))
    rooted = spark.read.parquet(path)
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(least, "root").select("fp", "component")
    return rows.join(classes, "fp").select("doc_id", "t", "fp", "component")
