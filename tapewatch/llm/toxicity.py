"""Toxicity by compression distance between two zstandard dictionaries.

A window is one word between spaces, written ``REPEATS`` times so that the format's fixed costs leave
room for differences.  One dictionary is trained on windows of ordinary documents, one on the
windows that mark toxic documents: words that are in far more toxic than ordinary ones, or that begin like many such
words, so that a stem with ever new endings is learned although no single word of it is frequent.  Each window is
compressed with both.  Its bytes, and its lengths under the two, put it in a cell; how much more often a cell occurs in
toxic documents is the calibrated weight of its windows.  A logistic curve over the two largest weights of a
document, the sum of all, and the number of its windows (of which chance finds more in long texts) is its score.
Cells and curve are calibrated on training documents from which neither dictionary was made: so words that a dictionary has
never seen weigh what their lengths have proved worth.

Training takes ``SAMPLE_ROWS`` labelled documents at most, chosen by a hash of their ids; counting runs in tasks,
and the driver gets the windows that make up the dictionaries, whose size is bounded, and the cells only.  All else covers all
documents and whole texts.  Null ids, repeated rows and clashing columns are scored like any other row; a null or empty
text has no windows and gets the curve's value for none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.llm.columns import pick
from tapewatch.session import scratch, ship_package

SAMPLE_ROWS = 20_000
REPEATS = 4
LEVEL = 19
ORDINARY_WINDOWS = 20_000
MARKING_WINDOWS = 4_096
DICTIONARY_BYTES = 1 << 16
LONGEST = 24  # longer windows share the cells of this length
# A marking window is in so many toxic documents, at least, and so many times as frequent there.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_RATIO, LEAST_SEEN = 3, 0.002, 20.0, 0.5
STEMS = (4, 5, 6)  # letters of a word's beginning that are counted besides the word
HELD_BACK = 4      # every so manyth training document calibrates and makes no dictionary
REMEMBERED = 400_000
MARKS = ".,;:!?|"
FEATURES = ("first", "second", "total", "size")

_SCORERS: dict[int, Scorer] = {}


def tokens(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def window(token: str) -> bytes:
    return b" " + token.strip(MARKS).encode() + b" "


def stems(token: str) -> list[bytes]:
    """The beginnings of a word; unlike windows, they don't end with a space."""
    word = token.strip(MARKS)
    return [b" " + word[:n].encode() for n in STEMS if len(word) > n]


def train(windows: list[bytes], size: int) -> bytes:
    """A zstandard dictionary from windows, put together to samples that the trainer can cut segments from."""
    draw = np.random.default_rng(3)
    samples = [b"".join(windows[i] for i in draw.permutation(len(windows))[:100]) for _ in range(400)]
    return zstandard.train_dictionary(max(size, 512), samples, k=64, d=6, level=LEVEL).as_bytes()


@dataclass(frozen=True)
class Model:
    """All that scoring needs; a few dozen kilobytes."""

    ordinary: bytes
    toxic: bytes
    weights: dict[tuple[int, int, int], float]
    curve: tuple[float, ...]
    floor: float


class Scorer:
    """The model within a worker, with the weights of windows it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._ordinary, self._toxic = self._compressor(model.ordinary), self._compressor(model.toxic)
        self._weights: dict[str, float] = {}
        # lengths under the toxic dictionary at which no window of this size has a weight
        best: dict[tuple[int, int], float] = {}
        for (n, _, toxic), weight in model.weights.items():
            best[n, toxic] = max(best.get((n, toxic), model.floor), weight)
        self._best = best

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        trained = zstandard.ZstdCompressionDict(dictionary)
        trained.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=trained, compression_params=settings)

    def cell(self, token: str) -> tuple[int, int, int]:
        """Bytes of the window, and its compressed lengths."""
        one = window(token)
        text = one * REPEATS
        return min(len(one), LONGEST), len(self._ordinary.compress(text)), len(self._toxic.compress(text))

    def _weight(self, token: str) -> float:
        one = window(token)
        text, n = one * REPEATS, min(len(one), LONGEST)
        toxic = len(self._toxic.compress(text))
        if self._best.get((n, toxic), self.model.floor) <= self.model.floor:
            return self.model.floor
        return self.model.weights.get((n, len(self._ordinary.compress(text)), toxic), self.model.floor)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """The two largest weights of a text, the logarithms of their sum and of its number of windows; a text without
        words has the floor."""
        if len(self._weights) > REMEMBERED:
            self._weights = {}
        known, floor, total = self._weights, self.model.floor, 0.0
        first = second = floor
        distinct = tokens(text)
        for token in distinct:
            weight = known.get(token)
            if weight is None:
                weight = known[token] = self._weight(token)
            if weight > floor:
                total += weight - floor
                if weight > first:
                    first, second = weight, first
                elif weight > second:
                    second = weight
        return first, second, math.log1p(total), math.log1p(len(distinct))


def _scorer(key: int, model: Model) -> Scorer:
    """The scorer of this worker; it outlives the task."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32(doc_id as text) mod 5 is 0; null ids count to them."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(0)) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text",
                  label: str = "toxic") -> DataFrame:
    """toxic, text and calibrates of up to ``rows`` labelled documents that are not held out.

    An id that is labelled twice is toxic if any label says so; null ids and labels don't count.
    """
    chosen = (
        pick(labels, doc_id=doc_id, toxic=label).where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    path = scratch(docs.sparkSession, "toxicity-sample")
    # ``rows`` ids at most, so the broadcast is bounded
    pick(docs, doc_id=doc_id, text=text).join(F.broadcast(chosen), "doc_id").select(
        "toxic", "text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_BACK)) == 0).alias("calibrates")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _windows(rows: DataFrame) -> DataFrame:
    """window (bytes, or a stem), toxic and ordinary: how many documents of each kind have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, list[int]] = {}
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for one in {w for t in tokens(text) for w in (window(t), *stems(t))}:
                    counts.setdefault(one, [0, 0])[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], ["window", "toxic", "ordinary"])

    return rows.mapInArrow(run, "window binary, toxic long, ordinary long").groupBy("window").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).where(F.octet_length("window") > 2)


def _marked(rows: DataFrame, marking: list[bytes]) -> DataFrame:
    """window, n: the windows of toxic documents that are marking or begin with a marking stem."""
    known = frozenset(marking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, int] = {}
            for text in batch.column("text").to_pylist():
                for t in tokens(text):
                    if window(t) in known or any(x in known for x in stems(t)):
                        counts[window(t)] = counts.get(window(t), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["window", "n"])

    return rows.where("toxic = 1").select("text").mapInArrow(run, "window binary, n long").groupBy("window").agg(F.sum("n").alias("n"))


def _cells(rows: DataFrame, model: Model) -> DataFrame:
    """n, o, t and how many documents of each kind have windows of the cell, window by window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        known: dict[str, tuple[int, int, int]] = {}
        for batch in batches:
            counts: dict[tuple[int, int, int], list[int]] = {}
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for token in {t.strip(MARKS) for t in tokens(text)}:
                    if token not in known:
                        known[token] = scorer.cell(token)
                    counts.setdefault(known[token], [0, 0])[0 if toxic else 1] += 1
            columns = [pa.array([c[i] for c in counts], pa.int32()) for i in range(3)]
            columns += [pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, ["n", "o", "t", "toxic", "ordinary"])

    return rows.mapInArrow(run, "n int, o int, t int, toxic long, ordinary long").groupBy("n", "o", "t").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """first, second, total, size (to a quarter) and how many documents of each kind have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([round(4 * f[i]) / 4 for f in found], pa.float64()) for i in range(4)]
                + [batch.column("toxic").cast(pa.int32())], [*FEATURES, "toxic"])

    return rows.mapInArrow(run, ", ".join(f"{c} double" for c in FEATURES) + ", toxic int").groupBy(*FEATURES).agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary"))


def _curve(points: list) -> tuple[float, ...]:
    """Logistic regression on the features by Newton's steps, with a slight pull to zero."""
    x = np.array([[1.0, *(p[c] for c in FEATURES)] for p in points])
    yes, no = (np.array([float(p[k]) for p in points]) for k in ("toxic", "ordinary"))
    beta = np.zeros(1 + len(FEATURES))
    for _ in range(50):
        guess = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (yes - (yes + no) * guess) - 0.01 * beta
        bend = (x * ((yes + no) * guess * (1 - guess))[:, None]).T @ x + 0.01 * np.eye(1 + len(FEATURES))
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | float:
    """A model from labelled documents; if they have one class or no marking windows, the share of toxic ones."""
    ship_package(docs.sparkSession)
    sample = training_rows(docs, labels, rows)
    n_toxic, n_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).head()
    n_ordinary = n_all - n_toxic
    if not n_toxic or not n_ordinary:
        return n_toxic / n_all if n_all else 0.0
    made, held = sample.where("not calibrates"), sample.where("calibrates")
    kinds = {r.toxic: r["count"] for r in held.groupBy("toxic").count().collect()}
    if len(kinds) < 2 or not {0, 1} <= {r.toxic for r in made.select("toxic").distinct().collect()}:
        made = held = sample  # too few documents to hold any back
    path = scratch(docs.sparkSession, "toxicity-windows")
    _windows(made).write.parquet(path)
    counted = docs.sparkSession.read.parquet(path)
    of_kind = {r.toxic: r["count"] for r in made.groupBy("toxic").count().collect()}
    marking = [bytes(r.window) for r in counted.where(
        (F.col("toxic") >= max(LEAST_DOCUMENTS, LEAST_SHARE * of_kind[1]))
        & (F.col("toxic") * of_kind[0] >= LEAST_RATIO * of_kind[1] * (F.col("ordinary") + LEAST_SEEN))
    ).orderBy(F.col("toxic").desc(), "window").limit(MARKING_WINDOWS).collect()]
    whole = F.substring("window", -1, 1) == F.lit(b" ")
    ordinary = [bytes(r.window) for r in counted.where(F.col("ordinary") > 0).where(whole).orderBy(
        F.col("ordinary").desc(), "window").limit(ORDINARY_WINDOWS).collect()]
    if not marking:
        return n_toxic / n_all
    marked = [bytes(r.window) for r in _marked(made, marking).orderBy(F.col("n").desc(), "window").limit(MARKING_WINDOWS).collect()]
    model = Model(train(ordinary, DICTIONARY_BYTES), train(marked, min(DICTIONARY_BYTES, 2 * sum(map(len, marked)) + 2048)), {}, (0.0,) * 5, 0.0)
    kinds = {r.toxic: r["count"] for r in held.groupBy("toxic").count().collect()}
    weights = {
        (c.n, c.o, c.t): math.log((c.toxic + 0.3) / kinds[1] / ((c.ordinary + 1.0) / kinds[0]))
        for c in _cells(held, model).collect()}
    floor = 0.0  # what speaks for ordinary text is left out: almost every window does, a little
    weighted = Model(model.ordinary, model.toxic, {c: w for c, w in weights.items() if w > floor}, (0.0,) * 5, floor)
    points = _features(held, weighted).collect()
    return Model(weighted.ordinary, weighted.toxic, weighted.weights, _curve(points), floor)


def score(docs: DataFrame, model: Model | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score of each row; a null text scores as an empty one."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if isinstance(model, float):
        return rows.select("doc_id", "held_out", F.lit(model).alias("score"))
    shipped, key = spark.sparkContext.broadcast(model), hash((model.toxic, model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, shipped.value)
        base, *slopes = shipped.value.curve
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                found = base + sum(b * x for b, x in zip(slopes, scorer.features(text.as_py()), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, found)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
