"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector of three groups: its distinct words in lower case, hashed into 2 ** WORD_BITS places
and averaged, so that no text weighs more for its length; statistics of its structure, each as a bucket with those below it (words,
characters a word, marks and capitals, repeated words and lines); and its metadata in buckets (``n_chars``).  The machine
has a weight per place and a vector of FACTORS numbers per place; two places interact by the product of
their vectors.  The sum over all pairs is half of (sum of v x) squared less the sum of (v x) squared,
so a document is scored in time linear in its places; pyspark.ml's FMClassifier does both fit and scoring that way.

Training takes ``SAMPLE_ROWS`` labelled documents at most, those with the smallest hashes of their ids; of rows with equal ids
the one with the smallest text.  All else covers all documents and whole texts.  A null text scores as an empty one,
which has statistics and metadata only.  Null metadata is a bucket of its own.  Without labels of both classes, the score is
the share of good ones among the labels, or a half without any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.llm.columns import pick, words
from tapewatch.session import scratch

SAMPLE_ROWS = 20_000
WORD_BITS, STATISTIC_BITS, METADATA_BITS = 11, 9, 6
FACTORS, ROUNDS, STEP, PENALTY, SPREAD = 6, 50, 0.05, 1e-3, 0.01
PARTS = 8  # of the training sample
MARKS = "#*$%&|<>!?={}[]()_~^+"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _share(part: Column, whole: Column, steps: int = 20) -> Column:
    """part / whole in steps, the last one open."""
    return F.least(F.floor(steps * part / F.greatest(whole, F.lit(1))), F.lit(2 * steps))


def _size(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(0)) + 1))


def statistics(text: Column, w: Column, lower: Column, distinct: Column) -> dict[str, Column]:
    """Buckets of a text's structure; ``w`` its words, ``lower`` those in lower case, ``distinct`` the distinct ones of these."""
    n = F.size(w)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    letters = F.length(F.array_join(w, ""))
    capitals = F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1)))
    unlettered = F.size(F.filter(w, lambda x: F.upper(x) == F.lower(x)))
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    return {
        "words": _size(n), "few": F.least(n, F.lit(20)), "length": F.least(F.floor(letters / F.greatest(n, F.lit(1))), F.lit(40)),
        "marks": _share(marks, n), "digits": _share(digits, n), "capitals": _share(capitals, n), "unlettered": _share(unlettered, n),
        "distinct": _share(F.size(distinct), n), "repeated": _share(n - F.size(distinct), n, 8),
        "lines": _size(F.size(lines)), "line repeats": _share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines))}


def _reached(name: str, bucket: Column) -> Column:
    """A bucket and all below it, so that what is learned of one holds for the next ones, too."""
    return F.transform(F.sequence(F.lit(0).cast("long"), bucket.cast("long")), lambda i: F.concat(F.lit(f"{name}:"), i.cast("string")))


def features(docs: DataFrame, metadata: tuple[str, ...] = ("n_chars",), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, and the words and buckets of each row as arrays of strings."""
    rows = pick(docs, doc_id=doc_id, text=text, **{f"m{i}": c for i, c in enumerate(metadata)})
    told = [F.concat(F.lit(f"{c}:"), F.coalesce(_size(F.col(f"m{i}").cast("double")).cast("string"), F.lit("none"))) for i, c in enumerate(metadata)]
    split = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("w", words(F.col("text")))
    split = split.withColumn("lower", words(F.lower("text"))).withColumn("words", F.array_distinct("lower"))
    found = statistics(F.col("text"), F.col("w"), F.col("lower"), F.col("words"))
    buckets = [_reached(name, bucket) for name, bucket in found.items()]
    return split.select("doc_id", "words", F.concat(*buckets).alias("statistics"), F.array(*told).cast("array<string>").alias("metadata"))


def _vectors() -> list:
    """Stages from arrays of strings to one sparse vector."""
    stages = []
    for name, bits in (("words", WORD_BITS), ("statistics", STATISTIC_BITS), ("metadata", METADATA_BITS)):
        stages.append(HashingTF(inputCol=name, outputCol=f"{name}_tf", numFeatures=1 << bits, binary=True))
        stages.append(Normalizer(inputCol=f"{name}_tf", outputCol=f"{name}_x", p=1.0 if name == "words" else 2.0))
    return [*stages, VectorAssembler(inputCols=["words_x", "statistics_x", "metadata_x"], outputCol="features")]


@dataclass(frozen=True)
class Model:
    """The fitted stages, or the constant score of labels without both classes."""

    stages: PipelineModel | None
    constant: float = 0.5
    metadata: tuple[str, ...] = ("n_chars",)

    def machine(self) -> FMClassificationModel:
        return self.stages.stages[-1]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, metadata: tuple[str, ...]) -> DataFrame:
    """Words, buckets and label of the labelled rows to learn from, written out."""
    spark = docs.sparkSession
    known = pick(labels, doc_id="doc_id", label=label).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("label").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = chosen.withColumnRenamed("doc_id", "labelled")
    given = pick(docs, doc_id="doc_id", text="text", **{f"m{i}": c for i, c in enumerate(metadata)})
    one = given.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).groupBy("doc_id", "label").agg(
        F.min(F.struct("text", *[f"m{i}" for i in range(len(metadata))])).alias("row"))
    one = one.select("doc_id", "label", "row.*").toDF("doc_id", "label", "text", *metadata)
    path = scratch(spark, "quality-rows")
    one.join(features(one, metadata), "doc_id").select("label", "words", "statistics", "metadata").repartition(PARTS, F.xxhash64("words")).write.parquet(path)
    return spark.read.parquet(path)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, metadata: tuple[str, ...] = ("n_chars",)) -> Model:
    """A factorisation machine from the labels of rows that are not held out."""
    sample = training_rows(docs, labels, label, rows, metadata)
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).head()
    if not 0 < good < n:
        return Model(None, good / n if n else 0.5, metadata)
    machine = FMClassifier(
        featuresCol="features", labelCol="label", factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=PENALTY, initStd=SPREAD, seed=11, solver="adamW")
    return Model(Pipeline(stages=[*_vectors(), machine]).fit(sample), metadata=metadata)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score of each row."""
    kept = ["doc_id", held_out(F.col("doc_id")).alias("held_out")]
    if model.stages is None:
        return pick(docs, doc_id="doc_id").select(*kept, F.lit(float(model.constant)).alias("score"))
    scored = model.stages.transform(features(docs, model.metadata))
    return scored.select(*kept, vector_to_array("probability")[1].alias("score"))
