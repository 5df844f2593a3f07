"""Secret scan with an incremental ledger of blobs, in built-in functions only.

Every version of every path is a blob, named by the SHA-256 of its content.  The ledger
remembers which (blob, version of the rules) pairs were scanned and what was found.  A run
scans the blobs that are new to the ledger, each once, however many paths hold it, adds them
to the ledger and joins the findings back to all paths.

The ledger is a Parquet folder with one subfolder per version of the rules and run; a run
that was broken off has left no complete subfolder, so the next one scans its blobs again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.errors import AnalysisException

from tapewatch.llm.columns import bind, pick
from tapewatch.session import scratch


@dataclass(frozen=True)
class Kind:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hint`` matches somewhere in every text with a match that counts.
    """

    name: str
    pattern: str
    hint: str
    group: int
    least: int


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""
# Fixed values of the contract, in its order.  Matches of the last two are whole runs of their
# characters, so a run that is too short can as well be no match at all.
KINDS = (
    Kind("assign", _ASSIGN + "+)", _ASSIGN + "{12,})", 2, 12),
    Kind("access", "AKIA[A-Z0-9]{14,}", "AKIA[A-Z0-9]{14,}", 0, 18),
    Kind("hex", "[0-9a-f]{16,}", "[0-9a-f]{16,}", 0, 16),
)
RULES_VERSION = "1"
LEDGER = "blob string, n_spans int, spans array<struct<start:long,kind:int,`end`:long>>, rules string, run string"


def _pieces(text: Column, kind: Kind) -> Column:
    """For each match in order: characters before it since the last match, its own, and whether it counts."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = matches if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))
    found = F.transform(
        F.arrays_zip(matches.alias("m"), F.split(text, kind.pattern).alias("before"), tested.alias("t")),
        lambda z: F.struct(F.length(z["before"]).alias("gap"), F.length(z["m"]).alias("long"),
                           (F.length(z["t"]) >= kind.least).alias("counts")))
    # the last part of the split stands after all matches
    return F.filter(found, lambda z: z["long"].isNotNull())


def find(blobs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """blob, spans (start, number of the kind, end; in characters, by start) of each blob of (blob, text).

    Blobs without a match of any kind keep a row with no spans.  A text without a run that
    could count is not cut in pieces at all.
    """
    text = F.col("text")
    none = F.array().cast("array<struct<gap:int,long:int,counts:boolean>>")
    cut = blobs.select("blob", F.explode(F.array(*(
        F.struct(F.lit(i).alias("kind"), F.when(text.rlike(k.hint), _pieces(text, k)).otherwise(none).alias("pieces"))
        for i, k in enumerate(kinds)))).alias("x"))
    pieces = cut.select("blob", "x.kind", F.posexplode_outer("x.pieces").alias("i", "p"))
    before = Window.partitionBy("blob", "kind").orderBy("i")
    end = F.sum(F.col("p.gap") + F.col("p.long")).over(before)
    placed = pieces.select("blob", "kind", end.cast("long").alias("end"), F.col("p.long").alias("n"), F.col("p.counts").alias("counts"))
    span = F.struct((F.col("end") - F.col("n")).alias("start"), "kind", "end")
    return placed.groupBy("blob").agg(
        F.sort_array(F.collect_list(F.when(F.col("counts"), span))).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger below ``path``, no rows if there is none."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: str, kinds: tuple[Kind, ...] = KINDS, rules: str = RULES_VERSION,
         path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob and spans of each row of ``versions``; new blobs go into the ledger.

    Change ``rules`` whenever ``kinds`` changes.  A null text is the empty blob.  Paths may be
    null or repeat: each row stands for a version of its own.  An empty table leaves the
    ledger alone.
    """
    spark = versions.sparkSession
    named = pick(versions, path=path, text=text).select(
        "path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    known = read_ledger(spark, ledger).where(F.col("rules") == rules)
    # equal blobs meet in their own tasks first, so a frequent one is not sent many times
    fresh = named.select("blob", "text").dropDuplicates(["blob"])
    if not known.isEmpty():
        fresh = fresh.join(known.select("blob"), "blob", "left_anti")
    (find(fresh, kinds).select("blob", F.size("spans").alias("n_spans"), "spans")
     .write.mode("append").parquet(f"{ledger}/rules={rules}/run={uuid.uuid4().hex}"))
    found = read_ledger(spark, ledger).where(F.col("rules") == rules).select("blob", "n_spans", "spans")
    # every blob of ``named`` is in the ledger by now; one without spans needs no look-up.  Two scans at once, or a try of one
    # that was lost after it wrote, can leave a blob there twice, with equal spans: one of them counts.
    # Written first, so that the join below is a plain one, in which Spark can split a blob that very many paths have.
    once = scratch(spark, "ledger-found")
    found.where("n_spans > 0").select("blob", "spans").dropDuplicates(["blob"]).write.parquet(once)
    some = spark.read.parquet(once)
    empty = F.array().cast("array<struct<start:long,kind:int,`end`:long>>")
    return named.select("path", "blob").join(some, "blob", "left").select(
        "path", "blob", F.coalesce("spans", empty).alias("spans"))


def told(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in kinds))
    return bind(names, lambda n: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(n, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","))
