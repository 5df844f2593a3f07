"""Bars from ticks, tables and CSV folders."""

from __future__ import annotations

import csv
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapewatch.functions.expr import finite
from tapewatch.operators.series import priced
from tapewatch.schema import BAR, BAR_COLUMNS, PRICE_COLUMNS
from tapewatch.session import ship_package

READ_BYTES = 64 * 1024  # read at a time until the header line ends

# Accepted spellings of the price columns.
STANDARD_NAMES = {
    "open": "Open",
    "high": "High",
    "low": "Low",
    "close": "Close",
    "volume": "Volume",
    "adj close": "Adj Close",
    "adjclose": "Adj Close",
}


def ticks_to_bars(ticks: DataFrame, unit: str, order: str = "tick") -> DataFrame:
    """One bar per symbol and ``unit`` (a truncation unit such as 'hour').

    ``ticks`` has symbol, ts, price and qty; the number ``order`` decides the first
    and the last tick of a bar.  Ticks of one bar are combined before the shuffle,
    by hash and without a sort where ``order`` is a plain number; a struct of several
    columns works as well.
    """
    key = F.col(order)
    return (
        ticks.groupBy("symbol", F.date_trunc(unit, "ts").alias("ts"))
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("qty").cast("long").alias("volume"))
        .withColumn("seq", F.lit(0).cast("long")))


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files of a folder by file name; contents are not read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
        .select("path").orderBy("path").collect())
    return [row.path for row in found]


def read_bar_folder(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """All per-symbol CSV files of a folder as one frame.

    The symbol is the file name, ``seq`` grows with the place in the file, so rows of one date keep
    their order.  Rows whose date cannot be read are dropped, an adjusted close is ignored, prices that are
    no finite number are NULL, and ``limit`` keeps the first files by name.
    """
    files = csv_files(spark, folder)
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    if limit:
        files = files[:limit]
    raw = None
    for header, paths in _by_header(spark, files).items():
        names = [name.strip() for name in next(csv.reader([header]))]
        part = (
            spark.read.option("header", True).option("enforceSchema", True)
            .schema(", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)).csv(paths)
            .withColumns({
                "symbol": F.regexp_extract(_file_name(), r"^(.*)\.csv$", 1),
                "seq": F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    if raw is None:
        raise ValueError(f"no CSV file in {folder} has a header")
    return (
        raw.select(
            "symbol",
            F.try_to_timestamp("Date").alias("ts"),
            *[finite(F.col(c.title()).try_cast("double")).alias(c) for c in PRICE_COLUMNS], "seq")
        .filter(F.col("ts").isNotNull())
        .withColumn("volume", F.col("volume").try_cast("long"))
        .select("symbol", "ts", *PRICE_COLUMNS, "seq"))


def _file_name() -> Column:
    """The file's own name; Spark reports it percent-encoded, with plus signs as they are."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _first_line(path: str) -> str:
    """The first line of a file that isn't blank."""
    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        uri = quote(path, safe=":/")
        system, name = fs.FileSystem.from_uri(uri.replace(uri.split(":", 1)[0], "s3", 1) if uri.startswith(("s3a:", "s3n:")) else uri)
    with system.open_input_stream(name) as stream:
        data = b""
        while True:
            more = stream.read(READ_BYTES)
            data = (data + more).lstrip(b"\xef\xbb\xbf\r\n \t") if not data else data + more
            line, ended, _ = data.partition(b"\n")
            if ended or not more:
                return line.decode("utf-8-sig").strip()


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "header": [_first_line(path) for path in batch["path"]]})


def _by_header(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """File paths per distinct header line, since column sets differ between files.

    Tasks read the first line of their files only; files without any line are left out.
    """
    ship_package(spark)
    paths = spark.createDataFrame([(f,) for f in files], "path string")
    tasks = min(len(files), spark.sparkContext.defaultParallelism)
    lines = paths.repartition(tasks).mapInPandas(_first_lines, "path string, header string").collect()
    groups: dict[str, list[str]] = {}
    for row in sorted(lines):
        if row.header:
            groups.setdefault(row.header, []).append(row.path)
    return groups


def standardise_columns(df: DataFrame) -> DataFrame:
    """Case-insensitive rename to Open/High/Low/Close/Volume; volume to integer."""
    renamed = df.withColumnsRenamed({
        c: STANDARD_NAMES[c.lower()] for c in df.columns if c.lower() in STANDARD_NAMES})
    if "Volume" in renamed.columns:
        renamed = renamed.withColumn("Volume", F.col("Volume").try_cast("double").try_cast("long"))
    return renamed


def clean_bars(df: DataFrame) -> DataFrame:
    """Canonical bars: known, finite prices and volume, volume as integer.

    A frame without a required column gives no rows.
    """
    names = {c.lower(): c for c in df.columns}
    names.setdefault("ts", names.get("date"))
    if names["ts"] is None or any(c not in names for c in PRICE_COLUMNS):
        return df.sparkSession.createDataFrame([], BAR)
    optional = {"previous_close": "double", "seq": "long"}
    bars = df.select(
        F.col(names["symbol"]).alias("symbol"),
        F.col(names["ts"]).cast("timestamp").alias("ts"),
        *[F.col(names[c]).try_cast("double").alias(c) for c in PRICE_COLUMNS],
        *[(F.col(names[c]) if c in names else F.lit(None)).cast(t).alias(c) for c, t in optional.items()])
    return (
        priced(bars)
        .withColumn("volume", F.col("volume").try_cast("long")).dropna(subset=["volume"])
        .withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))
        .select(*BAR_COLUMNS))


def write_bars(bars: DataFrame, path: str, form: str = "parquet") -> None:
    """Persist combined bars, sorted by symbol and time across the files."""
    ordered = bars.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts", "seq")
    writer = ordered.write.mode("errorifexists")
    if form == "csv":
        writer.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    else:
        writer.parquet(path)


def read_bars(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """What ``write_bars`` wrote; of CSV files the columns are found by their names."""
    if form == "csv":
        text = spark.read.option("header", True).csv(path)
        kinds = {f.name: f.dataType for f in BAR}
        return text.select(*[
            (F.to_timestamp(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if c == "ts" else F.col(c).cast(kinds[c])).alias(c)
            for c in text.columns])
    return spark.read.parquet(path)


def write_by_symbol(bars: DataFrame, path: str, buckets: int) -> None:
    """Bars by month and, within a month, in ``buckets`` by the hash of the symbol, sorted by symbol and time.

    What reads them back through ``read_by_symbol`` has each symbol's rows in one task without a shuffle, and
    reads only the months and buckets that a filter asks for.  A month's bars of a symbol are written by one task.
    """
    spark, name = bars.sparkSession, f"bars_{uuid.uuid4().hex}"
    dated = bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dated.schema)
    writer = dated.repartition("month", "symbol").write.format("parquet").mode("errorifexists").option("path", f"{path}/bars")
    writer.partitionBy("month").bucketBy(buckets, "symbol").sortBy("symbol", *_TIME_ORDER).saveAsTable(name)
    spark.sql(f"drop table {name}")  # the session's entry only; the files stay
    spark.createDataFrame([(columns, buckets)], "columns string, buckets int").coalesce(1).write.json(f"{path}/layout")


_TIME_ORDER = ("ts", "seq")


def read_by_symbol(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_by_symbol`` wrote, with its layout known to Spark."""
    layout = spark.read.schema("columns string, buckets int").json(f"{path}/layout").first()
    name = f"bars_{hashlib.md5(path.encode()).hexdigest()}"
    order = ", ".join(("symbol", *_TIME_ORDER))
    spark.sql(f"drop table if exists {name}")
    spark.sql(
        f"create table {name} ({layout.columns}) using parquet partitioned by (month) "
        f"clustered by (symbol) sorted by ({order}) into {layout.buckets} buckets location '{path}/bars'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def write_symbol_csvs(bars: DataFrame, path: str) -> None:
    """One ``<symbol>.csv`` per symbol, rows by time, the layout ``read_bar_folder`` takes.

    Rows of one time keep the order of ``seq`` if there is one, else that of their columns.
    """
    order = [c for c in ("ts", "seq", *PRICE_COLUMNS) if c in bars.columns]
    spark = bars.sparkSession
    (bars.repartition("symbol").sortWithinPartitions("symbol", *order).select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"),
        F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
        F.col("close").alias("Close"), F.col("close").alias("Adj Close"), F.col("volume").alias("Volume"))
     .write.partitionBy("symbol").option("header", True).csv(f"{path}/parts"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path}/named")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target)
    for part in store.globStatus(hadoop.Path(f"{path}/parts/symbol=*/part-*.csv")):
        # the folder's name is the symbol, percent-encoded where a path needs it
        symbol = unquote(part.getPath().getParent().getName().split("=", 1)[1])
        if "/" in symbol:
            raise ValueError(f"{symbol!r} cannot be a file's name")
        if not store.rename(part.getPath(), hadoop.Path(target, f"{symbol}.csv")):
            raise OSError(f"could not name the file of {symbol}")
