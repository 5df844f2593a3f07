"""Removal of repeated passages by content-defined chunks of lines, in built-in functions only.

Lines are hashed, a rolling hash goes over each pair of neighbouring lines, and a chunk ends after
each line whose rolling hash is a local minimum.  Such a boundary depends on the lines next
to it alone, so a passage that is shifted or put into other surroundings is cut at the same
lines inside; a chunk between two minima has two lines at least.  Chunks of several lines, and
single lines of ``LONG_LINE_WORDS`` words or more (which are chunks of their own), that occur
more than once anywhere are removed except for their first occurrence.

Work at scale: hashes alone are counted first, with partial sums in each task.  The texts of chunks whose hash
may repeat, by a filter of bounded size, are grouped by their bytes then, copies within a task
first.  A hash that turns out to have one text alone tells its places; where it has several, chunks are
joined by their bytes.  So two texts with one hash are never taken for copies.  Whole documents are shuffled only
if they lose something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapewatch.llm.columns import SPACE, Carried, Filter, bind, pick, same
from tapewatch.session import scratch

LONG_LINE_WORDS = 50
FACTOR = 1_048_573  # of the rolling hash
ROW = ["doc_id", "t"]


def line_hash(line: Column) -> Column:
    """60 bits of the line's MD5, which SQL engines share."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _is_long(line: Column, words: int) -> Column:
    """So many words, at least; lines too short for them are not split."""
    return F.when(F.length(line) >= 2 * words - 1, F.size(F.array_remove(F.split(line, SPACE), "")) >= words).otherwise(words <= 0)


def _starts(hashed: Column) -> Column:
    """Numbers of the lines that begin a chunk, with the end of the text as the last entry."""
    # r[i]: of lines i - 1 and i, from 40 bits of each so that it stays within a long
    rolled = F.transform(hashed, lambda x, i: F.coalesce(F.get(hashed, i - 1)["h"], F.lit(0)) % (1 << 40) * FACTOR + x["h"] % (1 << 40))
    return bind(rolled, lambda r: F.filter(
        F.sequence(F.lit(0), F.size(hashed)),
        lambda i: (i == 0) | (i == F.size(hashed)) | F.get(hashed, i)["long"] | F.get(hashed, i - 1)["long"]
        | ((i >= 2) & (F.get(r, i - 1) < F.get(r, i - 2)) & (F.get(r, i - 1) < F.get(r, i)))))


def with_chunks(lines: Column, long_line: int = LONG_LINE_WORDS) -> Column:
    """The chunks of a text in order: struct(text, n_lines, counts)."""
    hashed = F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), _is_long(x, long_line).alias("long")))

    def build(h: Column, starts: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            n = F.get(starts, k + 1) - i
            return F.struct(
                F.array_join(F.slice(lines, i + 1, n), "\n").alias("text"), n.alias("n_lines"),
                ((n > 1) | F.get(h, i)["long"]).alias("counts"))
        return F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), one)

    return bind(hashed, lambda h: bind(_starts(h), lambda starts: build(h, starts)))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, t (hash of the text), lines of each row."""
    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.select("doc_id", F.xxhash64("text").alias("t"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))


def _key(chunk: Column) -> Column:
    """The hash by which chunks are counted; texts may share it."""
    return F.xxhash64(chunk)


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_line: int = LONG_LINE_WORDS) -> DataFrame:
    """doc_id, t and the numbers of the chunks to remove, for documents that lose any.

    The first occurrence, by (doc_id, hash of the text, number of the chunk) with null ids last,
    stays.  Rows equal in id and text are the same document here: they keep or lose the same chunks.
    """
    spark = docs.sparkSession
    rows, chunks = _rows(docs, doc_id, text), with_chunks(F.col("lines"), long_line)
    exploded = rows.select(*ROW, F.posexplode(chunks).alias("k", "c")).where("c.counts").select(
        *ROW, "k", _key(F.col("c.text")).alias("h"), F.col("c.text").alias("chunk"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "k")
    ends = (F.min(place).alias("first"), F.max(place).alias("last"))
    hashes = _written(spark, exploded.select(*ROW, "k", "h"), "chunk-hashes")
    seen = _written(spark, hashes.groupBy("h").agg(*ends).where("first != last").select("h"), "chunks-seen")

    # The texts of those chunks, and a few others, are compared byte by byte.
    passed = Filter(seen, F.col("h")).mark(exploded, F.col("h")).where("marked")
    texts = passed.groupBy("h", "chunk").agg(*ends).select("h", "first", "last")
    found = _written(spark, texts.groupBy("h").agg(
        F.count("*").alias("n_texts"), F.min("first").alias("first"), F.max("last").alias("last")).where("first != last"), "chunks-compared")
    # a hash of one text stands for it
    later = hashes.join(found.where("n_texts = 1").select("h", "first"), "h").where(place != F.col("first")).select(*ROW, "k")
    several = found.where("n_texts > 1").select("h")
    if not several.isEmpty():
        mixed = _written(spark, exploded.join(several, "h").select(*ROW, "k", "chunk"), "chunk-texts")
        firsts = _written(spark, mixed.groupBy("chunk").agg(*ends).where("first != last").select("chunk", "first"), "chunk-firsts")
        later = later.union(mixed.join(firsts, "chunk").where(place != F.col("first")).select(*ROW, "k"))
    return _written(spark, later, "chunks-later").groupBy(*ROW).agg(F.collect_set("k").alias("gone"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   long_line: int = LONG_LINE_WORDS) -> DataFrame:
    """All columns of ``docs`` with repeated chunks cut out of the text, as struct ``row``,
    and n_lines, n_removed_lines.

    A null text stays null and has no lines; an empty text has one empty line.  Texts that
    lose nothing come back as they were; no row is dropped.
    """
    table = Carried(docs)
    gone = repeats(docs, doc_id, text, long_line)
    full = table.df.withColumns({"doc_id": table[doc_id], "t": F.xxhash64(table[text])})
    gone = _written(docs.sparkSession, gone, "chunks-gone")
    # rows that lose nothing needn't be shuffled
    marked = Filter(gone, F.xxhash64(*ROW)).mark(full, F.xxhash64(*ROW))
    untouched = marked.where("not marked").withColumn("gone", F.lit(None).cast("array<int>"))
    joined = same(marked.where("marked"), gone, ROW, "left").unionByName(untouched)
    lines = joined.withColumn("lines", F.split(table[text], "\n"))
    parts = lines.withColumn("chunks", F.when(F.col("gone").isNotNull(), with_chunks(F.col("lines"), long_line)))
    kept = F.filter("chunks", lambda c, k: ~F.array_contains("gone", k))
    whole = F.when(F.col("gone").isNull(), table[text]).otherwise(F.array_join(F.transform(kept, lambda c: c["text"]), "\n"))
    cut = F.aggregate(F.filter("chunks", lambda c, k: F.array_contains("gone", k)), F.lit(0), lambda s, c: s + c["n_lines"])
    number = table.names.index(text)
    row = F.struct(*(whole.alias(c) if i == number else F.col(c) for i, c in enumerate(table.numbers)))
    return parts.select(
        row.alias("row"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(cut, F.lit(0)).cast("long").alias("n_removed_lines"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the texts cleaned; a document that loses all its lines has an empty text."""
    out = remove_repeats(docs, doc_id, text)
    return out.select(*(F.col(f"row._{i}") for i in range(len(docs.columns)))).toDF(*docs.columns)
