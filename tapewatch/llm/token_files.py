"""Token ids of whole texts in Huffman-coded files.

Texts become ids once, in a table in the shared folder.  The counts of all ids there give
one canonical code of limited length.  The documents are then sorted by id over all files, and each
task writes one file:

    magic | block | block | ... | footer | length of the footer (8 bytes) | magic

A block holds ``BLOCK_IDS`` ids, the last one of a file the rest, and can be decoded alone: numbers of
ids, checkpoints and bytes of code (4 bytes each), CRC-32 of what follows, checkpoints (4 bytes each: the bit offset of
every ``CHECKPOINT_IDS``-th id), code.  The footer is compressed JSON and Arrow: code lengths, offset and
length of each block, ids and numbers of tokens of the documents, which run on through the blocks.

Files are numbered in the order of documents; the manifest has their numbers of ids, and so
the place of each document in the whole sequence.
"""

from __future__ import annotations

import base64
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewatch.llm.columns import pick
from tapewatch.llm.huffman import MAX_BITS, Decoder, Encoder, code_lengths
from tapewatch.llm.storage import Ranges, Writer, make_folder, opened
from tapewatch.session import scratch, ship_package

MAGIC = b"TWIDS001"
BLOCK_IDS = 1 << 16
CHECKPOINT_IDS = 256
# Blocks that are decoded in step.
BLOCKS_AT_ONCE = 8
# Words whose ids a worker remembers, and the bytes of the longest one of them: some 100 MB.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
# Text that is cut in words at once.
TEXT_BYTES = 4 << 20

_TOKENIZERS: dict[str, WordIds] = {}
# Words that are a run of letters, then a run of ASCII marks, or either alone.  Letters of Latin-1 are
# their own normal form and have lower cases of one letter each.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")


class WordIds:
    """Ids of words (separated by ASCII white space) by a tokenizer that drops white space.

    ``word_parts``: the tokenizer lower-cases, keeps runs of letters and of marks apart and ends each
    such part with a token in ``</w>``.  Only then are plain words cut up here and encoded many
    at a time; all other words go through the tokenizer one by one.
    """

    def __init__(self, serialized: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(serialized)
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.size = size
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        ends = [(self._tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)]
        self._ends = np.array(ends)
        self._known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.kind).tobytes()
                for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that are runs of letters or of marks: all in one text, cut after each end of a part."""
        found: dict[str, bytes] = {}
        for i in range(0, len(parts), 2000):
            some = parts[i:i + 2000]
            ids = np.array(self._tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype=self.kind)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(some):
                data, at = ids.tobytes(), (ends * ids.itemsize).tolist()
                found.update(zip(some, (data[a:b] for a, b in zip([0, *at], at)), strict=True))  # noqa: B905
            else:  # not what was expected of these parts
                found.update(zip(some, self._encode(some), strict=True))
        return found

    def _learn(self, words: set[bytes]) -> None:
        plain, other = [], []
        for word in words:
            text = word.decode()
            match = _PLAIN.fullmatch(text)
            if match:
                plain.append((word, match[1].lower(), match[2]))
            else:
                other.append((word, text))
        # parts are words themselves, and may be known as such
        parts = {p: self._known.get(p.encode()) for _, core, tail in plain for p in (core, tail) if p}
        missing = self._parts(sorted(p for p, ids in parts.items() if ids is None))
        parts |= missing
        parts[""] = b""
        self._known.update((p.encode(), ids) for p, ids in missing.items())
        self._known.update((word, parts[core] + parts[tail]) for word, core, tail in plain)
        self._known.update(zip((w for w, _ in other), self._encode([t for _, t in other]), strict=True))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes."""
        cut = [text.split() for text in texts]
        distinct: set[bytes] = set().union(*cut)
        new = distinct.difference(self._known)
        if len(self._known) + len(new) > REMEMBERED:
            self._known, new = {}, distinct
        self._learn(new)
        known = self._known
        ids = [b"".join([known[w] for w in words]) for words in cut]
        for word in new:
            if len(word) > LONGEST_REMEMBERED:
                del known[word]
        return ids


def _word_ids(serialized: str) -> WordIds:
    """The tokenizer of this worker; it outlives the task."""
    if serialized not in _TOKENIZERS:
        _TOKENIZERS[serialized] = WordIds(serialized)
    return _TOKENIZERS[serialized]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Where a slice of about TEXT_BYTES ends, and its texts."""
    some, size = [], 0
    for i, text in enumerate(texts):
        some.append(text.as_py())
        size += len(some[-1])
        if size >= TEXT_BYTES or i + 1 == len(texts):
            yield i + 1, some
            some, size = [], 0


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian bytes, two or four for an id) of each row, ``end_id`` last.

    ``tokenizer_file`` is read on the driver and goes to the tasks.  A null text is empty.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_file, encoding="utf-8") as file:
        serialized = file.read()
    shipped = spark.sparkContext.broadcast(serialized)
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_ids(shipped.value)
        end = np.array([end_id], dtype=encode.kind).tobytes()
        for batch in batches:
            begin = 0
            for stop, texts in _slices(batch.column("text")):
                ids = [x + end for x in encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, stop - begin), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                begin = stop

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def count_ids(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id below ``size`` occurs; tasks count on their own, the driver gets one row for each id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), dtype=kind), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], ["id", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


class _File:
    """A file as it is written."""

    def __init__(self, path: str, lengths: np.ndarray, kind: str) -> None:
        self._out, self._lengths, self._kind = Writer(path), lengths, kind
        self._encoder = Encoder(lengths)
        self._out.write(MAGIC)
        self._blocks, self._held, self._n_held, self.n_ids = [], [], 0, 0
        self._docs, self._tokens = [], []

    def add(self, docs: pa.Array, ids: list[bytes]) -> None:
        width = np.dtype(self._kind).itemsize
        self._docs.append(docs)
        self._tokens.extend(len(x) // width for x in ids)
        self._held.append(b"".join(ids))
        self._n_held += len(self._held[-1]) // width
        if self._n_held >= BLOCK_IDS:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        held = np.frombuffer(b"".join(self._held), dtype=self._kind)
        whole = len(held) if last else len(held) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            ids = held[i:min(i + BLOCK_IDS, whole)]
            code, marks = self._encoder.encode(ids, CHECKPOINT_IDS)
            body = marks.astype("<u4").tobytes() + code
            head = struct.pack("<4I", len(ids), len(marks), len(code), zlib.crc32(body))
            self._blocks.append(self._out.write(head + body))
        self.n_ids += whole
        self._held = [held[whole:].tobytes()]
        self._n_held = len(held) - whole

    def close(self) -> None:
        self._flush(last=True)
        docs = pa.table({"doc_id": pa.chunked_array(self._docs), "n_tokens": pa.array(self._tokens, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as stream:
            stream.write_table(docs)
        footer = zlib.compress(json.dumps({
            "kind": self._kind, "checkpoint_ids": CHECKPOINT_IDS, "blocks": self._blocks,
            "lengths": base64.b64encode(self._lengths.tobytes()).decode(),
            "documents": base64.b64encode(sink.getvalue()).decode()}).encode())
        self._out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self._out.close()


MANIFEST = "number int, file string, n_docs long, n_ids long"


def write_files(tokens: DataFrame, path: str, size: int, kind: str, max_bits: int = MAX_BITS) -> None:
    """Write ``tokens`` (doc_id, ids), a table, in order of doc_id to files and a manifest below ``path``.

    Null ids come last.  Rows with one id are ordered by a hash of their ids, and a frequent
    id is split over tasks by it.
    """
    spark = tokens.sparkSession
    ship_package(spark)
    lengths = code_lengths(count_ids(tokens, size, kind), max_bits)
    make_folder(f"{path}/files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, n_docs = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows:
                out = out or _File(file := f"{path}/files/{number:06d}-{uuid.uuid4().hex}.ids", lengths, kind)
                out.add(batch.column("doc_id"), batch.column("ids").to_pylist())
                n_docs += batch.num_rows
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([file]), pa.array([n_docs]), pa.array([out.n_ids])],
                ["number", "file", "n_docs", "n_ids"])

    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("ids"), F.col("ids"))
    (tokens.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(run, MANIFEST)
     .write.parquet(f"{path}/manifest"))


class File:
    """A file as it is read."""

    def __init__(self, path: str) -> None:
        self._path, self._ranges = path, Ranges()
        store, inside = opened(path)
        size = store.get_file_info(inside).size
        tail = self._ranges.read(path, size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} does not end as a file of ids")
        length = struct.unpack("<Q", tail[:8])[0]
        footer = json.loads(zlib.decompress(self._ranges.read(path, size - 16 - length, length)))
        self.kind, self._every, self.blocks = footer["kind"], footer["checkpoint_ids"], footer["blocks"]
        self._decoder = Decoder(np.frombuffer(base64.b64decode(footer["lengths"]), dtype=np.uint8))
        self.documents = pa.ipc.open_stream(base64.b64decode(footer["documents"])).read_all()

    def ids(self, first: int = 0, until: int | None = None) -> Iterator[np.ndarray]:
        """The ids of blocks ``first`` to ``until``, some blocks at a time."""
        blocks = self.blocks[first:until]
        for i in range(0, len(blocks), BLOCKS_AT_ONCE):
            some = blocks[i:i + BLOCKS_AT_ONCE]
            data = self._ranges.read(self._path, some[0][0], some[-1][0] + some[-1][1] - some[0][0])
            codes, starts, counts, at, bits = [], [], [], 0, 0
            for _ in some:
                n, marks, size, crc = struct.unpack_from("<4I", data, at)
                body = data[at + 16:at + 16 + 4 * marks + size]
                if zlib.crc32(body) != crc:
                    raise ValueError(f"a block of {self._path} is damaged")
                starts.append(np.frombuffer(body, dtype="<u4", count=marks).astype(np.int64) + bits)
                counts.append(np.minimum(self._every, n - self._every * np.arange(marks)))
                codes.append(body[4 * marks:])
                at, bits = at + 16 + 4 * marks + size, bits + 8 * size
            yield self._decoder.decode(b"".join(codes), np.concatenate(starts), np.concatenate(counts))


def read_files(spark: SparkSession, path: str, doc_id_kind: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files below ``path``.

    The manifest has a row for each file and none for documents, so the driver adds up the starts.
    """
    ship_package(spark)
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("number").collect()
    begins = np.cumsum([0] + [f.n_ids for f in files]).tolist()
    work = spark.createDataFrame([(f.file, b) for f, b in zip(files, begins, strict=False)], "file string, begin long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = File(row["file"])
                lengths = file.documents.column("n_tokens").to_numpy()
                ends = np.cumsum(lengths)
                crcs, doc, seen = np.zeros(len(lengths), dtype=np.int64), 0, 0
                for ids in file.ids():
                    data, at, stop = memoryview(ids.astype("<u4")).cast("B"), 0, seen + len(ids)
                    while doc < len(ends) and seen < stop:
                        take = min(int(ends[doc]), stop) - seen
                        crcs[doc] = zlib.crc32(data[4 * at:4 * (at + take)], int(crcs[doc]))
                        at, seen = at + take, seen + take
                        if seen == ends[doc]:
                            doc += 1
                if seen != (ends[-1] if len(ends) else 0):
                    raise ValueError(f"{row['file']} has {seen} ids")
                yield from pa.table({
                    "doc_id": file.documents.column("doc_id"), "start": pa.array(ends - lengths + row["begin"]),
                    "n_tokens": file.documents.column("n_tokens"), "ids_crc32": pa.array(crcs)}).to_batches(8192)

    return work.repartition(max(1, len(files))).mapInArrow(run, f"doc_id {doc_id_kind}, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write the files of ``docs`` below the shared folder; their path.  An empty table gives no files."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as file:
        ids = WordIds(file.read())
    if end_id >= ids.size:
        raise ValueError(f"the end id {end_id} is not below {ids.size}")
    table = scratch(spark, "tokens")
    tokenize(docs, tokenizer_file, end_id, doc_id, text).write.option("compression", "zstd").parquet(table)
    path = scratch(spark, "token-files")
    write_files(spark.read.parquet(table), path, ids.size, ids.kind)
    return path
