"""Two-level index of captures: compressed blocks of sorted lines and a sparse directory of blocks.

The first level are lines "key {json}", sorted by key, in files of separately compressed
blocks of ``BLOCK_LINES`` lines.  Keys begin with the host in reverse (com,example)/path), so
captures of a site lie side by side.  The second level has a row for each block: its first and last key,
file, offset and length.  A look-up searches the directory by bisection, reads the one block
with a range read and searches its lines by bisection again.

Nothing is sorted or held in one place: ranges of keys are sorted in tasks of their own, and a
look-up task loads the part of the directory that its own keys span.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tapewatch.llm.storage import Ranges, Writer, make_folder, opened
from tapewatch.session import ship_package

BLOCK_LINES = 512
DIRECTORY = "first string, last string, file string, offset long, length long, n_lines int"
# Keys that one step of a look-up task resolves; it loads the directory between its first and last.
STEP = 4096


def url_key(url: str | None) -> str:
    """The URL with its host in reverse, without scheme, fragment and white space; "-" for none.

    What isn't a URL stands for itself.
    """
    if not url or not url.strip():
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return quote(url.strip(), safe="/:?#[]@!$&'()*+,;=%-._~")
    turned = quote(",".join(reversed(host.split("."))), safe=",:!$&'()*+;=-._~") + (f":{port}" if port and port not in (80, 443) else "")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{turned}){quote(rest, safe="/:?[]@!$&'()*+,;=%-._~")}"


def build_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Write the index of ``captures`` (key and further columns that JSON can hold) to ``path``.

    Keys may repeat.  A key that very many captures share fills its own range; make keys end
    in something of the capture's own, as ``warc.capture_key`` does, to have it split.
    """
    spark = captures.sparkSession
    ship_package(spark)
    make_folder(f"{path}/blocks")
    others = [c for c in captures.columns if c != "key"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, rows = None, [], []

        def flush() -> None:
            nonlocal out, held
            out = out or Writer(f"{path}/blocks/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx.gz")
            offset, length = out.write(zlib.compress("".join(f"{k} {j}\n" for k, j in held).encode()))
            rows.append((held[0][0], held[-1][0], out.path, offset, length, len(held)))
            held = []

        for batch in batches:
            for row in batch.to_pylist():
                held.append((row["key"], json.dumps({c: row[c] for c in others}, ensure_ascii=False)))
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out:
            out.close()
        names = ["first", "last", "file", "offset", "length", "n_lines"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    (captures.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(write, DIRECTORY)
     .write.parquet(f"{path}/directory"))


class _Directory:
    """Look-ups of one task."""

    def __init__(self, path: str) -> None:
        store, inside = opened(f"{path}/directory")
        self._blocks = ds.dataset(inside, filesystem=store, format="parquet")
        self._ranges, self._at, self._keys, self._lines = Ranges(), None, [], []

    def span(self, least: str, most: str) -> None:
        """Load the entries of blocks that may hold keys from ``least`` to ``most``."""
        part = self._blocks.to_table(filter=(ds.field("first") <= most) & (ds.field("last") >= least)).sort_by("first")
        self._first = part.column("first").to_pylist()
        self._rows = part.select(["file", "offset", "length"]).to_pylist()

    def find(self, key: str) -> Iterator[dict]:
        """The captures with this key; those of a frequent key go on in the next blocks."""
        block = max(0, bisect_left(self._first, key) - 1)
        for i in range(block, bisect_right(self._first, key)):
            row = self._rows[i]
            if self._at != row:
                text = zlib.decompress(self._ranges.read(**{"path": row["file"], "offset": row["offset"], "length": row["length"]}))
                self._lines = text.decode().split("\n")[:-1]
                self._keys = [line.partition(" {")[0] for line in self._lines]
                self._at = row
            for j in range(bisect_left(self._keys, key), bisect_right(self._keys, key)):
                yield json.loads(self._lines[j][len(key) + 1:])


def look_up(keys: DataFrame, path: str, columns: str) -> DataFrame:
    """key and ``columns`` (a schema string) of the captures with one of the distinct ``keys``.

    Keys that the index doesn't hold give no row.
    """
    ship_package(keys.sparkSession)
    schema = f"key string, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = None
        for batch in batches:
            directory = directory or _Directory(path)
            for i in range(0, batch.num_rows, STEP):
                wanted = batch.column(0).slice(i, STEP).to_pylist()
                directory.span(wanted[0], wanted[-1])
                rows = [{"key": k} | x for k in wanted for x in directory.find(k)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = pa.schema([(c.strip().split()[0], {"string": pa.string(), "long": pa.int64()}[c.strip().split()[1]])
                       for c in schema.split(",")])
    distinct = keys.select(F.col("key")).where("key is not null").distinct()
    # keys are few bytes but many reads: their number of tasks is not left to their size
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(run, schema)
