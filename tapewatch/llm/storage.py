"""Files that tasks write and read themselves, in the store that a path's scheme names."""

from __future__ import annotations

import gc
from typing import Any
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tapewatch.session import scratch


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of ``path`` and the path within it; plain paths are local (or mounted) ones."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    scheme = "s3" if parts.scheme in ("s3a", "s3n") else parts.scheme
    return fs.FileSystem.from_uri(path.replace(parts.scheme, scheme, 1))


def make_folder(path: str) -> None:
    store, inside = opened(path)
    store.create_dir(inside, recursive=True)


class Writer:
    """A new file that knows how much was written to it."""

    def __init__(self, path: str) -> None:
        store, inside = opened(path)
        self.path, self.size = path, 0
        self._to = store.open_output_stream(inside, compression=None)

    def write(self, data: bytes) -> tuple[int, int]:
        """Offset and length of what was written."""
        self._to.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)

    def close(self) -> None:
        self._to.close()


class Ranges:
    """Range reads; the last few files stay open."""

    def __init__(self, keep: int = 16) -> None:
        self._keep, self._open = keep, {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self._open:
            if len(self._open) >= self._keep:
                self._open.pop(next(iter(self._open))).close()
            store, inside = opened(path)
            self._open[path] = store.open_input_file(inside)
        data = self._open[path].read_at(length, offset)
        if len(data) != length:
            raise EOFError(f"{path}: {len(data)} of {length} bytes at {offset}")
        return data

    def stream(self, path: str) -> Any:
        store, inside = opened(path)
        return store.open_input_stream(inside, compression=None)

    def close(self) -> None:
        for file in self._open.values():
            file.close()
        self._open = {}


class Tables:
    """Intermediate tables in the shared folder that are removed as soon as all that is made of them is written."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self._spark, name)
        df.write.option("compression", "zstd").parquet(path)
        del df
        self._settle()
        back = self._spark.read.parquet(path)
        self._paths[id(back)] = (path, back)
        return back

    def _settle(self) -> None:
        """Let Spark's cleaner find the shuffle files of plans that nothing refers to any more; it looks for them after collections only."""
        gc.collect()
        self._spark.sparkContext._jvm.System.gc()

    def remove(self, *frames: DataFrame) -> None:
        for frame in frames:
            path, _ = self._paths.pop(id(frame))
            folder = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        self._settle()

    def remove_all_but(self, *frames: DataFrame) -> None:
        kept = {id(f) for f in frames}
        self.remove(*[back for i, (_, back) in list(self._paths.items()) if i not in kept])
