"""Bytes in files of the shared folder, written and read by tasks.

Tasks write whole files under names of their own and report them in a table
that Spark stores; only reported files count, so a lost or repeated task leaves
at worst a file nobody reads.  Paths may belong to any store that pyarrow knows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from clauselens.session import checkpoint_dir


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder's address below the cluster's shared folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        # Hadoop's names for a store that pyarrow calls s3.
        return fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1).replace("s3n:", "s3:", 1))
    return fs.LocalFileSystem(), path


class Writer:
    """One new file, appended to; ``at`` is the next byte's offset."""

    def __init__(self, folder: str, suffix: str):
        self.name = f"{uuid.uuid4().hex}{suffix}"
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        self._out, self.at = store.open_output_stream(f"{base}/{self.name}", compression=None), 0

    def write(self, data: bytes) -> int:
        """Appends and returns the offset at which the data begins."""
        start = self.at
        self._out.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self._out.close()


class Reader:
    """Reads pieces of files in a folder, the last one kept open."""

    def __init__(self, folder: str):
        self._store, self._base = _open(folder)
        self._name, self._in = None, None

    def read(self, name: str, start: int, size: int) -> bytes:
        if name != self._name:
            if self._in is not None:
                self._in.close()
            self._in, self._name = self._store.open_input_file(f"{self._base}/{name}"), name
        self._in.seek(start)
        return self._in.read(size)

    def size(self, name: str) -> int:
        if name != self._name:
            self.read(name, 0, 0)
        return self._in.size()


def write_arrow(folder: str, table, **options) -> str:
    """One new Parquet file that a task writes; returns its name."""
    from pyarrow import parquet

    name = f"{uuid.uuid4().hex}.parquet"
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
        parquet.write_table(table, out, **options)
    return name


def read_arrow(folder: str, name: str):
    """The table of one such file."""
    from pyarrow import parquet

    store, base = _open(folder)
    with store.open_input_file(f"{base}/{name}") as source:
        return parquet.read_table(source)
