"""What the operators share on the Spark side: inputs, batches, the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bound what one Arrow batch holds, so that long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone; null texts are empty. No other column can clash then."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds) == F.lit(fold)


_made: list[str] = []  # folders of this process, oldest first
_local: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors all see, below ``spark.checkpoint.dir``.

    Only a session without such a folder whose executors are threads of this machine (as in
    tests) is given a local one; on a cluster that is an error. What is written below it is
    removed when its :func:`scratch` ends, or with this process.
    """
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _local = _local or tempfile.mkdtemp(prefix="shared-")
    _made.append(f"{root.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def remove(uri: str) -> None:
    """Remove a file or folder, if it is there."""
    store, path = _place(uri)
    with contextlib.suppress(OSError):
        kind = store.get_file_info(path).type.name
        if kind == "Directory":
            store.delete_dir(path)
        elif kind == "File":
            store.delete_file(path)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end what was written within, but for tables given to the function it yields."""
    before, kept = len(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(len(_made))
        return staged(df)

    try:
        yield keep
    finally:
        for k in range(len(_made) - 1, before - 1, -1):
            if k not in kept:
                remove(_made.pop(k))


@atexit.register
def _clean() -> None:
    for uri in _made:
        remove(uri)
    if _local:
        remove(_local)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of results that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut lineage that survives executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(uri: str):
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays, each 64-byte aligned, to one file of the shared folder.

    A temporary name first, then a rename: a task that runs twice leaves one whole file.
    """
    import json

    store, path = _place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    at, head, parts = 0, {}, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        pad = -a.nbytes % 64
        head[name] = [a.dtype.str, list(a.shape), at]
        parts += [a, bytes(pad)]
        at += a.nbytes + pad
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for p in parts:
            f.write(p.tobytes() if isinstance(p, np.ndarray) else p)
    store.move(tmp, path)


def map_file(uri: str) -> dict[str, np.ndarray]:
    """The arrays of :func:`write_file`: memory-mapped where the folder is mounted, else read."""
    import json

    store, path = _place(uri)
    if urlparse(uri).scheme in ("", "file"):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain array: every look-up in a memmap makes objects
    else:
        with store.open_input_file(path) as f:
            raw = np.frombuffer(f.read_buffer(), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, shape, at) in head.items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[8 + n + at : 8 + n + at + size].view(kind).reshape(shape)
    return out
