"""Shared plumbing of the training-data operators: tables, shared storage, bounded Arrow slices."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once inside a Python worker; only memory depends on it, never a result.
SLICE_BYTES = 3 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor sees.

    The setting is read from the session; only where it is unset (tests) is a folder of our own set.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="wicker-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/wicker-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The path that Python opens for a folder of a file system that every executor has mounted; others are refused."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if scheme and scheme[1] != "file":
        raise ValueError(f"{uri} is no mounted path: files that Python maps into memory need file: or a plain path")
    return "/" + uri[5:].lstrip("/") if scheme else uri


#: Drops an execution's shuffle files once it has ended; what it wrote is on shared storage by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing = threading.Lock(), []


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to shared storage and read back: cuts lineage, survives lost executors and frees the disk of its shuffles."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}"
    with _lock:  # writes may run side by side: the first sets, the last puts back
        if not _writing:
            _writing.append(spark.conf.get(CLEANUP, "false"))
            spark.conf.set(CLEANUP, "true")
        _writing.append(path)
    try:
        df.write.parquet(path)
    finally:
        with _lock:
            _writing.remove(path)
            if len(_writing) == 1:
                spark.conf.set(CLEANUP, _writing.pop())
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the folders of stored tables that nothing reads any more, so that shared storage holds what is still needed only."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_in).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def integers(df: DataFrame, column: str) -> None:
    """Refuses ids that aren't integers: results name the smallest of them as a number."""
    kind = dict(df.dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} has type {kind}; integer ids are needed here")


def texts_of(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, nulls as empty; offsets start at 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    raw = pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null(b"" if raw else "")
    array = array.cast(pa.large_binary() if raw else pa.large_string())
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` text bytes; a longer text is a range of its own."""
    _, offsets = texts_of(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j
    pa.default_memory_pool().release_unused()


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``most`` text bytes."""
    for batch in batches:
        for i, j in cuts(batch.column(batch.schema.get_field_index(column)), most):
            yield batch.slice(i, j - i)


def arrow_map(df: DataFrame, columns: list[str], f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str, most: int = SLICE_BYTES) -> DataFrame:
    """f over bounded slices of the named columns only, so that nothing else leaves the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, most):
            yield f(batch)

    return df.select(*columns).mapInArrow(run, schema)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def rows_where(docs: DataFrame, text: str, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose texts the judge accepts."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in cuts(batch.column(place), SLICE_BYTES):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(judge(part.column(place))))

    return docs.mapInArrow(run, docs.schema)
