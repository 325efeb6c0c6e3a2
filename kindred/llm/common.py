"""Session settings, intermediate tables and Arrow text access shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.words import U64, mix64
from kindred.plans.tables import kept as materialize

__all__ = ["KeyFilter", "discard", "free_names", "frugal", "keep_freed", "materialize", "one_file_a_task", "prepare", "sample", "text_steps"]
#: Bytes of text that one numpy step works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 19
#: Bits of the largest key filter: a broadcast of 32 MB.
FILTER_MOST = 1 << 28
_LIBC = ctypes.CDLL(None)


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches, by bytes too, so that very long texts don't meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def one_file_a_task(spark: SparkSession) -> None:
    """Raises a number of shuffle partitions for which each task writes a file a partition (200, the default, is the last) to one for
    which it writes one file. With few rows a task, opening the files is most of a shuffle's work."""
    most = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if most // 2 <= int(spark.conf.get("spark.sql.shuffle.partitions")) <= most:
        spark.conf.set("spark.sql.shuffle.partitions", str(most + 56))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize has written, when nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has columns of, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def give_back() -> None:
    """Returns what numpy and Arrow have freed to the system. Python workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def keep_freed(most: int = 16 << 20) -> None:
    """From now on this process keeps freed memory, up to `most` bytes, for its next numpy steps; give_back returns that too."""
    if hasattr(_LIBC, "mallopt"):
        for what in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            _LIBC.mallopt(what, most)


def frugal(function: Callable) -> Callable:
    """The function of a Python task, which gives freed memory back when it is done; for an Arrow function of columns, after each batch."""
    if isgeneratorfunction(function):

        @wraps(function)
        def run(*columns):
            try:
                yield from function(*columns)
            finally:
                give_back()
    else:

        @wraps(function)
        def run(*columns):
            try:
                return function(*columns)
            finally:
                give_back()

    run.__signature__ = signature(function)  # Spark counts the arguments
    return run


def sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of df: those with the least hashes of their key. A count and a bound on the hash come first, so tasks
    send few rows more than are wanted, however many tasks there are."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    bound = -(-(1 << 30) * (most + 8 * int(most**0.5) + 64) // max(1, df.count()))
    return df.where(place < min(bound, 1 << 30)).orderBy(place, *df.columns).limit(most)


def text_steps(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `step` bytes: first row, end row, their UTF-8 bytes, the rows' bounds in these. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + step, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def _filter_words(size: int):
    """Keys -> the 64-bit words of the filter of `size` bits that the task's keys set."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // 64, U64)
        for batch in batches:
            for spots in _spots(batch.column(0).to_numpy(), size):
                np.bitwise_or.at(total, (spots >> U64(6)).astype(np.int64), U64(1) << (spots & U64(63)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].view(np.int64))], ["word", "bits"])

    return run


def _spots(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix64(keys.astype(np.int64, copy=False).view(U64))
    return mixed & U64(size - 1), (mixed >> U64(32)) & U64(size - 1)


class KeyFilter:
    """Holds every key of a table, and some others: one in sixty up to FILTER_MOST / 16 keys, beyond that more. It saves work before a
    join and never decides."""

    def __init__(self, keys: DataFrame):
        """keys: one column of longs without nulls. The driver gets FILTER_MOST / 64 numbers at most."""
        self.size = 1 << 16
        wanted = 16 * keys.count()
        while self.size < min(wanted, FILTER_MOST):
            self.size *= 2
        told = keys.mapInArrow(_filter_words(self.size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        held = np.zeros(self.size // 64, np.int64)
        held[told.column("word").to_numpy()] = told.column("bits").to_numpy()
        self.bits = held.view(np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        first, second = _spots(keys, self.size)
        look = lambda spots: (self.bits[spots >> U64(3)] >> (spots & U64(7)).astype(np.uint8)) & 1
        return (look(first) & look(second)).astype(bool)
