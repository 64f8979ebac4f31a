"""What the operators of this subpackage share."""
from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of rows that go to a Python worker at a time; both sides hold them several times over.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH bytes, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        spark.conf.set(name, str(BATCH))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text is the empty text."""
    small_batches(df.sparkSession)
    return df.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text): all columns of df as one struct, so that none can clash with an operator's own."""
    small_batches(df.sparkSession)
    return df.select(F.struct(*(quoted(c) for c in df.columns)).alias("row"), quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Where the session names none, as in tests, a folder of our own is set, but on one machine only.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints/tessera")
    return sc._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this application wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share, with its lineage cut.

    The shuffles behind it are of no more use then; Spark removes their files
    once the driver has collected the plans that hold them, so this asks for it.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker's task (see ``released``)."""
    return sys.modules.setdefault("_tessera_worker_cache", types.ModuleType("_tessera_worker_cache")).__dict__.setdefault("kept", {})


def give_back() -> None:
    """Empties the worker's cache and returns free memory to the system: Arrow's and the allocator's."""
    worker_cache().clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """run over a task's batches, after which the worker, which Spark keeps for later tasks, holds no memory for this one."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return outer


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from uint64."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n."""
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd: they have an inverse mod 2**64
#: Bytes that end a word: \x09-\x0D and the space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of many texts, with a 64-bit hash each.

    ``doc`` has the text of each word, ``first`` the first word of each text
    (and one entry more), ``hash`` the words' hashes. All of it is computed over
    the joined bytes of the texts; no Python object is made for a word.
    """

    def __init__(self, items: list[bytes]):
        joined = b"\n".join(items) + b"\n"
        data = np.frombuffer(joined, dtype=np.uint8)
        gap = SPACE[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(data) and not gap[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[::2], edge[1::2]
        lengths = np.fromiter(map(len, items), dtype=np.int64, count=len(items)) + 1
        ends = np.cumsum(lengths)
        self.first = np.searchsorted(start, np.concatenate(([0], ends)))
        self.n = len(start)
        self.hash = hashed(data, start, end)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(items)), self.counts)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of each data[start:end], in blocks of bounded memory."""
    out = np.empty(len(start), dtype=U64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + step, side="right")))
        lo, hi = int(start[at]), int(end[stop - 1])
        pw = powers(BASE, hi - lo)
        total = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * pw, out=total[1:])
        a, b = start[at:stop] - lo, end[at:stop] - lo
        # the sum of byte * BASE**(position in the word), with the length mixed in
        out[at:stop] = mix((total[b] - total[a]) * powers(inverse(BASE), hi - lo)[a] + (b - a).astype(U64) * U64(BASE2))
        at = stop
    return out


def windows(hashes: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries."""
    n = len(hashes)
    if n < k:
        return np.empty(0, dtype=U64)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(hashes * powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(inverse(base), n)[: n - k + 1])
