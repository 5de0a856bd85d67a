"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words whose hashes a Python worker keeps; beyond it the cache starts anew.
CACHED_WORDS = 200_000
#: Bytes of text that are turned into numpy arrays at once, and rows of a batch that are turned into Python objects at once.
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 1_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the folder set by setCheckpointDir.

    Where neither is set, a session on one machine (tests) gets a temporary folder; on a cluster that is an error, as executors would write
    into folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/tidewater-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and the path: later stages neither recompute it nor lose it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written and read again. The tables of an application lie in one folder and stay until it is cleared, as results are read from them."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in whatever store holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has left in the shared folder; to be called when the results are written."""
    remove(spark, shared_dir(spark))


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added where a column is called so already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(columns: list[str], *names: str | None) -> list[str]:
    """The columns that are not called as one of the names; capitals don't count, as for Spark."""
    gone = {name.lower() for name in names if name}
    return [c for c in columns if c.lower() not in gone]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


_caches: list[weakref.ref] = []


def alone(cache: dict) -> dict:
    """The cache, with the others of this worker emptied: stages after each other share workers, and their memory."""
    others = [c for r in _caches if (c := r()) is not None and c is not cache]
    for other in others:
        other.clear()
    _caches[:] = [weakref.ref(c) for c in (*others, cache)]
    return cache


def forget() -> None:
    """Empties the caches that other stages have left in this worker."""
    for r in _caches:
        if (cache := r()) is not None:
            cache.clear()
    _caches.clear()


def release() -> None:
    """Gives memory that this worker has freed back to the system: workers live on between stages, beside the JVM that then needs it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def releasing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that ends with release(), when nothing of its own is held any more."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        release()

    return run


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts after each other, and the number of words of each text.

    A-Z are lower-cased; words are runs of other bytes than ASCII white space, which bytes.split() cuts at.
    """
    forget()
    parts = [b"".join(map(xxhash.xxh64_digest, t.lower().split())) if t else b"" for t in texts]  # faster than looking words up
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64), np.fromiter(map(len, parts), np.int64, len(parts)) // 8


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary(values: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string array."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
