"""Session-level helpers: written intermediate tables, arrow rows, tokenizer loading."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is read from the session. Without one, a local session (tests) uses a temporary folder of this
    machine for the operator's tables; on a cluster that is an error, as executors would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lexispark-")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session while the block runs; dots are written as two underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage in a way that survives lost executors, and gives later joins a size that
    Spark knows, so that it broadcasts by that size only and can split skewed partitions. Shuffle files
    of the job go when it has ended; ``forget`` removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexispark/{name}-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexispark_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Remove tables that ``written`` made, once all that reads them has been written itself."""
    for table in tables:
        path = getattr(table, "_lexispark_path", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def tokenizer_path() -> str:
    """Place of the default vocabulary; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(texts: list[str | None], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts sum to about ``limit`` characters, one row at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


MAP_BITS = 27


def bitmap(keys: DataFrame, key: str) -> bytes:
    """2^27 bits, whatever the input: the one at ``key`` modulo that is set for each long ``key``.

    The map tells what to send or read; a bit that other keys share costs work, never a result.
    """
    place = F.expr(f"pmod({key}, {1 << MAP_BITS}L)")
    words = keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({key}, {1 << MAP_BITS}L) & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)
    return (bits.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of long columns."""
    turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    h = np.full(len(columns[0]), 42, dtype=np.uint64)
    for c in columns:
        h = h + _P5 + np.uint64(8)
        h ^= turn(c.view(np.uint64) * _P2, 31) * _P1
        h = turn(h, 27) * _P1 + _P4
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def short_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, for whole texts; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")


def _give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """``run`` for Python workers that Spark goes on using: each begins and ends without the memory of what ran before."""

    def whole(batches):
        _give_back()
        yield from run(batches)
        _give_back()

    return whole
