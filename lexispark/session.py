"""Tables that are made once: fixed vocabularies, and intermediate results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a job go when its table has been written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fixed: dict[tuple[str, str], DataFrame] = {}


def fixed(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that the language alone bounds (20,000 rows at most): made once for a session, then a local
    relation whose size Spark knows."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _fixed:
        _fixed[key] = spark.createDataFrame(make().toArrow())
    return _fixed[key]


@lru_cache(maxsize=1)
def _local_dir() -> str:
    """For local sessions (tests) that name no folder."""
    return "file://" + tempfile.mkdtemp(prefix="lexispark-")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in ``spark.checkpoint.dir``: cuts the plan, survives lost executors, has a known size."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dir()
    path = f"{found.rstrip('/')}/lexispark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_BITS = 24


def word_bitmap(words: DataFrame, column: str) -> bytes:
    """2^24 bits (2 MB), whatever the input, for ``in_bitmap``: a bit that other words share costs work, never a result."""
    places = words.select(F.crc32(F.col(column).cast("binary")).alias("h")).select(F.expr(f"h % {1 << _BITS}").alias("h"))
    found = places.select(F.shiftright("h", 3).alias("at"), F.expr("shiftleft(1, cast(h % 8 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 3), np.uint8)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def in_bitmap(bits: bytes, word: str) -> bool:
    h = crc32(word.encode()) & ((1 << _BITS) - 1)
    return bool(bits[h >> 3] >> (h & 7) & 1)
