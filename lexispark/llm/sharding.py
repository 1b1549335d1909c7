"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number from the key and itself; a record goes to the shard with the largest
-weight / ln(u). A further shard changes the place only of records for which it draws the largest.
Slots come from two passes: running counts by scan task and shard, then bases from the tasks' totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of a key; null keys count as one key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def draw(k: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53)
        return -F.lit(float(weights[k])) / F.log(u)

    best = F.greatest(*[F.struct(draw(k).alias("draw"), F.lit(-k).alias("k")) for k in range(len(weights))]) if len(weights) > 1 else F.struct(F.lit(0).alias("k"))
    return (-best["k"]).cast("int")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, counts = TaskContext.get().partitionId(), np.zeros(0, dtype=np.int64)
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
        if not len(shard):
            continue
        counts = np.concatenate([counts, np.zeros(max(0, shard.max() + 1 - len(counts)), dtype=np.int64)])
        order = np.argsort(shard, kind="stable")
        ordered = shard[order]
        first = np.searchsorted(ordered, ordered)
        within = np.empty(len(shard), dtype=np.int64)
        within[order] = np.arange(len(shard)) - first + counts[ordered]
        counts += np.bincount(shard, minlength=len(counts))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, dtype=np.int64)), pa.array(within)], [*batch.schema.names, "part", "within"])


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown_weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``shard`` follows from the id and the weights alone; ``grown_shard`` is the shard with one more (of
    weight 1, or ``grown_weights``). ``size`` is the text's bytes plus 1; a null text has size 1 and counts
    as empty for the checksum. Rows that share an id share their shard but have slots of their own, so do
    rows with null ids, which count as one key. Slots run from 0 without gaps in each shard; their order
    is that of the scan. An empty table gives an empty result. Columns beside ``id_col`` and ``text_col`` are not read.
    """
    grown = list(grown_weights or [*weights, 1.0])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), weights)).withColumn("grown_shard", shard_of(F.col("doc_id"), grown))
    shape = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part long, within long"
    rows = written(rows.mapInArrow(_numbered, shape), "sharding")
    totals = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = rows.join(bases, ["part", "shard"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("within")).alias("slot"), "grown_shard")
