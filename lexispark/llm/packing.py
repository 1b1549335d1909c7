"""Packing: concatenate and cut.

A first pass encodes every document, and gives each the running token total of its partition; the rows
are written. Totals by partition are summed to bases, so that base plus running total is a document's
place in the whole concatenation. Fixed windows over those places are the sequences; a document that
crosses a window's edge gives one piece on each side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Codec
from .common import short_batches, tokenizer_path, written

_ENCODED = "part long, doc_id long, first long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continues boolean"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        codec, pack = Codec(path), zstandard.ZstdCompressor(level=1).compress
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            first, lengths, packed = [], [], []
            for text in batch.column(1).to_pylist():
                own = codec.encode(text or "")
                own.append(end_id)
                packed.append(pack(np.array(own, codec.dtype).tobytes()))
                first.append(total)
                lengths.append(len(own))
                total += len(own)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array(first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(packed, pa.binary())], ["part", "doc_id", "first", "n_tokens", "ids"])

    return run


def _pieces(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec, unpack = Codec(path), zstandard.ZstdDecompressor().decompress
        names = [f.split(" ")[0] for f in _PIECES.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, place, total, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(unpack(packed), codec.dtype).astype("<u4")
                at = 0
                while at < total:
                    sequence, offset = divmod(place + at, window)
                    length = min(total - at, window - offset)
                    out.append((doc_id, at, length, zlib.crc32(ids[at : at + length].tobytes()), total, sequence, offset, at + length < total))
                    at += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, continues, padded_length``.

    A null text is empty: its document is the end token alone. Repeated rows are packed as often as they
    stand; null ids stay null. Only the last sequence may be short: ``padded_length`` is ``window``,
    or the sequence's own length where that is a power of two. An empty table gives no piece. Columns
    beside ``id_col`` and ``text_col`` are not read.
    """
    path = path or tokenizer_path()
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = written(docs.mapInArrow(_encode(path, end_id), _ENCODED), "packing")
    # one row per task of the scan
    sums = encoded.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that Spark knows the size and needn't shuffle the ids to meet it
    bases = written(sums.select("part", "part_tokens", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base")), "packing-bases")
    total = bases.agg(F.sum("part_tokens")).first()[0] or 0
    last, rest = divmod(total, window)
    padded = rest if rest & (rest - 1) == 0 else window
    placed = encoded.join(bases.drop("part_tokens"), "part").select("doc_id", (F.col("base") + F.col("first")).alias("place"), "n_tokens", "ids")
    pieces = placed.mapInArrow(_pieces(path, window), _PIECES)
    return pieces.withColumn("padded_length", F.when(F.col("sequence_id") == last, F.lit(padded)).otherwise(F.lit(window)).cast("long"))
