"""Byte-level BPE with content-defined chunk reuse.

1. Texts are cut where a rolling hash of the last 32 bytes falls under a threshold, so that passages
   which documents share give the same chunks wherever they stand.
2. Chunk keys are counted over the corpus. Keys that occur twice or more set a bit in a map of fixed
   size; the map only decides what is worth sharing, never what the result is.
3. A second scan encodes what is not shared, together with the joins: from the last safe place of one
   shared chunk to the first safe place of the next. Shared chunks leave as references, their texts
   once per task.
4. Every shared chunk is encoded once, joined to its references, and the documents are put together.
   The ids of a chunk must have a token boundary at both ends of the part that is used; where they
   haven't, its text is re-encoded together with both neighbours, and on to theirs where those don't
   agree either, until all parts do.

A safe place is a space or line feed after a character that is no white space: no pre-token reaches over it,
so the ids on either side depend on that side alone. Scripts without spaces have few, and share little.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAP_BITS, bitmap, short_batches, tokenizer_path, written

WINDOW = 32
#: Chunk keys that a task remembers as sent already; beyond that it forgets them and may send again.
SEEN = 200_000


@lru_cache(maxsize=4)
class Codec:
    """The tokenizer file's ids by a faster encoder of the same merges."""

    def __init__(self, path: str):
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(alphabet[c] for c in token)
        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.names = [str(i) for i in range(len(self.bytes))]
        self.dtype = np.dtype("<u2") if len(self.bytes) <= 1 << 16 else np.dtype("<u4")
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> list[int]:
        if self._split is None or not any(s in text for s in self.special):
            return self._plain.encode_ordinary(text)
        out: list[int] = []
        for part in self._split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain.encode_ordinary(part)
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def ids_digest(self, ids) -> str:
        return hashlib.sha256(",".join(map(self.names.__getitem__, ids)).encode()).hexdigest()

    def text_digest(self, ids) -> str:
        return hashlib.sha256(self.decode(ids).encode()).hexdigest()


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE files: bytes without a printable form follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in shown}, 256
    for b in range(256):
        if chr(b) not in table or b not in shown:
            table[chr(extra)] = b
            extra += 1
    return table


_TABLE = np.random.default_rng(20240229).integers(1, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes, average: int, least: int) -> list[int]:
    """Ends of the chunks of ``data``; never inside a code point."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    a = np.frombuffer(data, np.uint8)
    h, span, power = _TABLE[a], 1, 0x9E3779B1
    while span < WINDOW:
        h[span:] = h[span:] + h[:-span] * np.uint32(power)
        span, power = span * 2, power * power & 0xFFFFFFFF
    ends, last = [], 0
    for p in (np.flatnonzero(h < (1 << 32) // average) + 1).tolist():
        while p < n and data[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= least and p < n:
            ends.append(p)
            last = p
    return [*ends, n]


def _safe(data: bytes) -> np.ndarray:
    """Safe places of ``data``."""
    a = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(((a[1:] == 32) | (a[1:] == 10)) & (a[:-1] > 32) & (a[:-1] != 127)) + 1
    wide = at[a[at - 1] > 127]
    if not len(wide):
        return at
    # white space beyond ASCII: U+85, U+A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    p1, p2, p3 = a[wide - 1], a[wide - 2], a[np.maximum(wide - 3, 0)]
    blank = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
    blank |= (p3 == 0xE2) & ((p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) | (p2 == 0x81) & (p1 == 0x9F))
    return np.setdiff1d(at, wide[blank])


def _keys(average: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for text in batch.column(0).to_pylist():
                data, begin = (text or "").encode(), 0
                for end in cuts(data, average, least):
                    found.append(xxhash.xxh3_64_intdigest(data[begin:end]) - (1 << 63))
                    begin = end
            keys, counts = np.unique(np.array(found, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], ["key", "n"])

    return run


def _shared_map(docs: DataFrame, text: str, average: int, least: int) -> bytes:
    """A bit for each key (modulo the map) that occurs twice or more. 2^27 bits, whatever the input."""
    keys = docs.select(text).mapInArrow(_keys(average, least), "key long, n long")
    twice = keys.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    return bitmap(twice, "key")


_SCAN = "kind int, row long, doc_id long, seq int, key binary, lo int, hi int, payload binary, sizes array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _scan(path: str, shared, average: int, least: int):
    """Rows of kind 0: a finished document; 1: what a document has beside shared chunks; 2: a reference;
    3: the text of a shared chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        codec, bits = Codec(path), np.frombuffer(shared.value, np.int64)
        pack = zstandard.ZstdCompressor(level=3).compress
        row, seen = TaskContext.get().partitionId() << 40, set()
        rows: list[tuple] = []

        def document(doc_id, data: bytes) -> None:
            begin, refs = 0, []
            ends = cuts(data, average, least)
            safe = None
            for end in ends:
                part = data[begin:end]
                slot = (xxhash.xxh3_64_intdigest(part) - (1 << 63)) % (1 << MAP_BITS)
                if bits[slot >> 6] >> (slot & 63) & 1:
                    safe = _safe(data) if safe is None else safe
                    # the document's own ends are safe as well
                    lo = 0 if begin == 0 else safe[k] if (k := np.searchsorted(safe, begin + 1)) < len(safe) else end
                    hi = end if end == len(data) else safe[k] if (k := np.searchsorted(safe, end) - 1) >= 0 else begin
                    if hi - lo > least // 2 and hi <= end:
                        refs.append((begin, int(lo), int(hi), part))
                begin = end
            if not refs:
                ids = codec.encode(data.decode())
                rows.append((0, row, doc_id, None, None, None, None, None, None, len(ids), codec.ids_digest(ids), codec.text_digest(ids)))
                return
            at, own, sizes = 0, [], []
            for seq, (begin, lo, hi, part) in enumerate(refs):
                ids = codec.encode(data[at:lo].decode()) if lo > at else []
                own += ids
                sizes.append(len(ids))
                key = xxhash.xxh3_128_digest(part)
                rows.append((2, row, doc_id, seq, key, lo - begin, hi - begin, None, None, None, None, None))
                if key not in seen:
                    seen.add(key)
                    rows.append((3, None, None, None, key, None, None, pack(part), None, None, None, None))
                at = hi
            ids = codec.encode(data[at:].decode()) if at < len(data) else []
            sizes.append(len(ids))
            rows.append((1, row, doc_id, -1, None, None, None, pack(np.array(own + ids, codec.dtype).tobytes()), sizes, None, None, None))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                document(doc_id, (text or "").encode())
                row += 1
                if len(rows) >= 4096:
                    yield _rows(rows)
                    rows = []
                if len(seen) > SEEN:
                    seen.clear()
            if rows:
                yield _rows(rows)
                rows = []

    return run


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _rows(rows: list[tuple], schema: str = _SCAN) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for (_, t), c in zip(fields, zip(*rows, strict=True), strict=True)], [n for n, _ in fields])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec, pack, unpack = Codec(path), zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            out = [pack(np.array(codec.encode(unpack(t).decode()), codec.dtype).tobytes()) for t in texts]
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.binary())], ["key", "chunk_ids"])

    return run


def joined(codec: Codec, own: np.ndarray, sizes: list[int], parts: list[tuple[int, int, np.ndarray]]) -> tuple[list[int], int]:
    """Ids of a document of ``own`` stretches and shared chunks in turn, and how many chunks had to be re-encoded.

    Of a chunk the bytes ``lo`` to ``hi`` count. If its ids have no boundary there, they are re-encoded with the
    stretches on both sides; neighbouring chunks that don't agree either are taken in as well.
    """
    ends = np.cumsum([0, *sizes])
    out: list[int] = []
    text = b""
    repaired = 0
    for k in range(len(sizes)):
        stretch = own[ends[k] : ends[k + 1]].tolist()
        found = None
        if k < len(parts):
            lo, hi, ids = parts[k]
            edges = np.concatenate([[0], np.cumsum(codec.lengths[ids])])
            i, j = np.searchsorted(edges, [lo, hi])
            if j < len(edges) and edges[i] == lo and edges[j] == hi:
                found = ids[i:j].tolist()
        if k < len(parts) and found is None:
            # begins, or goes on with, a text to encode as one
            text += codec.decode_bytes(stretch) + codec.decode_bytes(ids.tolist())[lo:hi]
            repaired += 1
            continue
        if text:
            out += codec.encode((text + codec.decode_bytes(stretch)).decode())
            text = b""
        else:
            out += stretch
        out += found or []
    return out, repaired


def _assemble(path: str):
    """Rows sorted by document: first what the document has itself, then its chunks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec, unpack = Codec(path), zstandard.ZstdDecompressor().decompress

        def ids_of(payload: bytes) -> np.ndarray:
            return np.frombuffer(unpack(payload), codec.dtype)

        def finish(doc_id, own, sizes, parts) -> tuple:
            ids, repaired = joined(codec, own, sizes, [(lo, hi, ids_of(payload)) for lo, hi, payload in parts])
            return doc_id, len(ids), codec.ids_digest(ids), codec.text_digest(ids), len(parts), repaired

        now, rows = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if x["seq"] == -1:
                    if now:
                        rows.append(finish(*now))
                    now = (x["doc_id"], ids_of(x["payload"]), x["sizes"], [])
                else:
                    now[3].append((x["lo"], x["hi"], x["payload"]))
            if len(rows) >= 1024:
                yield _rows(rows, _RESULT)
                rows = []
        if now:
            rows.append(finish(*now))
        if rows:
            yield _rows(rows, _RESULT)

    return run


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, shared_chunks int, repaired_chunks int"


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", average: int = 512, least: int = 64) -> DataFrame:
    """Encode whole texts and decode them again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and how many shared
    chunks the document has and how many of these were re-encoded (``shared_chunks, repaired_chunks``).

    One row per input row, also for repeated rows and ids and for null ids. A null text counts as
    empty: no token, digests of the empty string. An empty table gives an empty result. Columns beside
    ``id_col`` and ``text_col`` are not read.
    """
    path, spark = path or tokenizer_path(), docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(_shared_map(docs, "text", average, least))
    rows = written(docs.mapInArrow(_scan(path, shared, average, least), _SCAN), "bpe-scan")
    texts = rows.filter("kind = 3").groupBy("key").agg(F.first("payload").alias("payload"))
    encoded = written(texts.mapInArrow(_encode(path), "key binary, chunk_ids binary"), "bpe-chunks")
    own = rows.filter("kind = 1").select("row", "doc_id", "seq", "lo", "hi", "payload", "sizes")
    refs = rows.filter("kind = 2").select("row", "doc_id", "seq", "key", "lo", "hi").join(encoded, "key").select("row", "doc_id", "seq", "lo", "hi", F.col("chunk_ids").alias("payload"), F.lit(None).cast("array<int>").alias("sizes"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = own.unionByName(refs).repartition(n, "row").sortWithinPartitions("row", "seq")
    alone = rows.filter("kind = 0").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.lit(0).alias("shared_chunks"), F.lit(0).alias("repaired_chunks"))
    return alone.unionByName(whole.mapInArrow(_assemble(path), _RESULT))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of whole texts, row by row; null texts are empty, null and repeated ids stay. An empty
    table gives an empty result."""
    path = path or tokenizer_path()

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``, row by row; null ids give an empty text. An empty table gives an empty result."""
    path = path or tokenizer_path()

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
