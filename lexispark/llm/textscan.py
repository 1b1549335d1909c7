"""Vectorised words of whole texts: 64-bit hashes with the document and line that each stands in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z as a-z, and every space byte as a space.
_PLAIN = bytes(32 if b in (32, *range(9, 14)) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = np.random.default_rng(77051).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[32] = 0
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 19, 1 << (n - 1).bit_length())
        _powers[:] = [np.full(size, b & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64) for b in (_BASE, _BASE_INVERSE)]
        for p in _powers:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> list[bytes | None]:
    """The bytes of each text, which ``words`` takes without decoding and encoding them."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def words(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash, document, line`` of each word in order; bytes are taken as UTF-8.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
    return; A-Z count as a-z. Lines end at line feeds. The hash is a polynomial over random 64-bit
    letters, mixed; the powers and sums are taken over the whole buffer, where spaces count 0, and
    divided out at each word's start.
    """
    parts = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
    joined = b"\n".join(parts)
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if not joined:
        return none
    a = np.frombuffer(joined.translate(_PLAIN), np.uint8)
    space = a == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[int(not space[0]) :: 2] if len(edge) else edge
    if not space[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return none
    up, down = _power_tables(len(a))
    product = _LETTER[a]
    product *= up[: len(a)]
    np.add.accumulate(product, out=product)
    sums = np.diff(product[np.append(starts[1:], len(a)) - 1], prepend=np.uint64(0))
    h = mix(sums * down[starts])
    begins = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    # borders are few and words many: look up the borders
    counted = lambda borders: np.diff(np.concatenate([[0], np.searchsorted(starts, borders), [len(starts)]]))
    doc = np.repeat(np.arange(len(parts)), counted(begins[1:]))
    feeds = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
    line = np.repeat(np.arange(len(feeds) + 1), counted(feeds)) - np.searchsorted(feeds, begins)[doc]
    return h, doc, line


_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text; all words as one shingle where
    there are fewer; empty without words."""
    h, doc, _ = words(texts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out, n = [], len(h)
    if n >= size:
        rolled = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            rolled += h[k : n - size + 1 + k] * _PLACE[k]
        rolled = mix(rolled)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= size:
            out.append(np.unique(rolled[begin : end - size + 1]))
        elif end > begin:
            k = end - begin
            whole = (h[begin:end] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k)
            out.append(mix(whole))
        else:
            out.append(np.empty(0, np.uint64))
    return out
