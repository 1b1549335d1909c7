"""Line dedup by an exact set-similarity join.

Tokens are ordered from rare to common by counts over the whole corpus, kept in a table of fixed size by
token hash; tokens that share a place there are ordered by their hash, so that the order is the same
everywhere and the filters stay exact. Two lines whose Jaccard similarity reaches the threshold share a
token in the prefixes of that order (prefix filter), at places that leave enough tokens behind
(positional filter), and have lengths within the threshold (length filter). Each line also has 64 bits
of token parity, and long ones up to 512, which fold to fewer: two lines differ in at least as many tokens as in bits. What passes is verified on all
tokens. Lines of equal token sets are one class, which its first line stands for; where one word more or
less is below the threshold already (up to 3 words at 80 %), only the class can match, and it has no prefix.

A line goes if an earlier line, by (document, line), has a similar set. For each of its prefix tokens a
line keeps its likeliest earlier lines, up to ``PARTNERS``; one that had more and found no match goes
through all of them in a second pass. So a group of copies costs its size, not its square.

The scan drops what repeats within a task before anything moves, and packs the rest by destination:
classes by their hash, prefix tokens by the token, one column after the other. Tokens that are common in the corpus
go another way, as rows that are counted first and dealt out as pairs of blocks of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, forget, in_bitmap, short_batches, slices, trimmed, written, xxhash64
from .textscan import mix, utf8, words

COUNT_BITS, RANGE_BITS = 24, 14
#: Candidates of a line for one token in the first pass; the second has no limit.
PARTNERS = 8
#: Lines of a common token in one block.
BLOCK = 1 << 14
#: Tokens from this level on, 2^20 occurrences, are common.
COMMON_LEVEL = 8 * 20
#: Lines of a task that are put together before they are packed.
HELD = 1 << 15
#: Lines of more distinct words than these have 2, 4 and 8 words of parity.
WIDE = (80, 200, 440)
#: Words of the corpus for one partition of prefix tokens, of which a line has a fifth of its words at most.
WORDS_EACH = 5_000_000
_TIE = (1 << 24) - 1
_PROBE = 1 << 30
#: Kinds of rows; prefix tokens have one more for each level of parity.
_GONE, _CLASS, _COMMON, _PAIR, _POSTING = range(5)


def _tie(texts: list[str | bytes | None]) -> np.ndarray:
    """24 bits of the text: tells rows that share an id apart."""
    return np.array([xxhash.xxh3_64_intdigest(t or b"") & _TIE for t in texts], dtype=np.int64)


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns))


def _unpacked(blobs: list[bytes], *kinds) -> list[np.ndarray]:
    import zstandard

    unpack, sizes = zstandard.ZstdDecompressor().decompress, [np.dtype(k).itemsize for k in kinds]
    parts: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for blob in blobs:
        a, at = np.frombuffer(unpack(blob), np.uint8), 0
        n = len(a) // sum(sizes)
        for out, kind, size in zip(parts, kinds, sizes, strict=True):
            out.append(np.ascontiguousarray(a[at : at + n * size].reshape(size, n).T).view(kind).ravel())
            at += n * size
    return [np.concatenate(p) for p in parts]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # short numbers, and those that outgrow them apart
    total, large = np.zeros(1 << COUNT_BITS, dtype=np.uint16), {}
    for batch in batches:
        texts = utf8(batch.column(0))
        for i, j in slices(texts):
            at, n = np.unique(_place(words(texts[i:j])[0]), return_counts=True)
            now = total[at] + n
            for k in np.flatnonzero(now > 0xFFFF).tolist():
                large[int(at[k])] = large.get(int(at[k]), 0) + int(now[k])
                now[k] = 0
            total[at] = now.astype(np.uint16)
    rest: dict[int, list[int]] = {}
    for at in large:
        rest.setdefault(at >> RANGE_BITS, []).append(at)
    for k, part in enumerate(total.reshape(-1, 1 << RANGE_BITS)):
        if k in rest:
            part = part.astype(np.uint32)
            for at in rest[k]:
                part[at & (1 << RANGE_BITS) - 1] += large[at]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(at.astype(np.uint16), part[at].astype(np.uint32))], pa.binary())], ["range", "data"])


def _as_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, n = _unpacked([data], np.uint16, np.uint32)
            totals.setdefault(k, np.zeros(1 << RANGE_BITS, np.int64))[at] += n
    for k, n in totals.items():
        level = np.where(n > 1, np.minimum(255, np.floor(8 * np.log2(np.maximum(n, 1)))), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["range", "words", "levels"])


def _levels(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Rarity of each place as a byte: 0 for one occurrence, else a step for each eighth of a doubling. And all words."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("text").mapInArrow(trimmed(_counts), "range int, data binary")
    table = packed.repartition(n, "range").mapInArrow(trimmed(_as_levels), "range int, words long, levels binary").toArrow()
    out = np.zeros((1 << (COUNT_BITS - RANGE_BITS), 1 << RANGE_BITS), dtype=np.uint8)
    for k, levels in zip(table.column("range").to_pylist(), table.column("levels").to_pylist(), strict=True):
        out[k] = np.frombuffer(levels, np.uint8)
    return out.ravel(), sum(table.column("words").to_pylist())


def _token_sets(texts: list[str | bytes | None], levels: np.ndarray, asked=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: document, line, first and last place in ``tokens``; distinct tokens, rare first.

    With ``asked`` only lines with a token that it tells.
    """
    h, doc, line = words(texts)
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])])) if len(h) else h
    if asked is not None and len(h):
        wanted = np.logical_or.reduceat(asked(h), new)
        every = np.repeat(wanted, np.diff(np.concatenate([new, [len(h)]])))
        h, doc, line = h[every], doc[every], line[every]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])])) if len(h) else h
    if not len(h):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    group = np.repeat(np.arange(len(new)), np.diff(np.concatenate([new, [len(h)]])))
    level = levels[_place(h)].astype(np.uint64)
    if len(new) < 1 << 16:
        # ties in 40 bits of the hash are put right below, where they matter
        order = np.argsort(group.astype(np.uint64) << np.uint64(48) | level << np.uint64(40) | h >> np.uint64(24))
        t, g = h[order], group[order]
        if np.any((t[1:] != t[:-1]) & (t[1:] >> np.uint64(24) == t[:-1] >> np.uint64(24)) & (g[1:] == g[:-1])):
            order = np.lexsort((h, level, group))
    else:
        order = np.lexsort((h, level, group))
    h, g = h[order], group[order]
    keep = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
    h, g = h[keep], g[keep]
    first = np.searchsorted(g, np.arange(len(new)))
    return doc[new], line[new], first, np.concatenate([first[1:], [len(h)]]), h


def _wide_parity(n: np.ndarray, first: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level of each line, and for the long ones all words of parity but the first."""
    level = np.searchsorted(np.array(WIDE), n).astype(np.int8)
    out = np.zeros((len(n), (1 << len(WIDE)) - 1), np.uint64)
    for k in range(1, len(WIDE) + 1):
        of = np.flatnonzero(level == k)
        if len(of):
            size = n[of]
            begin = np.cumsum(size) - size
            t = tokens[np.repeat(first[of] - begin, size) + np.arange(size.sum())]
            bit, word = np.uint64(1) << (t & np.uint64(63)), (t >> np.uint64(6)) & np.uint64((1 << k) - 1)
            for w in range(1, 1 << k):
                out[of, w - 1] = np.bitwise_xor.reduceat(np.where(word == np.uint64(w), bit, np.uint64(0)), begin)
    return level, out


def _folded(level: np.ndarray, parity: np.ndarray, wide: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the row of each line among those that reach it, and the words of these."""
    top = len(WIDE)
    out: list = [None] * (top + 1)
    for k in range(top, 0, -1):
        own = np.flatnonzero(level == k)
        rest = wide[own, : (1 << k) - 1]
        words_ = np.concatenate([(parity[own] ^ np.bitwise_xor.reduce(rest, axis=1))[:, None], rest], axis=1)
        if k < top:
            above, w = out[k + 1]
            at = np.flatnonzero(above >= 0)
            own, words_ = np.concatenate([own, at]), np.concatenate([words_, (w[:, : 1 << k] ^ w[:, 1 << k :])[above[at]]])
        place = np.full(len(level), -1, np.int64)
        place[own] = np.arange(len(own))
        out[k] = (place, words_)
    return out


def _by_bucket(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """Rows of one kind, packed for each bucket; within one they keep their order."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    return [(int(bucket[i]), kind, _pack(*(c[order[i:j]] for c in columns))) for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]


def _scan(shared, percent: int, least: int, n_buckets: int, second: bool):
    """``bucket, kind, data``: lines that repeat an earlier one of the task, classes, prefix tokens.

    In the second pass only prefix tokens that are asked for, of lines that have one; the lines that ask are marked.
    """

    common_level, most = COMMON_LEVEL, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        levels = np.frombuffer(shared.value[0], np.uint8)
        asked = probes = None
        if second:
            tokens_asked, probes = (np.frombuffer(x, np.int64) for x in shared.value[1:])
            asked = lambda h: in_bitmap(tokens_asked, (h >> np.uint64(32)).view(np.int64))
        turn = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, ...]] = []
        posted_of: list[tuple[np.ndarray, ...]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            s0, s1, doc, spot, n, parity, level, wide = (np.concatenate(c) for c in zip(*held, strict=True))
            token, place, at = (np.concatenate(c) for c in zip(*posted_of, strict=True))
            held.clear()
            posted_of.clear()
            order = np.lexsort((spot, doc, s1, s0))
            first = np.ones(len(order), dtype=bool)
            first[order[1:]] = (s0[order[1:]] != s0[order[:-1]]) | (s1[order[1:]] != s1[order[:-1]])
            out = []
            if not second:
                gone = np.flatnonzero(~first)
                if len(gone):
                    out.append((turn % n_buckets, _GONE, _pack(doc[gone], spot[gone])))
                    turn += 1
                one = order[first[order]]
                out += _by_bucket(_CLASS, (s0[one] % np.uint64(n_buckets)).astype(np.int32), [s0[one], s1[one], doc[one], spot[one]])
            mine = first[at]
            token, place, at = token[mine], place[mine], at[mine]
            group = (token >> np.uint64(32)).astype(np.uint32)
            common = levels[_place(token)] >= common_level
            for kind, rows in ((_COMMON, np.flatnonzero(common)), *((_POSTING + w, np.flatnonzero(~common & (level[at] == w))) for w in range(len(WIDE) + 1))):
                rows = rows[np.argsort(group[rows], kind="stable")]
                k = at[rows]
                bucket = s0[k] % np.uint64(n_buckets) if kind == _COMMON else group[rows] % np.uint32(n_buckets)
                more = [] if kind == _COMMON else [wide[k, w] for w in range((1 << kind - _POSTING) - 1)]
                out += _by_bucket(kind, bucket.astype(np.int32), [group[rows], s0[k], doc[k], spot[k], n[k], place[rows], parity[k], *more])
            for i in range(0, len(out), 64):
                b, k, data = zip(*out[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])

        size = 0
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            ties = _tie(texts)
            for i, j in slices(texts):
                doc, line, first, last, tokens = _token_sets(texts[i:j], levels, asked)
                n = last - first
                kept = n >= least
                if not kept.any():
                    continue
                s0, s1 = (np.add.reduceat(mix(x), first)[kept] for x in (tokens, tokens ^ np.uint64(0x5851F42D4C957F2D)))
                parity = np.bitwise_xor.reduceat(np.uint64(1) << (tokens & np.uint64(63)), first)[kept]
                # n of n + 1 words are the likest that another set can be
                prefix = np.where(kept & (100 * n >= percent * (n + 1)), n + (-n * percent // 100) + 1, 0)
                at = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                of = np.repeat(np.arange(len(n)), prefix)
                token = tokens[first[of] + at]
                posted = levels[_place(token)] > 0
                if second:
                    posted &= asked(token)
                token, at, of = token[posted], at[posted], of[posted]
                number = np.cumsum(kept) - 1
                d = doc[kept] + i
                id_, spot = ids[d].astype(np.int64), line[kept] << 24 | ties[d]
                mark = in_bitmap(probes, xxhash64(id_, spot)) if second else np.ones(len(d), dtype=bool)
                held.append((s0, s1, id_, spot, n[kept].astype(np.int32), parity, *_wide_parity(n[kept], first[kept], tokens)))
                posted_of.append((token, np.minimum(at, _PROBE - 1).astype(np.int32) | np.where(mark[number[of]], _PROBE, 0).astype(np.int32), size + number[of]))
                size += len(d)
                if size >= most:
                    yield from packed()
                    size = 0
        if held:
            yield from packed()

    return trimmed(run)


def _within(percent: int, c: dict[str, np.ndarray]):
    """Which pairs of rows the filters leave, and in how many bits they differ; the cheap test comes first."""
    n, parity, place = c["n"], c["parity"], c["place"]
    folded = _folded(c["level"], parity, c["wide"])[1:] if "level" in c else []

    def test(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        differ = np.bitwise_count(parity[x] ^ parity[y])
        ok = np.flatnonzero(differ.astype(np.int32) * np.int32(100 + percent) <= np.int32(100 - percent) * (n[x] + n[y]))
        x, y, differ = x[ok], y[ok], differ[ok].astype(np.int32)
        for place_of, words_ in folded:
            a, b = place_of[x], place_of[y]
            both = np.flatnonzero((a >= 0) & (b >= 0))
            if not len(both):
                break
            differ[both] = np.bitwise_count(words_[a[both]] ^ words_[b[both]]).sum(1, dtype=np.int32)
            ok = np.flatnonzero(differ * np.int32(100 + percent) <= np.int32(100 - percent) * (n[x] + n[y]))
            x, y, differ = x[ok], y[ok], differ[ok]
        behind = np.minimum(n[x] - place[x], n[y] - place[y]).astype(np.int64)
        both = n[x].astype(np.int64) + n[y]
        ok = (100 * n[x].astype(np.int64) >= percent * n[y].astype(np.int64)) & (100 * n[y].astype(np.int64) >= percent * n[x].astype(np.int64)) & (behind * (100 + percent) >= percent * both)
        return x[ok], y[ok], differ[ok], 2 * differ[ok] * (100 + percent) <= (100 - percent) * both[ok]

    return test


def _meet(c: dict[str, np.ndarray], percent: int, limit: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row and earlier ones of its group, ``x, y, differ, complete``, of rows sorted by group, document and spot.

    ``probe``: whether the row looks for earlier lines; ``side``, if given: rows of a pair of two blocks
    meet only the other side. The likeliest ``limit`` are kept, or all; ``complete`` tells if
    these are all. Once a row has so many that differ in half of what they may, it looks no further.
    """
    test, side = _within(percent, c), c.get("side")
    everything, limit = limit is None, limit or len(c["group"])
    new = np.flatnonzero(np.concatenate([[True], c["group"][1:] != c["group"][:-1]]))
    size = np.diff(np.concatenate([new, [len(c["group"])]]))
    out: list = []
    stopped = np.zeros(len(c["group"]), dtype=bool)

    def apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if side is None:
            return x, y
        ok = (side[x] != side[y]) | (side[x] == 0)
        return x[ok], y[ok]

    # small groups together, by the distance of the rows
    rank = np.arange(len(stopped)) - np.repeat(new, size)
    at = np.flatnonzero(np.repeat((size <= 64) & (size > 1), size) & (rank > 0) & c["probe"])
    d = 1
    while len(at):
        out.append(test(*apart(at, at - d))[:3])
        d += 1
        at = at[rank[at] >= d]
    for begin, n in zip(new[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        for i in range(begin, begin + n, 1024):
            x = np.arange(i, min(i + 1024, begin + n))
            x = x[c["probe"][x]]
            likely = np.zeros(1024, dtype=np.int64)
            for j in range(begin, i + 1, 1024):
                if not len(x):
                    break
                y = np.arange(j, min(j + 1024, begin + n))
                a, b = np.repeat(x, len(y)), np.tile(y, len(x))
                if j == i:
                    a, b = a[b < a], b[b < a]
                a, b, differ, near = test(*apart(a, b))
                out.append((a, b, differ))
                if not everything and j < i:
                    likely += np.bincount(a[near] - i, minlength=1024)
                    enough = likely[x - i] >= limit
                    stopped[x[enough]] = True
                    x = x[~enough]
    none = np.empty(0, np.int64)
    x, y, differ = (np.concatenate(p) for p in zip((none, none, none.astype(np.int32)), *out, strict=True))
    order = np.lexsort((y, differ, x))
    x, y, differ = x[order], y[order], differ[order]
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else none
    n = np.diff(np.concatenate([begin, [len(x)]]))
    keep = np.arange(len(x)) - np.repeat(begin, n) < limit
    return x[keep], y[keep], differ[keep], (np.repeat(n <= limit, n) & ~stopped[x])[keep]


_MET = "kind int, token long, x_doc long, x_spot long, y_doc long, y_spot long, differ int, complete boolean"
_POSTED = (np.uint32, np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint64)


def _met(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in _MET.split(", ")]
    for i in range(0, len(columns[0]), 1 << 15):
        part = [c[i : i + (1 << 15)] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *(pa.array(c) for c in part)], names)


def _paired(c: dict[str, np.ndarray], percent: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    x, y, differ, complete = _meet(c, percent, limit)
    yield from _met(_PAIR, c["group"][x].astype(np.int64), c["doc"][x], c["spot"][x], c["doc"][y], c["spot"][y], differ, complete)


def _reduced(percent: int, limit: int | None):
    """What the packed rows of a partition say.

    Lines that repeat an earlier one (``_GONE``), pairs of lines of a prefix token (``_PAIR``), and prefix
    tokens that are common (``_COMMON``: ``y_doc`` has the parity, ``y_spot`` size and place).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                blobs.setdefault(kind, []).append(data)
        nothing = lambda n: (np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32), np.ones(n, dtype=bool))
        for data in blobs.pop(_GONE, []):
            doc, spot = _unpacked([data], np.int64, np.int64)
            yield from _met(_GONE, np.zeros(len(doc), np.int64), doc, spot, *nothing(len(doc)))
        if _CLASS in blobs:
            s0, s1, doc, spot = _unpacked(blobs.pop(_CLASS), np.uint64, np.uint64, np.int64, np.int64)
            order = np.lexsort((spot, doc, s1, s0))
            again = order[1:][(s0[order[1:]] == s0[order[:-1]]) & (s1[order[1:]] == s1[order[:-1]])]
            yield from _met(_GONE, np.zeros(len(again), np.int64), doc[again], spot[again], *nothing(len(again)))
        def firsts(group, s0, doc, spot, place):
            """Of each class only its first line."""
            key = group.astype(np.uint64) << np.uint64(32) | s0 >> np.uint64(32)
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            if not same.any():
                return order
            again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            some = order[again]
            some = some[np.lexsort((spot[some], doc[some], place[some] & (_PROBE - 1), s0[some], group[some]))]
            equal = (group[some[1:]] == group[some[:-1]]) & (s0[some[1:]] == s0[some[:-1]]) & ((place[some[1:]] ^ place[some[:-1]]) & (_PROBE - 1) == 0)
            return np.concatenate([order[~again], some[np.concatenate([[True], ~equal])]])

        if _COMMON in blobs:
            group, s0, doc, spot, n, place, parity = _unpacked(blobs.pop(_COMMON), *_POSTED)
            order = firsts(group, s0, doc, spot, place)
            yield from _met(_COMMON, group[order].astype(np.int64), doc[order], spot[order], parity[order].view(np.int64), n[order].astype(np.int64) << 32 | place[order] & (_PROBE - 1), np.zeros(len(order), np.int32), place[order] >= _PROBE)
        # most lines are short, and have no more parity
        parts, wides = [], []
        for w in range(len(WIDE) + 1):
            more = (1 << w) - 1
            own = _unpacked(blobs.pop(_POSTING + w, []), *_POSTED, *(np.uint64,) * more)
            parts.append((*own[: len(_POSTED)], np.full(len(own[0]), w, np.int8)))
            if w:
                wides.append(np.zeros((len(own[0]), (1 << len(WIDE)) - 1), np.uint64))
                for k in range(more):
                    wides[-1][:, k] = own[len(_POSTED) + k]
        group, s0, doc, spot, n, place, parity, level = (np.concatenate(c) for c in zip(*parts, strict=True))
        narrow = len(parts[0][0])
        del parts, own
        order = firsts(group, s0, doc, spot, place)
        # a token that one class has alone says nothing
        g = np.sort(group[order])
        several = np.unique(g[1:][g[1:] == g[:-1]])
        if len(several):
            at = np.minimum(np.searchsorted(several, group[order]), len(several) - 1)
            order = order[several[at] == group[order]]
        else:
            order = order[:0]
        order = order[np.lexsort((spot[order], doc[order], group[order]))]
        if len(order):
            place = place[order]
            long = np.flatnonzero(order >= narrow)
            wide = np.zeros((len(order), (1 << len(WIDE)) - 1), np.uint64)
            wide[long] = np.concatenate(wides)[order[long] - narrow]
            del wides
            yield from _paired({"group": group[order], "doc": doc[order], "spot": spot[order], "n": n[order], "place": place & (_PROBE - 1), "parity": parity[order], "level": level[order], "wide": wide, "probe": place >= _PROBE}, percent, limit)

    return trimmed(run)


def _blocks(percent: int, limit: int | None):
    """Pairs of lines of the common tokens, of rows sorted by token, block, document and spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "doc", "spot", "size", "parity"]
        carry = {k: np.empty(0, np.int64) for k in names}

        def work(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(c["group"]):
                packed = c.pop("size")
                token = {"group": c["group"], "n": (packed >> 32).astype(np.int32), "place": (packed >> 3 & (1 << 28) - 1).astype(np.int32), "side": packed >> 1 & 3, "probe": (packed & 1).astype(bool), "parity": c["parity"].view(np.uint64)}
                x, y, differ, complete = _meet(token, percent, limit)
                yield from _met(_PAIR, c["group"][x] >> 32 & 0xFFFFFFFF, c["doc"][x], c["spot"][x], c["doc"][y], c["spot"][y], differ, complete)

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: np.concatenate([carry[k], batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(names)}
            cut = int(np.searchsorted(c["group"], c["group"][-1]))
            carry = {k: v[cut:] for k, v in c.items()}
            yield from work({k: v[:cut] for k, v in c.items()})
        yield from work(carry)

    return trimmed(run)


def _of_common(met: DataFrame, percent: int, limit: int | None) -> DataFrame | None:
    """Pairs of lines of the common tokens, each dealt out as pairs of blocks by its exact number of lines."""
    rows = met.filter(f"kind = {_COMMON}")
    if rows.isEmpty():
        return None
    many = written(rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "ld-common")
    rows = rows.join(many, "token").withColumn("own", F.pmod(F.xxhash64("x_doc", "x_spot"), F.col("blocks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct((F.least("own", k) * F.col("blocks") + F.greatest("own", k)).alias("block"), F.when(k == F.col("own"), 0).when(k > F.col("own"), 1).otherwise(2).alias("side")))
    rows = rows.withColumn("b", F.explode(both))
    group = F.shiftleft(F.col("token"), 32) + F.col("b.block")
    size = F.col("y_spot").bitwiseAND(F.lit(-1 << 32)) + F.shiftleft(F.least(F.col("y_spot").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit((1 << 28) - 1)), 3) + F.col("b.side") * 2 + F.col("complete").cast("int")
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(group.alias("group"), "x_doc", "x_spot", size.alias("size"), F.col("y_doc").alias("parity"))
    pairs = written(rows.repartition(n, "group").sortWithinPartitions("group", "x_doc", "x_spot").mapInArrow(_blocks(percent, limit), _MET), "ld-pairs")
    forget(many)
    return pairs


def _wanted(bits_of):
    """Token sets of the lines that the map asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, lines = (np.frombuffer(x, np.int64) for x in bits_of.value)
        flat = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(in_bitmap(documents, xxhash64(ids)))
            if not len(asked):
                continue
            texts, ids = utf8(batch.column(1).take(pa.array(asked))), ids[asked]
            parts, at, spots = [], [], []
            for k, (text, tie) in enumerate(zip(texts, _tie(texts).tolist(), strict=True)):
                own = text.split(b"\n")
                spot = np.arange(len(own), dtype=np.int64) << 24 | tie
                for m in np.flatnonzero(in_bitmap(lines, xxhash64(np.full(len(own), ids[k]), spot))).tolist():
                    parts.append(own[m])
                    at.append(k)
                    spots.append(int(spot[m]))
            for i, j in slices(parts):
                doc, _, first, last, tokens = _token_sets(parts[i:j], flat)
                if len(doc):
                    d = doc + i
                    yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(at)[d]]), pa.array(np.array(spots)[d]), pa.ListArray.from_arrays(pa.array(np.concatenate([first, last[-1:]]).astype(np.int32)), pa.array(tokens.view(np.int64)))], ["doc_id", "spot", "tokens"])

    return trimmed(run)


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, spot`` of the lines x of the pairs whose token sets reach the threshold."""
    asked = pairs.select(F.col("x_doc").alias("doc_id"), F.col("x_spot").alias("spot")).unionByName(pairs.select(F.col("y_doc").alias("doc_id"), F.col("y_spot").alias("spot")))
    maps = bitmap(asked.select(F.xxhash64("doc_id").alias("k")), "k"), bitmap(asked.select(F.xxhash64("doc_id", "spot").alias("k")), "k")
    bits = docs.sparkSession.sparkContext.broadcast(maps)
    # a repeated row gives the same sets, and the same pairs, again
    sets = written(docs.mapInArrow(_wanted(bits), "doc_id long, spot long, tokens array<bigint>"), "ld-sets")
    side = lambda s: sets.select(F.col("doc_id").alias(f"{s}_doc"), F.col("spot").alias(f"{s}_spot"), F.col("tokens").alias(f"{s}_tokens"))
    full = pairs.join(side("y"), ["y_doc", "y_spot"]).join(side("x"), ["x_doc", "x_spot"])
    found = full.select("x_doc", "x_spot", (F.size("x_tokens") + F.size("y_tokens")).alias("both"), F.size(F.array_intersect("x_tokens", "y_tokens")).alias("common")).filter(f"100 * common >= {percent} * (both - common)")
    found = written(found.select(F.col("x_doc").alias("doc_id"), F.col("x_spot").alias("spot")).distinct(), "ld-found")
    bits.unpersist()
    forget(sets)
    return found


def later_matches(docs: DataFrame, percent: int = 80, least: int = 1) -> DataFrame:
    """``doc_id, tie, line`` of each line that an earlier one matches; ``docs``: ``doc_id, text``."""
    docs = docs.filter("doc_id is not null and text is not null")
    context, conf = docs.sparkSession.sparkContext, docs.sparkSession.conf
    levels, n_words = _levels(docs)
    n = max(int(conf.get("spark.sql.shuffle.partitions")), -(-n_words // WORDS_EACH))

    def join(second: bool, *maps: bytes) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        shared, limit = context.broadcast((levels.tobytes(), *maps)), None if second else PARTNERS
        packed = docs.mapInArrow(_scan(shared, percent, least, n, second), "bucket int, kind int, data binary")
        met = written(packed.repartitionById(n, "bucket").mapInArrow(_reduced(percent, limit), _MET), "ld-met")
        shared.unpersist()
        common, pairs = _of_common(met, percent, limit), met.filter(f"kind = {_PAIR}")
        return met, common, pairs if common is None else pairs.unionByName(common)

    met, common, pairs = join(False)
    line = ["x_doc", "x_spot"]
    # the likeliest candidate of each line alone; all others only of the lines that it doesn't match
    best = written(pairs.groupBy(*line).agg(F.min(F.struct("differ", "y_doc", "y_spot")).alias("y")).select(*line, "y.y_doc", "y.y_spot"), "ld-best")
    tables = [met, common, best, _verified(best, docs, percent)]
    named = lambda found: found.select(F.col("doc_id").alias("x_doc"), F.col("spot").alias("x_spot"))
    found = tables[-1]
    others = written(pairs.join(named(found), line, "left_anti").groupBy(*line, "y_doc", "y_spot").agg(F.min("complete").alias("complete"), F.collect_set(F.when(~F.col("complete"), F.col("token"))).alias("tokens")), "ld-others")
    tables.append(others)
    if not others.isEmpty():
        more = written(others.join(best, [*line, "y_doc", "y_spot"], "left_anti").select(*line, "y_doc", "y_spot"), "ld-more")
        tables += [more, _verified(more, docs, percent)]
        found = found.unionByName(tables[-1])
        rest = written(others.filter("not complete").join(named(tables[-1]), line, "left_anti").select(*line, "tokens"), "ld-rest")
        tables.append(rest)
        if not rest.isEmpty():
            maps = bitmap(rest.select(F.explode("tokens").alias("k")), "k"), bitmap(rest.select(F.xxhash64(*line).alias("k")), "k")
            met2, common2, again = join(True, *maps)
            again = written(again.select(*line, "y_doc", "y_spot").distinct().join(others, [*line, "y_doc", "y_spot"], "left_anti"), "ld-again")
            tables += [met2, common2, again, _verified(again, docs, percent)]
            found = found.unionByName(tables[-1])
    gone = met.filter(f"kind = {_GONE}").select(F.col("x_doc").alias("doc_id"), F.col("x_spot").alias("spot")).unionByName(found).distinct()
    out = written(gone.select("doc_id", F.col("spot").bitwiseAND(F.lit(_TIE)).alias("tie"), F.shiftright("spot", 24).cast("int").alias("line")), "ld-gone")
    forget(*tables)
    return out


def _cut(text: str, gone) -> str:
    gone = set(gone)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def _untouched(bits_of, at: int, text: int, names: list[str], touched: bool):
    """Rows of documents that the map doesn't have; or, packed and with their tie, of those it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, bits = zstandard.ZstdCompressor(level=1).compress, np.frombuffer(bits_of.value, np.int64)
        for batch in batches:
            ids = batch.column(at)
            asked = in_bitmap(bits, xxhash64(ids.fill_null(0).to_numpy(zero_copy_only=False))) & ids.is_valid().to_numpy(zero_copy_only=False)
            asked &= batch.column(text).is_valid().to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array(asked == touched))
            texts = utf8(part.column(text))
            columns = [part.column(k) for k in range(len(names)) if k != text]
            if touched:
                more = [pa.array([pack(t) for t in texts], pa.binary()), pa.array(_tie(texts))]
            else:
                more = [part.column(text), pa.array([0 if not t else t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array([0] * len(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*(x for k, x in enumerate(names) if k != text), *(["__text", "__tie"] if touched else ["__out", "__lines", "__removed"])])

    return trimmed(run)


def _without(n_columns: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [unpack(t).decode() for t in batch.column(n_columns).to_pylist()]
            gone = [x or [] for x in batch.column(n_columns + 1).to_pylist()]
            out = [_cut(t, g) if g else t for t, g in zip(texts, gone, strict=True)]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array([len(g) for g in gone], pa.int64())], names)

    return trimmed(run)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least: int = 1) -> DataFrame:
    """``docs`` without the lines that an earlier line matches, with the columns ``lines`` and ``removed_lines``
    (with a leading underscore for as long as ``docs`` has such a name).

    Lines end at line feeds. A line matches an earlier one, by (id, line), if the distinct words of both,
    with A-Z as a-z, reach a Jaccard similarity of ``percent`` / 100. Lines without a word, and those
    with fewer than ``least`` distinct words, stay. Rows with a null id or text stay as they are, with 0 removed. Rows that repeat
    id and text count as one document and lose the same lines; of rows that share an id but not the
    text, a fixed one comes first. A document may be left with an empty text, but no row goes. An empty
    table gives an empty result. Other columns pass through.
    """
    short_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = later_matches(plain, percent, least)
    removed = written(lines.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("gone")), "ld-removed")
    forget(lines)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(removed.select(F.xxhash64("doc_id").alias("k")), "k"))
    names = docs.columns
    text = names.index(text_col)
    # the columns under names of their own, so that none can clash
    inner = [f"__c{k}" for k in range(len(names))]
    types = [f.dataType.simpleString() for f in docs.schema]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)], F.col(id_col).cast("long").alias("__doc"))
    others = [f"{i} {t}" for k, (i, t) in enumerate(zip(inner, types, strict=True)) if k != text]
    columns = [*inner, "__doc"]
    same = rows.mapInArrow(_untouched(bits, len(names), text, columns, False), ", ".join([*others, "__doc long", "__out string", "__lines long", "__removed long"]))
    packed = rows.mapInArrow(_untouched(bits, len(names), text, columns, True), ", ".join([*others, "__doc long", "__text binary", "__tie long"]))
    # both sides grow with the corpus, so neither is ever broadcast
    joined = packed.join(removed.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__t"), "gone").hint("merge"), (F.col("__doc") == F.col("__id")) & (F.col("__tie") == F.col("__t")), "left")
    kept = [i for k, i in enumerate(inner) if k != text]
    out = joined.select(*kept, "__text", "gone").mapInArrow(_without(len(kept), [*kept, "__out", "__lines", "__removed"]), ", ".join([*others, "__out string", "__lines long", "__removed long"]))
    out = out.unionByName(same.drop("__doc"))
    fresh = lambda c: c if c not in names else fresh(f"_{c}")
    return out.select(*[F.col("__out" if k == text else i).alias(c) for k, (c, i) in enumerate(zip(names, inner, strict=True))], F.col("__lines").alias(fresh("lines")), F.col("__removed").alias(fresh("removed_lines")))
