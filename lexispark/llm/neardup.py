"""Near-duplicate groups with SetSketch registers.

A sketch has 126 registers: minima of independent hashes over a document's shingles, on an
exponential scale with base 1.001, cut off at both ends. The registers of a union are the largest of
both sides', so that sketches merge; each register of two sets is equal with a chance of about their
Jaccard similarity. Bands of three registers find candidates: a pair at the threshold of 0.75 shares no
band with a chance of 1e-10. A candidate's similarity is estimated by the joint likelihood of its
smaller, equal and larger registers; what could reach the threshold is confirmed on the full sets.

Equal sets are one class with its smallest doc_id as node. Inside a band each class is compared with
one centre, not with all others; only what still lies in different components of the same band is
compared further, first with other centres, then in memory by blocks of the band, which only likely pairs
leave. Links inside a component change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, short_batches, slices, trimmed, written
from .components import components
from .textscan import mix, shingle_sets

REGISTERS, BAND = 126, 3
BASE = 1.001
_MULTIPLIERS = (np.random.default_rng(4051).integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SALTS = np.random.default_rng(4052).integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
#: A pair whose likelihood peaks below this is left: over 4 standard errors under the threshold.
ESTIMATE = 0.58
#: Star rounds, at most, before all that remains in a band is compared.
ROUNDS = 4
#: Bits of a set's parity, by which what is compared in a band is bounded without error.
PARITY = 1024
#: Nodes of a band in one block.
BLOCK = 2048
WORDS = 5


def registers(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes; larger for smaller minima."""
    low = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    s = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), 256):
        h = s[i : i + 256, None] * _MULTIPLIERS
        h ^= _SALTS
        np.minimum(low, h.min(axis=0), out=low)
    return scale(low)


def scale(low: np.ndarray) -> np.ndarray:
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)) + 4096, 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)


_GRID = np.linspace(0, 1, 101)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard of rows of registers with known set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    up, down = _chance(u - v * j), _chance(v - u * j)
    value = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))
    return j[np.arange(len(a)), value.argmax(1)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in slices(texts):
            sets = shingle_sets(texts[i:j], WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "set_id", "registers"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``band`` holds the band's number and its three registers themselves."""
    n = REGISTERS // BAND
    for batch in batches:
        if not batch.num_rows:
            continue
        r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, n, BAND).astype(np.uint64)
        key = r[:, :, 0] | r[:, :, 1] << np.uint64(16) | r[:, :, 2] << np.uint64(32) | np.arange(n, dtype=np.uint64) << np.uint64(48)
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], ["band", "node"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(a):
            continue
        keep = np.zeros(len(a), dtype=bool)
        for i in range(0, len(a), 2048):
            r = [np.frombuffer(b"".join(batch.column(k)[i : i + 2048].to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5)]
            keep[i : i + 2048] = similarity(*r, n_a[i : i + 2048].astype(float), n_b[i : i + 2048].astype(float)) >= ESTIMATE
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, n_a, n_b)], ["a", "b", "n_a", "n_b"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each of ``PARITY`` places of shingles, whether the set has an odd number there."""
    for batch in batches:
        sets = batch.column(1)
        flat, ends = sets.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) for x in sets)])
        bits = [np.packbits(np.bincount(flat[i:j] & (PARITY - 1), minlength=PARITY).astype(np.uint8) & 1).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["node", "parity"])


def _met(percent: int):
    """Likely pairs inside each band and block, of rows sorted by both."""
    names = ["band", "block", "side", "node", "component", "size", "registers", "parity"]

    def meet(c: dict[str, np.ndarray], r: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, node, component, side = c["size"], c["node"], c["component"], c["side"]
        number = int(c["band"][0].view(np.uint64) >> np.uint64(48))
        step = max(1, (1 << 20) // len(node))
        for i in range(0, len(node), step):
            x, y = np.arange(i, min(i + step, len(node)))[:, None], np.arange(i, len(node))[None, :]
            ok = (x < y) & (component[x] != component[y]) & ((side[x] != side[y]) | (side[x] == 0))
            ok &= (100 * size[x] >= percent * size[y]) & (100 * size[y] >= percent * size[x])
            p, q = np.nonzero(ok)
            p, q = p + i, q + i
            for k in range(0, len(p), 8192):
                a, b = p[k : k + 8192], q[k : k + 8192]
                # at least as many shingles differ as bits
                near = np.bitwise_count(parity[a] ^ parity[b]).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (size[a] + size[b])
                a, b = a[near], b[near]
                if not len(a):
                    continue
                same = r[a] == r[b]
                # a pair comes from the first band that it shares
                first = same.reshape(len(a), -1, BAND).all(2).argmax(1) == number
                likely = np.flatnonzero(first & (same.sum(1) >= ESTIMATE * REGISTERS - 2 * REGISTERS**0.5))
                a, b = a[likely], b[likely]
                if len(a):
                    likely = similarity(r[a], r[b], size[a].astype(float), size[b].astype(float)) >= ESTIMATE
                    a, b = a[likely], b[likely]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (node[a], node[b], size[a], size[b])], ["a", "b", "n_a", "n_b"])

    def groups(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        band, block = c["band"], c["block"]
        edge = np.flatnonzero((band[1:] != band[:-1]) | (block[1:] != block[:-1])) + 1
        for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(band)], strict=True):
            if j - i > 1:
                one = {k: v[i:j] for k, v in c.items()}
                r, parity = (np.frombuffer(b"".join(one[k].tolist()), t).reshape(j - i, -1) for k, t in (("registers", np.uint16), ("parity", np.uint64)))
                yield from meet(one, r, parity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            keys = c["band"][-1], c["block"][-1]
            cut = int(np.flatnonzero((c["band"] == keys[0]) & (c["block"] == keys[1]))[0])
            if cut or last != keys:
                held.append({k: v[:cut] for k, v in c.items()})
                yield from groups({k: np.concatenate([h[k] for h in held]) for k in names})
                held = []
            held.append({k: v[cut:] for k, v in c.items()})
            last = keys
        if held:
            yield from groups({k: np.concatenate([h[k] for h in held]) for k in names})

    return trimmed(run)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in slices(texts):
            sets = shingle_sets(texts[i:j], WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "set_id", "shingles"],
            )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their distinct five-word
    shingles (all words as one, where there are fewer). Texts that are null or without words have
    ``n_shingles`` 0 and stand alone. Rows with a null id stand alone too, with a null component, and are
    kept. Rows that share an id count as one document with the links of each. Ties go to the smaller id.
    An empty table gives an empty result. Columns beside ``id_col`` and ``text_col`` are not read.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(docs.mapInArrow(trimmed(_sketches), "doc_id long, n_shingles long, set_id binary, registers binary"), "nd-sketches")
    classes = written(
        sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")),
        "nd-classes",
    )
    tables: list[DataFrame] = []
    edges = _links(docs, classes, percent, tables)
    labels = written(components(edges, "a", "b"), "nd-components")
    named = classes.join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    named = written(named, "nd-named")
    forget(classes, labels, *tables)
    out = sketches.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, classes: DataFrame, percent: int, tables: list[DataFrame]) -> DataFrame:
    """Confirmed links between nodes that give the components; ``tables`` gets those to remove after."""
    bands = classes.select("node", "registers").mapInArrow(trimmed(_bands), "band long, node long")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = written(bands.join(shared, "band"), "nd-shared")
    # a band's centre is its node with the most company in all bands: what a group's copies agree on
    company = written(pairs.groupBy("node").agg(F.sum("n").alias("company")), "nd-company")
    centres = written(pairs.join(company, "node").groupBy("band").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("centre")), "nd-centres")
    active = written(pairs.select("band", "node").join(centres, "band"), "nd-active")
    forget(pairs, company, centres)
    wanted = active.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(trimmed(_sets), "node long, set_id binary, shingles array<bigint>")
    sets = written(sets.join(classes.select("node", "set_id"), ["node", "set_id"], "left_semi").select("node", "shingles"), "nd-sets")
    tables.append(sets)
    edges = _confirmed(active.filter("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")), classes, sets, percent)
    tables.append(edges)
    for attempt in range(ROUNDS + 1):
        labels = written(components(edges, "a", "b"), "nd-labels")
        placed = active.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        parted = placed.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
        before, active = active, written(placed.join(parted.select("band", "n"), "band"), f"nd-open-{attempt}")
        forget(before, labels)
        tables.append(active)
        open_rows = active.count()
        if not open_rows:
            return edges
        if attempt == ROUNDS:
            break
        # another centre in each band: a member of the component that has most of it
        turn = F.xxhash64("node", F.lit(attempt))
        largest = active.groupBy("band", "component").agg(F.count("*").alias("n"), F.min_by("node", turn).alias("centre")).groupBy("band").agg(F.max_by(F.struct("centre", "component"), F.struct("n", "component")).alias("c"))
        largest = written(largest.select("band", "c.*").withColumnRenamed("component", "other"), "nd-centres")
        star = active.select("band", "node", "component").join(largest, "band").filter("component <> other")
        found = _confirmed(star.select(F.col("centre").alias("a"), F.col("node").alias("b")), classes, sets, percent)
        forget(largest)
        tables.append(found)
        edges = edges.unionByName(found)
        if 1000 * found.count() <= open_rows:
            break
    compared = _compared(active, classes, sets, percent)
    last = _verified(compared, sets, percent)
    tables += [compared, last]
    return edges.unionByName(last)


def _compared(active: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of ``active`` (``band, node, component, n``), each from the first band that both share.

    Nodes of a band meet in memory, so that only likely pairs leave it. A band of many nodes is dealt out
    as pairs of blocks, of which no task holds more than two.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = active.select("band", "node", "component", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct((F.least("own", k) * F.col("blocks") + F.greatest("own", k)).alias("block"), F.when(k == F.col("own"), 0).when(k > F.col("own"), 1).otherwise(2).alias("side")))
    parities = sets.join(active.select("node").distinct(), "node", "left_semi").mapInArrow(trimmed(_parities), "node long, parity binary")
    about = classes.select("node", F.col("n").alias("size"), "registers").join(parities, "node")
    about = written(about.distinct(), "nd-about")
    rows = rows.join(about, "node")
    rows = rows.withColumn("m", F.explode(meet)).select("band", F.col("m.block").alias("block"), F.col("m.side").alias("side"), "node", "component", "size", "registers", "parity")
    n = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "band", "block").sortWithinPartitions("band", "block")
    found = written(rows.mapInArrow(_met(percent), "a long, b long, n_a long, n_b long"), "nd-likely")
    forget(about)
    return found


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that reach the threshold on the full sets."""
    of = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    sized = pairs.distinct().join(of("a"), "a").join(of("b"), "b")
    sized = sized.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    likely = written(sized.mapInArrow(trimmed(_likely), "a long, b long, n_a long, n_b long"), "nd-likely")
    found = _verified(likely, sets, percent)
    forget(likely)
    return found


def _verified(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    full = likely.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a")
    common = full.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"))
    return written(common.filter(f"100 * common >= {percent} * (n_a + n_b - common)").select("a", "b"), "nd-links")
