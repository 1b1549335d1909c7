"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

A text is cut into units: words with the white space after them, or code points where it has fewer than
64. A paragraph ends after a unit whose hash is a multiple of m, a section after one whose hash is a
multiple of 2m, so that both follow the content and an insertion moves no later border; m is the power
of two that leaves about 64 paragraphs at most. A paragraph's digest chains the hashes of its units, a
section's those of all its paragraphs; the root is the digest of all sections and paragraphs. Equal
roots mean equal texts, unequal digests tell the sections and paragraphs that were edited. Texts whose
m differ by a factor of two are compared at the borders that both have.

A fingerprint is ``root:m:paragraphs:sections`` with 16 hexadecimal digits, 64 bits, for each node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

UNITS, SHORT = 64, 64


def _tree(text: Column) -> Column:
    """struct(m, p, s): the modulus, paragraph digests and section digests."""
    units = F.when(F.char_length(text) < SHORT, F.split(text, "")).otherwise(F.split(text, r"(?<=\s)(?=\S)"))
    hashes = F.transform(units, lambda u: F.xxhash64(u))
    base = F.struct(hashes.alias("h"), F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.size(units) / F.lit(float(UNITS)))))).cast("bigint").alias("m"))

    def step(m: Column):
        def run(s: Column, h: Column) -> Column:
            p, q = F.xxhash64(s["p0"], h), F.xxhash64(s["s0"], h)
            end_p, end_s = F.pmod(h, m) == 0, F.pmod(h, m * 2) == 0
            return F.struct(
                F.when(end_p, F.concat(s["p"], F.array(p))).otherwise(s["p"]).alias("p"),
                F.when(end_s, F.concat(s["s"], F.array(q))).otherwise(s["s"]).alias("s"),
                F.when(end_p, F.lit(0)).otherwise(p).cast("bigint").alias("p0"),
                F.when(end_s, F.lit(0)).otherwise(q).cast("bigint").alias("s0"),
            )

        return run

    empty = F.array().cast("array<bigint>")
    start = F.struct(empty.alias("p"), empty.alias("s"), F.lit(0).cast("bigint").alias("p0"), F.lit(0).cast("bigint").alias("s0"))

    def close(m: Column):
        def run(s: Column) -> Column:
            return F.struct(m.alias("m"), F.when(s["p0"] == 0, s["p"]).otherwise(F.concat(s["p"], F.array(s["p0"]))).alias("p"), F.when(s["s0"] == 0, s["s"]).otherwise(F.concat(s["s"], F.array(s["s0"]))).alias("s"))

        return run

    # through transform, so that the hashes are made once
    return F.element_at(F.transform(F.array(base), lambda b: F.aggregate(b["h"], start, step(b["m"]), close(b["m"]))), 1)


def _text(tree: Column) -> Column:
    nodes = lambda xs: F.array_join(F.transform(xs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    body = F.concat_ws(":", tree["m"].cast("string"), nodes(tree["p"]), nodes(tree["s"]))
    return F.concat_ws(":", F.substring(F.sha2(body, 256), 1, 16), body)


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))).cast("double")


def _likeness(a: Column, b: Column) -> Column:
    return F.when(a["m"] == b["m"], _shared(a["p"], b["p"])).when(a["m"] == b["m"] * 2, _shared(a["p"], b["s"])).when(a["m"] * 2 == b["m"], _shared(a["s"], b["p"])).otherwise(F.lit(0.0))


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text; a null counts as empty."""
    return _text(_tree(F.coalesce(text, F.lit(""))))


def _parsed(fp: Column) -> Column:
    parts = F.split(fp, ":")
    nodes = lambda k: F.transform(F.regexp_extract_all(parts[k], F.lit("[0-9a-f]{16}"), F.lit(0)), lambda x: F.conv(x, 16, -10).cast("bigint"))
    return F.struct(parts[1].cast("bigint").alias("m"), nodes(2).alias("p"), nodes(3).alias("s"))


def likeness(a: Column, b: Column) -> Column:
    """Share of common paragraphs of two fingerprints, 0 to 1; 1 for equal ones."""
    return F.when(a == b, F.lit(1.0)).otherwise(_likeness(_parsed(a), _parsed(b)))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Places (from 0) of the paragraphs of ``a`` that ``b`` lacks; null where the two have other moduli."""
    x, y = _parsed(a), _parsed(b)
    places = F.filter(F.transform(x["p"], lambda p, i: F.when(~F.array_contains(y["p"], p), i)), lambda i: i.isNotNull())
    return F.when(x["m"] == y["m"], places)


def _bucket(ids: DataFrame, n: int) -> Column:
    """Bucket of ``doc_id`` between approximate quantiles, by two steps of about sqrt(n) comparisons."""
    side = max(1, math.isqrt(max(n, 1)))
    steps = [k / (side * side) for k in range(1, side * side)]
    found = ids.agg(F.percentile_approx("doc_id", steps, 10000)).first()[0] if steps else None
    if not found:
        return F.lit(0)
    fences = sorted(found)
    coarse, fine = fences[side - 1 :: side], [fences[k : k + side - 1] for k in range(0, len(fences), side)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    literal = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<bigint>")
    first = below(literal(coarse))
    return first * side + below(F.element_at(F.array(*[literal(x) for x in fine]), first + 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document by ascending id; after the last comes the first. A null text counts as empty. Of
    rows that share an id, the smaller text comes first. Rows with a null id have no next document: it
    counts as empty. A single document is its own next. An empty table gives an empty result. Columns
    beside ``id_col`` and ``text_col`` are not read.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(n))).otherwise(_bucket(plain.filter("doc_id is not null").select("doc_id"), n)).cast("long")
    placed = plain.withColumn("bucket", bucket)
    # ids only: one row for each bucket
    heads = placed.filter("doc_id is not null").groupBy("bucket").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("bucket")
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"))
    # a table of known size, so that Spark needn't shuffle the texts to meet it
    heads = written(heads, "fp-heads")
    follow = heads.join(plain.select(F.col("doc_id").alias("head"), F.col("text")), "head").groupBy("bucket").agg(F.min("text").alias("text"))
    follow = follow.select(F.col("bucket").alias("b"), F.struct("text", _tree(F.col("text")).alias("tree")).alias("after"))
    rows = placed.select("bucket", "doc_id", "text", _tree(F.col("text")).alias("tree"))
    inside = Window.partitionBy("bucket").orderBy("doc_id", "text")
    rows = rows.withColumn("next", F.when(F.col("doc_id").isNotNull(), F.lead(F.struct("text", "tree")).over(inside)))
    rows = rows.join(follow, F.col("bucket") == F.col("b"), "left")
    none = F.struct(F.lit("").alias("text"), _tree(F.lit("")).alias("tree"))
    rows = rows.select("doc_id", "text", "tree", F.coalesce("next", "after", none).alias("next"), F.char_length("text").cast("long").alias("n_chars"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.col("next.text"), F.lit(1), quarter))
    rows = rows.select("doc_id", "n_chars", "tree", F.col("next.tree").alias("next_tree"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "tree", "next_tree", F.sha2("edited", 256).alias("edited_sha256"), _tree(F.col("edited")).alias("edited_tree"))
    return rows.select("doc_id", "n_chars", "edited_sha256", _text(F.col("tree")).alias("fingerprint"), _text(F.col("edited_tree")).alias("edited_fingerprint"), _likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"), _likeness(F.col("tree"), F.col("next_tree")).alias("near_next"))
