"""Language ID by Bayesian evidence fusion.

Text: hashed byte trigrams with Laplace-smoothed probabilities for each language and for an
uninformed model, tempered, as neighbouring trigrams aren't independent. Declared markup language and
address suffix: tables P(evidence | language), from the labelled sample where it has them, else from expected
counts over all rows. Host: a prior that shrinks the host's expected language counts towards those of its domain
(its last two labels), and these towards the corpus. Expected counts are sums of the text posteriors, by grouped
aggregation over all rows; a row's own posterior is taken out of the counts that judge it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, written

BINS = 1 << 15
#: Bounds of the labelled sample: rows, dealt evenly to the languages, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 4000
#: Weight of a trigram, and the most trigrams that count in full.
TEMPER, FULL = 0.25, 400
#: Pseudo-counts of the parent in a host's prior, in a domain's, and in the tables of evidence.
HOST_STRENGTH, DOMAIN_STRENGTH, EVIDENCE_STRENGTH = 20.0, 100.0, 20.0
#: P(declared = language) before any is seen.
TRUST = 0.9
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    trigrams: np.ndarray  # BINS x (languages + 1): log P, the last for text of no language
    declared: dict[str, dict[str, float]]
    suffix: dict[str, dict[str, float]]


def _bins(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    a[(a >= 65) & (a <= 90)] += 32
    a[(a >= 9) & (a <= 13)] = 32
    return (((a[:-2] * np.uint32(0x01000193) ^ a[1:-1]) * np.uint32(0x01000193) ^ a[2:]) * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int64)


def _padded(text: str | None) -> bytes:
    return f" {text or ''} ".encode()


def markup_language(html: Column) -> Column:
    """The primary subtag of ``<html lang=...>``, lower case; null without it."""
    found = F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return F.when(found != "", F.lower(found))


def address_suffix(url: Column) -> Column:
    """The last label of the host, lower case; null without one."""
    found = F.regexp_extract(url, r"://(?:[^/?#@]*@)?[^/?#:]*\.([A-Za-z]+)(?:[:/?#]|$)", 1)
    return F.when(found != "", F.lower(found))


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", declared: str | None = None, suffix: str | None = None, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``rows`` labelled rows (one of each language at least) and ``chars`` characters of each.

    Every label of the whole table is a language. Each gets the same share of ``rows``: distinct texts, the
    first by a hash. The classifier alone is fitted on this bounded sample; everything else covers all rows.
    """
    picked = labelled.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).withColumn("h", F.xxhash64(text))
    columns = [F.substring(F.col(text), 1, chars).alias("t"), F.col(language).alias("l"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("d"), (F.col(suffix) if suffix else F.lit(None)).cast("string").alias("s")]
    labels = picked.groupBy(F.col(language).alias("l")).agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("first")).collect()
    each = max(1, rows // max(1, len(labels)))
    sample = []
    if labels:
        # for each language the share of hashes that holds about twice its rows, and its first; copies of a text are one row before they move
        up_to = {r.l: max(r.first, int(-(2.0**63) + min(1.0, 2.0 * each / max(1, r.n)) * (2.0**64 - 2048))) for r in labels}
        bounds = F.create_map(*[F.lit(x) for pair in up_to.items() for x in pair])
        near = picked.select("h", *columns).filter(F.col("h") <= F.try_element_at(bounds, F.col("l")))
        near = near.groupBy("l", "h").agg(F.min(F.struct("t", "l", "d", "s")).alias("r"))
        sample = near.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("k") <= each).select("r.*").collect()
    languages = sorted({r.l for r in sample})
    counts = np.zeros((BINS, len(languages)))
    for r in sample:
        counts[:, languages.index(r.l)] += np.bincount(_bins(_padded(r.t)), minlength=BINS)
    table = np.empty((BINS, len(languages) + 1), dtype=np.float32)
    table[:, :-1] = np.log((counts + 0.05) / (counts.sum(0) + 0.05 * BINS))
    table[:, -1] = math.log(1 / BINS) + 2.0

    def evidence(name: str) -> dict[str, dict[str, float]]:
        values = sorted({r[name] for r in sample if r[name] is not None})
        return {v: {x: math.log((sum(1 for r in sample if r[name] == v and r.l == x) + 0.5) / (sum(1 for r in sample if r[name] is not None and r.l == x) + 0.5 * (len(values) + 1))) for x in languages} for v in values}

    return Model(languages, table, evidence("d"), evidence("s"))


def _scores(model_of, n_columns: int, names: list[str]):
    """The tempered log likelihoods of the text and the posterior that they give alone (nothing for a blank text), beside what the row has else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model_of.value
        for batch in batches:
            texts, blank = batch.column(n_columns).to_pylist(), batch.column(n_columns - 1).to_pylist()
            out, guesses = [], []
            for t, nothing in zip(texts, blank, strict=True):
                bins = _bins(_padded(t)) if t else ()
                if len(bins):
                    total = np.zeros(table.shape[1])
                    for i in range(0, len(bins), 1 << 16):
                        total += table[bins[i : i + (1 << 16)]].sum(0, dtype=np.float64)
                    out.append((total * (TEMPER * min(1.0, FULL / len(bins)))).tolist())
                else:
                    out.append([0.0] * table.shape[1])
                if nothing:
                    guesses.append([0.0] * table.shape[1])
                else:
                    e = np.exp(np.array(out[-1]) - max(out[-1]))
                    guesses.append((e / e.sum()).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], pa.array(out, pa.list_(pa.float64())), pa.array(guesses, pa.list_(pa.float64()))], names)

    return run


def _softmax(rows: DataFrame, scores: str, out: str) -> DataFrame:
    """Adds ``out``: the posterior of log ``scores``; step by step like ``_shrunk``."""
    rows = rows.withColumn("top", F.array_max(scores))
    rows = rows.withColumn("exps", F.transform(scores, lambda x: F.exp(x - F.col("top"))))
    rows = rows.withColumn("size", _size(F.col("exps")))
    return rows.withColumn(out, F.transform("exps", lambda x: x / F.col("size"))).drop("top", "exps", "size")


def _table(value: Column, table: dict[str, dict[str, float]], languages: list[str]) -> Column:
    """log P(value | language) as an array; 0 for null or unseen values. The unknown class gets the mean."""
    if not table:
        return F.array(*[F.lit(0.0)] * (len(languages) + 1))
    rows = {v: [*(p[x] for x in languages), sum(p.values()) / len(p)] for v, p in table.items()}
    as_map = F.create_map(*[x for v, p in rows.items() for x in (F.lit(v), F.array(*[F.lit(float(y)) for y in p]))])
    return F.coalesce(F.try_element_at(as_map, value), F.array(*[F.lit(0.0)] * (len(languages) + 1)))


def _size(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)


def _expected(known: DataFrame, name: str, n: int, out: str) -> DataFrame:
    """``name, out``: the sums of the text posteriors of each value."""
    sums = known.filter(F.col(name).isNotNull()).groupBy(name).agg(*[F.sum(F.col("guess")[k]).alias(f"n{k}") for k in range(n)])
    return sums.select(name, F.array(*[F.col(f"n{k}") for k in range(n)]).alias(out))


def _domain(host: Column) -> Column:
    """The last two labels, or the host itself."""
    found = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(found != "", found).otherwise(host)


def _shrunk(rows: DataFrame, counts: str, out: str, parent: Column, strength: float) -> DataFrame:
    """Adds ``out``: shares of ``counts`` without the row's ``guess``, shrunk towards ``parent``; null without counts.

    One step after the other, so that no expression is evaluated again for each element.
    """
    rows = rows.withColumn("rest", F.zip_with(counts, "guess", lambda c, g: F.greatest(c - g, F.lit(0.0))))
    rows = rows.withColumn("size", _size(F.col("rest")) + strength)
    return rows.withColumn(out, F.zip_with("rest", parent, lambda c, p: (c + p * strength) / F.col("size"))).drop("rest", "size")


def identify(rows: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = None, declared_col: str | None = None, suffix_col: str | None = None, keep_text_key: bool = False) -> DataFrame:
    """``doc_id, language, confidence, rejected, posterior`` (JSON) of every row.

    ``language`` has the highest posterior, ties to the first in alphabetical order, ``und`` last. ``rejected``
    rows are those whose text is null or blank (Unicode white space), or for which ``und`` wins. A null host, declared
    language or suffix is no evidence. Null ids and repeated rows are judged like others. An empty table gives an empty
    result. With ``keep_text_key`` the 64-bit hash of the text follows, to join back. Other columns are not read.
    """
    short_batches(rows.sparkSession)
    languages, n = model.languages, len(model.languages) + 1
    optional = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    plain = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), optional(host_col).alias("host"), optional(declared_col).alias("declared"), optional(suffix_col).alias("suffix"), (~F.coalesce(F.col(text_col), F.lit("")).rlike(r"\P{IsWhite_Space}")).alias("blank"), F.col(text_col).alias("text"))
    names = ["doc_id", "text_key", "host", "declared", "suffix", "blank", "scores", "guess"]
    table = rows.sparkSession.sparkContext.broadcast(model.trigrams)
    scored = written(plain.mapInArrow(_scores(table, 6, names), "doc_id long, text_key long, host string, declared string, suffix string, blank boolean, scores array<double>, guess array<double>"), "langid-scores")
    # expected counts of each language: over all rows, by host, domain and evidence
    known = scored
    whole = known.agg(*[F.sum(F.col("guess")[k]).alias(f"n{k}") for k in range(n)]).first()
    total = [float(whole[k] or 0.0) + 1.0 for k in range(n)]
    base = F.array(*[F.lit(x / sum(total)) for x in total])
    hosts = _expected(known, "host", n, "nh").withColumn("domain", _domain(F.col("host")))
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("nh")[k]) for k in range(n)]).alias("nd"))
    hosts = written(hosts.join(domains, "domain").select("host", "nh", "nd"), "langid-hosts")
    joined = known.join(hosts, "host", "left")
    joined = _shrunk(joined, "nd", "parent", base, DOMAIN_STRENGTH)
    joined = _shrunk(joined, "nh", "prior", F.col("parent"), HOST_STRENGTH)
    parts = [F.col("scores"), F.transform(F.coalesce("prior", base), lambda x: F.log(x))]
    for name, fitted, column in (("declared", model.declared, declared_col), ("suffix", model.suffix, suffix_col)):
        if not column:
            continue
        if fitted:
            parts.append(_table(F.col(name), fitted, languages))
            continue
        # what a value is expected to be in each language, before it is seen there
        values = _expected(known, name, n, f"n_{name}").withColumn("share", _size(F.col(f"n_{name}")))
        sums = values.agg(F.sum("share").alias("all"), *[F.sum(F.col(f"n_{name}")[k]).alias(f"s{k}") for k in range(n)]).first()
        per = F.array(*[F.lit(float(sums[f"s{k}"] or 0.0)) for k in range(n)])
        own = F.col(name)
        share = F.col("share") / F.lit(float(sums["all"] or 1.0))
        rest = (1 - TRUST) / max(1, len(languages))
        first = F.array(*[F.when(own == x, F.lit(TRUST)).otherwise(F.lit(rest)) for x in languages], F.lit(rest)) if name == "declared" else F.array(*[share] * n)
        seen = values.select(name, f"n_{name}", F.greatest(F.lit(1e-12), "share").alias("share")).withColumn(f"first_{name}", first).drop("share")
        joined = joined.join(seen, name, "left")
        chance = F.zip_with(F.zip_with(F.zip_with(f"n_{name}", "guess", lambda c, g: F.greatest(c - g, F.lit(0.0))), f"first_{name}", lambda c, p: c + p * EVIDENCE_STRENGTH), F.zip_with(per, F.col("guess"), lambda s, g: F.greatest(s - g, F.lit(0.0)) + EVIDENCE_STRENGTH), lambda a, b: F.log(F.greatest(a / b, F.lit(1e-12))))
        parts.append(F.coalesce(chance, F.array(*[F.lit(0.0)] * n)))
    summed = parts[0]
    for part in parts[1:]:
        summed = F.zip_with(summed, part, lambda a, b: a + b)
    out = _softmax(joined.select("doc_id", "text_key", "blank", summed.alias("summed")), "summed", "p")
    names_array = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    out = out.withColumn("k", F.array_position("p", F.array_max("p")).cast("int"))
    out = out.withColumn("language", F.when(F.col("blank"), F.lit(UNKNOWN)).otherwise(F.element_at(names_array, F.col("k"))))
    posterior = F.to_json(F.map_from_arrays(names_array, F.transform("p", lambda x: F.round(x, 6))))
    columns = ["doc_id", "language", F.round(F.array_max("p"), 6).alias("confidence"), (F.col("language") == UNKNOWN).alias("rejected"), posterior.alias("posterior")]
    return out.select(*columns, *(["text_key"] if keep_text_key else []))
