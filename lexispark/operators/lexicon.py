"""Corpus counts and the lexicon: frequency, spread, bigrams, trigrams, attested and accepted words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWER_ALPHABET
from ..session import written
from .tokens import portions


def unigrams(lines: DataFrame) -> DataFrame:
    """``token, count, spread``: occurrences, and lines with the token, in one pass and one shuffle."""
    first = F.transform("sorted", lambda w, i: F.struct(w.alias("token"), F.when((i > 0) & (F.get("sorted", i - 1) == w), 0).otherwise(1).alias("first")))
    rows = lines.select(F.sort_array("words").alias("sorted")).select(F.inline(first))
    return rows.groupBy("token").agg(F.count("*").alias("count"), F.sum("first").alias("spread"))


def _runs(lines: DataFrame, valid: DataFrame | None, n: int) -> DataFrame:
    """Adjacent words of a line, all of them valid; made inside the line, without a window."""
    steps = F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.struct(*[F.element_at("words", i + k).alias("abc"[k]) for k in range(n)])))
    rows = lines.select(F.explode(steps).alias("g")).select("g.*").groupBy(*"abc"[:n]).agg(F.count("*").alias("count"))
    if valid is not None:
        for c in "abc"[:n]:
            rows = rows.join(valid.select(F.col("syllable").alias(c)), c, "left_semi")
    return rows


def bigrams(lines: DataFrame, valid: DataFrame | None = None, least: int = 8) -> DataFrame:
    """``a, b, count``; exact counts, ``valid`` None accepts every word."""
    return _runs(lines, valid, 2).filter(F.col("count") >= least)


def trigrams(lines: DataFrame, kept: DataFrame, valid: DataFrame | None = None, least: int = 6) -> DataFrame:
    """``a, b, c, count`` whose first two words are a kept bigram."""
    return _runs(lines, valid, 3).filter(F.col("count") >= least).join(kept.select("a", "b"), ["a", "b"], "left_semi")


def attested(unis: DataFrame, valid: DataFrame, dump: DataFrame | None = None) -> DataFrame:
    """``syllable, dump_count, sentence_count`` of valid syllables that occur."""
    counts = unis.select(F.col("token").alias("syllable"), F.col("count").alias("sentence_count"))
    if dump is None:
        return valid.join(counts, "syllable").select("syllable", F.col("sentence_count").alias("dump_count"), "sentence_count")
    both = valid.join(dump.select(F.col("token").alias("syllable"), F.col("count").alias("dump_count")), "syllable").join(counts, "syllable", "left")
    return both.filter("dump_count > 0").select("syllable", "dump_count", F.coalesce("sentence_count", F.lit(0)).alias("sentence_count"))


def accepted(unis: DataFrame, valid: DataFrame, least: int = 20) -> DataFrame:
    """``token, count, spread`` of words outside the vocabulary that occur in many lines."""
    return unis.filter(F.col("spread") >= least).join(valid.select(F.col("syllable").alias("token")), "token", "left_anti")


@dataclass(frozen=True)
class Lexicon:
    """``attested(syllable, dump_count, sentence_count)``, ``accepted(token)``, ``bigrams(a, b, count)``, ``trigrams(a, b, c, count)``."""

    attested: DataFrame
    accepted: DataFrame
    bigrams: DataFrame
    trigrams: DataFrame

    def stored(self) -> Lexicon:
        """The four tables written once, for all look-ups that follow."""
        return Lexicon(*(written(getattr(self, k), f"lexicon-{k}") for k in ("attested", "accepted", "bigrams", "trigrams")))

    def stats(self) -> DataFrame:
        tables = {"attested": self.attested, "accepted": self.accepted, "bigrams": self.bigrams, "trigrams": self.trigrams}
        parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in tables.items()]
        total = self.attested.agg(F.coalesce(F.sum("sentence_count"), F.lit(0)).cast("long").alias("n")).select(F.lit("total_tokens").alias("what"), "n")
        out = total
        for p in parts:
            out = out.unionByName(p)
        return out

    def total(self) -> DataFrame:
        """One row: the sum of sentence counts."""
        return self.attested.agg(F.sum("sentence_count").cast("double").alias("total"))


def totals(lines: DataFrame) -> DataFrame:
    """One row: ``sentences`` (lines with a word) and ``tokens``."""
    return lines.agg(F.count("*").alias("sentences"), F.coalesce(F.sum(F.size("words")), F.lit(0)).cast("long").alias("tokens"))


def build(lines: DataFrame, valid: DataFrame, bigram_least: int = 8, trigram_least: int = 6, spread_least: int = 20, valid_grams: bool = True) -> Lexicon:
    unis = unigrams(lines)
    grams = valid if valid_grams else None
    twos = bigrams(lines, grams, bigram_least)
    return Lexicon(attested(unis, valid), accepted(unis, valid, spread_least).select("token"), twos, trigrams(lines, twos, grams, trigram_least))


class _Numbers(dict):
    """Numbers of words from 1, with the place of each among the syllables or -1; 0 is the end of a line."""

    def __init__(self, places: dict[str, int]):
        super().__init__({"\n": 0})
        self.places, self.words, self.syllable = places, ["\n"], [-1]

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.syllable.append(self.places.get(word, -1))
        return number


def counts(docs: DataFrame, valid: DataFrame, text_col: str = "text", most: int = 300_000) -> DataFrame:
    """``a, b, c, count, spread`` of the words of all texts (``a`` only; ``spread``: lines with it) and of the runs of two and of
    three valid words of a line. One pass over the texts; each task adds up its own before they move."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(sorted(valid.select("syllable").toArrow().column(0).to_pylist()))
    pattern = f"\n|[{LOWER_ALPHABET}]+"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = held.value, re.compile(pattern)
        places, base = {w: k for k, w in enumerate(names)}, len(names) + 1
        syllables = pa.array([*names, None], pa.string())
        words, own, spread, runs = _Numbers(places), np.zeros(0, np.int64), np.zeros(0, np.int64), ([], [])

        def packed() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(own)
            at = at[at > 0]
            none = pa.nulls(len(at), pa.string())
            columns = [pa.array([words.words[k] for k in at.tolist()], pa.string()), none, none, pa.array(own[at]), pa.array(spread[at])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "c", "count", "spread"])
            for n, parts in enumerate(runs, 2):
                if parts:
                    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                    sums = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
                    # no third word: the null behind the syllables
                    places = [keys // base ** (n - 1 - k) % base if k < n else np.full(len(keys), base - 1) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*(syllables.take(pa.array(p)) for p in places), pa.array(sums), pa.nulls(len(keys), pa.int64())], ["a", "b", "c", "count", "spread"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in portions(texts):
                whole = unicodedata.normalize("NFC", "\n".join(t or "" for t in texts[i:j])).lower()
                raws = found.findall(whole)
                code = np.fromiter(map(words.__getitem__, raws), np.int64, len(raws))
                more = np.zeros(len(words.words) - len(own), np.int64)
                own, spread = np.concatenate([own, more]) + np.bincount(code, minlength=len(words.words)), np.concatenate([spread, more])
                line = np.cumsum(code == 0)
                lines = np.unique(line * len(words.words) + code) % len(words.words)
                spread += np.bincount(lines, minlength=len(words.words))
                place = np.array(words.syllable)[code]
                for n, parts in enumerate(runs, 2):
                    steps = [place[k : len(place) - n + 1 + k] for k in range(n)]
                    inside = np.logical_and.reduce([x >= 0 for x in steps])
                    key = 0
                    for x in steps:
                        key = key * base + x[inside]
                    parts.append(np.unique(key, return_counts=True))
                if len(words.words) + sum(len(k) for parts in runs for k, _ in parts) > most:
                    yield from packed()
                    words, own, spread, runs = _Numbers(places), np.zeros(0, np.int64), np.zeros(0, np.int64), ([], [])
        yield from packed()

    rows = docs.select(F.col(text_col)).mapInArrow(run, "a string, b string, c string, count long, spread long")
    return rows.groupBy("a", "b", "c").agg(F.sum("count").alias("count"), F.sum("spread").alias("spread"))


def build_from(docs: DataFrame, valid: DataFrame, bigram_least: int = 8, trigram_least: int = 6, spread_least: int = 20, text_col: str = "text") -> tuple[Lexicon, DataFrame]:
    """The lexicon that ``build`` makes of the lines of the texts, from one pass over them; and their ``unigrams``."""
    table = written(counts(docs, valid, text_col), "lexicon-counts")
    unis = table.filter("b is null").select(F.col("a").alias("token"), "count", "spread")
    twos = table.filter(F.col("b").isNotNull() & F.col("c").isNull() & (F.col("count") >= bigram_least)).select("a", "b", "count")
    threes = table.filter(F.col("c").isNotNull() & (F.col("count") >= trigram_least)).select("a", "b", "c", "count")
    return Lexicon(attested(unis, valid), accepted(unis, valid, spread_least).select("token"), twos, threes.join(twos.select("a", "b"), ["a", "b"], "left_semi")), unis


def collocation(lex: Lexicon) -> DataFrame:
    """``a, b, strength, tightness``: P(b | a), and the smaller of P(b | a) and P(a | b)."""
    freq = lex.attested.select("syllable", "sentence_count")
    rows = lex.bigrams.join(freq.select(F.col("syllable").alias("a"), F.col("sentence_count").alias("n_a")), "a", "left").join(freq.select(F.col("syllable").alias("b"), F.col("sentence_count").alias("n_b")), "b", "left")
    share = lambda n: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.col("count") / F.col(n)).otherwise(F.lit(0.0))
    return rows.select("a", "b", share("n_a").alias("strength"), F.least(share("n_a"), share("n_b")).alias("tightness"))
