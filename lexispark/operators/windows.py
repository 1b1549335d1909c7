"""The check while typing: findings among the last two words of each window of a text, from one pass over the texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .check import CheckOptions, better_words, classify, word_marks
from .lexicon import Lexicon
from .tokens import KINDS, Vocabulary, portions, scan, strings

#: Fixed value: words of context while typing.
WINDOW = 5
# Fixed value: the code points of white space.
_SOLID = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def solid_words(text: str) -> list[str]:
    """The words by white space."""
    return _SOLID.findall(text)


def _pieces(texts: Sequence[str | None], split: Callable[[str], list[str]]) -> Iterator[tuple[int, int, bool, list[str]]]:
    """``text, first word, only the last window, words``. Code between backticks is the only thing that reaches from word to
    word, so each window of a text with one is a piece by itself; else the text is."""
    for k, text in enumerate(texts):
        words = split(text) if text else []
        if words and "`" in text:
            for n in range(1, len(words) + 1):
                begin = max(0, n - WINDOW)
                yield k, begin, True, words[begin:n]
        elif words:
            yield k, 0, False, words


def _window_rows(docs: DataFrame, keys: Sequence[str], mark: Callable[[], Callable[[str], int]], split: Callable[[str], list[str]], text_col: str) -> DataFrame:
    """``keys``, ``n`` (place of the window's last word, from 0), ``back, word``, and ``norm, place, open, l2, l1, r1, r2`` as in
    ``words_and_findings``, of each word that may be a finding with a candidate: it's seen as the last of a window and as the last but one.

    A text's words are scanned once. What a window adds are its ends: contexts stop there, and a sentence starts with it.
    """
    kinds = {"n": "int", "back": "int", "word": "string", "norm": "string", "place": "boolean", "open": "boolean", "l2": "string", "l1": "string", "r1": "string", "r2": "string"}
    own = {k: docs.schema[k].dataType for k in keys}
    names = [*keys, *kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(mark())
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            for a, b in portions(texts):
                known.room()
                pieces = list(_pieces(texts[a:b], split))
                if pieces:
                    yield from rows(batch, a, pieces, known)

    def rows(batch: pa.RecordBatch, a: int, pieces: list[tuple[int, int, bool, list[str]]], known: Vocabulary) -> Iterator[pa.RecordBatch]:
        s = scan([" ".join(p[3]) for p in pieces], known, joined=True)
        words = [w for p in pieces for w in p[3]]
        text, base, single = (np.array([p[k] for p in pieces]) for k in range(3))
        # the first word of each piece; places of words and tokens in code points
        head = np.cumsum([0, *(len(p[3]) for p in pieces)])
        step = np.fromiter(map(len, words), np.int64, len(words)) + 1
        step[head[1:] - 1] -= 1
        begin = np.concatenate([[0], np.cumsum(step)])
        at = np.concatenate([[0], np.cumsum(s.chars)])[:-1]
        every = np.flatnonzero(s.kind == KINDS.index("Word"))
        wanted = every[s.mark[every] & 10 > 0]
        number = np.searchsorted(begin, at[wanted], "right") - 1
        first = begin[number] == at[wanted]
        wanted, number = wanted[first], number[first]
        shown, names_ = np.where(s.mark[every] & 4 > 0, s.code[every], len(known.norms)), [*known.norms, "", None]
        for back in (0, 1):
            piece = s.row[wanted]
            end = number + back
            kept = (end < head[piece + 1]) & (~single[piece] | (end == head[piece + 1] - 1))
            # tokens of the window
            low = np.searchsorted(at, begin[np.maximum(head[piece], end - (WINDOW - 1))])
            high = np.searchsorted(at, begin[np.minimum(end + 1, len(words))])
            last, flags = s.last[wanted], s.flags[wanted]
            opening = (last < low) | ((s.flags[last] >> 11 & 3) == 2)
            kept &= (np.where(opening, flags >> 3 & 15, flags >> 7 & 15) == 0) & (s.zone[wanted] == 0)
            if not kept.any():
                continue
            x, low, high, piece, there, place = wanted[kept], np.searchsorted(every, low[kept]), np.searchsorted(every, high[kept]), piece[kept], number[kept], s.mark[wanted[kept]] & 2 > 0
            middle = np.searchsorted(every, x)

            def beside(by: int, place=place, low=low, high=high, middle=middle) -> pa.Array:
                k = middle + by
                inside = place & (k >= low) & (k < high)
                return strings(names_, np.where(inside, shown[np.clip(k, 0, len(every) - 1)], len(names_) - 1))

            columns = [batch.column(k).take(pa.array(a + text[piece])) for k in range(len(keys))]
            columns += [pa.array((there + back - head[piece] + base[piece]).astype(np.int32)), pa.array(np.full(len(x), back, np.int32)), strings(words, there), strings(known.norms, s.code[x]), pa.array(place), pa.array(s.mark[x] & 8 > 0)]
            yield pa.RecordBatch.from_arrays([*columns, *(beside(k) for k in (-2, -1, 1, 2))], names)

    schema = ", ".join([*(f"`{k}` {t.simpleString()}" for k, t in own.items()), *(f"{k} {t}" for k, t in kinds.items())])
    return docs.select(*keys, F.col(text_col)).mapInArrow(run, schema)


def window_hits(docs: DataFrame, lex: Lexicon, options: CheckOptions = CheckOptions(), split: Callable[[str], list[str]] = solid_words, keys: Sequence[str] = ("doc_id",), text_col: str = "text", personal: DataFrame | None = None, tried: DataFrame | None = None) -> DataFrame:
    """``keys, n, back, word, replacement, certain``: what ``recheck`` says of the last ``WINDOW`` words (by ``split``) at the word ``n``, from 0,
    of each text; only windows with a finding. Texts with equal ``keys`` must be equal."""
    held, mark, tried = word_marks(lex, options, tried)
    rows = written(_window_rows(docs, keys, mark, split, text_col), "window-rows")
    held.destroy()
    told = rows.filter("open")
    bad = written(classify(told.select("norm", "open").distinct(), lex, options.unattested).filter("size(options) > 0"), "window-bad")
    flagged = told.join(bad.select("norm", "valid", "options"), "norm")
    found = flagged.select(*keys, "n", "back", "word", F.lit(1).alias("layer"), F.element_at("options", 1).alias("replacement"), F.col("valid").isNull().alias("certain"))
    if options.real_word:
        better = better_words(rows.filter("place").withColumnRenamed("norm", "x"), tried, lex, options)
        found = found.unionByName(better.select(*keys, "n", "back", "word", F.lit(2).alias("layer"), F.col("text").alias("replacement"), F.lit(False).alias("certain")))
    if personal is not None:
        found = found.withColumn("__w", F.lower("word")).join(personal.select(F.lower("word").alias("__w")).distinct(), "__w", "left_anti")
    best = found.groupBy(*keys, "n").agg(F.min(F.struct("back", "layer", "replacement", "certain", "word")).alias("h"))
    return best.select(*keys, "n", "h.back", "h.word", "h.replacement", "h.certain")
