"""The spelling check: rules, words outside the vocabulary, and words that their context contradicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import in_bitmap, word_bitmap, written
from .candidates import candidates, maybe_candidates, top_candidates
from .lexicon import Lexicon
from .lm import contexts, scored
from .phonology import syllables
from .rules import RuleOptions, words_and_findings
from .tokens import tokens

#: Both neighbours' bigrams at this count: the word is taken as right.
SEEN_ENOUGH = 30
#: So many accepted words at most are known to the scan; rows of others are dropped by a join.
SKIPPED = 200_000


@dataclass(frozen=True)
class CheckOptions:
    margin: float = 6.0
    extra_edit_margin: float = 5.0
    unattested: bool = False
    real_word: bool = True
    rules: RuleOptions = RuleOptions()


_OUT = ("doc_id", "start_byte", "end_byte", "kind", "found", "options", "confidence", "layer")


def classify(words: DataFrame, lex: Lexicon, unattested: bool = False) -> DataFrame:
    """``norm, valid, options`` of the distinct words (``norm``) that aren't syllables, or (an option) aren't attested; those that
    aren't ``open``, if that is told, have no candidate."""
    valid = syllables(words.sparkSession).select(F.col("syllable").alias("norm"), F.lit(True).alias("valid"))
    known = lex.attested.select(F.col("syllable").alias("norm"), F.lit(True).alias("known"))
    distinct = words.join(valid, "norm", "left").join(known, "norm", "left")
    bad = distinct.filter("valid is null" + (" or known is null" if unattested else ""))
    bad = written(bad.join(lex.accepted.select(F.col("token").alias("norm")), "norm", "left_anti"), "check-unknown")
    options = top_candidates(bad.filter("open") if "open" in bad.columns else bad, lex.attested, "norm").withColumnRenamed("syllable", "norm")
    bad = bad.join(options, "norm", "left").withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
    # a word of ASCII letters without a candidate is a name or foreign
    return bad.filter("valid or size(options) > 0 or length(norm) <> octet_length(norm)").select("norm", "valid", "options")


def _flagged(rows: DataFrame, bad: DataFrame) -> DataFrame:
    rows = rows.join(bad, "norm")
    kind = F.when(F.col("valid"), "UnattestedSyllable").otherwise("InvalidSyllable")
    return rows.select("doc_id", "start_byte", "end_byte", kind.alias("kind"), F.col("norm").alias("found"), "options", F.when(F.col("valid"), "Likely").otherwise("Certain").alias("confidence"), F.lit(1).alias("layer"))


def _windows(words: DataFrame) -> DataFrame:
    """Each word with two words on either side; all words of the text, protected ones too."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return words.withColumns({**{f"l{k}": F.lag("norm", k).over(w) for k in (1, 2)}, **{f"r{k}": F.lead("norm", k).over(w) for k in (1, 2)}})


_FIVE = ("l2", "l1", "x", "r1", "r2")


def gains(places: DataFrame, attested: DataFrame, lex: Lexicon, options: DataFrame | None = None) -> DataFrame:
    """``l2, l1, x, r1, r2, text, reason, edits, rank, base, gain`` of distinct contexts and candidates (``options``, if they are made already)."""
    keys = written(places.select(*_FIVE).distinct(), "gains-contexts")
    options = (candidates(keys.select("x"), attested, "x") if options is None else options).withColumnRenamed("syllable", "x")
    tried = written(keys.join(options, "x"), "gains-tried")
    every = keys.select(*_FIVE, F.col("x").alias("y")).unionByName(tried.select(*_FIVE, F.col("text").alias("y")))
    steps = F.array(F.struct(F.col("l2").alias("a"), F.col("l1").alias("b"), F.col("y").alias("w")), F.struct(F.col("l1").alias("a"), F.col("y").alias("b"), F.col("r1").alias("w")), F.struct(F.col("y").alias("a"), F.col("r1").alias("b"), F.col("r2").alias("w")))
    grams = every.select(*_FIVE, "y", F.explode(steps).alias("g")).select(*_FIVE, "y", "g.*").filter("w is not null")
    local = written(scored(written(grams, "gains-grams"), lex).groupBy(*_FIVE, "y").agg(F.sum("log_score").alias("local")), "gains-local")
    base = local.filter("x = y").select(*[F.col(c).alias(f"b_{c}") for c in _FIVE], F.col("local").alias("base"))
    same = lambda p: [F.col(c).eqNullSafe(F.col(f"{p}_{c}")) for c in _FIVE]
    other = local.filter("x <> y").select(*[F.col(c).alias(f"o_{c}") for c in _FIVE], F.col("y").alias("o_y"), F.col("local").alias("changed"))
    out = tried.join(other, [*same("o"), F.col("text") == F.col("o_y")]).join(base, same("b"))
    return out.select(*_FIVE, "text", "reason", "edits", "rank", "base", (F.col("changed") - F.col("base")).alias("gain"))


def better_words(places: DataFrame, options: DataFrame, lex: Lexicon, check_options: CheckOptions = CheckOptions()) -> DataFrame:
    """Adds ``text`` to valid words that another explains better, by the margin; ``places`` has them in their contexts, ``options`` their candidates."""
    keys = written(places.select(*_FIVE).distinct(), "check-contexts")
    pair = lex.bigrams.filter(F.col("count") >= SEEN_ENOUGH)
    left = pair.select(F.col("a").alias("l1"), F.col("b").alias("x"), F.lit(True).alias("left_ok"))
    right = pair.select(F.col("a").alias("x"), F.col("b").alias("r1"), F.lit(True).alias("right_ok"))
    keys = keys.join(left, ["l1", "x"], "left").join(right, ["x", "r1"], "left")
    fine = (F.col("l1").isNull() | F.coalesce("left_ok", F.lit(False))) & (F.col("r1").isNull() | F.coalesce("right_ok", F.lit(False)))
    keys = keys.filter(~fine).join(syllables(places.sparkSession).select(F.col("syllable").alias("x")), "x", "left_semi")
    if check_options.unattested:
        keys = keys.join(lex.attested.select(F.col("syllable").alias("x")), "x", "left_semi")
    need = F.lit(check_options.margin) + F.lit(check_options.extra_edit_margin) * (F.col("edits") - 1)
    better = gains(keys, lex.attested, lex, options).filter("reason <> 'Variant'").withColumn("surplus", F.col("gain") - need).filter("surplus >= 0")
    best = better.groupBy(*_FIVE).agg(F.max_by("text", F.struct("surplus", -F.col("rank"))).alias("text"))
    best = written(best.select(*[F.col(c).alias(f"k_{c}") for c in _FIVE], "text"), "check-best")
    return places.join(best, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in _FIVE]).drop(*[f"k_{c}" for c in _FIVE])


def real_words(places: DataFrame, options: DataFrame, lex: Lexicon, check_options: CheckOptions = CheckOptions()) -> DataFrame:
    """The findings of ``better_words``."""
    rows = better_words(places, options, lex, check_options)
    return rows.select("doc_id", "start_byte", "end_byte", F.lit("RealWord").alias("kind"), F.col("x").alias("found"), F.array("text").alias("options"), F.lit("Likely").alias("confidence"), F.lit(2).alias("layer"))


def confusable(lex: Lexicon) -> DataFrame:
    """The candidates of all syllables but for variants; the language bounds them."""
    spark = lex.attested.sparkSession
    return written(candidates(syllables(spark), lex.attested).filter("reason <> 'Variant'"), "check-tried")


def word_marks(lex: Lexicon, options: CheckOptions, tried: DataFrame | None):
    """What executors know of words, as a broadcast; the function that makes the marks of ``words_and_findings`` of it; and ``tried``."""
    spark = lex.attested.sparkSession
    strings = lambda df, c: frozenset(df.select(c).toArrow().column(0).to_pylist())
    valid, maybe = strings(syllables(spark), "syllable"), maybe_candidates(lex.attested)
    fine = strings(lex.attested, "syllable") if options.unattested else valid
    skipped = strings(lex.accepted.limit(SKIPPED), "token")
    places, known = frozenset(), bytes(1 << 21)
    if options.real_word:
        tried = confusable(lex) if tried is None else tried
        places = strings(tried, "syllable")
        words = lex.attested.select(F.col("syllable").alias("word"))
        for table, columns in ((lex.bigrams, "ab"), (lex.trigrams, "abc")):
            words = words.unionByName(table.select(F.explode(F.array(*columns)).alias("word")))
        known = word_bitmap(words, "word")
    held = spark.sparkContext.broadcast((valid, fine, skipped, places, known, maybe))

    def mark():
        valid, fine, skipped, places, known, maybe = held.value

        def bits(w: str) -> int:
            out = (w in places) << 1 | in_bitmap(known, w) << 2
            if w in skipped or (w in valid and w in fine):
                return out
            # a word of ASCII letters without a candidate is a name or foreign
            tell = maybe(w)
            return out | tell << 3 | (tell or w in valid or not w.isascii())

        return bits

    return held, mark, tried


def _check(docs: DataFrame, lex: Lexicon, options: CheckOptions, id_col: str, text_col: str, punctuation: bool, tried: DataFrame | None, counted: bool) -> tuple[DataFrame, DataFrame]:
    held, mark, tried = word_marks(lex, options, tried)
    rows = written(words_and_findings(docs, options.rules if punctuation else None, mark, id_col, text_col, counted), "check-rows")
    held.destroy()
    marks = rows.filter("rule is not null").select("doc_id", "start_byte", "end_byte", F.when(F.col("rule") == "capital", "Capitalization").otherwise("Punctuation").alias("kind"), "found", F.array("fix").alias("options"), "confidence", F.lit(0).alias("layer"))
    # words that are valid and attested have a row for their place only
    told = rows.filter("norm is not null" + ("" if options.unattested else " and not place"))
    bad = written(classify(told.select("norm", "open").distinct(), lex, options.unattested), "check-bad")
    out = marks.unionByName(_flagged(told.select("doc_id", "start_byte", "end_byte", "norm"), bad).select(*_OUT))
    if options.real_word:
        out = out.unionByName(real_words(rows.filter("place").withColumnRenamed("norm", "x"), tried, lex, options).select(*_OUT))
    return out, rows


def check(docs: DataFrame, lex: Lexicon, options: CheckOptions = CheckOptions(), id_col: str = "doc_id", text_col: str = "text", punctuation: bool = True, tried: DataFrame | None = None) -> DataFrame:
    """All findings of all texts; order by ``doc_id, start_byte, layer`` to read them. Without ``punctuation`` the rules aren't tried.

    One pass over the texts gives the rows of words that can be findings, as the closed vocabulary tells which words can
    have a candidate; in their contexts the words that no table of the lexicon has are all the same, as they count
    alike. ``tried``: what ``confusable`` made of the lexicon.
    """
    return _check(docs, lex, options, id_col, text_col, punctuation, tried, False)[0]


def check_counted(docs: DataFrame, lex: Lexicon, options: CheckOptions = CheckOptions()) -> tuple[DataFrame, DataFrame]:
    """``check``, and the ``checked_words`` of the texts from the same pass."""
    out, rows = _check(docs, lex, options, "doc_id", "text", True, None, True)
    return out, rows.filter("checked is not null").select("checked", "protected")


def recheck(phrases: DataFrame, lex: Lexicon, options: CheckOptions = CheckOptions(), personal: DataFrame | None = None, tried: DataFrame | None = None) -> DataFrame:
    """``phrase, back, word, replacement, certain``: of the last two words of each distinct phrase (words joined by
    single spaces) the newest that has a finding with a candidate; ``back`` counts from the end.

    Findings of punctuation and case don't count, nor words of the ``personal`` dictionary (``word``).
    """
    # numbered, as documents of the check need an id
    rows = written(phrases.select("phrase").filter("phrase <> ''").distinct().select(F.monotonically_increasing_id().alias("doc_id"), F.col("phrase").alias("text")), "phrases")
    found = check(rows, lex, options, punctuation=False, tried=tried).filter("size(options) > 0")
    found = found.groupBy("doc_id", "start_byte").agg(F.min(F.struct("layer", F.element_at("options", 1).alias("replacement"), (F.col("confidence") == "Certain").alias("certain"))).alias("f"))
    words = F.split("text", " ")
    ends = F.octet_length("text")
    last = F.element_at(words, -1)
    before = F.when(F.size(words) > 1, F.element_at(words, -2))
    start = ends - F.octet_length(last)
    both = F.array(F.struct(F.lit(0).alias("back"), last.alias("word"), start.alias("start_byte")), F.struct(F.lit(1).alias("back"), before.alias("word"), (start - 1 - F.octet_length(before)).alias("start_byte")))
    tried = rows.select("doc_id", F.col("text").alias("phrase"), F.inline(both)).filter("word is not null")
    if personal is not None:
        tried = tried.withColumn("__w", F.lower("word")).join(personal.select(F.lower("word").alias("__w")).distinct(), "__w", "left_anti").drop("__w")
    hit = tried.join(found, ["doc_id", "start_byte"]).groupBy("phrase").agg(F.min(F.struct("back", "word", F.col("f.replacement").alias("replacement"), F.col("f.certain").alias("certain"))).alias("h"))
    return hit.select("phrase", "h.*")


def explain(docs: DataFrame, lex: Lexicon, most: int = 4) -> DataFrame:
    """``doc_id, pos, word, base, text, reason, gain, place``: the candidates with the largest gain, without a threshold."""
    places = _windows(tokens(docs).filter("kind = 'Word'")).withColumn("x", F.col("norm"))
    rows = gains(places, lex.attested, lex).select(*[F.col(c).alias(f"k_{c}") for c in _FIVE], "text", "reason", "base", "gain", "rank")
    out = places.join(rows, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in _FIVE])
    order = Window.partitionBy("doc_id", "pos").orderBy(F.desc("gain"), "rank")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("doc_id", "pos", F.col("norm").alias("word"), "base", "text", "reason", "gain", "place")


def without_personal(found: DataFrame, dictionary: DataFrame, punctuation: bool = True) -> DataFrame:
    """Drop findings whose text is in the personal dictionary (``word``), and punctuation if it isn't wanted."""
    rows = found if punctuation else found.filter("kind <> 'Punctuation'")
    return rows.join(dictionary.select(F.lower("word").alias("__w")).distinct(), F.lower("found") == F.col("__w"), "left_anti")
