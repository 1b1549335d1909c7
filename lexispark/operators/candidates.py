"""Corrections from structural confusions: onset, rime and tone axes with at most two edits, and Telex repair."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bare, needs_diacritics, untoned
from ..session import fixed, written
from .phonology import analyses, compose, compositions, decompose, rimes, syllables

# Confusions, each in both directions; * marks a spelling variant.
RULES = """
tone 3 4
onset c k
onset g gh
onset ng ngh
onset s x
onset ch tr
onset r d
onset r gi
onset d gi
onset l n
onset g r
onset v d
onset n nh
coda n ng
coda t c
coda nh n
coda ch t
nucleus i y *
nucleus iê ia
nucleus ươ ưa
nucleus uô ua
nucleus o ô
nucleus ao au
nucleus ă â
nucleus e ê
nucleus u ư
"""
# Telex digraphs in the order of replacement, and tone keys.
DIGRAPHS = (("dd", "đ"), ("aa", "â"), ("ee", "ê"), ("oo", "ô"), ("aw", "ă"), ("ow", "ơ"), ("uw", "ư"))
TONE_KEYS = {"s": 2, "f": 1, "r": 3, "x": 4, "j": 5}
MOST_EDITS, MOST_OPTIONS, MOST_CANDIDATES = 2, 12, 5


def rule_rows() -> list[tuple[int, str, str, str, bool]]:
    rows = [x.split() for x in RULES.strip().splitlines()]
    return [(2 * k + turn, r[0], *((r[1], r[2]) if not turn else (r[2], r[1])), len(r) > 3) for k, r in enumerate(rows) for turn in (0, 1)]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "ord int, kind string, src string, dst string, variant boolean")


def closure(spark: SparkSession) -> DataFrame:
    """``kind, src, dst, variant, ord``: onset, rime and tone alternatives; coda and nucleus rules applied to all rimes."""
    return fixed(spark, "closure", lambda: _closure(spark))


def _closure(spark: SparkSession) -> DataFrame:
    r, all_rimes = rules(spark), rimes(spark).select("rime")
    plain = r.filter("kind in ('onset', 'tone')").select("kind", "src", "dst", "variant", "ord")
    # 26 rules in both directions against 160 rimes
    tried = all_rimes.crossJoin(F.broadcast(r.filter("kind in ('coda', 'nucleus')")))
    at = F.instr("rime", F.col("src"))
    coda = F.when(F.col("rime").endswith(F.col("src")), F.concat(F.expr("left(rime, length(rime) - length(src))"), F.col("dst")))
    nucleus = F.when(at > 0, F.overlay(F.col("rime"), F.col("dst"), at, F.length("src")))
    made = tried.withColumn("made", F.when(F.col("kind") == "coda", coda).otherwise(nucleus)).filter("made <> rime")
    made = made.join(F.broadcast(all_rimes.select(F.col("rime").alias("made"))), "made", "left_semi")
    made = made.groupBy("rime", "made").agg(F.min_by("variant", "ord").alias("variant"), F.min("ord").alias("ord"))
    return plain.unionByName(made.select(F.lit("rime").alias("kind"), F.col("rime").alias("src"), F.col("made").alias("dst"), "variant", "ord"))


def _axis(table: DataFrame, kind: str, name: str, reason: Column) -> DataFrame:
    rows = table.filter(F.col("kind") == kind).select(F.col("src").alias(name), F.col("dst").alias(f"new_{name}"), reason.alias(f"why_{name}"), F.col("ord").alias(f"ord_{name}"))
    return rows


def structural(words: DataFrame, attested: DataFrame, column: str = "syllable") -> DataFrame:
    """``syllable, text, reason, edits, frequency``: one row per candidate, fewest edits and first path."""
    spark = words.sparkSession
    table = closure(spark)
    read = decompose(words.select(F.col(column).alias("syllable")).distinct()).withColumnRenamed("ord", "reading")

    def with_axis(rows: DataFrame, name: str, axis: DataFrame) -> DataFrame:
        # the word's own value and all others from one join: a union would double the plan at each axis
        made = [f"{x}_{name}" for x in ("new", "why", "ord")]
        others = axis.groupBy(name).agg(F.collect_list(F.struct(*made)).alias("others"))
        own = F.array(F.struct(F.col(name).alias(made[0]), F.lit(None).cast("string").alias(made[1]), F.lit(-1).alias(made[2])))
        every = rows.join(F.broadcast(others), name, "left").withColumn("others", F.concat(own, F.coalesce("others", F.filter(own, lambda x: F.lit(False)))))
        return every.select(*rows.columns, F.inline("others"))

    variant = F.when(F.col("variant"), F.lit("Variant")).otherwise(F.lit("Rime"))
    tones = _axis(table, "tone", "tone", F.lit("ToneConfusion")).withColumn("tone", F.col("tone").cast("int")).withColumn("new_tone", F.col("new_tone").cast("int"))
    base = read.select("syllable", "onset", "rime", "tone", "reading")
    fits = compositions(spark).select("onset", "rime", "tone").distinct().withColumn("fits", F.lit(True))
    broken = base.join(fits, ["onset", "rime", "tone"], "left").filter("fits is null").drop("fits")
    repair = broken.withColumn("new_tone", F.explode(F.array(*[F.lit(k) for k in range(6)]))).filter("new_tone <> tone")
    known = tones.select("tone", "new_tone").withColumn("known", F.lit(True))
    repair = repair.join(F.broadcast(known), ["tone", "new_tone"], "left").filter("known is null").select(*base.columns, "new_tone", F.lit("ToneRepair").alias("why_tone"), (F.lit(100) + F.col("new_tone")).alias("ord_tone"))
    toned = with_axis(base, "tone", tones).unionByName(repair)
    rows = with_axis(with_axis(toned, "onset", _axis(table, "onset", "onset", F.lit("Onset"))), "rime", _axis(table, "rime", "rime", variant))
    edits = sum((F.col(f"why_{x}").isNotNull().cast("int") for x in ("rime", "tone")), F.col("why_onset").isNotNull().cast("int"))
    rows = rows.withColumn("edits", edits).filter(F.col("edits").between(1, MOST_EDITS))
    whys = [F.when(F.col(f"why_{x}") != "Variant", F.col(f"why_{x}")) for x in ("onset", "rime", "tone")]
    rows = rows.withColumn("reason", F.coalesce(*whys, F.lit("Variant")))
    found = compose(rows.select(F.col("syllable").alias("word"), F.col("new_onset").alias("onset"), F.col("new_rime").alias("rime"), F.col("new_tone").alias("tone"), "reason", "edits", F.struct("reading", "ord_onset", "ord_rime", "ord_tone").alias("path")))
    found = found.select(F.col("word").alias("syllable"), F.col("syllable").alias("text"), "reason", "edits", "path")
    return _offered(found, attested)


def _offered(found: DataFrame, attested: DataFrame) -> DataFrame:
    first = F.min(F.struct("edits", "path", "reason")).alias("f")
    best = found.filter("text <> syllable").groupBy("syllable", "text").agg(first).select("syllable", "text", "f.reason", "f.edits")
    known = attested.select(F.col("syllable").alias("text"), F.col("sentence_count").alias("frequency")).filter("frequency > 0")
    return best.join(known, "text").select("syllable", "text", "reason", "edits", "frequency")


def telex(words: DataFrame, column: str = "syllable") -> DataFrame:
    """``syllable, text`` of Telex keys left in words that are no syllables."""
    spark = words.sparkSession
    valid = syllables(spark)
    bad = words.select(F.col(column).alias("syllable")).distinct().join(F.broadcast(valid), "syllable", "left_anti")
    full = F.col("syllable")
    for key, letter in DIGRAPHS:
        full = F.replace(full, F.lit(key), F.lit(letter))
    bad = bad.withColumn("full", full)
    whole = bad.filter("full <> syllable").join(F.broadcast(valid.select(F.col("syllable").alias("full"))), "full").select("syllable", F.col("full").alias("text"))
    keys = F.create_map(*[x for k, v in TONE_KEYS.items() for x in (F.lit(k), F.lit(v))])
    stems = bad.withColumn("key", F.try_element_at(keys, F.expr("right(full, 1)"))).filter("key is not null").select(F.col("syllable").alias("word"), F.expr("left(full, length(full) - 1)").alias("stem"), "key")
    read = decompose(stems, "stem").select("word", "onset", "rime", F.col("key").alias("tone")).distinct()
    made = compose(read).select(F.col("word").alias("syllable"), F.col("syllable").alias("text"))
    return whole.unionByName(made).distinct()


def candidates(words: DataFrame, attested: DataFrame, column: str = "syllable") -> DataFrame:
    """Structural and Telex candidates with ``rank`` by (edits, -frequency, text)."""
    words = written(words.select(column).distinct(), "candidate-words")
    typed = telex(words, column).select("syllable", "text", F.lit("Telex").alias("reason"), F.lit(1).alias("edits"))
    known = attested.select(F.col("syllable").alias("text"), F.col("sentence_count").alias("frequency")).filter("frequency > 0")
    typed = typed.filter("text <> syllable").join(known, "text").select("syllable", "text", "reason", "edits", "frequency")
    both = written(structural(words, attested, column).unionByName(typed), "candidates")
    best = both.groupBy("syllable", "text").agg(F.min(F.struct("edits", (F.col("reason") == "Telex").alias("typed"), "reason")).alias("f"), F.max("frequency").alias("frequency"))
    order = Window.partitionBy("syllable").orderBy("edits", F.desc("frequency"), "text")
    return best.select("syllable", "text", "f.reason", "f.edits", "frequency").withColumn("rank", F.row_number().over(order))


def restore_options(attested: DataFrame, most: int = MOST_OPTIONS) -> DataFrame:
    """``bare, text, frequency, rank``: attested syllables under their form without diacritics."""
    from ..functions.text import strip_diacritics

    order = Window.partitionBy("bare").orderBy(F.desc("frequency"), "text")
    rows = attested.select(strip_diacritics(F.col("syllable")).alias("bare"), F.col("syllable").alias("text"), F.col("sentence_count").alias("frequency"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def top_candidates(words: DataFrame, attested: DataFrame, column: str = "syllable", most: int = MOST_CANDIDATES) -> DataFrame:
    """``syllable, options``: for bare words the restored forms first, then candidates; at most ``most``."""
    own = words.select(F.col(column).alias("syllable")).distinct()
    restored = own.filter(needs_diacritics(F.col("syllable"))).join(restore_options(attested), F.col("syllable") == F.col("bare")).filter("text <> syllable").select("syllable", "text", F.lit(0).alias("source"), "rank")
    other = candidates(words, attested, column).select("syllable", "text", F.lit(1).alias("source"), "rank")
    first = restored.unionByName(other).groupBy("syllable", "text").agg(F.min(F.struct("source", "rank")).alias("p"))
    order = Window.partitionBy("syllable").orderBy("p", "text")
    kept = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    return kept.groupBy("syllable").agg(listed.alias("options"))


class MaybeCandidates(NamedTuple):
    """A test of one word: where it is false, ``top_candidates`` has none. The language bounds its tables."""

    read: frozenset[str]
    valid: frozenset[str]
    plain: frozenset[str]

    def __call__(self, word: str) -> bool:
        if word in self.plain or untoned(word) in self.read or (word[-1:] in TONE_KEYS and untoned(word[:-1]) in self.read):
            return True
        for key, letter in DIGRAPHS:
            word = word.replace(key, letter)
        return word in self.valid


def maybe_candidates(attested: DataFrame) -> MaybeCandidates:
    spark = attested.sparkSession
    strings = lambda df: frozenset(df.toArrow().column(0).to_pylist())
    return MaybeCandidates(strings(analyses(spark).select("untoned").distinct()), strings(syllables(spark)), frozenset(map(bare, strings(attested.select("syllable")))))


__all__ = ["analyses", "candidates", "closure", "maybe_candidates", "restore_options", "rules", "structural", "telex", "top_candidates"]
