"""The closed vocabulary of syllables, generated from onsets, rimes and tones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TONES, VOWELS, strip_tone, tone
from ..session import fixed

# Onsets with the class of vowels that may follow (F front, B back, A any).
ONSETS = "b:A c:B ch:A d:A đ:A g:B gh:F gi:A h:A k:F kh:A l:A m:A n:A ng:B ngh:F nh:A p:A ph:A qu:A r:A s:A t:A th:A tr:A v:A x:A"
# Rimes; those with * stand alone or after qu only.
RIMES = """
a ac ach ai am an ang anh ao ap at au ay
ăc ăm ăn ăng ăp ăt
âc âm ân âng âp ât âu ây
e ec em en eng eo ep et
ê êc êch êm ên êng ênh êp êt êu
i ich im in inh ip it iu
o oc oi om on ong op ot
ô ôc ôi ôm ôn ông ôp ôt
ơ ơi ơm ơn ơp ơt
u uc ui um un ung up ut
ư ưc ưi ưng ưt ưu
y
ia iêc iêm iên iêng iêp iêt iêu
yêm* yên* yêng* yêt* yêu*
ua uôc uôi uôm uôn uông uôt
ưa ươc ươi ươm ươn ương ươp ươt ươu
oa oac oach oai oam oan oang oanh oao oat oay
oăc oăm oăn oăng oăt
oe oem oen oeo oet
uân uâng uât uây
uê uêch uênh
uy uych uyn uynh uyt uya uyu uyên uyêt
uơ
oo ooc oong
"""


def onset_rows() -> list[tuple[int, str, str]]:
    return [(k + 1, *x.split(":")) for k, x in enumerate(ONSETS.split())]


def rime_rows() -> list[tuple[str, bool]]:
    return [(x.rstrip("*"), x.endswith("*")) for x in RIMES.split()]


def onsets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(onset_rows(), "onset_ord int, onset string, class string")


def rimes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rime_rows(), "rime string, q_only boolean")


def _tone_places(rime: Column) -> Column:
    """Places (from 1) that may carry the tone."""
    cluster = F.regexp_extract(rime, f"^[{VOWELS}]+", 0)
    return (
        F.when(F.instr(cluster, "ê") > 0, F.array(F.instr(cluster, "ê")))
        .when(F.instr(cluster, "ơ") > 0, F.array(F.instr(cluster, "ơ")))
        .when(F.length(rime) > F.length(cluster), F.array(F.length(cluster)))
        .when(rime.isin("oa", "oe", "uy"), F.array(F.lit(1), F.lit(2)))
        .when(F.length(cluster) <= 2, F.array(F.lit(1)))
        .otherwise(F.array(F.lit(2)))
    )


def compositions(spark: SparkSession) -> DataFrame:
    """``onset, rime, tone, placement, syllable``; placement 0 is the one that candidates use."""
    return fixed(spark, "compositions", lambda: _compositions(spark))


def _compositions(spark: SparkSession) -> DataFrame:
    vowels = spark.createDataFrame([(b, k, f) for b, forms in TONES.items() for k, f in enumerate(forms)], "vowel string, tone int, toned string")
    checked = F.col("rime").rlike("(ch|c|p|t)$")
    places = rimes(spark).select("rime", "q_only", F.posexplode(_tone_places(F.col("rime"))).alias("placement", "place"))
    toned = places.withColumn("vowel", F.substring(F.col("rime"), F.col("place"), F.lit(1))).join(vowels, "vowel").filter(~checked | F.col("tone").isin(2, 5))
    toned = toned.select("rime", "q_only", "tone", "placement", F.overlay("rime", "toned", "place", F.lit(1)).alias("form"))
    bare = toned.select(F.lit("").alias("onset"), "rime", "tone", "placement", F.col("form").alias("syllable"))
    first = F.substring("rime", 1, 1)
    front = first.isin("e", "ê", "i", "y")
    fits = ((F.col("class") == "A") | ((F.col("class") == "F") & front) | ((F.col("class") == "B") & ~front)) & (~F.col("q_only") | (F.col("onset") == "qu"))
    merged = F.when(F.col("onset").endswith(first), F.expr("left(onset, length(onset) - 1)")).otherwise(F.col("onset"))
    # 27 onsets against about a thousand toned rimes: both sides are the tables above
    full = toned.join(F.broadcast(onsets(spark)), fits).select("onset", "rime", "tone", "placement", F.concat(merged, "form").alias("syllable"))
    return bare.unionByName(full)


def syllables(spark: SparkSession) -> DataFrame:
    return fixed(spark, "syllables", lambda: _compositions(spark).select("syllable").distinct())


def analyses(spark: SparkSession) -> DataFrame:
    """``untoned, onset, rime, ord``: all readings of a string without its tone, in order."""
    return fixed(spark, "analyses", lambda: _analyses(spark))


def _analyses(spark: SparkSession) -> DataFrame:
    r, o = rimes(spark).select("rime"), onsets(spark)
    bare = r.select(F.col("rime").alias("untoned"), F.lit("").alias("onset"), "rime", F.lit(0).alias("ord"))
    pairs = o.crossJoin(F.broadcast(r))
    direct = pairs.select(F.concat("onset", "rime").alias("untoned"), "onset", "rime", (F.col("onset_ord") * 2).alias("ord"))
    head = F.expr("left(onset, length(onset) - 1)")
    merged = pairs.filter((F.length("onset") > 1) & (F.expr("right(onset, 1)") == F.substring("rime", 1, 1)))
    merged = merged.select(F.concat(head, F.col("rime")).alias("untoned"), "onset", "rime", (F.col("onset_ord") * 2 + 1).alias("ord"))
    every = bare.unionByName(direct).unionByName(merged)
    return every.groupBy("untoned", "onset", "rime").agg(F.min("ord").alias("ord"))


def decompose(words: DataFrame, column: str = "syllable") -> DataFrame:
    """Adds ``onset, rime, tone, ord`` for each reading; words without one go."""
    spark = words.sparkSession
    keyed = words.withColumn("tone", tone(F.col(column))).withColumn("untoned", strip_tone(F.col(column)))
    return keyed.join(analyses(spark), "untoned").drop("untoned")


def compose(parts: DataFrame) -> DataFrame:
    """Adds ``syllable`` to ``onset, rime, tone`` where the rules allow it."""
    table = compositions(parts.sparkSession).filter("placement = 0").drop("placement")
    return parts.join(table, ["onset", "rime", "tone"])
