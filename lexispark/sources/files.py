"""Readers and writers of the positional text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfc
from ..operators.pages import clean

# Columns of the lexicon's files.
LEXICON = {
    "attested": "syllable string, dump_count long, sentence_count long",
    "accepted": "token string, count long, spread long",
    "bigrams": "a string, b string, count long",
    "trigrams": "a string, b string, c string, count long",
}


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows; lines that start with ``#`` are comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="", ignoreLeadingWhiteSpace=False)


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``token, count``; tokens in NFC and lower case; counts that are no integers drop the row, repeated tokens are summed."""
    rows = tsv(spark, path, "token string, n string").select(F.lower(nfc(F.col("token"))).alias("token"), F.expr("try_cast(n as bigint)").alias("n"))
    return rows.filter("n is not null").groupBy("token").agg(F.sum("n").alias("count"))


def lexicon_tables(spark: SparkSession, folder: str, form: str = "parquet") -> dict[str, DataFrame]:
    """The lexicon's tables from Parquet, or from TSV with comment lines; a count that is no integer is null there."""
    if form == "tsv":
        return {k: tsv(spark, f"{folder}/{k}.tsv", v) for k, v in LEXICON.items()}
    return {k: spark.read.schema(v).parquet(f"{folder}/{k}") for k, v in LEXICON.items()}


def sentence_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of each line of UTF-8 files."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def errors(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows; lines with another number of fields go."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter("size(f) = 5")
    return rows.select(F.expr("try_cast(f[0] as int)").alias("start_byte"), F.expr("try_cast(f[1] as int)").alias("end_byte"), F.col("f")[2].alias("wrong"), F.col("f")[3].alias("right"), F.col("f")[4].alias("sentence"))


def wiki_dump(spark: SparkSession, path: str, cleaned: bool = True) -> DataFrame:
    """``title, text`` of article pages of an XML dump (compressed or not), without markup and in NFC. Pages
    without a known namespace go. Other than the original there is no limit, which followed the file's order."""
    shape = "title string, ns long, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(shape).load(path).filter("ns = 0")
    text = F.col("revision.text._VALUE")
    return pages.select("title", (nfc(clean(text)) if cleaned else text).alias("text"))


def write_lines(rows: DataFrame, path: str, column: str, header: tuple[str, ...] = (), order: tuple = ()) -> None:
    """One line per row. Sorted with ``order``; comment lines of ``header`` stand in a file that sorts first."""
    lines = (rows.orderBy(*order) if order else rows).select(F.col(column).alias("value"))
    if header:
        spark = rows.sparkSession
        spark.createDataFrame([(f"# {x}",) for x in header], "value string").coalesce(1).write.mode("overwrite").text(path)
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(path)


def write_lexicon(lexicon, folder: str, form: str = "parquet") -> None:
    """The four tables as Parquet, or as TSV with a header line."""
    for name, shape in LEXICON.items():
        table = getattr(lexicon, name)
        if form == "tsv":
            columns = [c.split(" ")[0] for c in shape.split(", ") if c.split(" ")[0] in table.columns]
            write_lines(table.select(F.concat_ws("\t", *columns).alias("value")), f"{folder}/{name}.tsv", "value", ("\t".join(columns),))
        else:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_frequencies(counts: DataFrame, path: str, least: int = 2, source: str = "") -> None:
    """``token<TAB>count`` by falling count, then token, below three comment lines: source, tokens, distinct ones and those kept."""
    about = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("m"), F.count(F.when(F.col("count") >= least, 1)).alias("k")).first()
    header = (f"source: {source}", f"tokens: {about.n}", f"distinct: {about.m} (>= {least}: {about.k})")
    kept = counts.filter(F.col("count") >= least).select("token", "count", F.concat_ws("\t", "token", "count").alias("value"))
    write_lines(kept, path, "value", header, (F.desc("count"), "token"))


def write_sentences(sentences: DataFrame, path: str, column: str = "sentence") -> None:
    """One sentence per line."""
    write_lines(sentences, path, column)


def write_syllables(syllables: DataFrame, path: str) -> None:
    """All syllables in order, one per line."""
    write_lines(syllables, path, "syllable", order=("syllable",))


def write_errors(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", "start_byte", "end_byte", "wrong", "right", "sentence").alias("value")).write.mode("overwrite").text(path)
