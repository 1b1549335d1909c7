"""The registered queries of this subpackage; each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, linededup, merkle, neardup, packing, sharding, urlrules, vafile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", vafile.scaled(F.col("embedding")).alias("vector"))
    return vafile.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their text, declared language (``lang``), the suffix of their address and its host (the source).

    ``lang`` labels the sample that the trigrams are fitted on; as evidence it is weighed by the expected counts of
    all rows without the judged one. A source without a dot has no suffix, which is no evidence.
    """
    docs = _table(spark, sf_dir, "documents")
    judged = docs.withColumns({"declared": F.lower("lang"), "suffix": langid.address_suffix(F.concat(F.lit("http://"), "source"))})
    return langid.identify(judged, langid.fit(docs), host_col="source", declared_col="declared", suffix_col="suffix")


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their visible text, markup language, address suffix and host; fitted on documents."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    pages = _table(spark, sf_dir, "pages")
    pages = pages.select("page_id", text.alias("text"), urlrules.parts(F.col("url"))[0].alias("host"), langid.markup_language(F.col("html")).alias("declared"), langid.address_suffix(F.col("url")).alias("suffix"))
    model = langid.fit(_table(spark, sf_dir, "documents"))
    out = langid.identify(pages, model, id_col="page_id", host_col="host", declared_col="declared", suffix_col="suffix")
    return out.withColumnRenamed("doc_id", "page_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a hundred in a directory ``source/lang/n``, of which one is its ``LICENSE``."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), name).alias("path"), "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines", "removed_lines", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_minhash, op3_fingerprints, op4_topk, op5_sharding, op6_langid, op7_licenses, op8_packing, op9_line_dedup, op10_url_filters, langid_pages)}
SQL: dict[str, str] = {
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op10_url_filters": """
        WITH p AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), q AS (
            SELECT page_id, lower(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
        ), rules(rule, rule_host, rule_path, action) AS (
            VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
                   ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
        ), own(k, pattern) AS (
            VALUES (1, '(^|[.-])(free-)?bets?[.-]'), (2, '(^|[.-])casinos?[.-]'), (3, '(^|[./-])(xxx|porn)([./-]|$)'), (5, '(^|[.-])cheap-pills[.-]'), (6, '(^|[./-])warez([./-]|$)')
        ), fits AS (
            SELECT page_id, host, path, r.rule, r.action,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS n
            FROM q LEFT JOIN rules r ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
        ), tries AS (
            SELECT page_id, min(k) AS k FROM fits JOIN own ON regexp_matches(host || path, pattern) WHERE n = 1 AND rule IS NULL GROUP BY page_id
        )
        SELECT f.page_id, host, path, f.rule, coalesce(f.action, CASE WHEN t.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
               o.pattern
        FROM fits f LEFT JOIN tries t ON f.page_id = t.page_id LEFT JOIN own o ON o.k = t.k WHERE n = 1
    """,
}
