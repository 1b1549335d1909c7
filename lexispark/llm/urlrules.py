"""URL filters, in DataFrame functions only.

Address rules (``action host/path``) fit a host with all its subdomains and the paths that start with
theirs; the longest wins. Pattern rules are regular expressions with a literal that each match holds; one
whose alternatives hold different literals has an entry for each.
Both kinds are indexed by their rarest literal token: token counts over the URLs choose it, a URL's
tokens fetch the rules of their entries, and only those are tried.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules are literals of the plan; a longer list is a table that the tokens are joined to.
MOST_LITERAL = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``literals``: tokens (runs of a-z and 0-9) that every matching URL has whole."""

    action: str
    name: str
    pattern: str
    literals: tuple[str, ...]
    address: bool


def address_rule(action: str, address: str) -> Rule:
    """``host/path``; tried on ``host/path`` of the URL."""
    host, slash, path = address.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}"
    # the last token of the path may go on in the URL
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", f"{host.lower()}/") + [t for t in re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())]
    return Rule(action, address, pattern, tuple(dict.fromkeys(whole)), True)


def pattern_rule(action: str, pattern: str, *literals: str) -> Rule:
    return Rule(action, pattern, pattern, literals, False)


#: The default lists.
ADDRESS_RULES = (
    address_rule("allow", "org/"),
    address_rule("block", "example.org/es/"),
    address_rule("block", "example.org/en/1"),
    address_rule("allow", "com/fr/"),
    address_rule("block", "com/de/"),
)
PATTERN_RULES = (
    pattern_rule("block", r"(^|[.-])(free-)?bets?[.-]", "bet"),
    pattern_rule("block", r"(^|[.-])(free-)?bets?[.-]", "bets"),
    pattern_rule("block", r"(^|[.-])casinos?[.-]", "casino"),
    pattern_rule("block", r"(^|[.-])casinos?[.-]", "casinos"),
    pattern_rule("block", r"(^|[./-])(xxx|porn)([./-]|$)", "porn"),
    pattern_rule("block", r"(^|[./-])(xxx|porn)([./-]|$)", "xxx"),
    pattern_rule("block", r"(^|[.-])cheap-pills[.-]", "pills"),
    pattern_rule("block", r"(^|[./-])warez([./-]|$)", "warez"),
)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0)))


def parts(url: Column) -> tuple[Column, Column]:
    """``host, path``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to
    ``?``, ``#`` or the end. Both empty for a null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, address_rules: Sequence[Rule] = ADDRESS_RULES, pattern_rules: Sequence[Rule] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` of every row.

    ``rule`` is the longest address rule that fits, ties to the smaller text, and gives the verdict. Without
    one, ``pattern`` is the first pattern rule that matches ``host`` and ``path``, and gives it; without that
    the page is allowed. Null URLs and those without ``://`` have an empty host and path, and are allowed. Repeated
    rows and null ids are judged like others. An empty table gives an empty result. Columns beside ``id_col`` and ``url_col`` are not read.
    """
    rules = [*address_rules, *pattern_rules]
    if loose := [r.name for r in rules if not r.literals]:
        raise ValueError(f"no whole literal token: {loose}")
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", _tokens(F.concat("host", "path")))
    counts = _counts(rows, sorted({t for r in rules for t in r.literals}))
    if len(rules) > MOST_LITERAL:
        return _by_table(rows, rules, counts)
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        index.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []).append(k)
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    entries = F.create_map(*[x for t, ks in index.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in ks]))])
    table = F.array(*[F.struct(F.lit(r.address).alias("address"), F.lit(len(r.name) if r.address else 0).alias("length"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.action).alias("action"), F.lit(k).alias("k")) for k, r in enumerate(rules)])
    fetched = F.flatten(F.transform(F.filter("tokens", lambda t: F.map_contains_key(entries, t)), lambda t: entries[t]))
    rows = rows.withColumn("place", F.concat("host", "path")).withColumn("fetched", F.transform(fetched, lambda k: F.element_at(table, k + 1)))
    fits = F.filter("fetched", lambda r: F.regexp_like(F.col("place"), r["pattern"]))
    rows = rows.select("page_id", "host", "path", fits.alias("fits"))
    # the longest address; then the smaller text, then the earlier pattern
    best = lambda address: F.element_at(F.array_sort(F.filter("fits", lambda r: r["address"] == F.lit(address)), lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(F.lit(address) & (a["name"] < b["name"]), F.lit(-1)).when(F.lit(address) & (a["name"] > b["name"]), F.lit(1)).otherwise(a["k"] - b["k"])), 1)
    some = lambda address: F.exists("fits", lambda r: r["address"] == F.lit(address))
    rows = rows.select("page_id", "host", "path", F.when(some(True), best(True)).alias("rule"), F.when(some(False), best(False)).alias("own"))
    return rows.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.coalesce("rule.action", "own.action", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("own.name")).alias("pattern"))


def _by_table(rows: DataFrame, rules: Sequence[Rule], counts: dict[str, int]) -> DataFrame:
    """As the end of ``judge``, for rules in a table by their rarest token; each distinct host and path is judged once."""
    spark = rows.sparkSession
    listed = [(min(r.literals, key=lambda t: (counts.get(t, 0), t)), r.address, len(r.name) if r.address else 0, r.name, r.pattern, r.action, k) for k, r in enumerate(rules)]
    table = spark.createDataFrame(listed, "token string, address boolean, length int, name string, pattern string, action string, k int")
    urls = rows.groupBy("host", "path").agg(F.first("tokens").alias("tokens"))
    tried = urls.select("host", "path", F.explode("tokens").alias("token")).join(table, "token").filter(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    address = F.min(F.when(F.col("address"), F.struct(-F.col("length"), "name", "k", "action")))
    own = F.min(F.when(~F.col("address"), F.struct("k", "name", "action")))
    best = tried.groupBy("host", "path").agg(address.alias("rule"), own.alias("own"))
    out = rows.drop("tokens").join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.coalesce("rule.action", "own.action", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("own.name")).alias("pattern"))


def _counts(rows: DataFrame, literals: list[str]) -> dict[str, int]:
    """How many URLs have each of the rules' literals: at most one row each."""
    if len(literals) > MOST_LITERAL:
        wanted = rows.sparkSession.createDataFrame([(t,) for t in literals], "token string")
        found = rows.select(F.explode("tokens").alias("token")).groupBy("token").count().join(wanted, "token")
    else:
        own = F.array(*[F.lit(t) for t in literals]) if literals else F.array().cast("array<string>")
        found = rows.select(F.explode(F.array_intersect("tokens", own)).alias("token")).groupBy("token").count()
    return {r[0]: r[1] for r in found.collect()}
