"""Markup off whole pages. Each construct of the markup is a row of a table: what opens it, what it may hold,
what closes it. Its expression is built from that row."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements whose content is no prose, link targets that are no prose, schemes of addresses,
# marks that are left over, how deep templates nest, and the longest tag.
VERBATIM = ("nowiki", "math", "chem", "code", "pre", "syntaxhighlight", "source", "timeline")
NAMESPACES = ("file", "image", "tập tin", "hình", "thể loại", "category", "media")
SCHEMES = ("https", "http", "ftp")
LEFT_OVER = "[]{}|'*#:;="
DEPTH, LONGEST_TAG = 6, 200


class Construct(NamedTuple):
    """``opens`` and ``closes`` are expressions; ``holds`` says what may stand between."""

    opens: str
    holds: str
    closes: str = ""
    flags: str = "siu"

    def expression(self) -> str:
        return f"(?{self.flags}){self.opens}{self.holds}{self.closes}"


_ANYTHING, _lit = ".*?", re.escape


def _none_of(marks: str, count: str = "*") -> str:
    return f"[^{_lit(marks)}]{count}"


def _either(words) -> str:
    return "(?:" + "|".join(map(_lit, words)) + ")"


def _element(name: str) -> Construct:
    return Construct(f"<{name}{_none_of('>')}>", _ANYTHING, rf"</{name}\s*>")


_ADDRESS = f"{_either(SCHEMES)}://"
#: In the order that the constructs need: what may hide others comes first, inner before outer.
CONSTRUCTS = (
    Construct(_lit("<!--"), _ANYTHING, _lit("-->")),
    *map(_element, VERBATIM),
    _element("ref"),
    Construct("<ref", _none_of(">"), r"/\s*>"),
    Construct(_lit("{|"), _ANYTHING, _lit("|}")),
    *(Construct(_lit("{{"), _none_of("{}"), _lit("}}")),) * DEPTH,
    Construct(rf"\[\[\s*{_either(NAMESPACES)}\s*:", _none_of("[]"), _lit("]]")),
    Construct("<", _none_of(">", f"{{0,{LONGEST_TAG}}}"), ">"),
    Construct(rf"\[{_ADDRESS}", r"[^\s\]]*", flags="s"),
    Construct(_ADDRESS, r"\S+", flags="s"),
    Construct(_lit("[["), _none_of("]|"), _lit("|")),
    Construct(f"[{_lit(LEFT_OVER)}]", ""),
)


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts if texts.isna().all() else texts.map(lambda t: html.unescape(html.unescape(t)), na_action="ignore")


def clean(text: Column) -> Column:
    """Each construct becomes a space; entities are decoded twice, first, and only where there is one."""
    out = F.coalesce(_unescape(F.when(F.instr(text, "&") > 0, text)), text)
    for construct in CONSTRUCTS:
        out = F.regexp_replace(out, construct.expression(), " ")
    return out


def clean_pages(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), clean(F.col(text_col)).alias("text"))
