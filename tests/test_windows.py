"""The check of windows while typing, from one pass over the texts, against the check of each window as a text."""

import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import check, windows
from lexispark.plans import evaluate, queries
from lexispark.streaming import typing

from .test_reports import lex  # noqa: F401

PARTS = ["tôi", "làm", "trong", "nghành", "này", "chia", "sẽ", "sẻ", "sẽ", "Sẽ", "SẼ", "nganh", "Nghành", "NGHÀNH", "lamf", "electron", "x", "e", "Tôi", "toi.", "sẽ!", "(sẽ)", "…", "12", "a1", "`", "```", "`sẽ", "nghành`", "``", "https://a.b/sẽ", "a@b.vn", "#sẽ", "@nghành", "./sẽ", "sẽ,nghành", "chia-sẽ", "sẽ:", ":", "日本", "😀", "sẽ\u0301", "\u200bsẽ", "nghành\u00a0", "\u3000chia", "s\x1cẽ", "abcdefghijklmnopqsẽ", "abcdefghijklmnopq", "sẽ😀", "C:\\sẽ", "www.sẽ", "-", "'sẽ'"]


def _texts():
    pick = random.Random(5)
    gaps = [" ", " ", " ", "  ", "\n", "\t", ", ", ". ", "\n\n    "]
    out = ["".join(pick.choice(PARTS[: 24 if k % 2 else None]) + pick.choice(gaps) for _ in range(pick.randrange(25))) for k in range(160)]
    return dict(enumerate([*out, "", "  ", None, "nghành", "nghành ", "sẽ", "chia sẽ này chia sẽ này"]))


@pytest.mark.parametrize("options", [check.CheckOptions(margin=1.0), check.CheckOptions(margin=1.0, unattested=True), check.CheckOptions(real_word=False)])
def test_windows_equal_the_check_of_each(spark, lex, options):  # noqa: F811
    texts = _texts()
    phrases = {(k, n): " ".join(w[max(0, n - 4) : n + 1]) for k, t in texts.items() for w in [windows.solid_words(t or "")] for n in range(len(w))}
    found = check.recheck(spark.createDataFrame([(p,) for p in phrases.values()], "phrase string"), lex, options)
    by = {r.phrase: tuple(r)[1:] for r in found.collect()}
    want = {(*k, *by[p]) for k, p in phrases.items() if p in by}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(want) > 100 and {tuple(r) for r in windows.window_hits(table, lex, options).collect()} == want
    words = table.select("doc_id", F.filter(F.split("text", r"[\p{IsWhite_Space}]+"), lambda w: w != "").alias("w")).collect()
    assert {r.doc_id: r.w or [] for r in words} == {k: windows.solid_words(t or "") for k, t in texts.items()}


def test_typed_texts_equal_their_keys(spark, lex):  # noqa: F811
    table = spark.createDataFrame([(f"{k % 150}:{k}", t) for k, t in _texts().items()], "session string, text string")
    keys = table.select("session", F.posexplode(F.split("text", "")).alias("seq", "ch")).filter("ch <> ''")
    event = F.when(typing.breaks(F.col("ch")), "WordBreak").otherwise("Char")
    events = keys.select("session", F.col("seq").cast("long"), (F.col("seq") * 100).cast("long").alias("ts_ms"), event.alias("event"), "ch", F.lit("Physical").alias("source"))
    options, own = check.CheckOptions(margin=1.0), spark.createDataFrame([("nganh",)], "word string")
    for personal in (None, own):
        want = sorted(map(repr, typing.suggestions(events, lex, options, personal).collect()))
        assert len(want) > 20 and sorted(map(repr, typing.typed_suggestions(table, lex, options, personal).collect())) == want


def _stored(monkeypatch, *modules):
    """Rows of the tables that these modules write, by name."""
    rows = {}

    def kept(df, name, write=check.written):
        out = write(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "written", kept)
    return rows


def test_windows_are_no_rows(spark, lex, monkeypatch):  # noqa: F811
    rows = _stored(monkeypatch, check, evaluate, windows)
    table = spark.createDataFrame([(1, " ".join(f"foreign{k}ing" for k in range(3000)) + " nghành")], "doc_id long, text string")
    assert [tuple(r) for r in evaluate.realtime_flags(table, lex).collect()] == [(1, 3000, "nghành")]
    assert max(n for k, v in rows.items() if k != "check-tried" for n in v) < 10


def test_realtime_makes_the_candidates_once(spark, monkeypatch):
    rows = _stored(monkeypatch, check, evaluate, windows)
    assert queries.eval_realtime(spark, "/root/testdata/sf0.001").count() == 1
    assert len(rows["check-tried"]) == 1


def test_keys_of_typed_texts_are_no_rows(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a row of each key")

    monkeypatch.setattr(queries, "_typed", none)
    assert queries.typing_suggestions(spark, "/root/testdata/sf0.001").columns == ["session", "seq", "action", "word", "replacement", "certain", "erase", "retype"]
