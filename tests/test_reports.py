"""Sources, sinks, reports, review and typing."""

import bz2
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexispark.functions import review
from lexispark.functions.text import lookup_key, looks_vietnamese, match_case
from lexispark.operators import check, lexicon, pages, tokens
from lexispark.plans import evaluate, queries
from lexispark.sources import files
from lexispark.streaming import typing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lex(spark):
    known = spark.createDataFrame([("ngành", 50, 50), ("này", 90, 90), ("chia", 30, 30), ("sẻ", 25, 25), ("sẽ", 400, 400), ("tôi", 500, 500), ("trong", 300, 300), ("làm", 200, 200)], "syllable string, dump_count long, sentence_count long")
    twos = spark.createDataFrame([("chia", "sẻ", 24), ("làm", "trong", 40), ("trong", "ngành", 35)], "a string, b string, count long")
    threes = spark.createDataFrame([("tôi", "chia", "sẻ", 9)], "a string, b string, c string, count long")
    return lexicon.Lexicon(known, spark.createDataFrame([("electron",)], "token string"), twos, threes)


@pytest.mark.parametrize("form", ["parquet", "tsv"])
def test_lexicon_round_trip(spark, tmp_path, lex, form):
    files.write_lexicon(lex, str(tmp_path), form)
    got = files.lexicon_tables(spark, str(tmp_path), form)
    for name in ("attested", "bigrams", "trigrams"):
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, getattr(lex, name).collect()))
    if form == "tsv":
        assert [r.token for r in got["accepted"].collect()] == ["electron"]


def test_frequencies_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("rare", 1), ("c", 9)], "token string, count long")
    files.write_frequencies(counts, str(tmp_path / "f"), source="dump")
    lines = [r.value for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert sorted(x for x in lines if x.startswith("#")) == ["# distinct: 4 (>= 2: 3)", "# source: dump", "# tokens: 20"]
    assert [x for x in lines if not x.startswith("#")] == ["c\t9", "a\t5", "b\t5"]
    with open(tmp_path / "g", "w") as f:
        f.write("# x\nTIẾNG\t2\ntiếng\t3\nbad\tx\n\nzero\t0\n")
    assert {tuple(r) for r in files.frequencies(spark, str(tmp_path / "g")).collect()} == {("tiếng", 5), ("zero", 0)}


def test_lines_and_errors_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("Một câu.",), ("Hai câu.",)], "sentence string")
    files.write_sentences(rows, str(tmp_path / "s"))
    assert {r.text for r in files.sentence_lines(spark, str(tmp_path / "s")).collect()} == {"Một câu.", "Hai câu."}
    files.write_syllables(spark.createDataFrame([("b",), ("a",)], "syllable string"), str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ["a", "b"]
    planted = spark.createDataFrame([(0, 3, "sẽ", "sẻ", "sẽ chia")], "start_byte int, end_byte int, wrong string, right string, sentence string")
    files.write_errors(planted, str(tmp_path / "e"))
    assert [tuple(r) for r in files.errors(spark, str(tmp_path / "e")).collect()] == [(0, 3, "sẽ", "sẻ", "sẽ chia")]


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{}</title>{}<revision><text>{}</text></revision></page>"
    xml = "<mediawiki>" + page.format("A", "<ns>0</ns>", "Tiếng {{x}} [[a|Việt]]") + page.format("B", "<ns>1</ns>", "no") + page.format("C", "", "no") + "</mediawiki>"
    with bz2.open(tmp_path / "d.xml.bz2", "wt", encoding="utf-8") as f:
        f.write(xml)
    assert [(r.title, r.text.split()) for r in files.wiki_dump(spark, str(tmp_path / "d.xml.bz2")).collect()] == [("A", ["Tiếng", "Việt"])]


@pytest.mark.parametrize(
    ("raw", "left"),
    [("a<!-- x\ny -->b", "a b"), ("a<math>x<b></math >b", "a b"), ("x<ref name=q/>y", "x y"), ("y<ref>z</ref>w", "y w"), ("{| t\n|}k", "k"), ("{{a{{b}}c}}d", "d"), ("{{a{{b{{c{{d{{e{{f{{g}}}}}}}}}}}}}}h", "a h"), ("[[Tập tin:x.png|y]]z", "z"), ("[[đích|nhãn]]", "nhãn"), ("[[đích]]", "đích"), ("[http://a.b nhãn]", "nhãn"), ("x http://a.b/c y", "x y"), ("<br>q<" + "x" * 201 + ">", "q<" + "x" * 201 + ">"), ("== Mục ==", "Mục"), ("&amp;lt;b&amp;gt;đậm", "đậm")],
)
def test_markup(spark, raw, left):
    got = pages.clean_pages(spark.createDataFrame([(1, raw)], "page_id long, html string")).first().text
    assert got.split() == left.split()


def test_kinds_equal_the_tokenizer(spark):
    texts = ["", "tiếng  Việt 12 a1 ٣ ² ​ ́x ! … 日本 \n", "a@b.c #d `e` ٣٣ 1٣", "😀½ǅ"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    want, size = Counter(), Counter()
    for t in texts:
        for x in tokens.tokenize(t):
            want[x.kind] += 1
            size[x.kind] += x.end - x.start
    assert {r.kind: (r.n, r.bytes) for r in tokens.kinds(rows).collect()} == {k: (want[k], size[k]) for k in want}


def test_regions_take_linear_time():
    import time

    text = "word me@x.org #tag `code` https://a.b/c " * 12_000
    began = time.time()
    assert len(tokens.tokenize(text)) > 100_000 and time.time() - began < 20


def test_capitals_after_other_tokens():
    from lexispark.operators import rules

    assert [f.found for f in rules.findings("Xong. ٣ bạn. bạn", options=rules.RuleOptions(True))] == ["bạn"]


def test_column_forms(spark):
    rows = spark.createDataFrame([("TIẾNG​", "đẹp", "XIN", "Xin")], "a string, b string, c string, d string")
    got = rows.select(lookup_key(F.col("a")), looks_vietnamese(F.col("a")), match_case(F.col("b"), F.col("c")), match_case(F.col("b"), F.col("d")), match_case(F.col("b"), F.col("b"))).first()
    assert tuple(got) == ("tiếng", False, "ĐẸP", "Đẹp", "đẹp")


def test_counts_of_words(spark):
    rows = spark.createDataFrame([(1, "a b a\n\nb c"), (2, None), (3, "")], "doc_id long, text string")
    lines = tokens.lines(rows)
    assert {tuple(r) for r in lexicon.unigrams(lines).collect()} == {("a", 2, 1), ("b", 2, 2), ("c", 1, 1)}
    assert tuple(lexicon.totals(lines).first()) == (2, 5)
    assert tuple(lexicon.totals(lines.limit(0)).first()) == (0, 0)


def test_surroundings_and_segments(spark):
    text = "đầu\n" + "x" * 40 + "SAI" + "y" * 30 + "\tcuối"
    start = len(text[: text.index("SAI")].encode())
    row = spark.createDataFrame([(text, start, start + 3)], "t string, a int, b int")
    before, after = row.select(*review.surroundings(F.col("t"), F.col("a"), F.col("b"))).first()
    assert (before, after) == ("x" * 26, "y" * 26)
    edge = spark.createDataFrame([("đ\nab", 0, 2)], "t string, a int, b int").select(*review.surroundings(F.col("t"), F.col("a"), F.col("b"))).first()
    assert tuple(edge) == ("", " ab")
    changes = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("to")) for a, b, c in ((6, 8, "Z"), (0, 2, "Đ"))])
    got = spark.createDataFrame([("đabcdefgđ",)], "t string").select(review.segments(F.col("t"), changes)).first()[0]
    assert [(s.text, s.changed) for s in got] == [("Đ", True), ("abcd", False), ("Z", True), ("gđ", False)]
    assert spark.createDataFrame([("đ",)], "t string").select(review.segments(F.col("t"), F.array().cast("array<struct<start:int,end:int,to:string>>"))).first()[0] == [("đ", False)]


def test_request(spark):
    row = spark.createDataFrame([("Câu.", ["sai"]), ("Câu.", [])], "t string, f array<string>")
    got = [r.q for r in row.select(review.request("rewrite", F.col("t"), F.col("f"), "trang trọng").alias("q")).collect()]
    assert "trang trọng" in got[0].system and got[0].user.startswith("Found already:\n- sai\n\n") and got[1].user == "Text:\n\nCâu."
    with pytest.raises(ValueError):
        review.request("rewrite", F.col("t"), F.col("f"))


def test_dump_frequency(spark):
    raw = {r.page_id: r.text for r in queries.pages_without_markup(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    want = Counter(w for t in raw.values() for w in re.findall(f"[{tokens.ALPHABET}]+", (t or "").lower()))
    assert {r.token: r["count"] for r in queries.dump_frequency(spark, SF).collect()} == want


def test_personal_dictionary(spark):
    found = spark.createDataFrame([("Abc", "InvalidSyllable"), (" ,", "Punctuation"), ("x", "RealWord")], "found string, kind string")
    own = spark.createDataFrame([("ABC",)], "word string")
    assert {r.found for r in check.without_personal(found, own).collect()} == {" ,", "x"}
    assert {r.found for r in check.without_personal(found, own, False).collect()} == {"x"}


def _simulated(text, hits):
    """Flagged places, by a table of hits of each phrase: (words from the end) with a finding."""
    words, seen = text.split(), []
    for end in range(1, len(words) + 1):
        window = words[max(0, end - 5) : end]
        for back in (0, 1):
            if back < len(window) and back in hits(" ".join(window)):
                if (place := end - 1 - back) not in seen:
                    seen.append(place)
                break
    return set(seen)


def test_realtime(spark, lex):
    texts = {1: "tôi làm trong nghành này tôi chia sẽ này", 2: "  ", 3: "nghành\nnghành", 4: None, 5: "làm"}
    options = check.CheckOptions(margin=2.0)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    windows = {" ".join((t or "").split()[max(0, e - 5) : e]) for t in texts.values() for e in range(1, len((t or "").split()) + 1)}
    numbered = dict(enumerate(sorted(windows)))
    found = check.check(spark.createDataFrame(list(numbered.items()), "doc_id long, text string"), lex, options).collect()
    by = {}
    for f in found:
        if f.kind not in ("Punctuation", "Capitalization") and f.options:
            by.setdefault(numbered[f.doc_id], set()).add(f.start_byte)

    def hits(phrase):
        words, at, out = phrase.split(" "), 0, set()
        for k, w in enumerate(words):
            if at in by.get(phrase, ()):
                out.add(len(words) - 1 - k)
            at += len(w.encode()) + 1
        return out

    got = {}
    for r in evaluate.realtime_flags(table, lex, options).collect():
        got.setdefault(r.doc_id, set()).add(r.place)
    assert got == {k: v for k, t in texts.items() if (v := _simulated(t or "", hits))}
    assert 3 in got[1] and got[3] == {0, 1}
    planted = spark.createDataFrame([(9, 14, "tôi làm trong nghành này".replace("làm", "làm"))], "doc_id long, start_byte int, text string")
    row = evaluate.realtime_report(table, planted.withColumn("start_byte", F.lit(len("tôi làm trong ".encode()))), lex, options).first()
    assert (row.words, row.planted, row.caught, row.recall) == (12, 1, 1, 1.0) and row.alarms_viet + row.alarms_ascii == sum(map(len, got.values()))


def test_word_accuracy(spark):
    rows = spark.createDataFrame([("Tôi yêu Huế", "Tôi yêu Hue"), ("a b", "a"), (" x  y ", "x y")], "truth string, restored string")
    assert evaluate.word_accuracy(rows).first().asDict() == {"sentences": 3, "exact": 1, "words": 5, "right": 4, "lower": 3, "lower_right": 3, "capitalised": 2, "capitalised_right": 1}


def test_key_events(spark):
    keys = [(0x41, 0, False, "Char", "a"), (0x41, 0, True, "Char", "A"), (0x31, 0, False, "Char", "1"), (0x31, 0, True, None, None), (0x20, 0, False, "WordBreak", " "), (0x0D, 0, False, "WordBreak", "\n"), (0x08, 0, False, "Backspace", None), (0x25, 0, False, "CaretMoved", None), (0xBC, 0, True, "WordBreak", "<"), (0xBD, 0, True, "Char", "_"), (0xE7, ord("ấ"), False, "Char", "ấ"), (0xE7, ord("!"), False, "WordBreak", "!"), (0x10, 0, False, None, None)]
    rows = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(keys)], "seq long, vk int, scan int, shift boolean")
    assert {r.seq: (r.event, r.ch) for r in typing.key_events(rows).collect()} == {k: x[3:] for k, x in enumerate(keys) if x[3]}


def test_focus_and_own_input(spark):
    t = typing.Typist()
    assert [t.feed(k, "Char", c, "Physical") for k, c in enumerate("ab")] == [None, None]
    t.feed(5, "FocusChanged", None, "Physical", True)
    assert t.feed(6, "Char", "x", "Physical") is None and t.word == ""
    t.feed(7, "FocusChanged", None, "Physical", False)
    t.expect_own(2)
    for k, c in enumerate("xyz"):
        t.feed(100 + k, "Char", c, "Injected")
    assert t.feed(200, "WordBreak", " ", "Physical") == ("z", " ")
    rows = spark.createDataFrame([("KeePass.exe", False), ("x.exe", True), ("x.exe", None), (None, None), ("my.exe", False)], "app string, password boolean")
    assert [r[0] for r in rows.select(typing.blocked(F.col("app"), F.col("password"), ["My.exe"])).collect()] == [True, True, False, False, True]


def test_decisions():
    assert [typing.decide(p, h) for p, h in ((None, None), (("a", "b"), None), (("a", "b"), ("a", "b")), (("a", "b"), ("a", "c")), (None, ("a", "b")))] == ["Clear", "Keep", "Keep", "Show", "Show"]
    assert typing.absorb("ab", "Backspace", None) == "a" and typing.absorb("", "Backspace", None) is None
    assert typing.absorb("x" * 23, "Char", "y") == "x" * 23 + "y" and typing.absorb("x" * 24, "Char", "y") is None and typing.absorb("q", "CaretMoved", None) == "q"
    assert typing.apply_plan("sẽ", " ", "nhé", "sẻ") == (6, "sẻ nhé")


def test_suggestions(spark, lex):
    def typed(session, text, *more):
        keys = [(c, "WordBreak" if c in " ,." else "Char") for c in text] + list(more)
        return [(session, k, 100 * k, event, c, "Physical") for k, (c, event) in enumerate(keys)]

    rows = [*typed("a", "trong nghành này ", (None, "Accept")), *typed("b", "nghành ", (None, "CaretMoved")), *typed("c", "nghành " + "làm " * 7), *typed("d", "làm trong ")]
    events = spark.createDataFrame(rows, "session string, seq long, ts_ms long, event string, ch string, source string")
    out = typing.suggestions(events, lex).orderBy("session", "seq").collect()
    got = [(r.session, r.action, r.word, r.replacement, r.erase, r.retype) for r in out]
    assert got == [("a", "Show", "nghành", "ngành", None, None), ("a", "Apply", "nghành", "ngành", 11, "ngành này "), ("b", "Show", "nghành", "ngành", None, None), ("b", "Hide", "nghành", "ngành", None, None), ("c", "Show", "nghành", "ngành", None, None), ("c", "Hide", "nghành", "ngành", None, None)]
    own = spark.createDataFrame([("Nghành",)], "word string")
    assert typing.suggestions(events, lex, personal=own).count() == 0


def test_suggestions_stream(spark, lex, tmp_path):
    keys = [("a", k, 100 * k, "WordBreak" if c == " " else "Char", c, "Physical") for k, c in enumerate("trong nghành này ")]
    table = spark.createDataFrame(keys, "session string, seq long, ts_ms long, event string, ch string, source string")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = typing.suggestions_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), lex, lambda df, n: seen.extend(map(tuple, df.collect()))).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == sorted(map(tuple, typing.hits(typing.words_batch(table), lex).collect()))
    assert {x[3] for x in seen} == {"nghành"}
