"""Golden cases of tokens, syllables, rules and key events."""

import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexispark.operators import lexicon, lm, phonology, rules, tokens
from lexispark.operators.restore import restore as restore_operator
from lexispark.streaming.typing import Typist


def checked(text):
    return [t.norm for t in tokens.tokenize(text) if t.kind == "Word" and t.protect is None]


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("Xem tại https://vi.wikipedia.org/wiki/Tiếng_Việt.", "xem tại"),
        ("truy cập www.example.com nhé", "truy cập nhé"),
        ("gửi cho a.b@c.com.vn nha", "gửi cho nha"),
        ("chào @khanh xem #tiengviet đi", "chào xem đi"),
        ("dùng `cargo buildd` nhé", "dùng nhé"),
        ("xem\n```\nsaii `x\n```\nxong", "xem xong"),
        ("mã:\n    let saii = 1;\nhết", "mã hết"),
        (r"mở D:\THUMUC\filee.txt rồi ../src/mainn.rs", "mở rồi"),
        ("nam/nữ và/hoặc", "nam nữ và hoặc"),
        ("HĐND ban hành QĐ số 12 khổ A4 về COVID19", "ban hành số khổ về"),
        ("Tôi sai. Nhưng sửa được.", "tôi sai nhưng sửa được"),
        ("dòng một\nHai dòng", "dòng một hai dòng"),
    ],
)
def test_checked_words(text, words):
    assert checked(text) == words.split()


def test_reasons():
    assert [t.protect for t in tokens.tokenize("bước sóng λ") if t.kind == "Word"][-1] == "NonLatinScript"
    got = {t.raw: t.protect for t in tokens.tokenize("xem https://a.vn/wiki/Viet nhe")}
    assert got["Viet"] == "ProperNoun" and got["wiki"] == "Url"


@pytest.mark.parametrize("text", ["", "   ", "…!?", "a@b.com  #tag\n\tcode\n…", "tie\u0302\u0301ng Việt", "x\u00a0y 😀 λ٣"])
def test_tokens_tile(text):
    found = tokens.tokenize(text)
    assert "".join(t.raw for t in found) == text
    assert [t.start for t in found] == list(itertools.accumulate([0, *(t.end - t.start for t in found)]))[:-1] if found else text == ""


def test_key_of_decomposed_text():
    first = tokens.tokenize(unicodedata.normalize("NFD", "tiếng") + " Việt")[0]
    assert (first.norm, first.start, first.end) == ("tiếng", 0, 9)


@pytest.mark.parametrize(("text", "found"), [("xin  chào", [("  ", " ")]), ("xin chào , bạn", [(" ,", ",")]), ("xin chào,bạn", [(",b", ", b")]), ("giá 1.000 đồng lúc 10:30, 3,14", []), ("đây là (ví dụ", [("(", ")")]), ('nói "xin chào', [('"', '"')]), ("xem https://a.vn,b nhé", [])])
def test_rules(text, found):
    assert [(f.found, f.fix) for f in rules.findings(text)] == found


def test_options_of_rules():
    options = rules.RuleOptions(True, True)
    assert [f.found for f in rules.findings("xin chào. bạn khoẻ", options=options)] == ["xin", "bạn"]
    assert [f.fix for f in rules.findings("Đợi đã... rồi", options=rules.RuleOptions(False, True))] == ["…"]


def test_splice_skips_overlaps():
    assert rules.splice("xin chào , bạn", [(f.start, f.end, f.fix) for f in rules.findings("xin chào , bạn")]) == "xin chào, bạn"
    assert rules.splice("abcdef", [(0, 3, "X"), (2, 4, "Y")]) == "abYef"


def test_vocabulary(spark):
    words = {r[0] for r in phonology.syllables(spark).collect()}
    assert len(words) == 18261
    assert words >= set("tôi nghiêng quyết khuỷu hòa hoà gì quỳnh yêu mát mạt".split())
    assert not words & set("nghành ngiên ce mat quyêt tieng quuyên".split())


def test_composition_inverts_decomposition(spark):
    every = phonology.syllables(spark)
    read = phonology.decompose(every).withColumnRenamed("syllable", "word")
    made = phonology.compose(read)
    back = {r[0] for r in made.filter("word = syllable").select("word").distinct().collect()}
    # the other placement of the tone is read, but not written
    rest = {r[0] for r in every.collect()} - back
    assert all(any(x in w for x in ("ò", "ó", "ỏ", "õ", "ọ", "à", "á", "ả", "ã", "ạ", "è", "é", "ẻ", "ẽ", "ẹ", "ỳ", "ý", "ỷ", "ỹ", "ỵ", "ù", "ú", "ủ", "ũ", "ụ")) for w in rest) and len(rest) < 600


def test_candidates_and_check(spark):
    from lexispark.operators import candidates, check
    from lexispark.operators.lexicon import Lexicon

    known = spark.createDataFrame([("ngành", 50, 50), ("này", 90, 90), ("chia", 30, 30), ("sẻ", 25, 25), ("sẽ", 400, 400), ("tôi", 500, 500), ("trong", 300, 300), ("làm", 200, 200), ("hoà", 5, 5), ("chính", 40, 40)], "syllable string, dump_count long, sentence_count long")
    twos = spark.createDataFrame([("chia", "sẻ", 24), ("làm", "trong", 40), ("trong", "ngành", 35)], "a string, b string, count long")
    threes = spark.createDataFrame([("tôi", "chia", "sẻ", 9)], "a string, b string, c string, count long")
    lex = Lexicon(known, spark.createDataFrame([("electron",)], "token string"), twos, threes)
    words = spark.createDataFrame([("nghành",), ("chinhs",), ("sẽ",)], "syllable string")
    got = {(r.syllable, r.text) for r in candidates.candidates(words, known).collect()}
    assert {("nghành", "ngành"), ("chinhs", "chính"), ("sẽ", "sẻ")} <= got
    docs = spark.createDataFrame([(1, "Tôi làm trong nghành này"), (2, "electron làm trong"), (3, "tôi chia sẽ này"), (4, ""), (5, None)], "doc_id long, text string")
    found = {(r.doc_id, r.kind, r.found): r.options for r in check.check(docs, lex, check.CheckOptions(margin=2.0)).collect()}
    assert "ngành" in found[1, "InvalidSyllable", "nghành"]
    assert found[3, "RealWord", "sẽ"] == ["sẻ"]
    assert not [k for k in found if k[0] in (2, 4, 5)]


def test_restore(spark):
    from lexispark.operators.lexicon import Lexicon
    from lexispark.operators.restore import restore

    known = spark.createDataFrame([("tôi", 50, 50), ("tối", 60, 60), ("yêu", 30, 30), ("tiếng", 20, 20), ("việt", 20, 20)], "syllable string, dump_count long, sentence_count long")
    twos = spark.createDataFrame([("tôi", "yêu", 20), ("yêu", "tiếng", 10), ("tiếng", "việt", 15)], "a string, b string, count long")
    threes = spark.createDataFrame([], "a string, b string, c string, count long")
    lex = Lexicon(known, spark.createDataFrame([], "token string"), twos, threes)
    docs = spark.createDataFrame([(1, "Toi yeu tieng VIET"), (2, "hoc https://a.vn/toi"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in restore(docs, lex).collect()}
    assert got[1].restored == "Tôi yêu tiếng VIỆT" and got[2].restored == "hoc https://a.vn/toi" and got[3].restored is None
    assert got[1].changes[0].options == ["Tôi", "Tối"]


def test_decoder_against_all_paths():
    import random

    r = random.Random(3)
    assert lm.decode([], None) == [] and lm.decode([["a"]], lambda *x: -1.0) == [0]
    for _ in range(50):
        table = {}
        score = lambda a, b, w, t=table: t.setdefault((b, w), -r.random())
        lattice = [[f"{i}{k}" for k in range(r.randint(1, 3))] for i in range(5)]
        got = lm.decode(lattice, score)
        value = lambda p: sum(score(None, lattice[i - 1][p[i - 1]] if i else None, lattice[i][p[i]]) for i in range(5))  # noqa: B023, E731
        assert value(got) == pytest.approx(max(value(p) for p in itertools.product(*[range(len(x)) for x in lattice])))


def test_typing():
    def words(keys):
        typist = Typist()
        return [d[0] for k, (event, ch, source, ts) in enumerate(keys) if (d := typist.feed(ts, event, ch, source))]

    plain = lambda s: [("WordBreak" if c == " " else "Char", c, "Physical", 100 * k) for k, c in enumerate(s)]
    assert words(plain("xin chao ")) == ["xin", "chao"]
    assert words([*plain("abx"), ("Backspace", None, "Physical", 900), ("WordBreak", " ", "Physical", 1000)]) == ["ab"]
    assert words([*plain("ab"), ("CaretMoved", None, "Physical", 900), ("WordBreak", " ", "Physical", 1000)]) == []
    assert words(plain("abcdefghijklmnopqrstuvwxyz ")) == ["rstuvwxyz"]
    # an injected letter right after a swallowed key takes its place
    assert words([*plain("nga"), ("Char", "f", "Physical", 500), ("Backspace", None, "Injected", 505), ("Char", "à", "Injected", 506), ("WordBreak", " ", "Physical", 600)]) == ["ngà"]


def test_stream_equals_batch(spark, tmp_path):
    from lexispark.streaming.typing import words_batch, words_stream

    rows = [(s, k, 100 * k, "WordBreak" if c == " " else "Char", c, "Physical") for s in "ab" for k, c in enumerate(f"xin {s}chao ")]
    keys = spark.createDataFrame(rows, "session string, seq long, ts_ms long, event string, ch string, source string")
    keys.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = words_stream(spark.readStream.schema(keys.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("typed").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(spark.table("typed")) == order(words_batch(keys))


def test_pages(spark):
    from lexispark.operators.pages import clean_pages

    raw = "Xin &lt;ref name=a&gt;x&lt;/ref&gt; {{a {{b}} c}} [[File:x.png]] [[đích|hiện]] <!-- no --> &amp;nbsp;chào [http://a.b c] == Mục =="
    got = clean_pages(spark.createDataFrame([(1, raw), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert got[0].text.split() == ["Xin", "hiện", "chào", "c", "Mục"] and got[1].text is None


SCANNED = ["x http://a.vn/b `code` a@b.vn, @bob #tag", "    indent code\nA. b\U00010400 tiếng VIỆT ABC a1 12 ./x/y http://http://www.x.y", "", None, "`a` `b\nc` Đây. Là\u200b Tie\u0302\u0301ng Ωmega ÄÖ ßx", "a. B c? D\n" * 50]


def test_columns_equal_the_tokenizer(spark):
    words = tokens.Vocabulary()
    for texts in ([t] for t in SCANNED), [SCANNED]:
        for own in texts:
            s = tokens.scan(own, words)
            got = [(own[r], a, z, words.raws[c], tokens.KINDS[k], words.norms[c], tokens.REASONS[w], o) for r, a, z, c, k, w, o in zip(*(x.tolist() for x in (s.row, s.start, s.end, s.code, s.kind, s.reason, s.opening)), strict=True)]
            assert got == [(t, *x) for t in own for x in tokens.tokenize(t or "")]
    docs = spark.createDataFrame(list(enumerate(SCANNED)), "doc_id long, text string")
    rows = tokens.tokens(docs).collect()
    assert {x.norm for x in tokens.vocabulary(docs).collect()} == {x.norm for x in rows if x.kind == "Word"}
    sums = tokens.checked_words(docs).agg(F.sum("checked"), F.sum("protected")).first()
    assert tuple(sums) == tuple(sum(x.kind == "Word" and (x.protect is None) == free for x in rows) for free in (True, False))


def test_lower_alphabet():
    import re

    from lexispark.functions.text import ALPHABET, LOWER_ALPHABET

    assert len(LOWER_ALPHABET) < 40
    text = "".join(chr(k) for k in range(0x10000) if not 0xD800 <= k < 0xE000).lower()
    assert re.findall(f"[{ALPHABET}]+", text) == re.findall(f"[{LOWER_ALPHABET}]+", text)


def test_contexts_hold_known_words_only(spark):
    docs = spark.createDataFrame([(1, "alpha tôi chai sẻ beta"), (2, "gamma tôi chai sẻ delta")], "doc_id long, text string")
    found = rules.words_and_findings(docs, None, lambda: lambda w: 6 if w == "chai" else 4 * (w in ("tôi", "sẻ")))
    assert {(x.l2, x.l1, x.norm, x.r1, x.r2, x.place) for x in found.collect()} == {("", "tôi", "chai", "sẻ", "", True)}


def test_restore_keeps_unknown_words(spark):
    """Texts of many words: rows hold three places at most, and words that no table has stay as they are."""
    known = spark.createDataFrame([("tiếng", 9, 9), ("tiêng", 9, 2), ("việt", 9, 9)], "syllable string, dump_count long, sentence_count long")
    twos = spark.createDataFrame([("tiếng", "việt", 9)], "a string, b string, count long")
    lex = lexicon.Lexicon(known, spark.createDataFrame([], "token string"), twos, spark.createDataFrame([], "a string, b string, c string, count long"))
    text = "Zork blah " * 2000 + "TIENG Viet quux"
    out = restore_operator(spark.createDataFrame([(1, text), (2, None), (3, "zork")], "doc_id long, text string"), lex)
    assert {x.doc_id: x.restored for x in out.collect()} == {1: "Zork blah " * 2000 + "TIẾNG Việt quux", 2: None, 3: "zork"}


def test_contexts_of_scores(spark):
    """Few distinct contexts, and the same scores."""
    lines = spark.createDataFrame([(1, 0, "a b c d a b c x".split()), (1, 1, ["q"]), (2, 0, "z b c y".split())], "doc_id long, line int, words array<string>")
    known = spark.createDataFrame([(c, n, n) for c, n in (("a", 2), ("b", 3), ("c", 3), ("d", 1), ("x", 1))], "syllable string, dump_count long, sentence_count long")
    lex = lexicon.Lexicon(known, known.select(F.col("syllable").alias("token")), spark.createDataFrame([("a", "b", 2), ("b", "c", 3)], "a string, b string, count long"), spark.createDataFrame([("a", "b", "c", 2)], "a string, b string, c string, count long"))
    rows = lm.scored_contexts(lines, lex).collect()
    assert {(x.doc_id, x.pos, x.a, x.b, x.w) for x in rows if x.doc_id == 2} == {(2, 0, None, None, "z"), (2, 1, None, "", "b"), (2, 2, "", "b", "c"), (2, 3, "", "", "y")}
    got, want = ({(x.doc_id, x.line, x.pos): x.score for x in lm.scored(c, lex).collect()} for c in (lm.scored_contexts(lines, lex), lm.line_contexts(lines)))
    assert got == want and len(got) == 13


def test_lexicon_of_texts(spark):
    from lexispark.operators import lexicon, phonology

    texts = ["Tôi đi học\ntôi đi học tôi", None, "", "́a tối đi học, xyz xyz\n\nxyz İx", "Tôi đi\nhọc đi học", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    valid = phonology.syllables(spark)
    one, unis = lexicon.build_from(docs, valid, 2, 2, 2)
    lines = tokens.lines(docs)
    other = lexicon.build(lines, valid, 2, 2, 2)
    for name in ("attested", "accepted", "bigrams", "trigrams"):
        a, b = (sorted(map(tuple, getattr(x, name).select(sorted(getattr(x, name).columns)).collect())) for x in (one, other))
        assert a == b and a, name
    assert sorted(map(tuple, unis.collect())) == sorted(map(tuple, lexicon.unigrams(lines).collect()))


def test_counts_of_the_check(spark):
    from lexispark.operators import check, lexicon, phonology

    texts = ["tôi đi học  , tôi đii học www.a.vn `x y`", None, "Xin chao An , ngưởi phố\xa0é ", "tôi dđi chào", "ABC đz\n xyz b@c.vn a/b ./d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = lexicon.build(tokens.lines(spark.createDataFrame([(1, "tôi đi học\ntôi đi chào")], "doc_id long, text string")), phonology.syllables(spark), 1, 1)
    found, words = check.check_counted(docs, lex)
    assert sorted(map(str, found.collect())) == sorted(map(str, check.check(docs, lex).collect()))
    assert {r.found for r in found.filter("layer = 1").collect()} == {"dđi", "đii", "đz"}
    sums = [df.agg(F.sum("checked"), F.sum("protected")).first() for df in (words, tokens.checked_words(docs))]
    assert sums[0] == sums[1]


def test_words_that_may_have_candidates(spark):
    from lexispark.operators import candidates, phonology

    valid = phonology.syllables(spark)
    known = valid.select("syllable", F.lit(1).alias("sentence_count"))
    words = ["toi", "đii", "tois", "ddi", "uow", "xyz", "hello", "ngưởi", "tóc", "tốc", "cảt", "é", "a", "nghieng", "aws", "qưa", "straße"]
    own = spark.createDataFrame([(w,) for w in words], "syllable string")
    maybe = candidates.maybe_candidates(known)
    assert {r.syllable for r in candidates.top_candidates(own, known).collect()} <= {w for w in words if maybe(w)}
    assert not maybe("xyz") and not maybe("hello") and not maybe("straße")


def test_joined_spaces(spark):
    texts = ["a b  c \n d", "é à\xa0b   ", "A. b c d", " `x y` @z #t w ", "x́ y 漢 z"]
    words = tokens.Vocabulary()
    s, j = tokens.scan(texts, words), tokens.scan(texts, words, joined=True)
    rows = lambda s: [(int(r), words.norms[c], int(a), int(b), int(p), bool(o)) for r, c, a, b, p, o, k in zip(s.row, s.code, s.start, s.end, s.reason, s.opening, s.kind, strict=True) if k != 1]
    assert rows(s) == rows(j) and len(j.code) < len(s.code)
