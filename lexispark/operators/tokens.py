"""Tokens with byte spans, kinds and protected regions; corpus words; sentences."""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import INVISIBLE, LOWER_ALPHABET, MARKS, nfc

#: Tokens of the same kinds in the JVM: they tile a text.
TILES = rf"(?s)[\p{{IsWhite_Space}}]+|[\p{{IsAlphabetic}}{MARKS}{INVISIBLE}0-9]+|."


class Token(NamedTuple):
    start: int
    end: int
    raw: str
    kind: str
    norm: str
    protect: str | None
    sentence_start: bool


def _patterns():
    import regex

    word = rf"\p{{Alphabetic}}{MARKS}{INVISIBLE}"
    space, alnum = r"\p{White_Space}", r"\p{Alphabetic}\p{N}"
    return {
        "tiles": regex.compile(rf"(?s)(?P<space>[{space}]+)|(?P<run>[{word}0-9]+)|."),
        "plain": regex.compile(rf"(?s)[{space}]+|[{word}0-9]+|."),
        "run": regex.compile(rf"[{word}0-9]+"),
        "letters": regex.compile(r"\p{Alphabetic}"),
        "latin": regex.compile(r"[A-Za-zÀ-ɏḀ-ỿ]+"),
        "alnum": regex.compile(rf"[{alnum}]"),
        "solid": regex.compile(rf"[^{space}]*"),
        "local": regex.compile(rf"[{alnum}._+\-]"),
        "domain": regex.compile(rf"[{alnum}.\-]*"),
        "marker": regex.compile(rf"(?<![^{space}(])([@#])([{word}0-9_]+)"),
        "path": regex.compile(rf"(?<![^{space}])(?:[A-Za-z]:[\\/]|\\\\|\.\.?/)[^{space}]*"),
    }


_compiled: dict = {}
_TICK, _INDENT, _AT, _SIGN = re.compile("`"), re.compile(r"(?m)^(?: {4}|\t)[^\n]*"), re.compile("@"), re.compile("[@#]")
_URL, _ROOT = re.compile(r"https?://|ftp://|www\."), re.compile(r"[A-Za-z]:[\\/]|\\\\|\.\.?/")
_TAIL = ".,;:!?)]\"'»…"


def _inside(spans: list[tuple[int, int]]):
    """Whether a place lies in one of the spans, which are sorted by their starts."""
    starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    return lambda i: bool(starts) and (k := bisect_right(starts, i)) > 0 and ends[k - 1] > i


def regions(text: str) -> list[tuple[int, int, str]]:
    """Protected stretches, by start and end."""
    if not _compiled:
        _compiled.update(_patterns())
    # each needs one of these
    if not any(x in text for x in ("`", "@", "#", "/", "\\", "\t", "www.", "    ")):
        return []
    p, out = _compiled, []
    fences, at = [], text.find("```")
    while at >= 0:
        close = text.find("```", at + 3)
        if close < 0:
            break
        fences.append((at, close + 3))
        at = text.find("```", close + 3)
    fenced = _inside(fences)
    out += [(a, b, "Code") for a, b in fences]
    held = None
    for m in _TICK.finditer(text) if "`" in text else ():
        if not fenced(i := m.start()):
            if held is not None and "\n" not in text[held:i]:
                out.append((held, i + 1, "Code"))
                held = None
            else:
                held = i
    for m in _INDENT.finditer(text) if "    " in text or "\t" in text else ():
        if m[0].strip():
            out.append((m.start(), m.start() + len(m[0].rstrip("\r\n")), "Code"))

    def trimmed(a: int, b: int) -> int:
        return a + len(text[a:b].rstrip(_TAIL))

    # the patterns are tried where their fixed characters are
    for h in _URL.finditer(text) if "//" in text or "www." in text else ():
        if not fenced(h.start()):
            out.append((h.start(), trimmed(h.start(), p["solid"].match(text, h.start()).end()), "Url"))
    emails = []
    for h in _AT.finditer(text) if "@" in text else ():
        a = h.start()
        while a and p["local"].match(text, a - 1):
            a -= 1
        domain = p["domain"].match(text, h.end())
        if a < h.start() and "." in domain[0] and not domain[0].endswith("."):
            emails.append((a, trimmed(a, domain.end())))
    out += [(a, b, "Email") for a, b in emails]
    mailed = _inside(emails)
    for h in _SIGN.finditer(text) if "@" in text or "#" in text else ():
        m = p["marker"].match(text, h.start())
        if m and not fenced(m.start()) and not mailed(m.start()):
            out.append((m.start(), m.end(), "Mention" if m[1] == "@" else "Hashtag"))
    for h in _ROOT.finditer(text) if "/" in text or "\\" in text else ():
        m = p["path"].match(text, h.start())
        if m and not fenced(m.start()):
            out.append((m.start(), trimmed(m.start(), m.end()), "Path"))
    return sorted((r for r in out if r[1] > r[0]), key=lambda r: r[:2])


_UNSEEN = {ord(c): None for c in INVISIBLE}


def _key(raw: str) -> str:
    return unicodedata.normalize("NFC", raw).translate(_UNSEEN).lower()


def _reason(raw: str, sentence_start: bool) -> str | None:
    p = _compiled
    letters = p["letters"].findall(raw)
    if not p["latin"].fullmatch("".join(letters)):
        return "NonLatinScript"
    if len(letters) >= 2 and all(c.isupper() for c in letters):
        return "Acronym"
    if not sentence_start and letters[0].isupper():
        return "ProperNoun"
    return None


class _Fact(NamedTuple):
    """What a raw token says by itself: ``at_start`` and ``inside`` are its own reasons there; ``opens`` and ``closes`` a sentence start."""

    kind: str
    norm: str
    size: int
    at_start: str | None
    inside: str | None
    opens: bool
    closes: bool


_facts: dict[str, _Fact] = {}


def _fact(raw: str, space: bool, run: bool) -> _Fact:
    p, size, norm = _compiled, len(raw.encode()), _key(raw)
    if space:
        return _Fact("Space", norm, size, None, None, "\n" in raw, False)
    if not run:
        kind = "Other" if p["alnum"].match(raw) else "Punct"
        return _Fact(kind, norm, size, None, None, kind == "Punct" and raw in ".!?…:;", False)
    digit = any(c in "0123456789" for c in raw)
    if p["letters"].search(raw):
        return _Fact("Word", norm, size, *(("MixedAlnum",) * 2 if digit else (_reason(raw, True), _reason(raw, False))), False, True)
    return _Fact("Number", norm, size, "Number", "Number", False, True) if digit else _Fact("Other", norm, size, None, None, False, False)


def tokenize(text: str) -> list[Token]:
    """Tokens that tile ``text``; spans are in UTF-8 bytes. A token's own reason goes before a region's.

    What a raw token says by itself is remembered; time is linear in the text and its regions.
    """
    zones = regions(text)
    out, byte, opening, zone = [], 0, True, 0
    for m in _compiled["tiles"].finditer(text):
        raw = m[0]
        fact = _facts.get(raw)
        if fact is None:
            fact = _fact(raw, m["space"] is not None, m["run"] is not None)
            if len(_facts) >= 100_000:
                _facts.clear()
            if len(raw) <= 64:
                _facts[raw] = fact
        starts, reason = opening, fact.at_start if opening else fact.inside
        opening = (opening or fact.opens) and not fact.closes
        if zones and reason is None:
            while zone < len(zones) and zones[zone][1] <= m.start():
                zone += 1
            # sorted by start: none that begins behind the token can hold it
            for k in range(zone, len(zones)):
                if zones[k][0] >= m.end():
                    break
                if zones[k][1] > m.start():
                    reason = zones[k][2]
                    break
        out.append(Token(byte, byte + fact.size, raw, fact.kind, fact.norm, reason, starts))
        byte += fact.size
    return out


KINDS = ("Word", "Space", "Punct", "Number", "Other")
REASONS = (None, "NonLatinScript", "Acronym", "ProperNoun", "MixedAlnum", "Number", "Code", "Url", "Email", "Mention", "Hashtag", "Path")
_LETTERS = re.compile("[A-Za-zÀ-ɏḀ-ỿ]+")
_ASCII = re.compile(r"(?s)[\t-\r ]+|[A-Za-z0-9]+|.")


class Vocabulary(dict):
    """Numbers of raw tokens, with what each says by itself in two columns: ``sizes`` has UTF-8 bytes and code points, ``flags`` its kind, its reasons at
    the start of a sentence and inside, whether it opens (1) or closes (-1) a sentence start, whether the space behind a run belongs to it, and ``mark`` of the normalised word."""

    def __init__(self, mark=None, most: int = 300_000):
        super().__init__()
        if not _compiled:
            _compiled.update(_patterns())
        self.mark, self.most, self.raws, self.norms, self.sizes, self.flags = mark, most, [], [], array("q"), array("q")

    def __missing__(self, raw: str) -> int:
        self[raw] = number = len(self.raws)
        tail = raw[-1] == " " and len(raw) > 1 and not raw[0].isspace()
        own = raw[:-1] if tail else raw
        if own.isalpha() and (own.isascii() or _compiled["latin"].fullmatch(own)):
            # letters only, of the Latin script
            norm = own.lower() if own.isascii() else unicodedata.normalize("NFC", own).lower()
            loud = 2 if len(own) > 1 and own.isupper() and all(map(str.isupper, own)) else 0
            size, flags = len(raw.encode()), loud << 3 | (loud or (3 if own[0].isupper() else 0)) << 7
            word = True
        else:
            m = _compiled["tiles"].match(own)
            fact = _fact(own, m["space"] is not None, m["run"] is not None)
            norm, size, word = fact.norm, fact.size + tail, fact.kind == "Word"
            flags = KINDS.index(fact.kind) | REASONS.index(fact.at_start) << 3 | REASONS.index(fact.inside) << 7 | (0 if fact.closes else 1 + fact.opens) << 11
        self.raws.append(raw)
        self.norms.append(norm)
        self.sizes.append(size << 32 | len(raw))
        self.flags.append(flags | tail << 13 | (self.mark(norm) << 14 if self.mark and word else 0))
        return number

    def add(self, new: Iterable[str]) -> None:
        """As if each were looked up; words of Latin letters, with or without the space behind, in one go."""
        mark, latin, normal = self.mark or (lambda w: 0), _LETTERS.fullmatch, unicodedata.normalize
        raws, norms, sizes, flags, rest = [], [], [], [], []
        for raw in new:
            own = raw[:-1] if raw[-1] == " " else raw
            if not own.isalpha():
                rest.append(raw)
            elif own.islower() and own.isascii():
                raws.append(raw)
                norms.append(own)
                sizes.append(len(raw) << 32 | len(raw))
                flags.append(mark(own) << 14 | (own is not raw) << 13)
            elif latin(own):
                norm = normal("NFC", own).lower()
                loud = 2 if len(own) > 1 and own.isupper() and all(map(str.isupper, own)) else 0
                raws.append(raw)
                norms.append(norm)
                sizes.append(len(raw.encode()) << 32 | len(raw))
                flags.append(mark(norm) << 14 | (own is not raw) << 13 | loud << 3 | (loud or (3 if own[0].isupper() else 0)) << 7)
            else:
                rest.append(raw)
        self.update(zip(raws, range(len(self.raws), len(self.raws) + len(raws)), strict=True))
        self.raws += raws
        self.norms += norms
        self.sizes.extend(sizes)
        self.flags.extend(flags)
        for raw in rest:
            self[raw]

    def room(self) -> None:
        """Forget all once there are too many."""
        if len(self.raws) > self.most:
            self.__init__(self.mark, self.most)
            self.clear()


class Scanned(NamedTuple):
    """Columns of all tokens of some texts: the text's place, the raw token's number, byte span, ``REASONS``' place, sentence
    start; the first token of each text and, behind the last, the end; code points of each token, kind, mark; the reason of
    its region, ``flags``, and the last token before that opens or closes a sentence start, of any text, or -1."""

    row: np.ndarray
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    reason: np.ndarray
    opening: np.ndarray
    first: np.ndarray
    chars: np.ndarray
    kind: np.ndarray
    mark: np.ndarray
    zone: np.ndarray
    flags: np.ndarray
    last: np.ndarray


#: Blocks whose letters and spaces ``_latin_tiles`` knows.
_LATIN = re.compile("[\\x00-\u02ff\u1e00-\u1eff\u2010-\u2027\u2030-\u205e]*")
_ASCII_TILES = re.compile(r"(?s)[A-Za-z0-9]+(?: (?![\t-\r ]))?|[\t-\r ]+|.")


@lru_cache(maxsize=1)
def _latin_tiles() -> re.Pattern:
    """The tiles of texts in ``_LATIN``, a run with the single space behind it."""
    known = [c for c in map(chr, range(0x2060)) if _LATIN.fullmatch(c)] + [chr(c) for c in range(0x1E00, 0x1F00)]
    run, space = ("".join(re.escape(c) for c in known if _compiled["plain"].match(c + x)[0] == c + x) for x in "a ")
    return re.compile(f"(?s)[{run}]+(?: (?![{space}]))?|[{space}]+|.")


def scan(texts: Sequence[str | None], words: Vocabulary, joined: bool = False) -> Scanned:
    """What ``tokenize`` says of each text, in columns. ``joined``: a single space may lie with the run before it, whose
    ``end`` is without it and whose ``chars`` are with it; such spaces aren't told."""
    raws: list[str] = []
    first = [0]
    for t in texts:
        if t:
            if joined and (t.isascii() or _LATIN.fullmatch(t)):
                raws += (_ASCII_TILES if t.isascii() else _latin_tiles()).findall(t)
            else:
                raws += _ASCII.findall(t) if t.isascii() else _compiled["plain"].findall(t)
        first.append(len(raws))
    first = np.array(first)
    words.add(set(raws).difference(words))
    code = np.fromiter(map(words.__getitem__, raws), np.int64, len(raws))
    size, flags = np.array(words.sizes, np.int64)[code], np.array(words.flags, np.int64)[code]
    size, chars, tail = size >> 32, size & 0xFFFFFFFF, flags >> 13 & 1
    kind, at_start, inside, event, mark = flags & 7, flags >> 3 & 15, flags >> 7 & 15, (flags >> 11 & 3) - 1, flags >> 14
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    place = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    start = place[:-1] - place[first[:-1]][row]
    # the last token before that opens or closes, in the same text
    last = np.maximum.accumulate(np.concatenate([[-1], np.where(event != 0, np.arange(len(code)), -1)]))[:-1]
    opening = (last < first[:-1][row]) | (event[last] == 1) if len(code) else np.zeros(0, bool)
    zone = np.zeros(len(code), np.int64)
    for k, t in enumerate(texts):
        zones = regions(t) if t else ()
        if not zones:
            continue
        a, b = first[k], first[k + 1]
        ends = np.cumsum(chars[a:b])
        low, high = np.searchsorted(ends - tail[a:b], [z[0] for z in zones], "right"), np.searchsorted(ends - chars[a:b], [z[1] for z in zones], "left")
        own, done = zone[a:b], 0
        # by their starts: a later zone adds what lies behind those before
        for (_, _, why), i, j in zip(zones, low.tolist(), high.tolist(), strict=True):
            i = max(i, done)
            if j > i:
                own[i:j] = REASONS.index(why)
                done = j
    reason = np.where(opening, at_start, inside)
    return Scanned(row, code, start, start + size - tail, np.where(reason == 0, zone, reason), opening, first, chars, kind, mark, zone, flags, last)


def portions(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together, one text at least."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def strings(values: Sequence[str | None], at: np.ndarray) -> pa.Array:
    """The values at these places."""
    kept, back = np.unique(at, return_inverse=True)
    return pa.array([values[k] for k in kept.tolist()], pa.string()).take(pa.array(back))


_SCHEMA = "doc_id long, pos int, start_byte int, end_byte int, raw string, kind string, norm string, protect string, sentence_start boolean"


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset[str] | None = None) -> DataFrame:
    """One row per token. One pass over each text, no shuffle; null texts give no token. ``only``: a row of the ``checkable``
    words that normalised are among these."""
    held = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
        words = Vocabulary(held and held.value.__contains__)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                words.room()
                s = scan(texts[a:b], words)
                shown = np.arange(len(s.code)) if held is None else np.flatnonzero((s.mark > 0) & (s.reason == 0))
                for i in range(0, len(shown), 100_000):
                    at = shown[i : i + 100_000]
                    code, row = s.code[at], s.row[at]
                    pos = at - s.first[row]
                    ints = [pa.array(c.astype(np.int32)) for c in (pos, s.start[at], s.end[at])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + row)), *ints, strings(words.raws, code), strings(KINDS, s.kind[at]), strings(words.norms, code), strings(REASONS, s.reason[at]), pa.array(s.opening[at])], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def checked_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``checked, protected``: words without and with a reason, in one row for each part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in portions(texts):
                words.room()
                s = scan(texts[a:b], words)
                reasons = s.reason[s.kind == KINDS.index("Word")]
                free = int((reasons == 0).sum())
                yield pa.RecordBatch.from_arrays([pa.array([free], pa.int64()), pa.array([len(reasons) - free], pa.int64())], ["checked", "protected"])

    return docs.select(F.col(text_col)).mapInArrow(run, "checked long, protected long")


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``norm``: the distinct normalised words, protected ones too; each task tells its own before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _compiled:
            _compiled.update(_patterns())
        letters, found = _compiled["letters"], set()
        key = lambda x: x.lower() if x.isascii() else _key(x)
        packed = lambda raws: pa.RecordBatch.from_arrays([pa.array(sorted({key(x) for x in raws if x.isalpha() or letters.search(x)}), pa.string())], ["norm"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    found.update(_ASCII_RUN.findall(t) if t.isascii() else _compiled["run"].findall(t))
                    if len(found) > 200_000:
                        yield packed(found)
                        found.clear()
        yield packed(found)

    return docs.select(F.col(text_col)).mapInArrow(run, "norm string").distinct()


_ASCII_RUN = re.compile("[A-Za-z0-9]+")


def checkable(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'Word' and protect is null")


def tiles(text: Column) -> Column:
    """The raw tokens as an array, in the JVM."""
    return F.regexp_extract_all(text, F.lit(TILES), F.lit(0))


def corpus_words(text: Column) -> Column:
    """Words of the lexicon builder: runs of the lower-case Vietnamese alphabet."""
    return F.regexp_extract_all(F.lower(nfc(text)), F.lit(f"[{LOWER_ALPHABET}]+"), F.lit(0))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line, words`` of each line with a word; one pass over the text, normalised once."""
    found = F.transform(F.split(F.lower(nfc(F.col(text_col))), "\n"), lambda x: F.regexp_extract_all(x, F.lit(f"[{LOWER_ALPHABET}]+"), F.lit(0)))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("line", "words")).filter("size(words) > 0")


def kinds(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, n, bytes`` over all tokens, in the JVM; distinct raw tokens are counted before they are told apart."""
    counts = docs.select(F.explode(tiles(F.col(text_col))).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    raw = F.col("raw")
    one = F.when(raw.rlike(r"^[\p{IsAlphabetic}\p{N}]"), "Other").otherwise("Punct")
    run = F.when(raw.rlike(r"\p{IsAlphabetic}"), "Word").when(raw.rlike("[0-9]"), "Number").otherwise("Other")
    kind = F.when(raw.rlike(r"^\p{IsWhite_Space}"), "Space").when(raw.rlike(rf"^[\p{{IsAlphabetic}}{MARKS}{INVISIBLE}0-9]"), run).otherwise(one)
    return counts.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.octet_length("raw")).alias("bytes"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 40, longest: int = 400, letters: float = 0.9, cap: int | None = None) -> DataFrame:
    """``doc_id, pos, sentence``: prose sentences with collapsed white space."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, r"(?<=[.!?…])[\p{IsWhite_Space}]+")).alias("pos", "s"))
    rows = rows.select("doc_id", "pos", F.trim(F.regexp_replace("s", r"[\p{IsWhite_Space}]+", " ")).alias("sentence"))
    good = F.length(F.regexp_replace("sentence", r"[^\p{IsAlphabetic} ]", "")) / F.length("sentence") >= letters
    rows = rows.filter(F.length("sentence").between(shortest, longest) & good)
    return rows.orderBy("doc_id", "pos").limit(cap) if cap is not None else rows
