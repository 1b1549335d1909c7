"""Normalisation and letters. Byte spans stay those of the original text: normalise tokens, not texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Vowels with their six tones (level, falling, rising, dipping, broken, heavy).
TONES = {
    "a": "aàáảãạ",
    "ă": "ăằắẳẵặ",
    "â": "âầấẩẫậ",
    "e": "eèéẻẽẹ",
    "ê": "êềếểễệ",
    "i": "iìíỉĩị",
    "o": "oòóỏõọ",
    "ô": "ôồốổỗộ",
    "ơ": "ơờớởỡợ",
    "u": "uùúủũụ",
    "ư": "ưừứửữự",
    "y": "yỳýỷỹỵ",
}
BARE = {"ă": "a", "â": "a", "ê": "e", "ô": "o", "ơ": "o", "ư": "u"}
VOWELS = "".join(TONES)
#: Letters that only Vietnamese text has, lower case, and the alphabet of the corpus tokenizer.
SPECIAL = "".join(sorted({c for forms in TONES.values() for c in forms if c not in "aeiouy"} | {"đ"}))
ALPHABET = "a-z" + SPECIAL


def _ranges(letters: str) -> str:
    """``letters`` (lower case) as few ranges for lower-case text: between their ends lie capitals only, which it hasn't."""
    out: list[list[str]] = []
    for c in sorted(letters):
        if out and all(chr(k).lower() != chr(k) for k in range(ord(out[-1][1]) + 1, ord(c))):
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(a if a == b else f"{a}-{b}" for a, b in out)


#: The alphabet for lower-case text: Java tries each part of a class beyond Latin-1 for each code point.
LOWER_ALPHABET = _ranges("".join(map(chr, range(97, 123))) + SPECIAL)
#: Code points that are dropped from keys.
INVISIBLE = "\u200b\u200c\u200d\u2060\u00ad\ufeff\u180e"
MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff"

_toned = "".join(f for forms in TONES.values() for f in forms[1:])
_untoned = "".join(b for b, forms in TONES.items() for _ in forms[1:])
_marked = "".join(f for b, forms in TONES.items() for f in forms if f != BARE.get(b, b)) + "đ"
_plain = "".join(BARE.get(b, b) for b, forms in TONES.items() for f in forms if f != BARE.get(b, b)) + "d"


#: Ranges of code points that NFC neither changes nor joins to the one before.
STABLE = "\\x{0}-\\x{2ff}\\x{400}-\\x{482}\\x{1e00}-\\x{1eff}\\x{2010}-\\x{2027}\\x{2030}-\\x{205e}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7a3}"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts if texts.isna().all() else texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC. Python gets a null for each text that is stable as it is; a branch alone wouldn't keep it from the others."""
    return F.coalesce(_nfc(F.when(text.rlike(f"[^{STABLE}]"), text)), text)


def lookup_key(text: Column) -> Column:
    """NFC, without invisible code points, lower case."""
    return F.lower(F.translate(nfc(text), INVISIBLE, ""))


_NO_TONE, _NO_MARK = str.maketrans(_toned, _untoned), str.maketrans(_marked + _marked.upper(), _plain + _plain.upper())


def untoned(word: str) -> str:
    """``strip_tone`` of a string."""
    return word.translate(_NO_TONE)


def bare(word: str) -> str:
    """``strip_diacritics`` of a string."""
    return word.translate(_NO_MARK)


def strip_tone(text: Column) -> Column:
    return F.translate(text, _toned, _untoned)


def tone(text: Column) -> Column:
    """0 to 5: the tone of the last toned vowel."""
    last = F.regexp_extract(text, f"([{_toned}])[^{_toned}]*$", 1)
    found = F.lit(0)
    for k in range(1, 6):
        found = F.when(last.isin([forms[k] for forms in TONES.values()]), F.lit(k)).otherwise(found)
    return found.cast("int")


def strip_diacritics(text: Column) -> Column:
    """Bare ASCII for Vietnamese letters; others stay."""
    return F.translate(text, _marked + _marked.upper(), _plain + _plain.upper())


def needs_diacritics(text: Column) -> Column:
    return text.rlike("^[A-Za-z]*$")


def looks_vietnamese(text: Column) -> Column:
    return F.lower(text).rlike(f"[{SPECIAL}]")


def match_case(text: Column, model: Column) -> Column:
    """``text`` in the case of ``model``: all upper, first upper, or as it is."""
    letters = F.regexp_replace(model, r"\P{IsAlphabetic}", "")
    upper = (F.length(letters) >= 2) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    first = F.substring(model, 1, 1)
    titled = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(upper, F.upper(text)).when(titled, F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)
