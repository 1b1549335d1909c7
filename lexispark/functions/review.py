"""What a reader of a finding sees: its surroundings, a preview of chosen changes, and a request for a language model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: code points on each side.
AROUND = 26
TASKS = ("grammar", "rewrite", "explain")


def _bytes(text: Column, begin: Column, length: Column) -> Column:
    return F.substring(text.cast("binary"), begin.cast("int"), length.cast("int")).cast("string")


def surroundings(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """``AROUND`` code points before and after a span of bytes; line feeds, returns and tabs as spaces."""
    flat = lambda c: F.translate(c, "\n\r\t", "   ")
    before, after = _bytes(text, F.lit(1), start), _bytes(text, end + 1, F.octet_length(text))
    tail = F.substring(before, F.greatest(F.lit(1), F.char_length(before) - (AROUND - 1)), F.lit(AROUND))
    return flat(F.when(start > 0, tail).otherwise(F.lit(""))), flat(F.substring(after, 1, AROUND))


def segments(text: Column, changes: Column) -> Column:
    """``array<struct<text, changed>>`` that gives the text with all ``changes`` (``array<struct<start, end, to>>`` in
    bytes); empty stretches between changes are left out."""
    ordered = F.array_sort(F.transform(changes, lambda c: F.struct(c["start"].cast("int").alias("start"), c["end"].cast("int").alias("end"), c["to"].alias("to"))))
    kind = "struct<at: int, out: array<struct<text: string, changed: boolean>>>"
    first = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)
    piece = lambda t, changed: F.array(F.struct(t.alias("text"), F.lit(changed).alias("changed")))
    nothing = F.array().cast("array<struct<text: string, changed: boolean>>")

    def step(s: Column, c: Column) -> Column:
        between = F.when(c["start"] > s["at"], piece(_bytes(text, s["at"] + 1, c["start"] - s["at"]), False)).otherwise(nothing)
        return F.struct(c["end"].alias("at"), F.concat(s["out"], between, piece(c["to"], True)).alias("out")).cast(kind)

    def close(s: Column) -> Column:
        rest = F.octet_length(text) - s["at"]
        return F.concat(s["out"], F.when(rest > 0, piece(_bytes(text, s["at"] + 1, rest), False)).otherwise(nothing))

    return F.aggregate(ordered, first, step, close)


def request(task: str, text: Column, found: Column, style: str | None = None) -> Column:
    """``struct<system, user>`` for a language model: what to do, what the offline check has found already
    (``array<string>``), and the text. The same input gives the same request; nothing is sent."""
    if task not in TASKS or (task == "rewrite") != (style is not None):
        raise ValueError("a task of TASKS; a style for rewrite alone")
    ask = {
        "grammar": "Report errors of grammar and word choice. A text without any gets an empty list.",
        "rewrite": f"Rewrite the text in this style and keep its meaning: {style}. Give one suggestion with the whole text as original.",
        "explain": "Say briefly why each marked place is wrong, and give the right form as replacement.",
    }[task]
    system = f"You help with Vietnamese writing. Spelling of syllables, confused sounds and tones, and punctuation have been checked already; leave them. {ask} Explain in Vietnamese. Each original must stand in the text word for word."
    known = F.when(F.size(found) > 0, F.concat(F.lit("Found already:\n"), F.array_join(F.transform(found, lambda f: F.concat(F.lit("- "), f)), "\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    return F.struct(F.lit(system).alias("system"), F.concat(known, F.lit("Text:\n\n"), text).alias("user"))
