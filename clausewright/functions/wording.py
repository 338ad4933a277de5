"""Small readings of text as column expressions: labels, slugs, snippets, sentences, quotes, references."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that one printed sign stands for; kinds of instrument a reference may belong to instead.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
INSTRUMENTS = "Directive|Regulation|Decision|Treaty|Charter|Convention|Protocol"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
SENTENCE_END = r"([.!?؟؛۔][\"'”’)\]]*[ \t]+)"


def label_style(label: Column) -> Column:
    """decimal, roman, letter or none of a printed label such as ``4.2``, ``(iv)`` or ``b)``; a lone i, v or x is roman."""
    bare = F.regexp_replace(F.lower(F.trim(label)), r"^\(|[).:]+$", "")
    return (
        F.when(bare.rlike(r"^\d+(\.\d+)*$"), "decimal")
        .when(bare.rlike(r"^(x{0,3})(ix|iv|v?i{0,3})$") & (bare != ""), "roman")
        .when(bare.rlike("^[a-z]$"), "letter")
    )


def label_value(label: Column) -> Column:
    """The last number of a label: 2 of ``4.2``, 4 of ``(iv)``, 2 of ``b)``."""
    bare, style = F.regexp_replace(F.lower(F.trim(label)), r"^\(|[).:]+$", ""), label_style(label)
    digits = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    values = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.element_at(digits, c))
    # A digit counts against a greater one that follows it.
    signed = F.transform(values, lambda x, i: F.when(x < F.coalesce(F.get(values, i + 1), F.lit(0)), -x).otherwise(x))
    roman = F.aggregate(signed, F.lit(0), lambda s, x: s + x)
    return F.when(style == "decimal", F.regexp_extract(bare, r"(\d+)$", 1).cast("int")).when(style == "roman", roman).when(style == "letter", F.ascii(bare) - 96)


def slug(name: Column) -> Column:
    """At most 60 characters of a name's words, marks off their letters, joined by hyphens; ``policy`` where none is left."""

    @F.pandas_udf("string")
    def bare(names: pd.Series) -> pd.Series:  # no built-in decomposes letters
        return names.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)))

    words = F.regexp_extract_all(F.lower(bare(name)), F.lit(r"(?U)\w+"), F.lit(0))
    cut = F.regexp_replace(F.substring(F.array_join(words, "-"), 1, 60), "^[-_]+|[-_]+$", "")
    return F.when(cut == "", "policy").otherwise(cut)


def snippet(text: Column, length: int) -> Column:
    """The start of a text, one space between words, cut after the last whole word that fits."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(plain, 1, length + 1)
    cut = F.when(F.instr(F.substring(plain, 1, length), " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(F.substring(plain, 1, length))
    return F.when(F.length(plain) <= length, plain).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:]+$", ""), F.lit("…")))


def boundaries(text: Column) -> Column:
    """Offsets where a sentence begins inside a line of text."""
    pieces = F.split(F.regexp_replace(text, SENTENCE_END + r"(?=\S)", "$1\u0001"), "\u0001")
    ends = F.transform(pieces, lambda _, i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda s, p: s + F.length(p)))
    return F.slice(ends, F.lit(1), F.size(ends) - 1)


def page_text(html: Column) -> Column:
    """A page's words: tags out, the five basic entities read, one space between words."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.translate(text, "‘’“”", "''\"\""), r"\s+", " "))


def quoted(quote: Column, text: Column) -> Column:
    """Whether text holds all parts of a quote, which ``...`` separates."""
    parts = F.filter(F.transform(F.split(quote, r"\.\.\."), lambda p: F.trim(p)), lambda p: p != "")
    return F.forall(parts, lambda p: F.contains(text, p))


def in_capitals(text: Column) -> Column:
    """Letters, and none of them small."""
    return text.rlike(r"\p{L}") & (text == F.upper(text))


def ends_as_prose(text: Column) -> Column:
    """The last sign ends a sentence or goes on with it."""
    return F.rtrim(text).rlike(r"[.;:,!?][\"'”’)\]]*$")


def without_ligatures(text: Column) -> Column:
    """Printed ligatures as their letters."""
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def references(text: Column, law: Column) -> Column:
    """array of struct(key, raw), by key: the clauses of the same law that a text names; of equal keys the first wording counts.

    ``Article 6(1)(f)`` and ``point (a) of Article 9(2)``; what goes on ``of (the) Directive`` or another instrument is left alone.
    """
    elsewhere = rf"(?!\s+of\s+(?:the\s+)?(?:{INSTRUMENTS})\b)"
    point = r"(?i:point \([0-9a-z]+\) of Article \d+\(\d+\))" + elsewhere
    plain = r"Article \d+\(\d+\)(?:\([0-9a-z]+\))?+" + elsewhere
    part = lambda raw, pattern, g=1: F.regexp_extract(raw, pattern, g)
    of_point = lambda raw: F.concat(
        law, F.lit(":art-"), part(raw, r"(\d+)\(\d+\)$"), F.lit(":para-"), part(raw, r"\((\d+)\)$"), F.lit(":pt-"), F.lower(part(raw, r"^\w+ \((\w+)\)"))
    )
    of_plain = lambda raw: F.concat(
        law, F.lit(":art-"), part(raw, r"^Article (\d+)"), F.lit(":para-"), part(raw, r"^Article \d+\((\d+)\)"),
        F.when(raw.rlike(r"\)\("), F.concat(F.lit(":pt-"), F.lower(part(raw, r"\(([0-9a-z]+)\)$")))).otherwise(F.lit("")),
    )
    named = lambda pattern, key: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r: F.struct(key(r).alias("key"), r.alias("raw")))
    every = F.concat(named(point, of_point), named(plain, of_plain))
    first = F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.array_sort(first)
