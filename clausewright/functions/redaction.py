"""Personal data taken out of questions, and Arabic words folded for keyword search: column expressions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data in the order they are looked for, spellings that are folded.
PATTERNS = {
    "card": r"\d[\d\s.-]{11,21}\d",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "emirates_id": r"\b784[-\s]?\d{4}[-\s]?\d{7}[-\s]?\d\b",
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "phone": r"(?<![\w.])\+?\d[\d\s().-]{5,20}\d(?![\w.])",
}
CARD_DIGITS, PHONE_DIGITS = (13, 19), (7, 15)
FOLD_FROM, FOLD_TO = "أإآٱىةؤئیک٠١٢٣٤٥٦٧٨٩", "اااايهءءيك0123456789"
# The longest custom pattern, and a repeat of a group that repeats itself, which can take for ever to fail.
MAX_PATTERN, NESTED = 200, r"\([^()]*[+*]\)[+*{]"


def _card(found: Column) -> Column:
    digits = F.regexp_replace(found, r"\D", "")
    return F.length(digits).between(*CARD_DIGITS) & F.call_function("luhn_check", digits)


def _iban(found: Column) -> Column:
    turned = F.concat(F.substr(found, F.lit(5)), F.substring(found, 1, 4))
    step = lambda rest, c: F.when(c.rlike("[0-9]"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _phone(found: Column) -> Column:
    return F.length(F.regexp_replace(found, r"\D", "")).between(*PHONE_DIGITS)


CHECKS = {"card": _card, "iban": _iban, "phone": _phone}


def _hidden(name: str, valid: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda found: F.when(valid(found), f"[redacted:{name}]").otherwise(found)


def check_pattern(name: str, pattern: str) -> None:
    """Refuse a custom pattern that is nameless, too long, broken, matches nothing at all or nests repeats."""
    try:
        empty = re.compile(pattern).match("")
    except re.error:
        empty = True
    if not name.isidentifier() or len(pattern) > MAX_PATTERN or empty or re.search(NESTED, pattern):
        raise ValueError(f"{name!r} is no usable pattern")


def _step(state: Column, name: str, pattern: str) -> Column:
    """state (text, count, types) with one kind's matches hidden; bound once, so that steps don't multiply."""
    valid = CHECKS.get(name, lambda m: F.lit(True))

    def hide(x: Column) -> Column:
        n = F.size(F.filter(x["found"], valid))
        shown = F.array_append(F.transform(x["found"], _hidden(name, valid)), F.lit(""))
        pieces = F.zip_with(F.split(x["text"], pattern, -1), shown, lambda rest, own: F.concat(rest, own))
        return F.struct(
            F.when(n > 0, F.array_join(pieces, "")).otherwise(x["text"]).alias("text"),
            (x["count"] + F.coalesce(n, F.lit(0))).alias("count"),
            F.when(n > 0, F.array_append(x["types"], F.lit(name))).otherwise(x["types"]).alias("types"),
        )

    found = lambda s: F.struct(s["text"].alias("text"), s["count"].alias("count"), s["types"].alias("types"), F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)).alias("found"))
    return F.transform(F.transform(F.array(state), found), hide)[0]


def redact(text: Column, custom: dict[str, str] | None = None) -> Column:
    """struct(text, count, types): every match of each kind, custom kinds first, becomes ``[redacted:kind]``.

    A kind's text is split at its matches and put together again, so that a match that fails its
    check (digits' sum, length) stays as it is. Null stays null.
    """
    for name, pattern in (custom or {}).items():
        check_pattern(name, pattern)
    state = F.struct(text.alias("text"), F.lit(0).alias("count"), F.array().cast("array<string>").alias("types"))
    for name, pattern in {**(custom or {}), **PATTERNS}.items():
        state = _step(state, name, f"(?U){pattern}")
    return state


def arabic_light(text: Column) -> Column:
    """Words joined by a space: spellings folded, marks and stretching dropped, the article cut from the front."""
    plain = F.translate(F.regexp_replace(text, "[ً-ٰٟـ]", ""), FOLD_FROM, FOLD_TO)
    words = F.filter(F.split(plain, "[^0-9A-Za-zء-ي]+"), lambda w: w != "")
    cut = lambda w: F.when(w.rlike("^(وال|فال|بال|كال).."), F.substr(w, F.lit(4))).when(w.rlike("^(ال|لل).."), F.substr(w, F.lit(3))).otherwise(w)
    return F.array_join(F.transform(words, cut), " ")


def natural_key(key: Column) -> Column:
    """A sort key of strings: runs of digits compare as numbers."""
    parts = F.regexp_extract_all(key, F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p))


def version_key(version: Column) -> Column:
    """Numbers of a dotted version; arrays compare number by number."""
    return F.transform(F.split(version, r"\."), lambda p: p.cast("int"))
