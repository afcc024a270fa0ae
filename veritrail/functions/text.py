"""Text, number, phone, identifier and code functions as native columns.

Parsers return a struct of ``value`` and ``error``; an error never drops the row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EMPTY, Codes

def no_error() -> Column:
    return F.lit(None).cast("string")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it; it also keeps generated code small."""
    return F.transform(F.array(value), use)[0]


def parsed(value: Column, error: Column | None = None) -> Column:
    return F.struct(value.alias("value"), (no_error() if error is None else error).alias("error"))


def clean(value: Column) -> Column:
    """White space put in order (no-break spaces and byte order marks too); placeholders for nothing become empty."""
    text = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "﻿", "")
    text = F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(F.lower(text).isin(*EMPTY), "").otherwise(text)


def _folds() -> tuple[str, str, str, dict[str, str]]:
    """(characters with a bare counterpart, the counterparts, combining marks to drop, ligatures with what they stand for)."""
    whole, bare, marks, joined = [], [], [], {}
    for code in range(128, min(sys.maxunicode, 0xFFFF) + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch and base.isascii():
            whole.append(ch)
            bare.append(base)
        elif len(base) > 1 and any(c.isascii() and c.isalpha() for c in base):
            joined[ch] = "".join(c if c.isascii() else " " for c in base)
    return "".join(whole), "".join(bare), "".join(marks), joined


_WHOLE, _BARE, _MARKS, _JOINED = _folds()
_LIGATURES = {k: v for k, v in _JOINED.items() if 0xFB00 <= ord(k) <= 0xFB06 or ord(k) < 0x250}


def simplify(text: Column) -> Column:
    """Lower-case ASCII letters and digits parted by blanks, accents dropped.

    A native stand-in for compatibility decomposition: single characters by translation, Latin ligatures by
    replacement. Rare symbols that decompose into several characters count as separators.
    """
    for ligature, letters in _LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    bare = F.translate(text, _WHOLE + _MARKS, _BARE)
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def header_key(text: Column) -> Column:
    return F.replace(simplify(clean(text)), F.lit(" "), F.lit("_"))


_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def parse_number(value: Column) -> Column:
    def read(text: Column) -> Column:
        bare = F.replace(text, F.lit(","), F.lit(""))
        number = F.when(bare.rlike(_NUMBER), F.replace(bare, F.lit("_"), F.lit(""))).try_cast("double")
        endless = F.when(bare.startswith("-"), float("-inf")).otherwise(float("inf"))
        number = F.when(F.lower(bare).rlike(r"^[+-]?inf(inity)?$"), endless).otherwise(number)
        bad = (text != "") & number.isNull()
        return parsed(number, F.when(bad, F.concat(F.lit("'"), text, F.lit("' is not a number"))))

    return let(clean(value), read)


def parse_phone(value: Column) -> Column:
    """ddd-ddd-dddd, a leading 1 of eleven digits dropped; anything else stays as it is, with an error."""

    def read(text: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(text, r"(?U)\D", ""), r"^1(?=\d{10}$)", "")
        shaped = F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3")
        good = F.length(digits) == 10
        return parsed(
            F.when(text == "", None).when(good, shaped).otherwise(text),
            F.when((text != "") & ~good, F.concat(F.lit("'"), text, F.lit("' is not a phone number of 10 digits"))),
        )

    return let(clean(value), read)


def parse_identifier(value: Column, pattern: str | None = None, dash: bool = False) -> Column:
    """Upper case with single dashes for blanks, dots, underscores and long dashes; checked against ``pattern``."""

    def read(text: Column) -> Column:
        shaped = F.regexp_replace(F.upper(text), "[\\s_–—.-]+", "-")
        shaped = F.regexp_replace(shaped, "^-|-$", "")
        if dash:
            shaped = F.regexp_replace(shaped, "^([A-Z]+)([0-9]+)$", "$1-$2")
        error = no_error()
        if pattern:
            bad = (text != "") & ~shaped.rlike(f"^(?:{pattern})$")
            error = F.when(bad, F.concat(F.lit("'"), text, F.lit("' is not a valid identifier")))
        return parsed(F.when(text != "", shaped), error)

    return let(clean(value), read)


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast("map<string,string>")


def parse_code(value: Column, codes: Codes) -> Column:
    """The code of a known spelling; else the only code that any longer spelling inside the text stands for."""
    longer = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in codes.spellings.items() if len(a) > 3])

    def find(key: Column) -> Column:
        exact = F.try_element_at(_literal_map(codes.spellings), key)
        if not any(len(a) > 3 for a in codes.spellings):
            return exact
        inside = F.array_distinct(F.transform(F.filter(longer, lambda x: F.contains(key, x["a"])), lambda x: x["c"]))
        return F.coalesce(exact, let(inside, lambda cs: F.when(F.size(cs) == 1, F.try_element_at(cs, F.lit(1)))))

    def read(text: Column) -> Column:
        def shape(found: Column) -> Column:
            unknown = (text != "") & found.isNull()
            return parsed(
                F.when(text == "", None).otherwise(F.coalesce(found, text)),
                F.when(unknown, F.concat(F.lit("'"), text, F.lit("' is not a known value"))),
            )

        return let(let(simplify(text), find), shape)

    return let(clean(value), read)


def code_label(code: Column, codes: Codes) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(codes.labels), code), code)


def short_number(x: Column, sign: bool = False) -> Column:
    """A number with six significant digits and no trailing zeros, as ``%g`` writes it."""
    size = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x))))
    near = F.round(x * F.pow(F.lit(10.0), 5 - size)) / F.pow(F.lit(10.0), 5 - size)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", near), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    tiny = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", x), r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    text = F.when((x != 0) & ((size < -4) | (size >= 6)), tiny).otherwise(plain)
    return F.when(F.lit(sign) & (x >= 0), F.concat(F.lit("+"), text)).otherwise(text)


def spoken_list(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n <= 1, F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))
