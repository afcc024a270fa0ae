"""People's names: split, canonical first names, display form, and the key by which names are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _literal_map, clean, let, simplify


def canonical_first(first: Column, nicknames: dict[str, str]) -> Column:
    return let(simplify(first), lambda bare: F.coalesce(F.try_element_at(_literal_map(nicknames), bare), bare))


def split_name(full: Column) -> Column:
    """A struct of ``first`` and ``last`` of 'LAST, FIRST' or 'First Middle Last'.

    Initials are left out of the last name if more of it remains.
    """

    def read(text: Column) -> Column:
        comma = F.instr(text, ",") > 0
        parts = F.when(comma, F.split(text, ",", 2)).otherwise(F.array(F.regexp_replace(text, "^[^ ]* ?", ""), F.substring_index(text, " ", 1)))
        rest = F.filter(F.split(F.trim(parts[0]), " "), lambda w: w != "")
        whole = F.filter(rest, lambda w: ~w.rlike(r"^[A-Za-z]\.?$"))
        last = let(whole, lambda w: F.array_join(F.when(F.size(w) > 0, w).otherwise(rest), " "))
        return F.struct(F.substring_index(F.trim(parts[1]), " ", 1).alias("first"), last.alias("last"))

    return let(clean(full), read)


def title_case(word: Column) -> Column:
    """Every letter that follows a letter in lower case, every other one in upper case."""
    pieces = F.regexp_extract_all(word, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    risen = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.right(p, F.length(p) - 1)))
    return F.array_join(F.transform(pieces, risen), "")


def build_name(first: Column, last: Column, nicknames: dict[str, str]) -> Column:
    """A struct of ``display`` and ``key``; words in one case only are put in title case for display."""

    def read(n: Column) -> Column:
        words = F.filter(F.split(F.concat_ws(" ", n["first"], n["last"]), " "), lambda w: w != "")
        one_case = lambda w: w.rlike(r"\p{L}") & ((w == F.upper(w)) | (w == F.lower(w)))
        display = F.array_join(F.transform(words, lambda w: F.when(one_case(w), title_case(w)).otherwise(w)), " ")
        key = F.trim(F.concat_ws(" ", canonical_first(n["first"], nicknames), simplify(n["last"])))
        return F.struct(display.alias("display"), key.alias("key"))

    return let(F.struct(clean(first).alias("first"), clean(last).alias("last")), read)
