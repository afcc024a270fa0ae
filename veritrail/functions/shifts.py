"""Shift codes and the legends of printed schedules, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

# A time of day on the 12-hour clock, what parts two times, and a time on the 24-hour clock.
TIME = r"(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m?\.?"
TO = r"\s*(?:-|–|—|to)\s*"
TIME24 = r"(\d{1,2}):?(\d{2})"
DAY = r"(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?"


def shift_key(code: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(code), r"(?U)\s+", ""), "–—", "--")


def parse_shift(code: Column) -> Column:
    """A struct of ``start`` and ``end`` hours of the day, null if the code is no shift."""
    text = clean(code)
    half, day = f"^(?i){TIME}{TO}{TIME}$", f"^{TIME24}{TO}{TIME24}$"
    part = lambda p, k: F.regexp_extract(text, p, k)
    number = lambda p, k: F.when(part(p, k) != "", part(p, k)).try_cast("int")

    def of_half(k: int) -> Column:
        noon = F.when(F.lower(part(half, k + 2)) == "p", 12).otherwise(0)
        return (number(half, k) % 12 + noon + F.coalesce(number(half, k + 1), F.lit(0)) / 60.0).cast("double")

    def of_day(k: int) -> Column:
        return (number(day, k) + number(day, k + 1) / 60.0).cast("double")

    return (
        F.when(text.rlike(half), F.struct(of_half(1).alias("start"), of_half(4).alias("end")))
        .when(text.rlike(day), F.struct(of_day(1).alias("start"), of_day(3).alias("end")))
        .otherwise(F.lit(None).cast("struct<start:double,end:double>"))
    )


def length(start: Column, end: Column) -> Column:
    """Hours from start to end, over midnight if need be; equal times are a whole day."""
    hours = F.pmod(end - start, F.lit(24.0))
    return F.when(hours == 0, 24.0).otherwise(hours)


def legend(text: Column) -> Column:
    """A map from shift keys to hours, from the sentences of a page that give some shifts' length; later ones win."""
    sentences = F.split(text, r"(?i)(?<=[a-z])\.\s+|\n|;")
    hours = lambda s: F.regexp_extract(s, r"(?i)(\d+(?:\.\d+)?)\s*(?:hours|hrs|hr|h)\b", 1)
    tokens = lambda s: F.regexp_extract_all(s, F.lit(f"(?i)({TIME}{TO}{TIME})"), 1)
    pairs = F.flatten(
        F.transform(
            F.filter(sentences, lambda s: hours(s) != ""),
            lambda s: F.transform(tokens(s), lambda t: F.struct(shift_key(t).alias("key"), hours(s).try_cast("double").alias("value"))),
        )
    )
    # The last entry of a key counts.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)
