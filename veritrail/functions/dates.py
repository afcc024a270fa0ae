"""Dates in many spellings, read natively: one pattern per spelling, tried in order, the first that is a real date wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, let, parsed

# Months, and what a year, a month and a day look like.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_Y, _M, _D = r"(\d{4})", r"(1[0-2]|0[1-9]|[1-9])", r"(3[01]|[12]\d|0[1-9]|[1-9])"
#: Two-digit years up to 68 are of this century.
_NEW, _OLD = r"([0-5]\d|6[0-8])", r"(69|[7-9]\d)"
_NAME = "(?=(?:" + "|".join([*MONTHS, *(m[:3] for m in MONTHS)]) + r")\b)([a-z]{3})[a-z]*"
_TIME = r"(?:2[0-3]|[01]\d|\d):[0-5]?\d:(?:6[01]|[0-5]\d|\d)"
FIRST_YEAR, LAST_YEAR = 1900, 2100


def _spellings(order: str) -> list[tuple[str, str]]:
    """(pattern, the same in year-month-day order) of every spelling; months stay names where they are."""
    one, two = (_M, _D) if order == "mdy" else (_D, _M)
    month, day = ("$1", "$3") if order == "mdy" else ("$3", "$1")
    return [
        (f"{_Y}/{_M}/{_D}", "$1-$2-$3"),
        (f"{_Y}{_M}{_D}", "$1-$2-$3"),
        (f"{_D}-{_NAME}-{_Y}", "$3-$2-$1"),
        (rf"{_D}\s+{_NAME}\s+{_Y}", "$3-$2-$1"),
        (rf"{_NAME}\s+{_D}\s+{_Y}", "$3-$1-$2"),
        (rf"{_Y}-{_M}-{_D}(?:T|\s+){_TIME}", "$1-$2-$3"),
        (rf"{one}([/.-]){two}\2{_Y}", f"$4-{month}-{day}"),
        (rf"{one}([/-]){two}\2{_NEW}", f"20$4-{month}-{day}"),
        (rf"{one}([/-]){two}\2{_OLD}", f"19$4-{month}-{day}"),
    ]


def parse_date(value: Column, order: str = "mdy") -> Column:
    """A struct of ``value`` (a date) and ``error``; spreadsheet serial numbers are read too."""

    def read(text: Column) -> Column:
        written = F.replace(text, F.lit(","), F.lit(""))
        for pattern, ordered in _spellings("mdy" if order == "mdy" else "dmy"):
            written = F.regexp_replace(written, f"^(?i){pattern}$", ordered)
        plain = let(written, lambda w: F.coalesce(
            F.when(w.rlike(f"^{_Y}-{_M}-{_D}$"), w).try_cast("date"), F.when(w.rlike(rf"^(?i)\d{{4}}-[a-z]{{3}}-\d\d?$"), F.try_to_date(w, "yyyy-MMM-d"))
        ))

        def judge(found: Column) -> Column:
            in_range = F.year(found).between(FIRST_YEAR, LAST_YEAR)
            serial = F.when(text.rlike(r"^\d{5}(\.0+)?$"), F.substring(text, 1, 5).try_cast("int"))
            counted = F.when((serial > 20000) & (serial < 80000), F.date_add(F.lit("1899-12-30").cast("date"), serial))
            said = F.concat(F.lit("'"), text, F.lit("'"))
            error = F.when(text == "", None).when(found.isNotNull() & ~in_range, F.concat(said, F.lit(" is a date out of range")))
            error = error.when(found.isNull() & counted.isNull(), F.concat(said, F.lit(" is not a date")))
            return parsed(F.when(found.isNotNull(), F.when(in_range, found)).otherwise(counted), error)

        return let(plain, judge)

    return let(clean(value), read)


def is_non_iso(value: Column) -> Column:
    text = clean(value)
    return (text != "") & ~text.rlike(r"^\d{4}-\d{2}-\d{2}( 00:00:00)?$")


def quarter_bounds(quarter: str) -> tuple[Column, Column]:
    """First and last day of a quarter written as 2026Q3."""
    start = F.make_date(F.lit(int(quarter[:4])), F.lit(3 * int(quarter[-1]) - 2), F.lit(1))
    return start, F.date_sub(F.add_months(start, 3), 1)


def expiry_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "MISSING DATE").when(days < 0, "EXPIRED").when(days <= 30, "<30 days").when(days <= 90, "<90 days").otherwise("ok")
