"""Scalar functions against what they stand for."""

import random
import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from veritrail.config import Codes, simple_text
from veritrail.functions import dates, names, shifts, similarity, text


@pytest.fixture(scope="module")
def ask(spark):
    def run(values, *columns):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()]

    return run


V = lambda: F.col("v")


def test_clean(ask):
    values = ["﻿ a \xa0 b\t\nc ", "N/A", "--", None, "None", "  ", "x"]
    assert ask(values, text.clean(V())) == ["a b c", "", "", "", "", "", "x"]


def test_simplify_is_decomposition_for_latin(ask):
    values = ["Ünïted-Ståtes  Ñandú!", "ﬁne ǅ", "İstanbul", "œuvre", "A–B", "".join(map(chr, range(0xC0, 0x24F)))]
    assert ask(values, text.simplify(V())) == [simple_text(v) for v in values]
    assert ask(["  Date of\xa0Birth# "], text.header_key(V())) == ["date_of_birth"]


@pytest.mark.parametrize(
    "written, read",
    [
        ("2026-09-14", "2026-09-14"), ("2026/9/4", "2026-09-04"), ("20260914", "2026-09-14"), ("202691", "2026-09-01"), ("14-Sep-2026", "2026-09-14"), ("14 Sep 2026", "2026-09-14"),
        ("Sep 14, 2026", "2026-09-14"), ("September 14 2026", "2026-09-14"), ("14 september 2026", "2026-09-14"), ("2026-09-14T07:30:00", "2026-09-14"), ("2026-09-14 00:00:00", "2026-09-14"),
        ("9/14/2026", "2026-09-14"), ("09/14/26", "2026-09-14"), ("9/14/85", "1985-09-14"), ("9-14-68", "2068-09-14"), ("09.14.2026", "2026-09-14"), ("46279", "2026-09-14"), ("46279.0", "2026-09-14"),
        ("2026-02-30", None), ("14/9/2026", None), ("1820-01-01", None), ("thirty", None), ("12345", None), ("", None),
    ],
)
def test_dates(ask, written, read):
    got = ask([written], dates.parse_date(V()))[0]
    assert got["value"] == (date.fromisoformat(read) if read else None)
    assert bool(got["error"]) == (read is None and written != "")


def test_day_first_and_other_forms(ask):
    assert ask(["14/9/2026"], dates.parse_date(V(), "dmy")["value"]) == [date(2026, 9, 14)]
    assert ask(["2026-09-14", "2026-09-14 00:00:00", "9/14/2026", ""], dates.is_non_iso(V())) == [False, False, True, False]
    assert ask(["x"], *dates.quarter_bounds("2026Q4")) == [(date(2026, 10, 1), date(2026, 12, 31))]
    days = [(None, "MISSING DATE"), (-1, "EXPIRED"), (30, "<30 days"), (90, "<90 days"), (91, "ok")]
    assert [ask(["x"], dates.expiry_bucket(F.lit(d).cast("int")))[0] for d, _ in days] == [b for _, b in days]


def test_numbers(ask):
    got = ask(["1,234.5", "-5", "1_000", "inf", "thirty", "", "1.0d", "1e3", "."], text.parse_number(V()))
    assert [g["value"] for g in got] == [1234.5, -5, 1000, float("inf"), None, None, None, 1000, None]
    assert [bool(g["error"]) for g in got] == [False] * 4 + [True, False, True, False, True]
    pairs = [(36.0, "36"), (7.5, "7.5"), (0.1 + 0.2, "0.3"), (1234567.0, "1.23457e+06"), (-4.25, "-4.25"), (0.0, "0"), (0.00001, "1e-05")]
    assert [ask(["x"], text.short_number(F.lit(x)))[0] for x, _ in pairs] == [f"{x:g}" for x, _ in pairs] == [y for _, y in pairs]
    assert ask(["x"], text.short_number(F.lit(8.0), sign=True)) == ["+8"]


def test_phones_identifiers_codes(ask):
    got = ask(["(718) 555 0203", "1-718-555-0203", "555-0203", ""], text.parse_phone(V()))
    assert [(g["value"], bool(g["error"])) for g in got] == [("718-555-0203", False), ("718-555-0203", False), ("555-0203", True), (None, False)]
    got = ask(["rn551203", "RN 551203", "rn–551203", "RN..551203-", "X-1"], text.parse_identifier(V(), "^(RN|LPN)-\\d{4,}$", True))
    assert [(g["value"], bool(g["error"])) for g in got] == [("RN-551203", False)] * 4 + [("X-1", True)]
    codes = Codes.of({"LKS": {"label": "Lakeside House", "aliases": ["Lakeside"]}, "HLC": {"label": "Hillcrest House"}})
    got = ask(["lakeside", "The Lakeside Campus", "Lakeside and Hillcrest House", "elsewhere", "LKS", None], text.parse_code(V(), codes))
    assert [(g["value"], bool(g["error"])) for g in got] == [("LKS", False), ("LKS", False), ("Lakeside and Hillcrest House", True), ("elsewhere", True), ("LKS", False), (None, False)]
    assert ask(["LKS", "?"], text.code_label(V(), codes)) == ["Lakeside House", "?"]


def test_names(ask):
    nick = {"tom": "thomas"}
    split = names.split_name(V())
    values = ["CASTILLO, NORA", "Nora M. Castillo", "Tom", "Q", "Nora B", "van Dyke, J R", ""]
    assert [tuple(r) for r in ask(values, split)] == [("NORA", "CASTILLO"), ("Nora", "Castillo"), ("Tom", ""), ("Q", ""), ("Nora", "B"), ("J", "van Dyke"), ("", "")]
    built = ask(["TOM MORENO-RUIZ", "tom o'neil", "Tom McAdam"], text.let(split, lambda n: names.build_name(n["first"], n["last"], nick)))
    assert [tuple(r) for r in built] == [("Tom Moreno-Ruiz", "thomas moreno ruiz"), ("Tom O'Neil", "thomas o neil"), ("Tom McAdam", "thomas mcadam")]


def test_similarity(spark):
    assert similarity.name_similarity("j okonkwo", "james okonkwo") == pytest.approx(2 * 9 / 22)
    assert similarity.name_similarity("rob lee", "robert lee") == 0.93
    assert similarity.name_similarity("lee ann", "ann lee") == 1.0 and similarity.name_similarity("", "x") == 0
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))).strip()
    pairs = [(word(), word()) for _ in range(60)]
    native = spark.createDataFrame(pairs, "a string, b string").select(similarity.native_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in native] == pytest.approx([similarity.name_similarity(a, b) for a, b in pairs])

    def table(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            rows.append([0])
            for k, y in enumerate(b, 1):
                rows[-1].append(rows[-2][k - 1] + 1 if x == y else max(rows[-2][k], rows[-1][-1]))
        return rows[-1][-1]

    assert all(similarity.common_length(a, b) == table(a, b) for a, b in pairs)


def test_shifts(ask):
    got = ask(["7a-3p", "11p - 7a", "7:30am to 3pm", "07:00-15:00", "12a-12p", "OFF", "7-3"], shifts.parse_shift(V()))
    assert [tuple(g) if g else None for g in got] == [(7, 15), (23, 7), (7.5, 15), (7, 15), (0, 12), None, None]
    assert ask(["x"], shifts.length(F.lit(23.0), F.lit(7.0)), shifts.length(F.lit(7.0), F.lit(7.0))) == [(8.0, 24.0)]
    assert ask(["Shifts: 7a-3p, 11p–7a are 8 hours. 7a-7p is 12 hrs; off is 0"], shifts.legend(V())) == [{"7a-3p": 8.0, "11p-7a": 8.0, "7a-7p": 12.0}]


def test_lists(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r[0] for r in df.select(text.spoken_list(F.col("x"))).collect()] == ["a", "a and b", "a, b and c"]
    assert unicodedata.normalize("NFKD", "é") != "é"
