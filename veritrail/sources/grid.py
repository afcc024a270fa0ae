"""Printed schedules: a row per person and a column per day, from page text or from the tables of a page.

Pages are rows (file, file_ord, page, text, tables); everything after the extraction of text is native.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import shifts
from ..functions.text import clean, header_key, parse_code, simplify
from ..operators.normalize import ERRORS, SHIFTS, normalize

PAGES = "file string, file_ord int, page int, text string, tables array<array<array<string>>>"
#: Lines of a page that may name its place, rows of a table that may head its days, days that make a header.
TITLE_LINES, HEADER_ROWS, HEADER_DAYS = 6, 5, 3
WEEKDAY = r"([A-Za-z]{3}\s+\d{1,2}/\d{1,2}(?:/\d{2,4})?)"
UNUSED = ("off", "-", "x")


def read_pdf(spark: SparkSession, path: str, file_ord: int = 0) -> DataFrame:
    """The pages of PDF files; needs the optional package pdfplumber on the executors."""

    def each(batches):
        import io

        import pdfplumber

        loose = {"vertical_strategy": "text", "horizontal_strategy": "text"}
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                with pdfplumber.open(io.BytesIO(data.as_py())) as pdf:
                    for number, page in enumerate(pdf.pages, 1):
                        tables = [t for t in page.extract_tables() if t] or [t for t in page.extract_tables(loose) if t]
                        row = [[file], [file_ord], [number], [page.extract_text() or ""], [tables]]
                        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.list_(pa.string()))))
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["file", "file_ord", "page", "text", "tables"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(each, PAGES)


def _days(cell: Column) -> Column:
    return F.regexp_count(cell, F.lit(shifts.DAY))


def _from_text(text: Column) -> Column:
    """A struct of header and rows from page lines: the last cells of a line are its days, the word before them the role."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: clean(x) != "")
    at = F.array_position(F.transform(lines, lambda x: _days(x) >= HEADER_DAYS), F.lit(True))
    days = F.regexp_extract_all(F.element_at(lines, at.cast("int")), F.lit(WEEKDAY), 1)
    n = F.size(days)
    later = F.slice(lines, at.cast("int") + 1, F.greatest(F.size(lines), F.lit(1)))
    words = F.filter(F.transform(later, lambda x: F.split(F.trim(x), r"\s+")), lambda w: F.size(w) >= n + 2)
    good = lambda c: shifts.parse_shift(c).isNotNull() | F.lower(c).isin(*UNUSED) | c.rlike(r"^\p{L}+$")
    rows = F.filter(words, lambda w: F.forall(F.slice(w, F.size(w) - n + 1, n), good))
    shaped = F.transform(
        rows,
        lambda w: F.concat(
            F.array(F.array_join(F.slice(w, 1, F.size(w) - n - 1), " "), F.element_at(w, F.size(w) - n)), F.slice(w, F.size(w) - n + 1, n)
        ),
    )
    header = F.concat(F.array(F.lit("Staff"), F.lit("Role")), days)
    return F.when((at > 0) & (n > 0) & (F.size(shaped) > 0), F.struct(header.alias("header"), shaped.alias("rows")))


def _from_table(table: Column) -> Column:
    """A table from the row that heads its days, if there is one and rows follow it."""
    heads = F.transform(F.slice(table, 1, HEADER_ROWS), lambda r: F.size(F.filter(r, lambda c: F.coalesce(_days(c) > 0, F.lit(False)))) >= HEADER_DAYS)
    at = F.array_position(heads, F.lit(True)).cast("int")
    rest = F.slice(table, at + 1, F.greatest(F.size(table), F.lit(1)))
    return F.when((at > 0) & (F.size(table) > at), F.struct(F.element_at(table, at).alias("header"), rest.alias("rows")))


def page_facts(cfg: Config, pages: DataFrame) -> DataFrame:
    """Pages with the place they name, its title line, their legend, their year (null if none) and their grids."""
    codes = cfg.codes.get(cfg.page_field)
    none = F.struct(F.lit(None).cast("string").alias("place"), F.lit("").alias("title"))
    titled = none
    if codes:
        lines = F.slice(F.split("text", r"\r\n|\r|\n"), 1, TITLE_LINES)
        read = F.transform(lines, lambda x: F.struct(parse_code(x, codes).alias("code"), clean(x).alias("title")))
        hit = F.filter(read, lambda x: (x["title"] != "") & x["code"]["error"].isNull())
        titled = F.when(F.size(hit) > 0, F.struct(hit[0]["code"]["value"].alias("place"), hit[0]["title"].alias("title"))).otherwise(none)
    year = F.regexp_extract("text", r"\b(20\d{2})\b", 1)
    tables = F.filter(F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), _from_table), lambda x: x.isNotNull())
    text = _from_text(F.col("text"))
    grids = F.when(F.size(tables) > 0, tables).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<struct<header:array<string>,rows:array<array<string>>>>"))
    out = pages.select("file", "file_ord", "page", "text", titled.alias("_t"), shifts.legend(F.col("text")).alias("legend"), F.when(year != "", year.cast("int")).alias("year"), grids.alias("grids"))
    return out.select("file", "file_ord", "page", F.col("_t.place").alias("place"), F.col("_t.title").alias("title"), "legend", "year", "grids")


def grid_records(cfg: Config, source: str, facts: DataFrame, year_hint: int) -> DataFrame:
    """Normalized records of all grids, a row per person, with their shifts."""
    fields = cfg.sources[source].fields
    keys = lambda f: sorted(fields[f].keys) if f in fields else []
    column = lambda f: F.array_position(F.transform("header", lambda h: header_key(h).isin(*keys(f))), F.lit(True)).cast("int") if keys(f) else F.lit(0)
    flat = facts.select("file", "file_ord", "page", "place", "title", "legend", "year", F.posexplode("grids").alias("g", "grid"))
    flat = flat.select("*", F.transform("grid.header", lambda h: clean(h)).alias("header"), F.posexplode("grid.rows").alias("r", "cells"))
    flat = flat.withColumn("name_at", column("name")).withColumn("role_at", column("role"))
    # Short rows are filled up, and cells beyond the header have no day.
    flat = flat.withColumn("cells", F.transform(F.sequence(F.lit(1), F.size("header")), lambda k: clean(F.try_element_at("cells", k))))
    flat = flat.filter("name_at > 0").withColumn("f_name", F.element_at("cells", F.col("name_at")))
    flat = flat.filter((F.col("f_name") != "") & ~header_key(F.col("f_name")).isin(*keys("name")))
    if "role" in fields:
        flat = flat.withColumn("f_role", F.when(F.col("role_at") > 0, F.element_at("cells", F.col("role_at"))).otherwise(""))

    def day(header: Column) -> Column:
        part = [F.regexp_extract(header, shifts.DAY, k) for k in (1, 2, 3)]
        written = F.when(part[2] == "", F.coalesce("year", F.lit(year_hint)).cast("string")).when(F.length(part[2]) == 2, F.concat(F.lit("20"), part[2])).otherwise(part[2])
        joined = F.concat_ws("-", F.lpad(written, 4, "0"), F.lpad(part[0], 2, "0"), F.lpad(part[1], 2, "0"))
        return F.when(part[0] != "", joined).try_cast("date")

    dated = F.filter(F.zip_with("header", "cells", lambda h, c: F.struct(day(h).alias("date"), c.alias("code"))), lambda x: x["date"].isNotNull())
    off, leave = (sorted(x) for x in (cfg.sources[source].off, cfg.sources[source].leave))

    def shift(x: Column) -> Column:
        span, key = shifts.parse_shift(x["code"]), simplify(x["code"])
        away = key.isin(*leave) if leave else F.lit(False)
        status = F.when(away, "leave").when(span.isNull(), "unknown").otherwise("work")
        hours = F.coalesce(F.try_element_at("legend", shifts.shift_key(x["code"])), shifts.length(span["start"], span["end"]))
        work = status == "work"
        return F.struct(
            x["date"].alias("date"), x["code"].alias("code"), status.alias("status"),
            F.when(work, span["start"]).alias("start"), F.when(work, span["end"]).alias("end"), F.when(work, hours).otherwise(0.0).alias("hours"),
        )

    due = F.filter(dated, lambda x: ~simplify(x["code"]).isin(*off)) if off else dated
    flat = flat.withColumn("_dated", dated).filter(F.size("_dated") > 0).withColumn("_shifts", F.transform(due, shift).cast(SHIFTS))
    titled = F.concat(F.zip_with("header", "cells", lambda h, c: F.struct(h.alias("k"), c.alias("v"))), F.array(F.struct(F.lit("_page_title").alias("k"), F.coalesce("title", F.lit("")).alias("v"))))
    raw = F.map_from_entries(F.filter(titled, lambda x, k: ~F.exists(F.slice(titled, k + 2, F.size(titled)), lambda y: y["k"] == x["k"])))
    flat = flat.withColumn("raw", raw)
    out = normalize(cfg, source, flat.select("file", "file_ord", "page", "g", "r", "place", "raw", "_shifts", *[c for c in flat.columns if c.startswith("f_")]))
    norm = out["norm"].withField("_shifts", F.col("_shifts"))
    if cfg.page_field in cfg.columns:
        norm = norm.withField(cfg.page_field, F.coalesce("place", f"norm.{cfg.page_field}"))
    unknown = F.transform(
        F.filter("_shifts", lambda s: s["status"] == "unknown"),
        lambda s: F.struct(F.lit("shift").alias("field"), F.concat(F.lit("'"), s["code"], F.lit("' on "), s["date"].cast("string"), F.lit(" is not a known schedule entry")).alias("message")),
    )
    return out.select(
        F.lit(source).alias("source"),
        "file",
        F.concat_ws(" ", F.lit("page"), F.col("page").cast("string"), F.lit("row"), (F.col("r") + 2).cast("string")).alias("row_ref"),
        "file_ord",
        ((F.col("page").cast("long") * 1000 + F.col("g")) * 1_000_000 + F.col("r")).alias("ord"),
        "raw",
        norm.alias("norm"),
        F.concat("errors", unknown).cast(ERRORS).alias("errors"),
    )


