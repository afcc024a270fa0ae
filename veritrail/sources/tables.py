"""Delimited files and spreadsheets as rows of strings: an array of cells and a row number that is stable."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = ",;\t|"
HEAD = 4096


def sniff(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head[:HEAD], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def numbered(df: DataFrame, name: str = "ord") -> DataFrame:
    """Rows numbered from 0 in the order of their files; one count per partition reaches the driver."""
    placed = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = sorted((r["p"], r["count"]) for r in placed.groupBy(part.alias("p")).count().collect())
    offset, pairs = 0, []
    for p, n in counts:
        pairs += [F.lit(p), F.lit(offset)]
        offset += n
    start = F.coalesce(F.create_map(*pairs)[part], F.lit(0)) if pairs else F.lit(0)
    return placed.withColumn(name, (start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_id")


def _unlike(names: list[str]) -> list[str]:
    """Header names made distinct with .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def _head(lines: DataFrame) -> str:
    """The first line that is not blank, with what follows it; the file is read no further than that takes."""
    some = lines.filter(F.regexp_replace("value", "\ufeff", "").rlike(r"[^\s,;|]"))
    return "\n".join(r["value"] for r in some.limit(64).collect()).removeprefix("\ufeff")


def _has_quoted_line_ends(lines: DataFrame) -> bool:
    """Whether any line has an odd number of quotes, as one has that a quoted line end cuts."""
    return bool(lines.filter(F.regexp_count("value", F.lit('"')) % 2 == 1).head(1))


def read_delimited(spark: SparkSession, path: str, multi_line: bool | None = None) -> tuple[list[str], DataFrame]:
    """(headers, rows with ``ord`` and ``cells``). Short rows are filled with nulls, rows with too many cells left out.

    ``multi_line`` says whether quotes hold line ends, which costs one task a file; without them a file is split. Unless
    it is given, the lines are looked through for it. The header is the first line with a value, wherever it stands.
    """
    lines = spark.read.option("encoding", "UTF-8").text(path)
    head = _head(lines)
    delimiter = sniff(head)
    headers = _unlike(next((row for row in csv.reader(io.StringIO(head), delimiter=delimiter) if row), []))
    if not headers:
        raise ValueError("the file has no header line")
    if multi_line is None:
        multi_line = _has_quoted_line_ends(lines)
    names = [f"c{k}" for k in range(len(headers))]
    # One column more than there are headers tells rows with too many cells; a null value that no file holds keeps
    # empty cells apart from missing ones.
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_over"]])
    rows = spark.read.csv(
        path, schema=schema, sep=delimiter, header=True, mode="PERMISSIVE", multiLine=multi_line,
        quote='"', escape='"', nullValue="\x01", emptyValue="", enforceSchema=True, encoding="UTF-8",
    )
    return headers, numbered(rows.filter("_over is null").select(F.array(*names).alias("cells")))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates, a fixed value of the format.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """The cells of a workbook's first sheet, as strings; date cells as ``YYYY-MM-DD HH:MM:SS``."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        tree = lambda name: ElementTree.fromstring(book.read(name))
        names = set(book.namelist())
        text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))
        shared = [text_of(s) for s in tree("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.findall("m:numFmts/m:numFmt", _NS)}
            for x in styles.findall("m:cellXfs/m:xf", _NS):
                kind = int(x.get("numFmtId", 0))
                dated.append(kind in _DATE_FORMATS or bool(re.search("[ymd]", re.sub(r'"[^"]*"|\[[^]]*\]', "", own.get(kind, "")), re.I)))
        first = tree("xl/workbook.xml").find("m:sheets/m:sheet", _NS).get(_REL)
        target = next(r.get("Target") for r in tree("xl/_rels/workbook.xml.rels") if r.get("Id") == first)
        sheet = tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        for row in sheet.findall("m:sheetData/m:row", _NS):
            cells: list[str] = []
            for c in row.findall("m:c", _NS):
                letters = re.match("[A-Z]+", c.get("r", ""))
                place = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                cells += [""] * (place + 1 - len(cells))
                value, kind = c.find("m:v", _NS), c.get("t", "n")
                text = (value.text or "") if value is not None else ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = text_of(c)
                elif kind == "b":
                    text = "True" if text == "1" else "False"
                elif kind == "n" and text and int(c.get("s", 0)) < len(dated) and dated[int(c.get("s", 0))]:
                    text = (datetime(1899, 12, 30) + timedelta(days=float(text))).strftime("%Y-%m-%d %H:%M:%S")
                cells[place] = text
            yield cells


def read_sheet(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The first sheet of a workbook, as :func:`read_delimited` gives it."""

    def each(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = list(sheet_rows(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["n", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(each, "n long, cells array<string>")
    first = rows.filter("n = 0").head()
    if not first:
        raise ValueError("the sheet is empty")
    headers = _unlike(first["cells"])
    cells = F.slice(F.concat("cells", F.array_repeat(F.lit(None).cast("string"), len(headers))), 1, len(headers))
    return headers, rows.filter("n > 0").select(cells.alias("cells"), (F.col("n") - 1).alias("ord"))
