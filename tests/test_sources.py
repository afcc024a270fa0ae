"""Files as they come."""

import csv
import zipfile
from datetime import date

import pytest

from tests import ferry
from tests.ferry import Ferry
from tests.test_pipeline import CONFIG
from veritrail.config import Config
from veritrail.sources import detect, grid, tables
from veritrail.sources.ingest import collect_files, ingest_files


@pytest.fixture(scope="module")
def cfg():
    return Config.load(CONFIG)


def test_headers(cfg):
    mapping, left = detect.map_headers(cfg, "wages", ["Slip-No", "Paid to", "Wage Class", "QUAY", "week begins", "Week_Ends on", "Time paid", "remarks"])
    assert mapping == {"slip": "Slip-No", "name": "Paid to", "role": "Wage Class", "facility": "QUAY", "first_day": "week begins", "last_day": "Week_Ends on", "worked": "Time paid"}
    assert left == ["remarks"]
    assert detect.detect_source(cfg, ferry.CREW)[0] == "crew" and detect.detect_source(cfg, ["foo", "bar"])[0] is None


def test_bom_semicolons_shuffled_columns_bad_and_blank_lines(spark, cfg, tmp_path):
    line = Ferry.build(5, hands=11)
    back = lambda r: ";".join(reversed(r))
    lines = [back([h.replace(" ", "_").title() for h in ferry.CREW]), *map(back, line.crew[:5]), ";" * 8, *map(back, line.crew[5:]), ";" * 8, "", "a;b;" * 9, back(line.crew[0][1:])]
    (tmp_path / "crew.csv").write_text("\ufeff" + "\n".join(lines) + "\n", encoding="utf-8")
    got = ingest_files(cfg, spark, [tmp_path / "crew.csv"])
    records = got.records.orderBy("ord").collect()
    assert len(records) == 12 and {r["source"] for r in records} == {"crew"}
    assert records[0]["row_ref"] == "row 2" and records[0]["norm"]["signed_on"] == date(*map(int, line.crew[0][8].split("-")))
    assert records[5]["row_ref"] == "row 8", "a row without values still counts"
    assert not [i for i in got.issues if i[1] == "critical"]


def test_missing_column_and_weird_values(spark, cfg, tmp_path):
    rows = Ferry.build(5).wages
    rows[0][6], rows[1][4], rows[2][6] = "forty", "2026-02-31", "-2"
    for name, cut in (("slips.csv", None), ("short.csv", 6)):
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f).writerows([r[:cut] for r in [ferry.WAGES, *rows]])
    got = ingest_files(cfg, spark, collect_files([tmp_path]))
    assert [(i[0], i[5]) for i in got.issues if i[0] == "missing_column"] == [("missing_column", "worked")]
    errors = {(e["field"], r["row_ref"]) for r in got.records.filter("file = 'slips.csv'").collect() for e in r["errors"]}
    assert errors == {("worked", "row 2"), ("first_day", "row 3")}


def test_a_header_after_many_blank_lines_and_line_ends_in_quotes(spark, cfg, tmp_path):
    rows = Ferry.build(5, hands=3).wages
    rows[1][0] = "W\n501"
    with open(tmp_path / "slips.csv", "w", newline="") as f:
        f.write("\n" * 200)
        csv.writer(f).writerows([ferry.WAGES, *rows])
    got = ingest_files(cfg, spark, [tmp_path / "slips.csv"])
    assert got.records.count() == 3 and "W 501" in {r["norm"]["slip"] for r in got.records.collect()}


def test_a_plain_file_is_split(spark, tmp_path):
    """A file without line ends in quotes is read by several tasks, and its rows keep their numbers."""
    with open(tmp_path / "long.csv", "w") as f:
        f.write("slip no,hours\n" + "".join(f"W{k},{k % 50}\n" for k in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
    try:
        header, rows = tables.read_delimited(spark, str(tmp_path / "long.csv"))
        assert header == ["slip no", "hours"] and rows.rdd.getNumPartitions() > 2
        assert [(r["ord"], r["cells"][0]) for r in rows.orderBy("ord").filter("ord % 9999 = 0").collect()] == [(k, f"W{k}") for k in range(0, 40_000, 9_999)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def sheet(path, rows):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if not isinstance(v, int) else f'<c s="1"><v>{v}</v></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_spreadsheet_and_other_files(spark, cfg, tmp_path):
    rows = Ferry.build(5, hands=8).registry
    days = (date(2026, 2, 20) - date(1899, 12, 30)).days
    sheet(tmp_path / "register.xlsx", [ferry.REGISTRY, *[[*r[:4], days] for r in rows]])
    (tmp_path / "notes.csv").write_text("foo,bar\n1,2\n")
    (tmp_path / "broken.xlsx").write_text("no workbook")
    (tmp_path / "photo.png").write_text("x")
    (tmp_path / "readme.md").write_text("x")
    got = ingest_files(cfg, spark, collect_files([tmp_path, tmp_path / "nowhere"]))
    assert got.records.count() == 8
    first = got.records.orderBy("ord").head()
    assert first["norm"]["checked_on"] == date(2026, 2, 20) and "checked_on" not in first["norm"]["_reformatted"]
    assert sorted((i[0], i[4]) for i in got.issues) == [("unreadable_file", "broken.xlsx"), ("unrecognised_file", "notes.csv"), ("unrecognised_file", "photo.png")]


def test_text_grid(spark, cfg):
    line = Ferry()
    line.watches = [["Ada Holm", "MATE", "KLI", ["6a-2p", "ashore", "8a-8p", "ashore", "ashore", "10p-6a", "ashore"]], ["Bo Dahl", "DECK", "KLI", ["2p-10p"] * 2 + ["ADRIFT"] + ["ashore"] * 4]]
    text = line.pages("2026")[1][3]
    table = [["", "printed"], ["Hand", "Duty", "03/02/26", "03/03", "03/04"], ["Eli Sund", "ENG", "8a-8p", "course", ""], ["Hand", "", "", "", ""], [None, "ENG", "x", "x", "x"]]
    pages = spark.createDataFrame([("b.pdf", 1, 1, text, None), ("b.pdf", 1, 2, "nothing here", None), ("b.pdf", 1, 3, "no legend", [table])], grid.PAGES)
    got = ingest_files(cfg, spark, [], pages=pages, year_hint=2031)
    rows = {r["norm"]["_display"]: r for r in got.records.collect()}
    ada = rows["Ada Holm"]["norm"]
    assert (ada["facility"], ada["role"], rows["Ada Holm"]["row_ref"]) == ("KLI", "MATE", "page 1 row 2")
    assert [(s["date"].isoformat(), s["status"], s["hours"]) for s in ada["_shifts"]] == [("2026-03-02", "work", 8), ("2026-03-04", "work", 12), ("2026-03-07", "work", 8)]
    assert [e["field"] for e in rows["Bo Dahl"]["errors"]] == ["shift"]
    eli = rows["Eli Sund"]
    assert [(s["date"].isoformat(), s["status"], s["hours"]) for s in eli["norm"]["_shifts"]] == [("2026-03-02", "work", 12.0), ("2031-03-03", "leave", 0.0)]
    assert eli["raw"]["_page_title"] == "" and eli["raw"]["03/03"] == "course"
    assert len(rows) == 3 and {i[0] for i in got.issues} == {"unknown_facility", "no_shift_legend", "no_table"}


def test_pdf_pages_become_records(spark, cfg, tmp_path):
    """The reader itself: pages with drawn tables, with tables by alignment only, and with text only, of two files."""
    line = Ferry.build(6, hands=9)
    (tmp_path / "modules").mkdir()
    pages = {name: line.pages("2026")[k][3] for k, name in enumerate(("drawn", "aligned", "text"))}
    drawn = [["Staff", "Role", *ferry.DAYS], *[[n, d, *codes] for n, d, p, codes in line.watches if p == "OST"]]
    aligned = [["Staff", "Role", *ferry.DAYS], *[[n, d, *codes] for n, d, p, codes in line.watches if p == "KLI"]]
    import json

    module = tmp_path / "modules" / "pdfplumber.py"
    module.write_text(
        "import json\nclass Page:\n    def __init__(self, p): self.p = p\n    def extract_text(self): return self.p['text']\n"
        "    def extract_tables(self, s=None): return self.p['loose'] if s else self.p['tables']\n"
        "class Book:\n    def __init__(self, pages): self.pages = [Page(p) for p in pages]\n    def __enter__(self): return self\n    def __exit__(self, *a): pass\n"
        "def open(f): return Book(json.loads(f.read()))\n"
    )
    spark.sparkContext.addPyFile(str(module))
    one = [{"text": pages["drawn"], "tables": [drawn], "loose": []}, {"text": pages["aligned"], "tables": [], "loose": [aligned]}]
    (tmp_path / "a.pdf").write_bytes(json.dumps(one).encode())
    (tmp_path / "b.pdf").write_bytes(json.dumps([{"text": pages["text"], "tables": [], "loose": []}]).encode())
    got = ingest_files(cfg, spark, [tmp_path / "a.pdf", tmp_path / "b.pdf"], year_hint=2026)
    records = got.records.collect()
    assert {r["norm"]["_display"] for r in records} == {n for n, *_ in line.watches} and not got.issues
    assert {(r["file"], r["norm"]["facility"]) for r in records} == {("a.pdf", "OST"), ("a.pdf", "KLI"), ("b.pdf", "SAN")}
    hours = {r["norm"]["_display"]: sum(s["hours"] for s in r["norm"]["_shifts"]) for r in records}
    assert hours == {n: float(w[6]) for (n, *_), w in zip(line.watches, line.wages)}


def test_pdf_without_a_reader_is_an_issue(spark, cfg, tmp_path):
    (tmp_path / "plan.pdf").write_bytes(b"%PDF-1.4 broken")  # neither a file for the reader nor one for its stand-in
    got = ingest_files(cfg, spark, [tmp_path / "plan.pdf"])
    assert [(i[0], i[1]) for i in got.issues] == [("unreadable_file", "critical")] and got.records.count() == 0


def test_sniffed_delimiters():
    assert [tables.sniff(x) for x in ("a,b\n1,2\n", "a;b\n1;2\n", "a\tb\n1\t2\n", "a|b\n1|2\n", "one\n")] == [",", ";", "\t", "|", ","]
