"""A seeded business with planted faults: findings, links, golden records, reports, decisions and the command line."""

import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.ferry import AS_OF, FAULTS, Ferry, faulty
from veritrail import cli, listings, pipeline, reports
from veritrail.config import Config
from veritrail.functions.similarity import name_similarity
from veritrail.sources.grid import PAGES
from veritrail.store import Store

CONFIG = Path(__file__).resolve().parents[1] / "config/example.yaml"
DAY = date.fromisoformat(AS_OF)


@pytest.fixture(scope="module")
def cfg():
    return Config.load(CONFIG)


def built(spark, cfg, folder, line):
    pages = spark.createDataFrame(line.write(folder / "exports"), PAGES)
    store = Store(spark, str(folder / "tables"))
    return store, pipeline.ingest(cfg, store, [folder / "exports"], DAY, pages=pages)


@pytest.fixture(scope="module")
def sunk(spark, cfg, tmp_path_factory):
    """Every fault at once."""
    line, want, at = faulty()
    store, summary = built(spark, cfg, tmp_path_factory.mktemp("faulty"), line)
    return store, summary, line, want, at


def found(store):
    return {(r["rule_id"], r["entity_key"]) for r in store.table("issues").select("rule_id", "entity_key").collect()}


def test_what_was_planted_is_found_and_nothing_else(sunk):
    store, summary, line, want, _ = sunk
    assert found(store) == want
    assert summary["read"]["records"] == {"crew": len(line.crew), "wages": len(line.wages), "registry": len(line.registry), "watches": len(line.watches)}
    assert summary["linked"]["anchored"] == 21 and summary["linked"]["entities"] == 23
    by = summary["linked"]["by"]
    assert by["anchor_key"] == 22 and by["strong_key"] == len(line.registry) and by["unmatched"] == 2


@pytest.mark.parametrize("seed", [2])
def test_any_few_faults_come_back(spark, cfg, tmp_path, seed):
    """Faults by chance, at other people of another line: findings add up as the faults do."""
    rng = random.Random(seed)
    line, want = Ferry.build(seed), set()
    chosen = rng.sample(FAULTS[2:], 7)
    for fault, k in zip(chosen, rng.sample(range(3, 21), 7)):
        want |= fault(line, k)
    line.wages, line.registry = ([r for r in rows if r is not None] for rows in (line.wages, line.registry))
    store, _ = built(spark, cfg, tmp_path, line)
    assert found(store) == want


def test_a_line_without_faults_has_no_issue(spark, cfg, tmp_path):
    store, summary = built(spark, cfg, tmp_path, Ferry.build(7, hands=9))
    assert found(store) == set() and summary["issues"] == {"open": {}, "decided": {}}
    assert summary["linked"] == {"entities": 9, "anchored": 9, "by": {"anchor_key": 9, "strong_key": 9, "fuzzy_name": 18}}


def test_short_names_and_initials(sunk):
    store, _, line, _, at = sunk
    rows = {r["norm"]["_display"]: r for r in store.table("records").join(store.table("links"), "record_key").filter("source in ('watches', 'wages')").collect()}
    kate = rows[line.watches[1][0]]
    assert kate["entity_key"] == at["short_name_on_the_bill"] and kate["method"] == "fuzzy_name"
    lone = store.table("links").filter("method = 'unmatched' and candidates is not null").head()
    own = line.crew[0]
    key = lone["entity_key"].removeprefix("wages:")
    assert lone["candidates"] == [at["initial_on_the_slip"]] and lone["score"] == pytest.approx(name_similarity(key, f"{own[1]} {own[2]}".lower()) + 0.06)


def test_golden_values_by_authority(sunk):
    store, _, line, _, at = sunk
    key = at["register_says_another_day"]
    row = store.table("golden").filter((F.col("entity_key") == key) & (F.col("field") == "valid_until")).head()
    own = next(r for r in line.crew if f"crew:{r[0]}" == key)
    assert (row["source"], row["value"]) == ("registry", "2027-12-24") and [(c["source"], c["value"]) for c in row["conflicts"]] == [("crew", date.fromisoformat("-".join(p.zfill(2) for p in own[7].split("-"))).isoformat())]
    said = {r["entity_key"]: r["field"] for r in listings.issues(store).filter("rule_id = 'field_conflict'").join(store.table("issues").select("fingerprint", "field"), "fingerprint").collect()}
    assert said == {key: "Validity", at["on_two_quays"]: "Port", at["other_duty_in_the_register"]: "Duty"}


def test_lists(sunk, cfg):
    store, _, line, want, at = sunk
    everything = listings.issues(store, status=None).collect()
    assert len(everything) == store.table("issues").count() and [r["position"] for r in everything] == sorted(r["position"] for r in everything)
    heavy = listings.issues(store, ["critical"]).collect()
    assert heavy and {r["severity"] for r in heavy} == {"critical"}
    one = at["on_two_quays"]
    own = listings.issues(store, person=one).collect()
    assert {r["rule_id"] for r in own} == {"overlap", "field_conflict", "hours_reconcile"} and listings.issues(store, person=own[0]["person"]).count() == len(own)
    assert listings.issues(store, titles=[own[0]["title"]], status="resolved").count() == 0
    twice = next(r for r in everything if r["rule_id"] == "duplicate_key")
    behind = listings.lineage(store, twice["fingerprint"]).collect()
    assert [r["raw"]["crew number"] for r in behind] == [at["entered_twice"].removeprefix("crew:")] * 2 and {r["entity_key"] for r in behind} == {at["entered_twice"]}
    people = listings.entities(cfg, store).collect()
    assert [r["display_name"] for r in people] == sorted(r["display_name"] for r in people) and len(people) == 23
    assert {r["entity_key"] for r in listings.entities(cfg, store, False).collect()} == {k for rule, k in want if rule == "not_in_anchor"}
    assert listings.records_of(store, one).count() == 5
    for r in store.table("issues").collect():
        assert r["explanation"] and (r["record_keys"] or r["file"] or r["rule_id"] in ("overlap", "overtime"))


def test_reports(sunk, cfg):
    store, _, line, _, at = sunk
    lapsed = next(f"{r[1]} {r[2]}" for r in line.crew if f"crew:{r[0]}" == at["lapsed_in_the_week"])
    front = reports.overview(cfg, store)
    void = next(r for r in line.wages if lapsed.split()[1] in r[1])
    assert front["credentials"]["EXPIRED"] == {"count": 1, "names": [lapsed]} and front["worked_without"] == [lapsed] and front["doubts"] > 5
    assert front["hours"]["void"]["paid"] == float(void[6]) and front["hours"]["counted"]["paid"] == sum(float(r[6]) for r in line.wages) - float(void[6])
    assert lapsed in front["not_counted"] and front["data"]["first"] == date(2026, 3, 2)
    assert {r["name"] for r in reports.staffing_excluded(cfg, store).collect()} == {lapsed}
    grid = reports.staffing(cfg, store, "2026Q1").collect()
    assert sum(r["paid_hours"] for r in grid) == front["hours"]["counted"]["paid"] and reports.staffing(cfg, store, "2025Q4").count() == 0
    daily = reports.staffing_daily(cfg, store).agg(F.sum("scheduled_hours")).head()[0]
    wide = reports.staffing_pivot(cfg, store)
    assert daily == sum(r["scheduled_hours"] for r in grid) == sum(sum(v for v in r[2:]) for r in wide.collect()) and len(wide.columns) == 9
    state = {(r["entity_key"], r["source"]): (r["status"], r["why"]) for r in reports.agreement(cfg, store).collect()}
    assert state[at["unpaid"], "wages"][0] == "missing" and state[at["other_duty_in_the_register"], "registry"] == ("differs", "duty")
    assert state[at["paid_far_too_much"], "wages"] == ("differs", "hours vs schedule") and state[at["short_name_on_the_bill"], "watches"][0] == "agrees"
    able = {(r["facility"], r["role"]): r["people"] for r in reports.capacity(cfg, store).collect()}
    assert able == front["able"] and sum(able.values()) <= 21


def test_verdicts_outlive_builds(spark, cfg, tmp_path):
    line, _, at = faulty()
    store, before = built(spark, cfg, tmp_path, line)
    mark = {r["rule_id"]: r["fingerprint"] for r in store.table("issues").orderBy("position").collect()}
    joined = pipeline.decide(cfg, store, mark["possible_match"], "confirm")
    assert joined["linked"]["by"]["human_decision"] == 1 and joined["linked"]["entities"] == before["linked"]["entities"] - 1
    for refused in ((mark["overlap"], "confirm"), (mark["overlap"], "resolve"), (mark["overlap"], "forget"), ("nobody", "accept")):
        with pytest.raises(ValueError):
            pipeline.decide(cfg, store, *refused)
    assert pipeline.decide(cfg, store, mark["overlap"], "resolve", note=" sent ashore ")["issues"]["decided"] == {"resolved": 1}
    assert pipeline.decide(cfg, store, mark["stale"], "accept")["issues"]["decided"] == {"resolved": 1, "accepted": 1}
    told = listings.decisions(store).collect()
    assert [(r["about"], r["verdict"], r["note"]) for r in told] == [("issue", "accepted", ""), ("issue", "resolved", "sent ashore"), ("match", "joined", "")]
    assert told[1]["person"] and told[2]["person"] and told[1]["title"] == "Booked twice"
    pages = spark.createDataFrame(line.write(tmp_path / "exports"), PAGES)
    again = pipeline.ingest(cfg, store, [tmp_path / "exports"], DAY, pages=pages)
    assert again["issues"]["decided"] == {"resolved": 1, "accepted": 1} and again["linked"] == joined["linked"]
    assert pipeline.decide(cfg, store, mark["overlap"], "reopen")["issues"]["decided"] == {"accepted": 1}
    assert store.query("SELECT count(*) AS n FROM decisions").head()["n"] == 4
    store.reset(keep_decisions=True)
    assert store.last_run() is None and store.decisions("match").count() == 1


def test_kept_apart(spark, cfg, tmp_path):
    line = Ferry.build(4, hands=6)
    FAULTS[0](line, 0)
    store, _ = built(spark, cfg, tmp_path, line)
    asked = store.table("issues").filter("rule_id = 'possible_match'").head()["fingerprint"]
    after = pipeline.decide(cfg, store, asked, "separate", note="a cousin")
    assert after["linked"]["by"]["human_kept_separate"] == 1 and "possible_match" not in {r for r, _ in found(store)}
    assert listings.decisions(store).head()["verdict"] == "kept apart"


def test_command_line(spark, cfg, tmp_path, capsys):
    line, want, at = faulty()
    line.write(tmp_path / "exports")
    base = ["--config", str(CONFIG), "--store", str(tmp_path / "tables")]

    def ask(*words):
        code = cli.main([*base, *words], spark)
        return code, capsys.readouterr().out

    code, out = ask("ingest", str(tmp_path / "exports"), "--as-of", AS_OF)
    assert code == 0 and f"{len(line.crew)} records from crew list.csv (crew)" in out
    store = Store(spark, str(tmp_path / "tables"))
    _, listed = ask("issues", "--status", "any")
    assert listed.count("\n    ") == store.table("issues").count()
    mark = next(r["fingerprint"] for r in store.table("issues").collect() if r["rule_id"] == "duplicate_key")
    assert ask("rows", mark)[1].count(at["entered_twice"].removeprefix("crew:")) == 2
    assert "Careful" in ask("report", "staffing", "--quarter", "2026Q1")[1] and "from 2026-03-02 to 2026-03-08" in ask("report", "staffing", "--csv", str(tmp_path / "days"))[1]
    assert list((tmp_path / "days").glob("*.csv")) and "Zebulon Quillfeather" in ask("entities", "--unanchored")[1]
    assert ask("decide", mark, "confirm")[0] == 1 and ask("decide", mark, "accept", "--note", "known")[0] == 0 and "known" in ask("decisions")[1]
    assert ask("rebuild")[0] == 0 and "EXPIRED" in ask("report", "credentials")[1] and ask("reset")[1] == "The store is empty.\n"


def test_tables_of_text_have_no_end(spark):
    lines = list(cli.columns(spark.range(2_500).select("id", F.lit(None).cast("string").alias("x"))))
    assert len(lines) == 2_501 and lines[-1].strip() == "2499" and list(cli.columns(spark.range(0))) == ["  nothing"]


def test_empty_folder(spark, cfg, tmp_path):
    (tmp_path / "exports").mkdir()
    store = Store(spark, str(tmp_path / "tables"))
    assert pipeline.ingest(cfg, store, [tmp_path / "exports"], DAY)["linked"]["entities"] == 0
