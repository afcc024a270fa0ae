"""Every registered query of the engine, with the SQL it must equal.

The tables are a star schema with an event stream. ``worlds.py`` tells them as records; rules, reports, listings and issues
are the engine's own, and so are the functions below. The SQL says the same from the tables alone.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import listings, pipeline, reports
from ..config import Codes, Config
from ..functions import dates, names, shifts, similarity, text
from ..operators import golden as golden_ops
from ..operators import issues as issue_ops
from ..operators import rules
from ..operators.issues import fingerprint
from ..operators.link import name_pairs
from ..sources import grid, tables
from ..store import latest
from . import worlds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *days: str):
    """Register a function under its own name, with its SQL if it can be said in SQL.

    ``days`` are date columns, which both sides return as text.
    """

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in days}) if days else df

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            texts = ", ".join(f"{c}::VARCHAR AS {c}" for c in days)
            ORACLE_SQL[fn.__name__] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if days else sql
        return run

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _day(c: str) -> Column:
    return F.col(c).cast("date")


AS_OF = "DATE '2001-08-01'"
_AS_OF = lambda: F.lit("2001-08-01").cast("date")

# The records of worlds.py, in SQL.
_C = """c AS (
    SELECT c_custkey, 'crm:' || c_custkey AS k, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_mktsegment AS role,
           CASE WHEN c_nationkey <> 7 THEN 'N' || c_nationkey END AS facility, DATE '1998-01-01' + ((c_custkey * 37) % 1500)::INT AS until FROM customer)"""
_O = """o AS (
    SELECT o_orderkey, 'crm:' || o_custkey AS k, o_orderdate::DATE AS ordered, o_orderdate::DATE + 60 AS closes, (o_orderkey % 24 + 1)::DOUBLE AS hours,
           CASE WHEN year(o_orderdate) = 1998 THEN 'season' ELSE 'sales' END AS src, o_orderpriority FROM orders)"""
_L = """l AS (
    SELECT l_orderkey || '-' || l_linenumber AS line, 'crm:' || o_custkey AS k, o_orderdate::DATE AS ordered, l_shipdate::DATE AS shipped, l_quantity AS qty
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_E = f"""{_C}, {_O}, {_L}, e AS (
    SELECT k, 'paid' AS kind, ordered AS day, closes AS last, hours FROM o UNION ALL SELECT k, 'scheduled', shipped, shipped, qty FROM l),
x AS (
    SELECT e.*, name, coalesce(facility, 'Unknown') AS facility, coalesce(role, 'Unknown') AS role, until, c.k IS NOT NULL AS anchored, coalesce(last > until AND hours <> 0, false) AS late
    FROM e LEFT JOIN c ON c.k = e.k)"""

# --- rules over one table


@query(f"WITH {_L} SELECT line, count(*) AS n FROM l GROUP BY 1 HAVING count(*) > 1")
def dup_key(spark, d):
    """A key that several records have."""
    found = worlds.trade(spark, d).rule({"type": "duplicate_key", "source": "shipping", "field": "line"})
    return found.select(F.col("detail").alias("line"), F.size("record_keys").cast("long").alias("n"))


@query(f"WITH {_C} SELECT k AS entity_key, 'crm|' || c_custkey AS record FROM c WHERE balance < 100 OR balance > 9000")
def numeric_range(spark, d):
    found = worlds.trade(spark, d).rule({"type": "numeric_range", "source": "crm", "field": "balance", "min": 100, "max": 9000})
    return found.select("entity_key", F.col("record_keys")[0].alias("record"))


@query(f"WITH {_L} SELECT 'shipping|' || line AS record, k AS entity_key FROM l WHERE shipped < ordered")
def date_order(spark, d):
    found = worlds.trade(spark, d).rule({"type": "date_order", "source": "shipping", "start": "ordered", "end": "shipped"})
    return found.select(F.col("detail").alias("record"), "entity_key")


@query(f"WITH {_O} SELECT 'sales|' || o_orderkey AS record FROM o WHERE src = 'sales' AND ordered > DATE '2000-12-31'")
def future_date(spark, d):
    world = worlds.trade(spark, d, date(2000, 12, 31))
    return world.rule({"type": "future_date", "source": "sales", "field": "ordered"}).select(F.col("detail").alias("record"))


@query(f"""
    WITH {_C}, {_O} SELECT 'season|' || o_orderkey AS record,
      name || ' (' || c_custkey || '): last checked ' || ordered || ', ' || date_diff('day', ordered, {AS_OF}) || ' days ago (at most 1000 are allowed).' AS explanation
    FROM o JOIN c ON c.k = o.k WHERE src = 'season' AND date_diff('day', ordered, {AS_OF}) > 1000""")
def stale(spark, d):
    found = worlds.trade(spark, d).rule({"type": "stale", "source": "season", "field": "ordered", "max_age_days": 1000})
    return found.select(F.col("detail").alias("record"), "explanation")


@query(f"WITH {_C} SELECT k AS entity_key, 'balance' AS field FROM c WHERE balance IS NULL UNION ALL SELECT k, 'facility' FROM c WHERE facility IS NULL")
def required(spark, d):
    """One finding for each required field that is empty."""
    return worlds.trade(spark, d).rule({"type": "required"}).select("entity_key", "field")


@query(f"WITH {_O} SELECT src || '|' || o_orderkey AS record, 'price' AS field, src || '|' || o_orderkey || '|''low'' is no number' AS detail FROM o WHERE o_orderpriority = '5-LOW'")
def invalid_value(spark, d):
    """What could not be read, from the errors that records carry."""
    found = worlds.trade(spark, d).rule({"type": "invalid_value"})
    return found.select(F.col("record_keys")[0].alias("record"), "field", "detail")


@query(f"WITH {_O} SELECT src || '|' || o_orderkey AS record, k AS entity_key FROM o WHERE hours > 2 * 61 / 7.0")
def overtime(spark, d):
    found = worlds.trade(spark, d).rule({"type": "overtime", "kind": "paid", "max_hours": 2})
    return found.select(F.col("detail").alias("record"), "entity_key")


@query("""
    SELECT 'user:' || user_id AS entity_key, strftime(t, '%Y-%m-%dT%H:%M:%S') || '|' || strftime(next, '%Y-%m-%dT%H:%M:%S') AS moments
    FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next FROM (SELECT user_id, event_id, date_trunc('second', ts) AS t FROM events))
    WHERE next < t + INTERVAL 30 MINUTE""")
def overlap(spark, d):
    """Neighbours in time that run into each other."""
    return worlds.clock(spark, d).rule({"type": "overlap", "kind": "scheduled"}).select("entity_key", F.col("detail").alias("moments"))


# --- rules across tables


@query(f"WITH {_C}, {_O} SELECT k AS entity_key, 'crm|' || c_custkey AS record FROM c WHERE k NOT IN (SELECT k FROM o WHERE src = 'season')")
def missing_from(spark, d):
    found = worlds.trade(spark, d).rule({"type": "missing_from", "source": "season"})
    return found.select("entity_key", F.col("record_keys")[0].alias("record"))


@query("SELECT 'order:' || o_orderkey AS entity_key, 'orders|' || o_orderkey AS record FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_in_anchor(spark, d):
    found = worlds.parcels(spark, d).rule({"type": "not_in_anchor", "source": "orders"})
    return found.select("entity_key", F.col("record_keys")[0].alias("record"))


@query(f"WITH {_C} SELECT k AS entity_key FROM c WHERE role IN ('BUILDING', 'MACHINERY') AND balance IS NULL")
def missing_value(spark, d):
    return worlds.trade(spark, d).rule({"type": "missing_value", "field": "balance", "roles": ["BUILDING", "MACHINERY"]}).select("entity_key")


@query("""
    WITH v AS (SELECT l_orderkey AS k, l_linestatus AS v FROM lineitem UNION ALL SELECT o_orderkey, o_orderstatus FROM orders)
    SELECT 'order:' || k AS entity_key, string_agg(DISTINCT v, ',' ORDER BY v) AS vals, count(*) AS n FROM v GROUP BY k HAVING count(DISTINCT v) > 1""")
def field_conflict(spark, d):
    found = worlds.parcels(spark, d).rule({"type": "field_conflict", "label": "Flag", "fields": {"lines": "flag", "orders": "flag"}})
    return found.select("entity_key", F.array_join(F.from_json("vals", "values array<string>")["values"], ",").alias("vals"), F.size("record_keys").cast("long").alias("n"))


@query(f"""
    WITH {_C}, d AS (SELECT *, date_diff('day', {AS_OF}, until) AS days FROM c)
    SELECT k AS entity_key, days::VARCHAR AS days, CASE WHEN days < 0 THEN 'critical' WHEN days <= 30 THEN 'warning' ELSE 'info' END AS severity,
           CASE WHEN days < 0 THEN 'until expired' WHEN days <= 30 THEN 'until expires within 30 days' ELSE 'until expires within 90 days' END AS title
    FROM d WHERE days <= 90""")
def expiry(spark, d):
    """Golden dates that have passed or come soon, in the tightest window that holds them."""
    found = worlds.trade(spark, d).rule(worlds.TRADE["rules"][0])
    return found.select("entity_key", F.get_json_object("vals", "$.days").alias("days"), "severity", "title")


@query(f"""
    SELECT o_orderkey, date_diff('day', {AS_OF}, o_orderdate::DATE + 400)::BIGINT AS days_left,
           CASE WHEN date_diff('day', {AS_OF}, o_orderdate::DATE + 400) < 0 THEN 'EXPIRED' WHEN date_diff('day', {AS_OF}, o_orderdate::DATE + 400) <= 30 THEN '<30 days'
                WHEN date_diff('day', {AS_OF}, o_orderdate::DATE + 400) <= 90 THEN '<90 days' ELSE 'ok' END AS status FROM orders""")
def expiry_buckets(spark, d):
    rows = _t(spark, d, "orders", "o_orderkey", "o_orderdate")
    rows = rows.select("o_orderkey", F.datediff(F.date_add(_day("o_orderdate"), 400), _AS_OF()).cast("long").alias("days_left"))
    return rows.withColumn("status", dates.expiry_bucket(F.col("days_left")))


@query(f"""
    WITH {_C}, {_O} SELECT o.k AS entity_key, count(*) AS n, sum(hours) AS hours FROM o JOIN c ON c.k = o.k WHERE closes > until GROUP BY 1""")
def activity_after_expiry(spark, d):
    """Hours of periods that end after a golden date; the finding says how many, and names every record."""
    found = worlds.trade(spark, d).rule(worlds.TRADE["rules"][1])
    hours = F.regexp_extract("explanation", r"paid (\S+) hours", 1).cast("double")
    return found.select("entity_key", (F.size("record_keys") - 1).cast("long").alias("n"), hours.alias("hours"))


_PERIODS = f"""
    WITH {_O}, {_L} SELECT src || '|' || o_orderkey AS record, o.k AS entity_key, hours AS paid, coalesce(sum(qty), 0) AS planned
    FROM o LEFT JOIN l ON l.k = o.k AND shipped BETWEEN o.ordered AND o.closes WHERE o.k IN (SELECT k FROM l) GROUP BY ALL"""
_RECONCILE = {"type": "hours_reconcile", "scheduled": "scheduled", "paid": "paid", "tolerance": 20}


@query(f"SELECT entity_key, record, paid, planned FROM ({_PERIODS}) WHERE abs(planned - paid) > 20")
def hours_reconcile(spark, d):
    found = worlds.trade(spark, d).rule(_RECONCILE).filter("detail <> 'uncovered'")
    of = lambda k: F.get_json_object("vals", f"$.{k}").cast("double")
    paid_by = F.filter("record_keys", lambda x: ~x.startswith("shipping"))[0]
    return found.select("entity_key", paid_by.alias("record"), of("paid").alias("paid"), of("scheduled").alias("planned"))


@query(_PERIODS)
def range_join(spark, d):
    """Work inside the pay periods of the same entity: an equal join with a range beside it."""
    periods, _ = rules.reconciled(worlds.trade(spark, d).plain, _RECONCILE)
    return periods.select(F.col("record_key").alias("record"), "entity_key", F.col("hours").alias("paid"), "planned")


@query(f"WITH {_O}, {_L} SELECT k AS entity_key, shipped AS day, 'shipping|' || line AS record FROM l WHERE k IN (SELECT k FROM o) AND NOT EXISTS (SELECT 1 FROM o WHERE o.k = l.k AND shipped BETWEEN o.ordered AND o.closes)", "day")
def range_anti_join(spark, d):
    """Work that no pay period of its entity covers."""
    _, loose = rules.reconciled(worlds.trade(spark, d).plain, _RECONCILE)
    return loose.select("entity_key", "day", F.col("shift_key").alias("record"))


@query(f"""
    WITH {_O}, {_L} SELECT k AS entity_key, count(DISTINCT shipped) AS days FROM l
    WHERE k IN (SELECT k FROM o) AND NOT EXISTS (SELECT 1 FROM o WHERE o.k = l.k AND shipped BETWEEN o.ordered AND o.closes) GROUP BY 1""")
def uncovered(spark, d):
    found = worlds.trade(spark, d).rule(_RECONCILE).filter("detail = 'uncovered'")
    return found.select("entity_key", F.regexp_count("explanation", F.lit(r"\d{4}-\d\d-\d\d")).cast("long").alias("days"))


# --- golden records, votes, reports


@query("""
    SELECT o_custkey, o_orderpriority AS priority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS k
    FROM orders GROUP BY 1, 2) WHERE k = 1""")
def golden_pick(spark, d):
    """The commonest value of an entity, the first seen among equals."""
    return _survivors(spark, d).select(F.col("entity_key").cast("long").alias("o_custkey"), F.col("value").alias("priority"))


def _survivors(spark, d):
    rows = _t(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderkey")
    rows = rows.select(F.col("o_custkey").cast("string").alias("entity_key"), F.lit("priority").alias("field"), F.lit("orders").alias("source"), F.lit(0).alias("rank"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("at"))
    return golden_ops.survivors(rows)


@query("""
    WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS k FROM v)
    SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first) AS losing FROM k WHERE k > 1 GROUP BY 1""")
def conflicts_list(spark, d):
    rows = _survivors(spark, d).filter(F.size("conflicts") > 0)
    return rows.select(F.col("entity_key").cast("long").alias("o_custkey"), F.array_join(F.transform("conflicts", lambda c: c["value"]), ",").alias("losing"))


@query(f"""
    WITH {_C} SELECT k AS entity_key, unnest(['display_name', 'id', 'balance', 'role', 'facility', 'until']) AS field,
      unnest([name, c_custkey::VARCHAR, balance::VARCHAR, role, facility, until::VARCHAR]) AS value FROM c""".join(["SELECT * FROM (", ") WHERE value IS NOT NULL"]))
def golden_rows(spark, d):
    """Long golden records of the anchor, values as text."""
    return worlds.trade(spark, d).table("golden").filter("source = 'crm'").select("entity_key", "field", "value")


@query(f"WITH {_E} SELECT k AS entity_key, kind, day, last, hours FROM e", "day", "last")
def event_rows(spark, d):
    """Pay periods and scheduled work as events."""
    events = worlds.trade(spark, d).table("events")
    return events.select("entity_key", "kind", F.col("start_date").alias("day"), F.col("end_date").alias("last"), "hours")


_VOTES = """
    v AS (SELECT DISTINCT 'order:' || l_orderkey AS k, 's' || (l_suppkey % 3) AS src, l_returnflag AS val FROM lineitem),
    t AS (SELECT k, val, count(*) AS n FROM v GROUP BY 1, 2),
    w AS (SELECT k, CASE WHEN count(*) FILTER (n = top) = 1 THEN max(CASE WHEN n = top THEN val END) END AS winner, count(*) AS vals
          FROM (SELECT *, max(n) OVER (PARTITION BY k) AS top FROM t) GROUP BY 1)"""
_STATUS = f"""
    WITH {_VOTES}, o AS (SELECT k, src, count(*) AS n, max(val) AS val FROM v GROUP BY 1, 2)
    SELECT w.k AS entity_key, x.src AS source, CASE WHEN o.src IS NULL THEN 'missing' WHEN vals > 1 AND (winner IS NULL OR o.n > 1 OR o.val <> winner) THEN 'differs' ELSE 'agrees' END AS status
    FROM w CROSS JOIN (SELECT unnest(['s0', 's1', 's2']) AS src) x LEFT JOIN o ON o.k = w.k AND o.src = x.src"""


@query(f"WITH {_VOTES} SELECT k AS entity_key, winner FROM w")
def majority_vote(spark, d):
    """The one commonest value, or none where several are equally common."""
    votes = rules.compared(worlds.polls(spark, d).plain, worlds.POLLS["rules"][0])
    return reports.majority(votes).select("entity_key", "winner")


@query(_STATUS)
def agreement_status(spark, d):
    """Does each source say what most sources say about an entity?"""
    world = worlds.polls(spark, d)
    return reports.agreement(world.cfg, world).select("entity_key", "source", "status")


@query(f"SELECT entity_key, bool_and(status = 'agrees') AS all_agree FROM ({_STATUS}) GROUP BY 1")
def agreement_rollup(spark, d):
    world = worlds.polls(spark, d)
    return reports.agreement_rollup(world.cfg, world).select("entity_key", "all_agree")


@query(f"""
    WITH {_E} SELECT facility, role, count(DISTINCT k) AS headcount, round(sum(CASE WHEN kind = 'paid' THEN hours ELSE 0 END), 2) AS paid_hours,
      round(sum(CASE WHEN kind = 'scheduled' THEN hours ELSE 0 END), 2) AS scheduled_hours,
      round(round(sum(CASE WHEN kind = 'paid' THEN hours ELSE 0 END), 2) - round(sum(CASE WHEN kind = 'scheduled' THEN hours ELSE 0 END), 2), 2) AS variance FROM x WHERE NOT late GROUP BY 1, 2""")
def staffing_grid(spark, d):
    """Heads and hours by place and role, hours after an expiry left out."""
    world = worlds.trade(spark, d)
    return reports.staffing(world.cfg, world)


@query(f"WITH {_E} SELECT day AS date, facility, role, sum(hours) AS scheduled_hours FROM x WHERE NOT late AND kind = 'scheduled' AND day BETWEEN DATE '1998-07-01' AND DATE '1998-09-30' GROUP BY 1, 2, 3", "date")
def daily_hours(spark, d):
    world = worlds.trade(spark, d)
    return reports.staffing_daily(world.cfg, world, "1998Q3")


@query(f"WITH {_E} SELECT day::VARCHAR AS day, facility, role, sum(hours) AS hours FROM x WHERE NOT late AND kind = 'scheduled' AND day BETWEEN DATE '1998-07-01' AND DATE '1998-09-30' GROUP BY 1, 2, 3 HAVING sum(hours) <> 0")
def pivot_daily(spark, d):
    """A column per day, turned back into rows."""
    world = worlds.trade(spark, d)
    wide = reports.staffing_pivot(world.cfg, world, "1998Q3")
    days = [c for c in wide.columns if c not in ("facility", "role")]
    return wide.unpivot(["facility", "role"], days, "day", "hours").filter("hours <> 0") if days else wide.select(F.lit("").alias("day"), "facility", "role", F.lit(0.0).alias("hours"))


@query(f"WITH {_E} SELECT name, hours, kind || ' on ' || day || ', expired ' || until AS reason FROM x WHERE late")
def excluded_hours(spark, d):
    world = worlds.trade(spark, d)
    return reports.staffing_excluded(world.cfg, world)


@query(f"""
    WITH {_C}, {_L} SELECT c_custkey::VARCHAR AS number, facility, role, until AS expires, date_diff('day', {AS_OF}, until)::BIGINT AS days_left,
      count(*) FILTER (shipped > until) AS shifts_after_expiry, min(shipped) FILTER (shipped >= {AS_OF}) AS next_shift,
      CASE WHEN until < {AS_OF} THEN 'EXPIRED' WHEN until <= {AS_OF} + 30 THEN '<30 days' WHEN until <= {AS_OF} + 90 THEN '<90 days' ELSE 'ok' END AS status
    FROM c LEFT JOIN l ON l.k = c.k GROUP BY ALL""", "expires", "next_shift")
def credentials_shape(spark, d):
    """Credentials with the days left, what came after their end, and the next shift."""
    world = worlds.trade(spark, d)
    rows = reports.credentials(world.cfg, world).withColumn("days_left", F.col("days_left").cast("long"))
    return rows.select("number", "facility", "role", "expires", "days_left", "shifts_after_expiry", "next_shift", "status")


@query(f"WITH {_E} SELECT facility, role, count(DISTINCT k) AS people FROM x WHERE kind = 'scheduled' AND anchored AND until >= day GROUP BY 1, 2")
def capacity(spark, d):
    world = worlds.trade(spark, d)
    return reports.capacity(world.cfg, world)


@query(f"WITH {_E} SELECT DISTINCT coalesce(name, k) AS name FROM x WHERE kind = 'scheduled' AND NOT coalesce(anchored AND until >= day, false)")
def not_counted(spark, d):
    world = worlds.trade(spark, d)
    return reports.not_counted(world.cfg, world)


@query(f"WITH {_E} SELECT min(day) AS first_day, max(last) AS last_day FROM e WHERE day BETWEEN DATE '1998-07-01' AND DATE '1998-09-30'", "first_day", "last_day")
def coverage(spark, d):
    """A quarter's rows: the bounds reach the scan."""
    seen = reports.coverage(worlds.trade(spark, d), "1998Q3")
    return spark.createDataFrame([(seen["first"], seen["last"])], "first_day date, last_day date")


# --- issues: identity, order, state

_ISSUES = f"""
    WITH {_C}, {_O}, found AS (
      SELECT 'expiry' AS rule_id, k, 'until' AS field, CASE WHEN until < {AS_OF} THEN 'until expired' WHEN until <= {AS_OF} + 30 THEN 'until expires within 30 days' ELSE 'until expires within 90 days' END AS detail,
             CASE WHEN until < {AS_OF} THEN 'critical' WHEN until <= {AS_OF} + 30 THEN 'warning' ELSE 'info' END AS severity FROM c WHERE until <= {AS_OF} + 90
      UNION ALL SELECT DISTINCT 'activity_after_expiry', o.k, 'until', 'after_expiry', 'critical' FROM o JOIN c ON c.k = o.k WHERE closes > until
      UNION ALL SELECT 'missing_from', k, '', 'season', 'warning' FROM c WHERE k NOT IN (SELECT k FROM o WHERE src = 'season')
      UNION ALL SELECT 'numeric_range', k, 'balance', 'crm|' || c_custkey, 'info' FROM c WHERE balance < 100 OR balance > 9000)
    SELECT *, substr(sha1(rule_id || '|' || k || '|' || field || '|' || detail), 1, 16) AS fingerprint,
      row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, rule_id, (SELECT name || ' (' || c_custkey || ')' FROM c WHERE c.k = found.k)) AS place FROM found"""


@query(f"SELECT rule_id, severity, k AS entity_key, fingerprint FROM ({_ISSUES})")
def union_records(spark, d):
    """The findings of all rules as issues, with the fingerprints that keep them the same from run to run."""
    return worlds.trade(spark, d).table("issues").select("rule_id", "severity", "entity_key", "fingerprint")


@query(f"SELECT fingerprint, place FROM ({_ISSUES})")
def issue_order(spark, d):
    """The order of all issues, numbered part by part."""
    return tables.numbered(worlds.trade(spark, d).table("issues").select("fingerprint")).select("fingerprint", (F.col("ord") + 1).alias("place"))


@query(f"SELECT fingerprint, severity FROM ({_ISSUES}) WHERE severity <> 'info' ORDER BY place LIMIT 10")
def top_k(spark, d):
    """The first ten issues of weight."""
    return listings.issues(worlds.trade(spark, d), ["critical", "warning"]).limit(10).select("fingerprint", "severity")


@query(f"SELECT CASE severity WHEN 'critical' THEN 'critical' ELSE severity END AS name, count(*) AS n FROM ({_ISSUES}) GROUP BY 1")
def summary_counters(spark, d):
    counts = pipeline._weighed(worlds.trade(spark, d).table("issues"))
    return spark.createDataFrame(sorted(counts["open"].items()), "name string, n long")


@query(f"SELECT fingerprint, 1 AS step FROM ({_ISSUES}) WHERE rule_id = 'missing_from'")
def dedupe_keep_first(spark, d):
    """Findings with one fingerprint are one issue, the first rule's."""
    world = worlds.trade(spark, d)
    found = world.rule(worlds.TRADE["rules"][2]).withColumn("stage", F.lit(2))
    both = found.withColumn("step", F.lit(5)).unionByName(found.withColumn("step", F.lit(1)))
    return issue_ops.finish(world.cfg, both, world.context.names, None).select("fingerprint", F.col("position.step").alias("step"))


@query(f"SELECT k AS entity_key, name AS person FROM ({_ISSUES.replace('SELECT *, substr', 'SELECT found.*, (SELECT name FROM c WHERE c.k = found.k) AS name, substr')}) WHERE rule_id = 'expiry' AND severity = 'critical' AND name LIKE '%7'")
def issue_filter(spark, d):
    """Issues by severity, state and title, with the people they are about."""
    found = listings.issues(worlds.trade(spark, d), ["critical"], "open", ["until expired"])
    return found.filter(F.col("person").endswith("7")).select("entity_key", "person")


@query("SELECT 'order:' || o_orderkey AS entity_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def except_keys(spark, d):
    """Entities that the anchor does not know."""
    world = worlds.parcels(spark, d)
    return listings.entities(world.cfg, world, False).select("entity_key")


@query("SELECT o_orderkey, substr(sha1('stale|' || o_custkey::VARCHAR || '||' || o_orderkey::VARCHAR), 1, 16) AS fingerprint FROM orders")
def issue_fingerprint(spark, d):
    rows = _t(spark, d, "orders", "o_orderkey", "o_custkey").withColumns({"rule_id": F.lit("stale"), "field": F.lit(None).cast("string")})
    return rows.select("o_orderkey", fingerprint("rule_id", "o_custkey", "field", "o_orderkey").alias("fingerprint"))


@query("""
    SELECT o_custkey::VARCHAR AS key, o_orderpriority AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
    WHERE k = 1 AND o_orderstatus <> 'P'""")
def latest_decision(spark, d):
    """What stands of a log: the newest row of each key, its value read from JSON, unless it takes the key back."""
    seq = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 1_000_000_000 + F.col("o_orderkey")
    log = _t(spark, d, "orders").select(
        seq.alias("seq"), F.lit("close").alias("kind"), F.col("o_custkey").cast("string").alias("key"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')).alias("value"),
        F.lit("").alias("note"), F.lit(None).cast("timestamp").alias("created_at"), (F.col("o_orderstatus") == "P").alias("removed"),
    )
    return latest(log).select("key", "value")


# --- functions

_CLEAN = r"trim(regexp_replace(text, '[\s\x{00a0}]+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN lower({_CLEAN}) IN ('', 'nan', 'none', 'null', 'n/a', 'na', '-', '--') THEN '' ELSE {_CLEAN} END AS t FROM documents")
def clean(spark, d):
    return _t(spark, d, "documents", "doc_id", "text").select("doc_id", text.clean(F.col("text")).alias("t"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents")
def simplify(spark, d):
    return _t(spark, d, "documents", "doc_id", "text").select("doc_id", text.simplify(F.col("text")).alias("t"))


@query("SELECT p_partkey, replace(trim(regexp_replace(lower(strip_accents(p_type)), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS k FROM part")
def header_key(spark, d):
    return _t(spark, d, "part", "p_partkey", "p_type").select("p_partkey", text.header_key(F.col("p_type")).alias("k"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day, false AS bad FROM orders", "day")
def parse_date(spark, d):
    """Dates written in several ways, read back."""
    forms = ("yyyy-MM-dd", "M/d/yyyy", "MM/dd/yy", "d-MMM-yyyy", "MMMM d, yyyy", "yyyyMMdd", "MM.dd.yyyy", "yyyy/M/d")
    rows = _t(spark, d, "orders", "o_orderkey", "o_orderdate")
    written = F.coalesce(*[F.when(F.col("o_orderkey") % len(forms) == k, F.date_format("o_orderdate", f)) for k, f in enumerate(forms)])
    read = rows.select("o_orderkey", dates.parse_date(written).alias("p"))
    return read.select("o_orderkey", F.col("p.value").alias("day"), F.col("p.error").isNotNull().alias("bad"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS n, o_orderkey % 7 = 0 AS bad FROM orders")
def parse_number(spark, d):
    rows = _t(spark, d, "orders", "o_orderkey", "o_totalprice")
    written = F.when(F.col("o_orderkey") % 7 == 0, F.lit("about ten")).otherwise(F.format_number("o_totalprice", 2))
    read = rows.select("o_orderkey", text.parse_number(written).alias("p"))
    return read.select("o_orderkey", F.col("p.value").alias("n"), F.col("p.error").isNotNull().alias("bad"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR || '-12' ELSE '718-' || substr(lpad(c_custkey::VARCHAR, 7, '5'), 1, 3) || '-' || substr(lpad(c_custkey::VARCHAR, 7, '5'), 4, 4) END AS phone,
           c_custkey % 5 = 0 AS bad FROM customer""")
def parse_phone(spark, d):
    rows, key = _t(spark, d, "customer", "c_custkey"), F.col("c_custkey").cast("string")
    whole = F.concat(F.lit("1 (718) "), F.lpad(key, 7, "5"))
    read = rows.select("c_custkey", text.parse_phone(F.when(F.col("c_custkey") % 5 == 0, F.concat(key, F.lit("-12"))).otherwise(whole)).alias("p"))
    return read.select("c_custkey", F.col("p.value").alias("phone"), F.col("p.error").isNotNull().alias("bad"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'X-' || s_suppkey ELSE 'RN-' || lpad(s_suppkey::VARCHAR, 6, '0') END AS id, s_suppkey % 4 = 0 AS bad FROM supplier")
def parse_identifier(spark, d):
    rows, key = _t(spark, d, "supplier", "s_suppkey"), F.col("s_suppkey").cast("string")
    written = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("x"), key)).otherwise(F.concat(F.lit(" rn "), F.lpad(key, 6, "0"), F.lit(".")))
    read = rows.select("s_suppkey", text.parse_identifier(written, r"RN-\d{4,}", True).alias("p"))
    return read.select("s_suppkey", F.col("p.value").alias("id"), F.col("p.error").isNotNull().alias("bad"))


def _priorities() -> Codes:
    return Codes.of({"HI": {"label": "Pressing", "aliases": ["1-URGENT", "High"]}, "LO": {"label": "Can wait", "aliases": ["Not Specified"]}})


@query("""
    SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HI' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'LO' ELSE o_orderpriority END AS code,
           o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') AS bad FROM orders""")
def code_map(spark, d):
    read = _t(spark, d, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", text.parse_code(F.col("o_orderpriority"), _priorities()).alias("p"))
    return read.select("o_orderkey", F.col("p.value").alias("code"), F.col("p.error").isNotNull().alias("bad"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS label FROM orders")
def code_labels(spark, d):
    codes = Codes.of({"F": {"label": "Finished"}, "O": {"label": "Open"}})
    return _t(spark, d, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", text.code_label(F.col("o_orderstatus"), codes).alias("label"))


@query("""
    SELECT c_custkey, split_part(c_name, '#', 1) AS first, ltrim(split_part(c_name, '#', 2), '0') AS last,
           trim(regexp_replace(lower(split_part(c_name, '#', 1)), '[^a-z0-9]+', ' ', 'g') || ' ' || ltrim(split_part(c_name, '#', 2), '0')) AS key FROM customer""")
def name_split_build(spark, d):
    rows = _t(spark, d, "customer", "c_custkey", "c_name")
    written = F.concat(F.ltrim(F.split("c_name", "#")[1], F.lit("0")), F.lit(",  "), F.split("c_name", "#")[0])
    split = rows.select("c_custkey", names.split_name(written).alias("n"))
    return split.select("c_custkey", "n.first", "n.last", names.build_name(F.col("n.first"), F.col("n.last"), {})["key"].alias("key"))


@query()
def name_similarity(spark, d):
    """All pairs of distinct part names that are alike, found by the blocked search of the linker."""
    names_of = _t(spark, d, "part", "p_name").select(F.lower("p_name").alias("name")).distinct()
    pairs = name_pairs(names_of, 0.69)
    return pairs.select("a", "b", F.round(similarity.native_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""
    SELECT event_id, h AS start_hour, (h + 8) % 24 AS end_hour, 8.0::DOUBLE AS hours FROM (SELECT event_id, hour(ts)::DOUBLE AS h FROM events)""")
def shift_parse(spark, d):
    """Shift codes written from the hour of an event, and read back."""
    rows = _t(spark, d, "events", "event_id", "ts").select("event_id", F.hour("ts").alias("h"))
    clock = lambda h: F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.when(h % 24 < 12, "a").otherwise("p"))
    read = rows.select("event_id", shifts.parse_shift(F.concat(clock(F.col("h")), F.lit("-"), clock((F.col("h") + 8) % 24))).alias("s"))
    return read.select("event_id", F.col("s.start").alias("start_hour"), F.col("s.end").alias("end_hour"), shifts.length(F.col("s.start"), F.col("s.end")).alias("hours"))


@query("""
    SELECT DISTINCT 'User ' || user_id AS name, DATE '2026-03-01' + isodow(ts)::INT AS day, 8.0::DOUBLE AS hours FROM events WHERE isodow(ts) <= 3""", "day")
def unpivot_grid(spark, d):
    """Printed grids with a column per day turned into a row per person and day, empty cells left out; one page for each user."""
    cfg = Config.of({"sources": {"bill": {"loader": "pdf_grid", "fields": {"name": {"type": "person_name"}}}}})
    rows = _t(spark, d, "events", "user_id", "ts").groupBy("user_id")
    days = {"Mon 03/02": 2, "Tue 03/03": 3, "Wed 03/04": 4}
    due = rows.agg(*[F.max(F.dayofweek("ts") == k).alias(n) for n, k in days.items()])
    cells = F.array(F.concat(F.lit("User "), F.col("user_id").cast("string")), *[F.when(F.col(f"`{n}`"), "8a-4p").otherwise("off") for n in days])
    sheet = F.struct(F.array(F.lit("name"), *[F.lit(n) for n in days]).alias("header"), F.array(cells).alias("rows"))
    none = F.lit(None).cast("string")
    facts = due.select(
        F.lit("bill.pdf").alias("file"), F.lit(0).alias("file_ord"), F.col("user_id").cast("int").alias("page"), none.alias("place"), F.lit("").alias("title"),
        F.create_map().cast("map<string,double>").alias("legend"), F.lit(2026).alias("year"), F.array(sheet).alias("grids"),
    )
    read = grid.grid_records(cfg, "bill", facts, 2026).select(F.col("norm.name").alias("name"), F.explode("norm._shifts").alias("s"))
    return read.select("name", F.col("s.date").alias("day"), F.col("s.hours").alias("hours"))


@query("""
    SELECT event_id, ts::DATE::TIMESTAMP + INTERVAL 22 HOUR AS start_ts, ts::DATE::TIMESTAMP + INTERVAL 30 HOUR AS end_ts FROM events""")
def shift_times(spark, d):
    """A night shift of the event's day ends on the next."""
    from ..operators.events import shift_times as times

    rows = _t(spark, d, "events", "event_id", "ts")
    start, end = times(_day("ts"), F.lit(22.0), F.lit(6.0))
    return rows.select("event_id", start.alias("start_ts"), end.alias("end_ts"))


def ladder_records(spark: SparkSession, d: str):
    """The configuration and the records of ``link_ladder``: every customer and every order.

    Customers have a first name of their own and the last name of a family of eight; the first hundred are one family.
    An order has its customer's name in full, with a shortened first name, or with the last name cut.
    """
    cfg = Config.of(
        {
            "sources": {
                "crm": {"loader": "table", "anchor": True, "fields": {"id": {"type": "string"}, "name": {"type": "person_name"}, "facility": {}, "role": {}}},
                "web": {"loader": "table", "fields": {"name": {"type": "person_name"}, "facility": {}, "role": {}}},
            },
            "entity": {"anchor_key": "id", "support_fields": ["facility", "role"], "thresholds": {"auto": 0.9, "review": 0.75}},
        }
    )
    k, n = F.col("k"), F.col("o_orderkey")
    letter = lambda digest: lambda i: F.chr(97 + F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % 26)
    word = lambda of, size: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), letter(F.md5(of.cast("string")))), "")
    family = F.concat(F.lit("family "), F.when(k <= 100, 0).otherwise(F.floor(k / 8) + 1).cast("string"))
    customers = _t(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("nation"))
    customers = customers.select("k", "nation", word(k, 5).alias("first"), word(family, 10).alias("last"))
    orders = _t(spark, d, "orders", "o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == k)
    shown = F.element_at(F.array(F.lit(5), F.lit(5), F.lit(4), F.lit(3)), (F.pmod(F.xxhash64(n), F.lit(4)) + 1).cast("int"))
    cut = F.when(F.pmod(F.xxhash64(n), F.lit(4)) == 0, 7).otherwise(10)
    norm = lambda key, name: F.struct(key.alias("id"), name.alias("name"), F.col("nation").alias("facility"), F.lit("R").alias("role"), name.alias("_name_key")).alias("norm")
    record = lambda source, key: [F.concat_ws("|", F.lit(source), key.cast("string")).alias("record_key"), F.lit(source).alias("source"), F.lit(0).alias("file_ord"), key.alias("ord")]
    anchors = customers.select(*record("crm", k), norm(k.cast("string"), F.concat_ws(" ", "first", "last")))
    short = F.concat_ws(" ", F.col("first").substr(F.lit(1), shown), F.col("last").substr(F.lit(1), cut))
    return cfg, anchors.unionByName(orders.select(*record("web", n), norm(F.lit(None).cast("string"), short)))


@query()
def link_ladder(spark, d):
    """The linker over customers (anchor) and orders of them under shortened names: a link per record."""
    from ..operators.link import resolve

    cfg, records = ladder_records(spark, d)
    return resolve(cfg, records, candidates=False).select("record_key", "entity_key", "method", "confidence")
