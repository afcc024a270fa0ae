"""The star schema told as the engine's own tables, so that rules, reports and listings run on it as they do on files.

A world has a configuration and linked records; golden records, entities, events and issues are made of them by the
engine. Nothing but the rendering of rows as records is done here.

* ``trade``: customers are the anchor; their orders (those of 1998 a source of their own) are pay periods, their lines are
  scheduled work. Every customer has a credential that ends on some day.
* ``parcels``: an entity for each order, known to the anchor by its lines; does the order say what its lines say?
* ``polls``: an entity for each order, on which three sources, made of its suppliers, give their votes.
* ``clock``: an entity for each user, whose events are half-hour shifts.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import issues as issue_ops
from ..operators.components import staged, tabled
from ..operators.events import events as build_events
from ..operators.golden import golden as build_golden
from ..operators.golden import sources_of, with_golden
from ..operators.normalize import DERIVED, ERRORS
from ..operators.rules import RULES, Context, run_rules

AS_OF = date(2001, 8, 1)

_DATE, _NUMBER = {"type": "date"}, {"type": "number"}
_ORDER = {"order_no": {}, "ordered": _DATE, "closes": _DATE, "hours": _NUMBER, "price": _NUMBER}
TRADE = {
    "sources": {
        "shipping": {"loader": "table", "fields": {"line": {}, "ordered": _DATE, "shipped": _DATE, "qty": _NUMBER}},
        "crm": {
            "loader": "table",
            "fields": {
                "id": {"required": True}, "name": {"type": "person_name"}, "balance": _NUMBER | {"required": True}, "role": {},
                "facility": {"required": True}, "until": _DATE,
            },
        },
        "sales": {"loader": "table", "fields": _ORDER},
        "season": {"loader": "table", "fields": _ORDER},
    },
    "entity": {"anchor_source": "crm", "anchor_key": "id"},
    "golden": {"display_name": ["crm"], "id": ["crm"], "balance": ["crm"], "role": ["crm"], "facility": ["crm"], "until": ["crm"]},
    "events": [
        {"source": "sales", "kind": "paid", "start": "ordered", "end": "closes", "hours": "hours"},
        {"source": "season", "kind": "paid", "start": "ordered", "end": "closes", "hours": "hours"},
        {"source": "shipping", "kind": "scheduled", "start": "shipped", "hours": "qty"},
    ],
    "rules": [
        {"type": "expiry", "field": "until", "id_field": "id", "severity": "critical", "windows": [[30, "warning"], [90, "info"]]},
        {"type": "activity_after_expiry", "field": "until", "kinds": ["paid"], "severity": "critical"},
        {"type": "missing_from", "source": "season", "severity": "warning"},
        {"type": "numeric_range", "source": "crm", "field": "balance", "min": 100, "max": 9000, "severity": "info"},
    ],
}
_FLAG = {"fields": {"flag": {}}, "loader": "table"}
PARCELS = {
    "sources": {"lines": _FLAG, "orders": _FLAG},
    "entity": {"anchor_source": "lines"},
    "golden": {"flag": ["lines", "orders"]},
    "rules": [{"type": "field_conflict", "label": "Flag", "fields": {"lines": "flag", "orders": "flag"}}],
}
POLLS = {
    "sources": {f"s{k}": _FLAG for k in range(3)},
    "entity": {"anchor_source": "s0"},
    "rules": [{"type": "field_conflict", "label": "Flag", "fields": {f"s{k}": "flag" for k in range(3)}, "severity": "warning"}],
}
CLOCK = {
    "sources": {"clock": {"loader": "table", "fields": {"name": {"type": "person_name"}, "facility": {}}}},
    "entity": {"anchor_source": "clock"},
    "events": [{"source": "clock", "kind": "scheduled"}],
    "rules": [{"type": "overlap", "kind": "scheduled"}],
}


class World:
    """Linked records under a configuration; what the engine makes of them is made when it is asked for.

    It stands in for a store where reports and listings look for their tables. The order in which entities were made is
    joined to records so that a plan which does not ask for it leaves the join out.
    """

    def __init__(self, spark: SparkSession, raw: dict, parts: list[DataFrame], as_of: date = AS_OF):
        self.spark, self.cfg, self.as_of = spark, Config.of(raw), as_of
        records = parts[0]
        for p in parts[1:]:
            records = records.unionByName(p)
        records = records.filter("entity_key is not null")
        ranked = sorted(self.cfg.sources, key=self.cfg.rank)
        has = lambda s: F.max(F.col("source") == s)
        first = lambda s: F.min(F.when(F.col("source") == s, F.col("ord")))
        of_first = lambda value: F.coalesce(*[F.when(has(s), value(s)) for s in ranked])
        # The source that comes first in rank, and its first record.
        self._born = records.groupBy("entity_key").agg(
            of_first(F.lit).alias("origin"), of_first(lambda s: F.lit(self.cfg.rank(s))).alias("entity_rank"), F.lit(0).alias("entity_file"),
            of_first(first).alias("entity_ord"), sources_of(self.cfg).alias("sources"),
        )
        self.records = records.join(self._born.drop("sources"), "entity_key", "left")
        self._made: dict[str, DataFrame] = {}

    def linked(self) -> DataFrame:
        """Records with their links."""
        return self.records

    def _entities(self, golden: DataFrame) -> DataFrame:
        made = self._born.select("entity_key", "origin", "sources", F.struct("entity_rank", "entity_file", "entity_ord").alias("made"))
        return with_golden(self.cfg, made, golden)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        made = self._made
        if name == "records":
            return self.records.drop("entity_key", "origin", "entity_rank", "entity_file", "entity_ord")
        if name == "links":
            return self.records.select("record_key", "entity_key", "origin", "entity_rank", "entity_file", "entity_ord")
        if name == "golden" and name not in made:
            made[name] = tabled(build_golden(self.cfg, self.records))
        if name == "entities" and name not in made:
            made[name] = tabled(self._entities(self.table("golden")))
        if name == "events" and name not in made:
            made[name] = build_events(self.cfg, self.records)
        if name == "issues" and name not in made:
            found = run_rules(self.context).select(F.lit(2).alias("stage"), "*")
            made[name] = staged(issue_ops.finish(self.cfg, found, self.context.names, None))
        return made[name]

    def last_run(self) -> dict:
        return {"id": 1, "snapshot": 1, "as_of": self.as_of}

    @property
    def plain(self) -> Context:
        """A context for one rule: nothing is made before it is asked for, and no more than is asked for."""
        golden = build_golden(self.cfg, self.records)
        return Context(self.cfg, self.spark, self.records, self._entities(golden), golden, self.table("events"), self.as_of, [], set(self.cfg.sources), lean=True)

    @property
    def context(self) -> Context:
        return Context(self.cfg, self.spark, self.records, self.table("entities"), self.table("golden"), self.table("events"), self.as_of, [], set(self.cfg.sources))

    def rule(self, p: dict) -> DataFrame:
        """The findings of one rule."""
        return RULES[p["type"]](self.plain, p)


def _records(raw: dict, source: str, rows: DataFrame, key: Column, entity: Column, values: dict[str, Column], order: Column, errors: Column | None = None) -> DataFrame:
    """Rows as the records of a source; fields that are not given are null."""
    kinds = Config.of(raw).columns
    given = {**values}
    norm = [F.coalesce(given[c].cast(t), F.lit(None).cast(t)).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    own = {k: given[f"_{k}"] if f"_{k}" in given else F.lit(None) for k in DERIVED}
    norm += [own[k].cast(t).alias(f"_{k}") for k, t in DERIVED.items()]
    return rows.select(
        F.concat_ws("|", F.lit(source), key.cast("string")).alias("record_key"), F.lit(source).alias("source"), F.lit(f"{source}.csv").alias("file"),
        F.concat(F.lit("row "), key.cast("string")).alias("row_ref"), F.lit(0).alias("file_ord"), order.cast("long").alias("ord"),
        F.create_map(F.lit("key"), key.cast("string")).alias("raw"), F.struct(*norm).alias("norm"), (errors if errors is not None else F.array()).cast(ERRORS).alias("errors"), entity.alias("entity_key"),
    )


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trade(spark: SparkSession, d: str, as_of: date = AS_OF) -> World:
    of = lambda key: F.concat(F.lit("crm:"), F.col(key).cast("string"))
    custkey = F.col("c_custkey")
    until = F.date_add(F.lit("1998-01-01").cast("date"), ((custkey * 37) % 1500).cast("int"))
    person = {
        "id": custkey.cast("string"), "balance": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "role": F.col("c_mktsegment"),
        "facility": F.when(F.col("c_nationkey") != 7, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))), "until": until, "_display": F.col("c_name"), "_name_key": F.lower("c_name"),
    }
    day = F.col("o_orderdate").cast("date")
    order = {"order_no": F.col("o_orderkey").cast("string"), "ordered": day, "closes": F.date_add(day, 60), "hours": F.col("o_orderkey") % 24 + 1, "price": F.col("o_totalprice")}
    orders = _table(spark, d, "orders")
    misread = F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.struct(F.lit("price").alias("field"), F.lit("'low' is no number").alias("message")))).otherwise(F.array().cast(ERRORS))
    lines = _table(spark, d, "lineitem").join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    shipped = {"line": line, "ordered": day, "shipped": F.col("l_shipdate").cast("date"), "qty": F.col("l_quantity")}
    late = F.year("o_orderdate") == 1998
    return World(
        spark,
        TRADE,
        [
            _records(TRADE, "crm", _table(spark, d, "customer"), custkey, of("c_custkey"), person, custkey),
            _records(TRADE, "sales", orders.filter(~late), F.col("o_orderkey"), of("o_custkey"), order, F.col("o_orderkey"), misread),
            _records(TRADE, "season", orders.filter(late), F.col("o_orderkey"), of("o_custkey"), order, F.col("o_orderkey"), misread),
            _records(TRADE, "shipping", lines, line, of("o_custkey"), shipped, F.col("l_orderkey") * 100 + F.col("l_linenumber")),
        ],
        as_of,
    )


def parcels(spark: SparkSession, d: str) -> World:
    of = lambda key: F.concat(F.lit("order:"), F.col(key).cast("string"))
    lines, orders = _table(spark, d, "lineitem"), _table(spark, d, "orders")
    return World(
        spark,
        PARCELS,
        [
            _records(PARCELS, "lines", lines, F.concat_ws("-", "l_orderkey", "l_linenumber"), of("l_orderkey"), {"flag": F.col("l_linestatus")}, F.col("l_orderkey") * 100 + F.col("l_linenumber")),
            _records(PARCELS, "orders", orders, F.col("o_orderkey"), of("o_orderkey"), {"flag": F.col("o_orderstatus")}, F.col("o_orderkey")),
        ],
    )


def polls(spark: SparkSession, d: str) -> World:
    lines = _table(spark, d, "lineitem")
    of, order = F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")), F.col("l_orderkey") * 100 + F.col("l_linenumber")
    part = lambda k: _records(POLLS, f"s{k}", lines.filter(F.col("l_suppkey") % 3 == k), F.concat_ws("-", "l_orderkey", "l_linenumber"), of, {"flag": F.col("l_returnflag")}, order)
    return World(spark, POLLS, [part(k) for k in range(3)])


def clock(spark: SparkSession, d: str) -> World:
    rows = _table(spark, d, "events")
    start = F.hour("ts") + F.minute("ts") / 60.0 + F.second("ts") / 3600.0
    shift = F.struct(
        F.col("ts").cast("date").alias("date"), F.col("event_type").alias("code"), F.lit("work").alias("status"), start.cast("double").alias("start"),
        F.pmod(start + 0.5, F.lit(24.0)).alias("end"), F.lit(0.5).alias("hours"),
    )
    user = F.col("user_id").cast("string")
    values = {"facility": F.lit("here"), "_display": F.concat(F.lit("user "), user), "_name_key": F.concat(F.lit("user "), user), "_shifts": F.array(shift)}
    return World(spark, CLOCK, [_records(CLOCK, "clock", rows, F.col("event_id"), F.concat(F.lit("user:"), user), values, F.col("event_id"))])
