"""Declarative quality rules: a registry of rule types, each from a context and parameters to a table of findings.

A rule is a plan, not a loop: it returns rows (see FINDING) and runs with the others as one job. Register more with
``@rule("name")``. A rule that fails to run becomes a finding itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import code_label, short_number, spoken_list
from .components import staged
from .golden import golden_fields

FINDING = (
    "rule_id string, severity string, title string, explanation string, entity_key string, field string, "
    "record_keys array<string>, detail string, file string, vals string, at string"
)
COLUMNS = [x.split()[0] for x in FINDING.split(", ")]
RULES: dict[str, Callable] = {}
#: Parts of an event's ``at`` that are its own.
PLACE = ("o.source_rank", "o.file_ord", "o.ord", "k")


def rule(name: str):
    def keep(fn):
        RULES[name] = fn
        return fn

    return keep


@dataclass
class Context:
    """What rules see. ``records`` are linked; ``names`` has entity_key and shown (name with the anchor's id)."""

    cfg: Config
    spark: SparkSession
    records: DataFrame
    entities: DataFrame
    golden: DataFrame
    events: DataFrame
    as_of: date
    missing_columns: list[tuple[str, str]]
    present: set[str]
    #: Entities are not at hand as a table: names come from golden records, and entities are made where a rule asks for them.
    lean: bool = False

    @property
    def names(self) -> DataFrame:
        return self.entities.select("entity_key", self._shown())

    def _shown(self) -> Column:
        if self.cfg.anchor_key not in golden_fields(self.cfg):
            return F.col("display_name").alias("shown")
        known = F.try_element_at("golden", F.lit(self.cfg.anchor_key))["value"]
        return F.when(known.isNotNull(), F.concat("display_name", F.lit(" ("), known, F.lit(")"))).otherwise(F.col("display_name")).alias("shown")

    def told(self, rows: DataFrame) -> DataFrame:
        """Rows with what findings tell of their entity: shown and made. What of these nobody asks for is not joined."""
        if not self.lean:
            return rows.join(self.entities.select("entity_key", self._shown(), "made"), "entity_key", "left")
        value = lambda f: F.first(F.when(F.col("field") == f, F.col("value")), ignorenulls=True)
        known = self.golden.filter(F.col("field").isin("display_name", self.cfg.anchor_key or "")).groupBy("entity_key").agg(value("display_name").alias("_name"), value(self.cfg.anchor_key or "").alias("_id"))
        name = F.coalesce("_name", "entity_key")
        shown = F.when(F.col("_id").isNotNull(), F.concat(name, F.lit(" ("), "_id", F.lit(")"))).otherwise(name)
        rows = rows.join(known, "entity_key", "left").withColumn("shown", shown).drop("_name", "_id")
        return rows.join(self.entities.select("entity_key", "made"), "entity_key", "left")

    def of(self, source: str) -> DataFrame:
        return self.records.filter(F.col("source") == source)

    def value(self, field: str, kind: str | None = None) -> Column:
        out = F.col(f"norm.`{field}`") if field in self.cfg.columns else F.lit(None)
        return out.cast(kind) if kind else out

    def fact(self, field: str) -> DataFrame:
        """entity_key with a golden field's value and source."""
        return self.golden.filter(F.col("field") == field).select("entity_key", "value", F.col("source").alias("by"))

    def where(self) -> Column:
        labels = F.create_map(*[F.lit(x) for s in self.cfg.sources for x in (s, self.cfg.label(s))])
        return F.concat(labels[F.col("source")], F.lit(", "), F.col("file"), F.lit(" "), F.col("row_ref"))

    def shown(self, source: str, field: str, value: Column) -> Column:
        kind, _, name = self.cfg.field_type(source, field).partition(":")
        return code_label(value, self.cfg.codes[name]) if kind == "code" and name in self.cfg.codes else value


def said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def spaced(name: str) -> str:
    return name.replace("_", " ")


def _position() -> Column:
    """Where a record stands in its file, as text that sorts."""
    return F.concat_ws(".", F.lpad(F.col("file_ord").cast("string"), 6, "0"), F.lpad(F.col("ord").cast("string"), 16, "0"))


def _made() -> Column:
    """When an entity was made, as text that sorts."""
    parts = (("entity_rank", 3), ("entity_file", 6), ("entity_ord", 16))
    return F.concat_ws(".", *[F.lpad(F.col(f"made.{c}").cast("string"), n, "0") for c, n in parts])



def findings(df: DataFrame, p: dict, severity, title, text, entity=None, field=None, keys=None, detail=None, vals=None, at=None, file=None) -> DataFrame:
    """``df`` as findings; plain values become literals."""
    literal = lambda x: x if isinstance(x, Column) else F.lit(x)
    keys = F.array().cast("array<string>") if keys is None else keys
    own = p.get("severity", severity) if not isinstance(severity, Column) else severity
    values = (
        literal(p.get("id") or p["type"]), literal(own), literal(title), literal(text), literal(entity).cast("string"), literal(field).cast("string"),
        keys, literal(detail).cast("string"), literal(file).cast("string"), literal("{}" if vals is None else vals), literal("" if at is None else at).cast("string"),
    )
    return df.select(*[v.alias(c) for v, c in zip(values, COLUMNS)])


def members(ctx: Context, source: str | None = None, field: str | None = None) -> DataFrame:
    """entity_key and the keys of its records, of one source or with a value in a field if asked, in their order."""
    rows = ctx.records
    if source:
        rows = rows.filter(F.col("source") == source)
    if field:
        rows = rows.filter(ctx.value(field).isNotNull())
    ranks = F.create_map(*[F.lit(x) for s in ctx.cfg.sources for x in (s, ctx.cfg.rank(s))])
    one = F.struct(ranks[F.col("source")].alias("r"), "file_ord", "ord", "record_key")
    return rows.groupBy("entity_key").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["record_key"]).alias("keys"))


# --- one record


@rule("required")
def required(ctx: Context, p: dict) -> DataFrame:
    """A required field without a value, unless it could not be read or its file has no such column."""
    parts = []
    gone = [f"{file}\n{field}" for file, field in ctx.missing_columns]
    for source, spec in ctx.cfg.sources.items():
        needed = [n for n, f in spec.fields.items() if f.required]
        if not needed:
            continue
        misread = F.transform("errors", lambda e: e["field"])
        empty = F.array_compact(
            F.array(*[F.when(F.coalesce(ctx.value(n, "string"), F.lit("")) == "", F.lit(n)) for n in needed])
        )
        lacking = F.filter(empty, lambda n: ~F.array_contains(misread, n) & ~F.concat_ws("\n", "file", n).isin(*(gone or [""])))
        rows = ctx.of(source).withColumn("lacking", lacking).filter(F.size("lacking") > 0).select("*", F.posexplode("lacking").alias("k", "lacks"))
        name = F.replace("lacks", F.lit("_"), F.lit(" "))
        parts.append(
            findings(rows, p, "warning", said("No value for ", name), said(ctx.where(), " leaves ", name, " empty."), F.col("entity_key"), F.col("lacks"), F.array("record_key"), F.col("record_key"), at=F.concat_ws(".", _position(), F.col("k").cast("string")))
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


@rule("invalid_value")
def invalid_value(ctx: Context, p: dict) -> DataFrame:
    """Every value that could not be read; and once per file, that dates were rewritten."""
    rows = ctx.records.filter(F.size("errors") > 0).select("*", F.posexplode("errors").alias("k", "e"))
    title = F.when(F.col("e.field") == "shift", "Schedule entry not known").otherwise(said("Cannot read ", F.replace("e.field", F.lit("_"), F.lit(" "))))
    wrong = findings(
        rows, p, "warning", title, said(ctx.where(), ": ", F.col("e.message"), "."), F.col("entity_key"), F.col("e.field"), F.array("record_key"),
        F.concat_ws("|", "record_key", "e.message"), at=F.concat_ws(".", F.lit("0"), _position(), F.col("k").cast("string")),
    )
    dates = ctx.records.filter(F.size("norm._reformatted") > 0)
    files = dates.groupBy("file").agg(
        F.sum(F.size("norm._reformatted")).alias("n"), F.count(F.lit(1)).alias("rows"), F.first("entity_key").alias("one"), F.min("file_ord").alias("file_ord"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("norm._reformatted")))).alias("fields"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "record_key"))), lambda x: x["record_key"]).alias("keys"),
    )
    told = said(
        F.col("file"), ": ", F.col("n").cast("string"), " date(s) in ", F.array_join(F.transform("fields", lambda f: F.replace(f, F.lit("_"), F.lit(" "))), ", "),
        f" were read from other forms than YYYY-MM-DD, days and months in {ctx.cfg.date_order.upper()} order.",
    )
    rewritten = findings(
        files, p, F.lit("info"), "Dates in another form", told, F.when(F.col("rows") == 1, F.col("one")), None, F.col("keys"), F.col("file"),
        at=F.concat_ws(".", F.lit("1"), F.lpad(F.col("file_ord").cast("string"), 6, "0")),
    )
    return wrong.unionByName(rewritten)


@rule("duplicate_key")
def duplicate_key(ctx: Context, p: dict) -> DataFrame:
    """A key that several records of a source have; equal rows and differing ones are told apart."""
    value = ctx.value(p["field"], "string")
    rows = ctx.of(p["source"]).filter(F.coalesce(value, F.lit("")) != "").withColumn("v", value)
    plain = F.struct(*[F.col(f"norm.`{c}`") for c in ctx.cfg.columns])
    one = F.struct("file_ord", "ord", "record_key", "row_ref", "entity_key")
    groups = rows.groupBy("v").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.xxhash64(plain)).alias("least"), F.max(F.xxhash64(plain)).alias("most"), F.array_sort(F.collect_list(one)).alias("rows"),
    ).filter("n > 1")
    alike = F.when(F.col("least") == F.col("most"), "The rows are equal: most likely an export ran twice.").otherwise("The rows differ: somebody has to choose.")
    text = said(F.col("v"), " is in ", F.col("n").cast("string"), f" rows of {ctx.cfg.label(p['source'])} (", F.array_join(F.transform("rows", lambda r: r["row_ref"]), ", "), "). ", alike)
    first = F.concat_ws(".", F.lpad(F.col("rows")[0]["file_ord"].cast("string"), 6, "0"), F.lpad(F.col("rows")[0]["ord"].cast("string"), 16, "0"))
    return findings(groups, p, "warning", f"Repeated {spaced(p['field'])}", text, F.col("rows")[0]["entity_key"], p["field"], F.transform("rows", lambda r: r["record_key"]), F.col("v"), at=first)


def _per_record(ctx: Context, p: dict, rows: DataFrame, title: str, text: Column, field: str) -> DataFrame:
    return findings(rows, p, "warning", title, text, F.col("entity_key"), field, F.array("record_key"), F.col("record_key"), at=_position())


@rule("future_date")
def future_date(ctx: Context, p: dict) -> DataFrame:
    day, today = ctx.value(p["field"]).try_cast("date"), F.lit(ctx.as_of)
    rows = ctx.of(p["source"]).filter(day > today)
    name = spaced(p["field"])
    return _per_record(ctx, p, rows, f"{name.capitalize()} lies ahead", said(ctx.where(), f": {name} ", day.cast("string"), f" is later than {ctx.as_of}."), p["field"])


@rule("numeric_range")
def numeric_range(ctx: Context, p: dict) -> DataFrame:
    """Outside the bounds, which count as inside; no number at all is outside too."""
    v = ctx.value(p["field"]).try_cast("double")
    low, high = F.lit(float(p.get("min", "-inf"))), F.lit(float(p.get("max", "inf")))
    rows = ctx.of(p["source"]).filter(v.isNotNull() & (F.isnan(v) | (v < low) | (v > high)))
    text = said(ctx.where(), f": {spaced(p['field'])} is ", short_number(v), f", not between {p.get('min')} and {p.get('max')}.")
    return _per_record(ctx, p, rows, f"Unlikely {spaced(p['field'])}", text, p["field"])


@rule("date_order")
def date_order(ctx: Context, p: dict) -> DataFrame:
    start, end = (ctx.value(p[k]).try_cast("date") for k in ("start", "end"))
    rows = ctx.of(p["source"]).filter(end < start)
    text = said(ctx.where(), f": {spaced(p['end'])} ", end.cast("string"), f" comes before {spaced(p['start'])} ", start.cast("string"), ".")
    return _per_record(ctx, p, rows, "Ends before it starts", text, p["end"])


@rule("stale")
def stale(ctx: Context, p: dict) -> DataFrame:
    day, most = ctx.value(p["field"]).try_cast("date"), int(p.get("max_age_days", 90))
    age = F.datediff(F.lit(ctx.as_of), day)
    rows = ctx.told(ctx.of(p["source"]).filter(age > most))
    text = said(F.coalesce("shown", F.lit("Unknown")), ": last checked ", day.cast("string"), ", ", age.cast("string"), f" days ago (at most {most} are allowed).")
    return _per_record(ctx, p, rows, "Not checked for too long", text, p["field"])


# --- across sources


@rule("not_in_anchor")
def not_in_anchor(ctx: Context, p: dict) -> DataFrame:
    """Entities that came from this source and have no record in the anchor."""
    alone = ctx.entities.filter(~F.array_contains("sources", ctx.cfg.anchor) & (F.col("origin") == p["source"]))
    # Only their own records are put in order.
    ours = ctx.of(p["source"]).select("entity_key", F.struct("file_ord", "ord", "record_key").alias("one"))
    rows = ours.join(alone.select("entity_key", "display_name", "made"), "entity_key").groupBy("entity_key").agg(
        F.first("display_name").alias("display_name"), F.first("made").alias("made"), F.transform(F.array_sort(F.collect_list("one")), lambda x: x["record_key"]).alias("keys"),
    )
    here, there = ctx.cfg.label(p["source"]), ctx.cfg.label(ctx.cfg.anchor)
    text = said(F.col("display_name"), f" has ", F.size("keys").cast("string"), f" record(s) in {here} and none in {there}. {p.get('why', '')}")
    return findings(rows, p, "warning", f"{here} has somebody that {there} does not", text, F.col("entity_key"), None, F.col("keys"), p["source"], at=_made())


@rule("missing_from")
def missing_from(ctx: Context, p: dict) -> DataFrame:
    """Entities of the anchor without a record in a source that was read at all."""
    rows = ctx.entities.filter((F.col("origin") == ctx.cfg.anchor) & ~F.array_contains("sources", p["source"]))
    if p["source"] not in ctx.present:
        rows = rows.filter(F.lit(False))
    if p.get("when_field"):
        having = ctx.records.filter(F.coalesce(ctx.value(p["when_field"], "string"), F.lit("")) != "").select("entity_key").distinct()
        rows = rows.join(having, "entity_key", "left_semi")
    rows = rows.join(members(ctx, ctx.cfg.anchor), "entity_key", "left").join(ctx.names, "entity_key")
    return findings(
        rows, p, "warning", f"Missing from {ctx.cfg.label(p['source'])}", said(F.col("shown"), f": {p.get('why', '')}"), F.col("entity_key"), p.get("when_field"),
        F.coalesce("keys", F.array().cast("array<string>")), p["source"], at=_made(),
    )


@rule("missing_value")
def missing_value(ctx: Context, p: dict) -> DataFrame:
    """Entities of the anchor in certain roles whose golden record lacks a field."""
    fact = lambda f: F.try_element_at("golden", F.lit(f))["value"]
    roles = [str(r) for r in p.get("roles", [])] or [""]
    rows = ctx.entities.filter((F.col("origin") == ctx.cfg.anchor) & fact(p.get("role_field", "role")).isin(*roles) & (F.coalesce(fact(p["field"]), F.lit("")) == ""))
    rows = rows.join(members(ctx), "entity_key").join(ctx.names, "entity_key")
    return findings(rows, p, "warning", f"{spaced(p['field']).capitalize()} is not on file", said(F.col("shown"), f": {p.get('why', '')}"), F.col("entity_key"), p["field"], F.col("keys"), p["field"], at=_made())


def compared(ctx: Context, p: dict) -> DataFrame:
    """(entity_key, source, canonical, shown, record position and key) of every value that a conflict rule looks at."""
    same = ctx.cfg.equivalents.get(p.get("equivalents") or "", {})
    canon = F.create_map(*[F.lit(x) for kv in same.items() for x in kv]) if same else None
    parts = []
    for source, field in p["fields"].items():
        if source not in ctx.cfg.sources:
            continue
        v = F.col("norm._name_key") if field == "_name_key" else ctx.value(field, "string")
        shown = F.col("norm._display") if field == "_name_key" else ctx.shown(source, field, v)
        one = F.coalesce(F.try_element_at(canon, v), v) if canon is not None else v
        rows = ctx.of(source).filter(F.coalesce(v, F.lit("")) != "")
        parts.append(rows.select("entity_key", "source", one.alias("canonical"), shown.alias("shown"), F.struct(F.lit(ctx.cfg.rank(source)).alias("r"), "file_ord", "ord", "record_key").alias("at")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@rule("field_conflict")
def field_conflict(ctx: Context, p: dict) -> DataFrame:
    """Sources that say different things, equivalent codes counting as one; sources are listed by what they say."""
    rows = compared(ctx, p)
    labels = F.create_map(*[F.lit(x) for s in ctx.cfg.sources for x in (s, ctx.cfg.label(s))])
    odd = rows.groupBy("entity_key").agg(F.size(F.collect_set("canonical")).alias("n"), F.array_sort(F.collect_list("at")).alias("all"), F.array_sort(F.collect_set("shown")).alias("values")).filter("n > 1")
    voices = rows.groupBy("entity_key", "shown").agg(F.array_sort(F.collect_set("source")).alias("by"), F.min("at").alias("first"))
    who = spoken_list(F.transform("by", lambda s: labels[s]))
    voice = F.concat(who, F.when(F.size("by") == 1, " has ").otherwise(" have "), F.col("shown"))
    spoken = voices.groupBy("entity_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.size("by")).alias("n"), "first", voice.alias("t")))), lambda x: x["t"]), "; ").alias("said"))
    out = ctx.told(odd.join(spoken, "entity_key", "left")).withColumnRenamed("shown", "who")
    return findings(
        out, p, "warning", f"{p['label']}: systems disagree", said(F.col("who"), ": ", F.col("said"), "."), F.col("entity_key"), p["label"],
        F.transform("all", lambda x: x["record_key"]), p["label"], F.to_json(F.struct("values")), _made(),
    )


# --- over time


@rule("expiry")
def expiry(ctx: Context, p: dict) -> DataFrame:
    """A golden date that has passed, or that falls within the tightest window that holds it."""
    cfg, day = ctx.cfg, F.col("value").try_cast("date")
    left = F.datediff(day, F.lit(ctx.as_of))
    credential = cfg.credential_label or spaced(p["field"])
    severity, title = F.when(left < 0, p.get("severity", "critical")), F.when(left < 0, f"{credential} expired")
    for days, level in sorted(p.get("windows", [])):
        severity, title = severity.when(left <= days, level), title.when(left <= days, f"{credential} expires within {days} days")
    rows = ctx.fact(p["field"]).withColumn("title", title).filter(F.col("title").isNotNull())
    number = ctx.fact(p.get("id_field", "")).select("entity_key", F.col("value").alias("number"))
    rows = ctx.told(rows.join(number, "entity_key", "left").join(members(ctx, field=p["field"]), "entity_key", "left"))
    labels = F.create_map(*[F.lit(x) for s in cfg.sources for x in (s, cfg.label(s))])
    when = F.when(left < 0, said("expired on ", day.cast("string"), ", ", (-left).cast("string"), " days ago")).otherwise(said("ends on ", day.cast("string"), ", in ", left.cast("string"), " days"))
    text = F.concat_ws(" ", said(F.col("shown"), ":"), F.lit(credential), "number", said(when, " (", labels[F.col("by")], ")."))
    vals = F.to_json(F.struct(left.alias("days"), day.cast("string").alias("date")))
    return findings(rows, p, severity, F.col("title"), text, F.col("entity_key"), p["field"], F.coalesce("keys", F.array().cast("array<string>")), F.col("title"), vals, _made())


@rule("activity_after_expiry")
def activity_after_expiry(ctx: Context, p: dict) -> DataFrame:
    """Hours of events that end after a golden date, by kind."""
    fact = ctx.fact(p["field"]).select("entity_key", F.col("value").try_cast("date").alias("until"), "by")
    late = ctx.events.filter(F.col("kind").isin(*p.get("kinds", [])) & (F.col("hours") > 0)).join(fact, "entity_key").filter(F.col("end_date") > F.col("until"))
    span = F.when(F.col("start_date") == F.col("end_date"), F.col("start_date").cast("string")).otherwise(said(F.col("start_date").cast("string"), " to ", F.col("end_date").cast("string")))
    kinds = late.groupBy("entity_key", "kind").agg(F.sum("hours").alias("hours"), F.array_sort(F.collect_set(span)).alias("when"), F.collect_set("record_key").alias("keys"), F.first("until").alias("until"), F.first("by").alias("by"))
    part = said(F.col("kind"), " ", short_number(F.col("hours")), " hours (", F.array_join("when", ", "), ")")
    rows = kinds.groupBy("entity_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", part.alias("t")))), lambda x: x["t"]), " and ").alias("done"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("of_events"), F.first("until").alias("until"), F.first("by").alias("by"),
    )
    proof = ctx.records.filter(ctx.value(p["field"]).isNotNull()).groupBy("entity_key", F.col("source").alias("by")).agg(F.min_by("record_key", F.struct("file_ord", "ord")).alias("proof"))
    rows = ctx.told(rows.join(proof, ["entity_key", "by"], "left"))
    keys = F.array_distinct(F.concat(F.when(F.col("proof").isNotNull(), F.array("proof")).otherwise(F.array().cast("array<string>")), "of_events"))
    text = said(F.col("shown"), ": ", (ctx.cfg.credential_label or spaced(p["field"])).lower(), " expired on ", F.col("until").cast("string"), ", yet ", F.col("done"), " came after it. These hours do not count.")
    return findings(rows, p, "critical", "Activity after expiry", text, F.col("entity_key"), p["field"], keys, "after_expiry", at=_made())


def reconciled(ctx: Context, p: dict) -> tuple[DataFrame, DataFrame]:
    """(pay periods with the scheduled hours inside them, shifts that no period covers), of entities that have both kinds."""
    cut = lambda kind: ctx.events.filter(F.col("kind") == kind)
    planned = cut(p["scheduled"]).select("entity_key", F.col("start_date").alias("day"), F.col("hours").alias("planned"), F.col("record_key").alias("shift_key"), F.col("source").alias("shift_source"), F.col("at").alias("shift_at"))
    paid = cut(p["paid"]).select("entity_key", "start_date", "end_date", "hours", "record_key", "at", *[F.col(f"at.{c}").alias(f"_{k}") for k, c in enumerate(PLACE)])
    inside = F.col("s.day").between(F.col("p.start_date"), F.col("p.end_date"))
    # One shift of each entity meets all its periods, so that those without any shift inside stay, and no others do.
    marked = planned.withColumn("mark", F.row_number().over(Window.partitionBy("entity_key").orderBy("day")) == 1)
    met = (F.col("p.entity_key") == F.col("s.entity_key")) & (F.coalesce(inside, F.lit(False)) | F.col("s.mark"))
    # A record's place tells its events apart; the rest of ``at`` follows from the entity.
    joined = paid.alias("p").join(marked.alias("s"), met).groupBy("p.entity_key", "p.start_date", "p.end_date", "p.hours", "p.record_key", *[f"p._{k}" for k in range(len(PLACE))])
    periods = joined.agg(
        F.first("p.at").alias("at"), F.coalesce(F.sum(F.when(inside, F.col("s.planned"))), F.lit(0.0)).alias("planned"), F.collect_set(F.when(inside, F.col("s.shift_key"))).alias("shift_keys"),
    ).drop(*[f"_{k}" for k in range(len(PLACE))])
    with_pay = planned.join(paid.select("entity_key").distinct(), "entity_key", "left_semi")
    covered = (F.col("p.entity_key") == F.col("s.entity_key")) & inside
    loose = with_pay.alias("s").join(paid.select("entity_key", "start_date", "end_date").alias("p"), covered, "left_anti")
    return periods, loose


@rule("hours_reconcile")
def hours_reconcile(ctx: Context, p: dict) -> DataFrame:
    """Paid hours against the shifts inside the period; and shifts outside all periods."""
    periods, loose = reconciled(ctx, p)
    off = ctx.told(periods.filter(F.abs(F.col("planned") - F.col("hours")) > p.get("tolerance", 0.5)))
    text = said(
        F.col("shown"), ", ", F.col("start_date").cast("string"), " to ", F.col("end_date").cast("string"), ": ", short_number(F.col("planned")), " hours scheduled, ",
        short_number(F.col("hours")), " paid (", short_number(F.col("hours") - F.col("planned"), sign=True), ").",
    )
    keys = F.array_sort(F.array_distinct(F.concat(F.array("record_key"), "shift_keys")))
    vals = F.to_json(F.struct(F.col("planned").alias("scheduled"), F.col("hours").alias("paid")))
    wrong = findings(off, p, "warning", "Hours paid are not hours scheduled", text, F.col("entity_key"), "hours", keys, F.col("start_date").cast("string"), vals, F.concat_ws(".", _made(), F.lit("0"), F.to_json("at")))
    bare = loose.groupBy("entity_key").agg(F.array_sort(F.collect_set(F.col("day").cast("string"))).alias("days"), F.min_by("shift_source", "shift_at").alias("source"))
    ranks = F.struct("file_ord", "ord", "record_key")
    own = ctx.records.groupBy("entity_key", "source").agg(F.transform(F.array_sort(F.collect_list(ranks)), lambda x: x["record_key"]).alias("keys"))
    bare = ctx.told(bare.join(own, ["entity_key", "source"], "left"))
    told = said(F.col("shown"), ": no pay period covers the shifts on ", F.array_join("days", ", "), ".")
    return wrong.unionByName(findings(bare, p, "warning", "Shifts outside all pay periods", told, F.col("entity_key"), "hours", F.col("keys"), "uncovered", at=F.concat_ws(".", _made(), F.lit("1"))))


@rule("overtime")
def overtime(ctx: Context, p: dict) -> DataFrame:
    """More hours than a weekly limit, stretched over periods longer than a week."""
    weeks = F.greatest(F.lit(1.0), (F.datediff("end_date", "start_date") + 1) / 7.0)
    most = F.lit(float(p.get("max_hours", 40))) * F.coalesce(weeks, F.lit(1.0))
    rows = ctx.told(ctx.events.filter((F.col("kind") == p["kind"]) & (F.col("hours") > most)))
    text = said(F.col("shown"), ": ", short_number(F.col("hours")), " hours from ", F.col("start_date").cast("string"), " to ", F.col("end_date").cast("string"), ", above ", short_number(most), ".")
    return findings(rows, p, "info", "Overtime", text, F.col("entity_key"), "hours", None, F.col("record_key"), at=F.concat_ws(".", _made(), F.to_json("at")))


@rule("overlap")
def overlap(ctx: Context, p: dict) -> DataFrame:
    """An event that starts before the one before it has ended; only neighbours in time are compared."""
    turn = Window.partitionBy("entity_key").orderBy("start_ts", "at")
    rows = ctx.events.filter((F.col("kind") == p["kind"]) & F.col("start_ts").isNotNull())
    after = lambda c: F.lead(c).over(turn).alias(f"next_{c}")
    rows = rows.select("*", *[after(c) for c in ("start_ts", "code", "facility", "source")]).filter(F.col("next_start_ts") < F.col("end_ts"))
    rows = ctx.told(rows)
    codes = ctx.cfg.codes.get(ctx.cfg.page_field)
    place = lambda c: F.coalesce(code_label(F.col(c), codes) if codes else F.col(c), F.lit("?"))
    text = said(F.col("shown"), ": on ", F.col("start_date").cast("string"), ", ", F.coalesce("code", F.lit("?")), " at ", place("facility"), " runs into ", F.coalesce("next_code", F.lit("?")), " at ", place("next_facility"), ".")
    moment = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return findings(rows, p, "warning", "Booked twice", text, F.col("entity_key"), "shift", None, F.concat_ws("|", moment("start_ts"), moment("next_start_ts")), at=F.concat_ws(".", _made(), moment("start_ts")))


def run_rules(ctx: Context) -> DataFrame:
    """The findings of all configured rules, with ``step``, the rule's place in the configuration.

    Each rule is computed by itself, so that a broken one costs its own findings only.
    """
    parts, failed = [], []
    for step, p in enumerate(ctx.cfg.rules):
        kind = p.get("type")
        if kind not in RULES:
            failed.append((step, "config", "warning", "No such rule type", f"The configuration asks for '{kind}', which is not known.", str(p)))
            continue
        try:
            parts.append(staged(RULES[kind](ctx, p).select(F.lit(step).alias("step"), *COLUMNS)))
        except Exception as e:  # noqa: BLE001 - one broken rule must not stop the others
            why = (str(e).strip().splitlines() or [type(e).__name__])[0][:200]
            failed.append((step, kind, "warning", "A rule did not run", f"{kind}: {why}", str(p)))
    none = F.lit(None).cast("string")
    extra = ctx.spark.createDataFrame(failed, "step int, rule_id string, severity string, title string, explanation string, detail string")
    extra = extra.select("step", "rule_id", "severity", "title", "explanation", none.alias("entity_key"), none.alias("field"), F.array().cast("array<string>").alias("record_keys"), "detail", none.alias("file"), F.lit("{}").alias("vals"), F.lit("").alias("at"))
    return reduce(lambda a, b: a.unionByName(b), parts, extra)
