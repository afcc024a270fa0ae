"""Command line. ``python -m veritrail.cli --config FILE COMMAND``; each command is a function below."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import listings, pipeline, reports
from .config import Config
from .operators.issues import SEVERITIES
from .store import Store

Lines = Iterator[str]
COMMANDS: dict[str, tuple[Callable, tuple]] = {}


def command(*arguments: tuple):
    """Register a function (options, configuration, store) that yields lines; ``arguments`` are of its own parser."""

    def keep(fn):
        COMMANDS[fn.__name__] = fn, arguments
        return fn

    return keep


def option(*names, **how) -> tuple:
    return names, how


def columns(df: DataFrame) -> Lines:
    """All rows in columns of fixed width: Spark measures the widths, and rows come to the driver part by part."""
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    widest = shown.agg(*[F.max(F.length(c)).alias(c) for c in shown.columns]).head()
    if widest[0] is None:
        yield "  nothing"
        return
    size = [max(len(c), widest[c]) for c in shown.columns]
    line = lambda cells: "  ".join(["", *(x.ljust(n) for x, n in zip(cells, size))]).rstrip()
    yield line(shown.columns)
    for row in shown.toLocalIterator():
        yield line(row)


def told(built: dict, store: Store, first: int = 10) -> Lines:
    """What a build found."""
    for f in built["read"]["files"]:
        yield f"{f['records']:>8} records from {f['file']}" + (f" ({f['source']})" if f["source"] else ", which fits no source")
    linked = built["linked"]
    yield f"{linked['entities']:>8} entities, {linked['anchored']} of them known to the anchor; links: " + ", ".join(f"{n} by {k.replace('_', ' ')}" for k, n in sorted(linked["by"].items()))
    for kind, counts in built["issues"].items():
        if counts:
            yield f"{sum(counts.values()):>8} issues {kind}: " + ", ".join(f"{n} {k}" for k, n in sorted(counts.items()))
    yield f"as of {built['as_of']}"
    for r in listings.issues(store, SEVERITIES[:2]).limit(first).collect():
        yield f"- {r['severity']}: {r['title']}. {r['explanation']}"


_DAY = option("--as-of", type=date.fromisoformat, help="the day that counts as today")


@command(option("paths", nargs="+"), _DAY)
def ingest(a, cfg, store) -> Lines:
    """Read files or folders, and build."""
    yield from told(pipeline.ingest(cfg, store, a.paths, a.as_of), store)


@command(_DAY)
def rebuild(a, cfg, store) -> Lines:
    """Build again on what was read last."""
    yield from told(pipeline.build(cfg, store, a.as_of), store)


@command(option("--severity", choices=SEVERITIES, action="append"), option("--status", default="open"), option("--title", action="append"), option("--person"))
def issues(a, cfg, store) -> Lines:
    """List issues: open ones, unless --status names another state or "any"."""
    for r in listings.issues(store, a.severity or (), None if a.status == "any" else a.status, a.title or (), a.person).toLocalIterator():
        yield f"{r['fingerprint']}  {r['severity']}  {r['title']}" + (f" - {r['person']}" if r["person"] else "")
        yield f"    {r['explanation']}" + (f" ({r['status']}: {r['note'] or 'no note'})" if r["status"] != "open" else "")


@command(option("issue", help="its fingerprint"))
def rows(a, cfg, store) -> Lines:
    """The source rows behind an issue."""
    yield from columns(listings.lineage(store, a.issue).select("source", "file", "row_ref", F.to_json("raw").alias("values")))


@command(option("--unanchored", action="store_true", help="only those that the anchor does not know"))
def entities(a, cfg, store) -> Lines:
    """List entities by name."""
    yield from columns(listings.entities(cfg, store, False if a.unanchored else None))


@command(option("kind", choices=["staffing", "credentials", "agreement", "capacity"]), option("--quarter"), option("--csv", help="a folder for the hours by day"))
def report(a, cfg, store) -> Lines:
    """Print a report."""
    if a.kind != "staffing":
        yield from columns(getattr(reports, a.kind)(cfg, store))
        return
    span, doubts = reports.coverage(store, a.quarter), reports.blocking(store, a.quarter).count()
    asked = " to ".join(map(str, span["asked"])) if span["asked"] else "everything that was read"
    yield f"Hours of {asked}" + (f"; there are events from {span['first']} to {span['last']}" if span["first"] else "; there are no events")
    if doubts:
        yield f"Careful: {doubts} open issues of weight are about people in these figures."
    yield from columns(reports.staffing(cfg, store, a.quarter))
    yield "Void, as a credential had expired:"
    yield from columns(reports.staffing_excluded(cfg, store, a.quarter))
    if a.csv:
        reports.staffing_daily(cfg, store, a.quarter).coalesce(1).write.mode("overwrite").option("header", True).csv(a.csv)


@command(option("issue", help="its fingerprint"), option("action", choices=list(pipeline.VERDICTS)), option("--to", help="the entity that a record belongs to"), option("--note", default=""))
def decide(a, cfg, store) -> Lines:
    """Say what is to be done about an issue."""
    yield from told(pipeline.decide(cfg, store, a.issue, a.action, a.to, a.note), store)


@command()
def decisions(a, cfg, store) -> Lines:
    """List what was decided."""
    yield from columns(listings.decisions(store).select("verdict", "title", "person", "note", "created_at"))


@command(option("--keep-decisions", action="store_true"))
def reset(a, cfg, store) -> Lines:
    """Delete what was read and built, and the decisions unless they are to be kept."""
    store.reset(a.keep_decisions)
    yield "The store is empty" + (", but for its decisions." if a.keep_decisions else ".")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veritrail", description="One trusted dataset from the exports of several systems")
    parser.add_argument("--config", required=True, help="the YAML file of the business")
    parser.add_argument("--store", default="veritrail-store", help="the folder of the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (fn, arguments) in COMMANDS.items():
        own = commands.add_parser(name, help=fn.__doc__)
        for names, how in arguments:
            own.add_argument(*names, **how)
    options = parser.parse_args(argv)
    store = Store(spark or SparkSession.builder.appName("veritrail").getOrCreate(), options.store)
    try:
        for line in COMMANDS[options.command][0](options, Config.load(options.config), store):
            print(line)
    except ValueError as refused:
        print(f"Refused: {refused}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
