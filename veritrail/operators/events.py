"""Time intervals: worked shifts of grids, and periods of table records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.shifts import length

EVENT = ["entity_key", "kind", "source", "record_key", "start_date", "end_date", "start_ts", "end_ts", "hours", "facility", "role", "code", "at"]


def _hours(hours: Column) -> Column:
    """A day-time interval of fractional hours."""
    seconds = F.round(hours * 3600)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def shift_times(day: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end of a shift; one that ends at or before its start goes over midnight."""
    midnight = day.cast("timestamp_ntz")
    begun = midnight + _hours(start)
    return begun, begun + _hours(length(start, end))


def events(cfg: Config, records: DataFrame) -> DataFrame:
    """The events of linked records, ``at`` being their order."""
    have = set(cfg.columns)
    column = lambda f: F.col(f"norm.`{f}`") if f in have else F.lit(None)
    base = ["entity_key", "source", "record_key", column("facility").cast("string").alias("facility"), column("role").cast("string").alias("role")]
    order = F.struct("entity_rank", "entity_file", "entity_ord", F.lit(0).alias("source_rank"), "file_ord", "ord")
    parts = []
    for spec in cfg.events:
        own = records.filter(F.col("source") == spec["source"]).withColumn("kind", F.lit(spec["kind"]))
        order = F.struct("entity_rank", "entity_file", "entity_ord", F.lit(cfg.rank(spec["source"])).alias("source_rank"), "file_ord", "ord")
        shifts = own.filter("norm._shifts is not null").select(*base, "kind", order.alias("o"), F.posexplode("norm._shifts").alias("k", "s")).filter("s.status = 'work'")
        begun, ended = shift_times(F.col("s.date"), F.col("s.start"), F.col("s.end"))
        parts.append(
            shifts.select(
                *EVENT[:1], "kind", "source", "record_key", F.col("s.date").alias("start_date"), F.col("s.date").alias("end_date"),
                begun.alias("start_ts"), ended.alias("end_ts"), F.col("s.hours").alias("hours"), "facility", "role", F.col("s.code").alias("code"),
                F.struct("o", "k").alias("at"),
            )
        )
        if spec.get("start") in have:
            start = column(spec["start"]).cast("date")
            end = F.coalesce(column(spec.get("end")).cast("date"), start)
            hours = F.coalesce(column(spec.get("hours")).cast("double"), F.lit(0.0))
            none = F.lit(None).cast("timestamp_ntz")
            periods = own.filter(F.col("norm._shifts").isNull() & start.isNotNull())
            parts.append(
                periods.select(
                    "entity_key", "kind", "source", "record_key", start.alias("start_date"), end.alias("end_date"), none.alias("start_ts"),
                    none.alias("end_ts"), hours.alias("hours"), *base[3:], F.lit(None).cast("string").alias("code"),
                    F.struct(order.alias("o"), F.lit(0).alias("k")).alias("at"),
                )
            )
    if not parts:
        none = records.filter(F.lit(False))
        kinds = {"start_date": "date", "end_date": "date", "start_ts": "timestamp_ntz", "end_ts": "timestamp_ntz", "hours": "double"}
        return none.select(*[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in EVENT[:-1]], F.struct(order.alias("o"), F.lit(0).alias("k")).alias("at"))
    return reduce(lambda a, b: a.unionByName(b), parts)
