"""Golden records: one value per entity and field, by the authority of sources, with all disagreement kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def linked(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records with their links."""
    return records.join(links, "record_key")


def survivors(values: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(entity_key, field, value, source, conflicts) of rows (entity_key, field, source, rank, value, at).

    ``rank`` is a source's authority for the field (null: none). Of the best source present the commonest value wins,
    the first seen among equals; every other value of any source is a conflict, in the order first seen.
    """
    seen = values.groupBy("entity_key", "field", "source", "rank", "value").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    entry = F.struct("at", "source", "value")
    best = F.max_by(F.struct("value", "source"), F.when(F.col("rank").isNotNull(), F.struct(-F.col("rank"), F.col("n"), -F.col("at"))))
    whole = seen.groupBy("entity_key", "field").agg(best.alias("best"), F.array_sort(F.collect_list(entry)).alias("all"))
    others = F.filter("all", lambda x: F.col("best").isNull() | (x["value"] != F.col("best.value")))
    return whole.select(
        "entity_key", "field", F.col("best.value").alias("value"), F.col("best.source").alias("source"),
        F.transform(others, lambda x: F.struct(x["source"].alias("source"), x["value"].alias("value"))).alias("conflicts"),
    )


def golden_fields(cfg: Config) -> dict[str, tuple[str, ...]]:
    """The fields of golden records with their sources in the order of authority."""
    have = {*cfg.columns, "display_name"}
    return {f: order for f, order in cfg.golden.items() if f in have} or {"display_name": tuple(cfg.sources)}


def golden(cfg: Config, records: DataFrame) -> DataFrame:
    """Long golden records of linked records."""
    fields = golden_fields(cfg)
    value = lambda f: F.col("norm._display" if f == "display_name" else f"norm.`{f}`").cast("string")
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), value(f).alias("value"),
                F.try_element_at(F.create_map(*[F.lit(x) for k, s in enumerate(order) for x in (s, k)]), F.col("source")).alias("rank"),
            )
            for f, order in fields.items()
        ]
    )
    ranks = F.create_map(*[F.lit(x) for s in cfg.sources for x in (s, cfg.rank(s))])
    at = (ranks[F.col("source")].cast("long") * 100_000 + F.col("file_ord")) * 10**12 + F.col("ord")
    # Records that have nothing to say are left out before they are told field by field; so are whole sources.
    some = reduce(lambda a, b: a | b, [value(f).isNotNull() & (value(f) != "") for f in fields])
    rows = records.filter(some).select("entity_key", "source", at.alias("at"), F.explode(entries).alias("e")).select("entity_key", "source", "at", "e.*")
    return survivors(rows.filter("value is not null and value <> ''"))


def wide(golden_rows: DataFrame) -> DataFrame:
    """(entity_key, golden): a map from field to value, source and conflicts."""
    entry = F.struct("field", F.struct("value", "source", "conflicts").alias("v"))
    return golden_rows.groupBy("entity_key").agg(F.map_from_entries(F.collect_list(entry)).alias("golden"))


def sources_of(cfg: Config) -> Column:
    """An aggregate: the sources of records, sorted."""
    return F.array_compact(F.array(*[F.when(F.max(F.col("source") == s), F.lit(s)) for s in sorted(cfg.sources)]))


def entities(cfg: Config, records: DataFrame, golden_rows: DataFrame) -> DataFrame:
    """entity_key, origin, display_name, sources, golden and the order in which entities were made."""
    made = records.groupBy("entity_key").agg(
        F.first("origin").alias("origin"),
        sources_of(cfg).alias("sources"),
        F.struct(*[F.first(c).alias(c) for c in ("entity_rank", "entity_file", "entity_ord")]).alias("made"),
    )
    return with_golden(cfg, made, golden_rows)


def with_golden(cfg: Config, made: DataFrame, golden_rows: DataFrame) -> DataFrame:
    """Entities as they were made (entity_key, origin, sources, made) with their golden records and names."""
    out = made.join(wide(golden_rows), "entity_key", "left")
    named = F.try_element_at("golden", F.lit("display_name"))["value"] if "display_name" in golden_fields(cfg) else F.lit(None).cast("string")
    name = F.coalesce(named, F.col("entity_key"))
    return out.select("entity_key", "origin", name.alias("display_name"), "sources", "golden", "made")
