"""Lists to look things up in: issues, the rows behind one, entities, and what humans decided. All are tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config
from .store import Store


def issues(store: Store, severities: Sequence[str] = (), status: str | None = "open", titles: Sequence[str] = (), person: str | None = None) -> DataFrame:
    """Issues in their order, with the name of whom they are about; each facet that is given narrows them down.

    ``status`` None means any. ``person`` is a display name or an entity key, ``titles`` are whole titles.
    """
    names = store.table("entities").select("entity_key", F.col("display_name").alias("person"))
    rows = store.table("issues")
    for column, wanted in (("severity", severities), ("title", titles), ("status", [status] if status else ())):
        rows = rows.filter(F.col(column).isin(*wanted)) if wanted else rows
    rows = rows.join(names, "entity_key", "left")
    if person is not None:
        rows = rows.filter((F.col("person") == person) | (F.col("entity_key") == person))
    return rows.select("fingerprint", "severity", "status", "title", "person", "explanation", "rule_id", "entity_key", "note", "position").orderBy("position")


def lineage(store: Store, fingerprint: str) -> DataFrame:
    """The records behind an issue, in the order it names them: where each stands, its raw values and its entity."""
    named = store.table("issues").filter(F.col("fingerprint") == fingerprint).select(F.posexplode("record_keys").alias("n", "record_key"))
    rows = store.table("records").join(F.broadcast(named), "record_key")  # the keys of one issue
    rows = rows.join(store.table("links").select("record_key", "entity_key", "method", "confidence"), "record_key", "left")
    return rows.select("n", "source", "file", "row_ref", "raw", "entity_key", "method", "confidence", "record_key").orderBy("n")


def entities(cfg: Config, store: Store, anchored: bool | None = None) -> DataFrame:
    """Entities by name, with the systems that know them; ``anchored`` False: only those the anchor does not know."""
    rows = store.table("entities").withColumn("anchored", F.col("origin") == cfg.anchor)
    rows = rows if anchored is None else rows.filter(F.col("anchored") == anchored)
    return rows.select("display_name", "entity_key", "anchored", F.array_join("sources", ", ").alias("sources")).orderBy("display_name", "entity_key")


def records_of(store: Store, entity_key: str) -> DataFrame:
    """Every record of an entity and how it came to it."""
    rows = store.table("links").filter(F.col("entity_key") == entity_key).join(store.table("records"), "record_key")
    return rows.select("source", "file", "row_ref", "method", "confidence", "raw").orderBy("source", "file_ord", "ord")


def decisions(store: Store) -> DataFrame:
    """What stands decided, newest first: the verdict, and whom or what it is about.

    A decision about an issue that no build brings up any more is listed too, without title and person.
    """
    names = store.table("entities").select("entity_key", F.col("display_name").alias("person"))
    known = store.table("issues").select(F.col("fingerprint").alias("key"), "title", "entity_key").join(names, "entity_key", "left").drop("entity_key")
    closed = store.decisions("close").join(known, "key", "left")
    closed = closed.select("seq", F.lit("issue").alias("about"), "key", F.col("value").alias("verdict"), "title", "person", "note", "created_at")
    part = F.split("key", r"\|")
    matched = store.decisions("match").join(names.withColumnRenamed("entity_key", "value"), "value", "left")
    title = F.concat(part[0], F.lit(" record of "), part[1])
    matched = matched.select("seq", F.lit("match").alias("about"), "key", F.when(F.col("value").isNull(), "kept apart").otherwise("joined").alias("verdict"), title.alias("title"), F.coalesce("person", "value").alias("person"), "note", "created_at")
    return closed.unionByName(matched).orderBy(F.desc("seq"))
