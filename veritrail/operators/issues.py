"""Findings to issues: fingerprints, one issue per fingerprint, the state that humans gave them, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .rules import COLUMNS

SEVERITIES = ("critical", "warning", "info")


def fingerprint(*parts: str) -> Column:
    """Sixteen hexadecimal digits that stay the same from run to run."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])), 1, 16)


def severity_rank(severity: str = "severity") -> Column:
    out = F.lit(len(SEVERITIES) + 6)
    for k, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(F.col(severity) == s, k).otherwise(out)
    return out


def from_files(file_issues: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return file_issues.select(
        F.lit(0).alias("stage"), F.lit(0).alias("step"), "rule_id", "severity", "title", "explanation", none.alias("entity_key"), "field",
        F.array().cast("array<string>").alias("record_keys"), F.col("file").alias("detail"), "file", F.lit("{}").alias("vals"), F.lpad(F.col("ord").cast("string"), 8, "0").alias("at"),
    )


def possible_matches(cfg: Config, linked: DataFrame, fingerprint_of: Column) -> DataFrame:
    """Records that were left alone although an entity is rather like them, for a human to decide."""
    rows = linked.filter("candidates is not null").withColumn("fp", fingerprint_of)
    labels = F.create_map(*[F.lit(x) for s in cfg.sources for x in (s, cfg.label(s))])
    name = F.coalesce(F.try_element_at("raw", F.lit("name")), "norm._display", F.lit(""))
    percent = F.concat(F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%"))
    text = F.concat(labels[F.col("source")], F.lit(": '"), name, F.lit("' is "), percent, F.lit(f" like a known {cfg.entity_label.lower()}"), F.when(F.col("ambiguous"), F.lit(", and like others too")).otherwise(""), F.lit(". It stays by itself until somebody decides."))
    vals = F.to_json(F.struct(F.col("fp").alias("fingerprint"), "candidates", F.round("score", 3).alias("score")))
    order = F.concat_ws(".", F.lpad(F.element_at(F.create_map(*[F.lit(x) for s in cfg.sources for x in (s, cfg.rank(s))]), F.col("source")).cast("string"), 3, "0"), F.lpad(F.col("file_ord").cast("string"), 6, "0"), F.lpad(F.col("ord").cast("string"), 16, "0"))
    return rows.select(
        F.lit(1).alias("stage"), F.lit(0).alias("step"), F.lit("possible_match").alias("rule_id"), F.lit("warning").alias("severity"), F.lit("This may be somebody known").alias("title"),
        text.alias("explanation"), "entity_key", F.lit(None).cast("string").alias("field"), F.array("record_key").alias("record_keys"), F.col("fp").alias("detail"), F.lit(None).cast("string").alias("file"), vals.alias("vals"), order.alias("at"),
    )


def finish(cfg: Config, findings: DataFrame, names: DataFrame, closed: DataFrame | None) -> DataFrame:
    """Issues in order: ``n``, the fingerprint, the finding, its status and note.

    Of findings with one fingerprint the first stays: files before matches before rules, as configured.
    """
    first = Window.partitionBy("fingerprint").orderBy("stage", "step", "at")
    kept = findings.withColumn("fingerprint", fingerprint("rule_id", "entity_key", "field", "detail"))
    kept = kept.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    if closed is not None:
        kept = kept.join(closed.select(F.col("key").alias("fingerprint"), F.col("value").alias("_status"), "note"), "fingerprint", "left")
    else:
        kept = kept.withColumn("_status", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string"))
    kept = kept.join(names, "entity_key", "left")
    order = [severity_rank(), F.col("rule_id"), F.coalesce("shown", F.lit("Unknown")), F.col("stage"), F.col("step"), F.col("at")]
    status = F.coalesce("_status", F.lit("open")).alias("status")
    return kept.orderBy(*order).select("fingerprint", *[c for c in COLUMNS if c not in ("at", "detail")], "detail", status, F.when(F.col("_status").isNotNull(), F.col("note")).alias("note"), F.struct(*order).alias("position"))
