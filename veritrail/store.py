"""The engine's tables as Parquet: versioned snapshots and builds, and an append-only log of human decisions.

``<root>/<table>/<version>`` holds one version of a table; ``runs`` is appended to and says which versions are current,
so a reader never sees a half-written build. All reading and writing goes through Spark, on any file system it knows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "id long, snapshot long, started_at timestamp, as_of date, config string, files string, summary string"
DECISIONS = "seq long, kind string, key string, value string, note string, created_at timestamp, removed boolean"
SNAPSHOT = ("records", "file_issues")
DERIVED = ("links", "entities", "golden", "events", "issues")


def latest(log: DataFrame) -> DataFrame:
    """What stands of a log of decisions: the newest of each key, unless it takes the key's decision back."""
    rest = [c for c in log.columns if c != "key"]
    newest = log.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("d")).filter("not d.removed")
    value = F.from_json(F.concat(F.lit('{"v":'), "d.value", F.lit("}")), "v string")["v"]
    return newest.select("key", value.alias("value"), "d.note", "d.seq", "d.created_at")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, path: str, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        if by:
            try:
                self.spark.read.parquet(path)
            except AnalysisException:  # no rows make no partitions, and then nothing tells the schema
                df.write.mode("overwrite").parquet(path)

    # Snapshots and builds

    def last_run(self) -> dict[str, Any] | None:
        """The newest run: the greatest id, found without sorting the log."""
        row = self._log("runs", RUNS).orderBy(F.desc("id")).limit(1).head()
        return row.asDict() if row else None

    def replace_snapshot(self, records: DataFrame, file_issues: DataFrame) -> int:
        """A new version of what was read; the version's number. It becomes current with the next :meth:`add_run`."""
        last = self.last_run()
        version = (last["id"] if last else 0) + 1
        self._write(records, f"{self.root}/records/{version}", "source")
        self._write(file_issues, f"{self.root}/file_issues/{version}")
        return version

    def save_derived(self, tables: dict[str, DataFrame]) -> int:
        last = self.last_run()
        version = (last["id"] if last else 0) + 1
        for name, df in tables.items():
            self._write(df, f"{self.root}/{name}/{version}", "kind" if name == "events" else None)
        return version

    def add_run(self, version: int, snapshot: int, as_of: date, config: str, files: list, summary: dict) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self._append("runs", RUNS, (version, snapshot, now, as_of, config, json.dumps(files), json.dumps(summary)))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        if version is None:
            last = self.last_run()
            if last is None:
                raise ValueError("nothing was ingested yet")
            version = last["snapshot"] if name in SNAPSHOT else last["id"]
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def linked(self) -> DataFrame:
        """Records with their links."""
        return self.table("records").join(self.table("links"), "record_key")

    # Decisions

    def _decide(self, kind: str, key: str, value: Any, note: str, removed: bool) -> None:
        seq = (self._log("decisions", DECISIONS).agg(F.max("seq")).head()[0] or 0) + 1
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self._append("decisions", DECISIONS, (seq, kind, key, json.dumps(value), note, now, removed))

    def add_decision(self, kind: str, key: str, value: Any = None, note: str = "") -> None:
        self._decide(kind, key, value, note, False)

    def remove_decision(self, kind: str, key: str) -> None:
        self._decide(kind, key, None, "", True)

    def decisions(self, kind: str) -> DataFrame:
        """key, value, note, seq and time of the latest decision about each key, removed ones left out."""
        return latest(self._log("decisions", DECISIONS).filter(F.col("kind") == kind))

    def reset(self, keep_decisions: bool = False) -> None:
        """Delete all tables, the decisions too unless they are to be kept."""
        jvm = self.spark.sparkContext._jvm
        for name in ("runs", *SNAPSHOT, *DERIVED, *(() if keep_decisions else ("decisions",))):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def query(self, sql: str, args: Sequence | dict | None = None) -> DataFrame:
        """SQL over the current tables, which are registered as views for it."""
        if self.last_run() is not None:
            for name in (*SNAPSHOT, *DERIVED):
                self.table(name).createOrReplaceTempView(name)
        self._log("runs", RUNS).createOrReplaceTempView("runs")
        self._log("decisions", DECISIONS).createOrReplaceTempView("decisions")
        return self.spark.sql(sql, args=list(args) if args is not None and not isinstance(args, dict) else args)
