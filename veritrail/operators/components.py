"""Connected components of a table of links between long ids, in rounds of least neighbours."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a task's share, as the optimizer estimates them, where a table is dealt by a key.
SHARE = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see.

    Where none is set, a temporary folder serves a session that runs in one process; a cluster must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, of which only the columns that are wanted are read; rows in any order."""
    path = f"{shared_folder(df.sparkSession)}/tabled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by a key over as many parts as its size asks for, where the session's would be larger than SHARE each."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // SHARE)
    return df.repartition(min(parts, 100_000), key) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (long columns a and b); the root is the least node of the component.

    Each round, a node takes the least label among its own and its neighbours', then the label of that label.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both)
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = moved.select(F.col("node").alias("next"), F.col("next").alias("onward"))
        moved = staged(moved.join(jump, "next", "left").select("node", F.least("next", F.coalesce("onward", "next")).alias("new"), "root"))
        changed = moved.filter("new <> root").head(1)
        labels = moved.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
