"""What the operators share: tables, checkpoints, word expressions, and views of Arrow text as numpy bytes."""

from __future__ import annotations

import contextlib
import ctypes
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_folder

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a side up to which a join sends it to every executor; larger sides are shuffled.
BROADCAST_ROWS = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its whole name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


_scope = threading.local()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as a table of the shared folder and read again, so that its lineage is cut.

    Columns that a reader does not want are not read back, and many small parts are read by few tasks.
    """
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = getattr(_scope, "made", None)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def stage(spark: SparkSession):
    """Around the function of a pipeline's stage: what the stage before it staged goes, as its result is written by now.

    Only tables that such functions of this thread staged; those of single operators stay until their folder goes.
    """
    for path in getattr(_scope, "left", ()):
        delete(spark, path)
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of plans that nobody holds any more
    _scope.left = _scope.made = []
    try:
        yield
    finally:
        _scope.made = None


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Send Python workers fewer rows at once where the session has Spark's default: texts are long rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_enough(df: DataFrame) -> bool:
    """Whether ``df``, already staged, is within the bound for broadcasting."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


#: Parts into which the rows of hot keys are dealt where facts about those keys are joined to them.
SALTS = 64


def beside(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with the columns of ``hot`` (staged, one row for each of few keys), null for other keys.

    A hot key's rows are dealt over salts by the column ``by``, and its row of ``hot`` is repeated for each salt.
    """
    dealt = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = F.broadcast(dealt) if small_enough(dealt) else dealt
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(dealt, [key, "_salt"], "left").drop("_salt")


def dealt_join(many: DataFrame, few: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """``many`` joined with ``few``, which has few but long rows a key, where a key may hold any share of ``many``.

    Keys with more than ``most`` rows of ``many`` are dealt into parts of about that size, by the column ``by``.
    """
    hot = many.groupBy(key).agg(F.count(F.lit(1)).alias("_parts")).filter(F.col("_parts") > most)
    hot = staged(hot.withColumn("_parts", F.ceil(F.col("_parts") / most).cast("int")))
    if not hot.head(1):
        return many.join(few, key)
    parts = F.coalesce("_parts", F.lit(1))
    rows = beside(many, hot, key, by).withColumn("_part", F.pmod(F.xxhash64(by, F.lit(1)), parts).cast("int")).drop("_parts")
    others = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return rows.join(others, [key, "_part"]).drop("_part")


_releases: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None] | None = None) -> None:
    """Called by a Python worker when it starts on a partition: what other operators remember there is let go.

    Workers outlive tasks, and what each operator keeps between partitions (a vocabulary, tables) would add up.
    """
    for other in [n for n in _releases if n != name]:
        _releases.pop(other)()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can give memory back
            ctypes.CDLL(None).malloc_trim(0)
    _releases[name] = release or (lambda: None)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow text column as one byte array and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    payload = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return payload[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(bounds: np.ndarray, most: int):
    """Consecutive row ranges of about ``most`` bytes each, so that scratch arrays stay small; a longer row is alone."""
    start, rows = 0, len(bounds) - 1
    while start < rows:
        end = int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing hash, over an array of unsigned words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_map(places: DataFrame, bits: int) -> np.ndarray:
    """The set bits of a map of fixed size, from a column ``p`` of places below ``bits``.

    Executors set the bits; the driver gets bits / 8 bytes at most, however many rows there are.
    """
    rows = places.groupBy(F.shiftright("p", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["k"] * 4096 : r["k"] * 4096 + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out
