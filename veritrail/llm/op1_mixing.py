"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1: its weight times a factor that changes. Its integral gives
the source's share of the token budget, and its cumulative form says how much of that share is wanted by any moment. A
document that starts at word c of its source's stream is therefore placed at the moment when the source's cumulative
demand reaches c; sorting by that moment gives the training order.

* Shares above ``cap`` times a source's size stop there; the excess goes to the others by weight. While no share is
  capped, the mix around any moment is that of the weights at that moment.
* The stream of a source is its documents in the order of a hash of their id, over again if more is wanted. A pass
  over a document counts if its middle lies before the target, so a source misses its target by less than a document.
* Running word counts need no group in one task: a source is cut into hash ranges, the ranges are summed first, and
  only a range is ever sorted in one task.
* The training order is a row for each pass. :func:`sequence` gives it without texts, :func:`curriculum` with all
  columns; the query tells what is taken, and from when on, from the rows of that order.

Only one row per source and one schedule per source reach the driver.

Null or empty text has size 0 and is never taken. A null source is a source of its own, last in order. Null ids hash
as the empty text. Rows that repeat an id are separate documents. No rows give no rows. Other columns are ignored,
or carried by :func:`curriculum`, whatever their names. A source whose schedule integrates to 0 is never taken.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, staged, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Factors on a weight over time, as (moment, factor) knots with straight lines between; one for each place in WEIGHTS.
SCHEDULES = (((0.0, 1.4), (1.0, 0.6)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.6), (0.5, 1.0), (1.0, 1.4)))
#: Documents that a hash range is meant to hold.
RANGE_ROWS = 2_048
#: Words that a part of the training order holds at least, where the session has more shuffle partitions than that needs.
PART_WORDS = 2_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words wanted of each source: shares of ``share`` times all sizes by weight, none above ``cap`` times its size."""
    left, out = share * float(sum(sizes)), [cap * n if w > 0 else 0.0 for n, w in zip(sizes, weights)]
    # In order of how soon the cap is met, a source is capped if even the sources after it would be given too much.
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: (cap * sizes[i] / weights[i], i))
    free = list(accumulate(weights[i] for i in reversed(order)))[::-1]
    for k, i in enumerate(order):
        if left * weights[i] / free[k] < out[i]:
            for j in order[k:]:
                out[j] = left * weights[j] / free[k]
            break
        left -= out[i]
    return out


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(start, weight there, slope, integral up to there) of each line of a schedule, the integral scaled to end at 1."""
    lines, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        lines.append((t0, w0, (w1 - w0) / (t1 - t0), before))
        before += integral(((t0, w0), (t1, w1)))
    total = before or 1.0
    return [(float(t), w / total, s / total, c / total) for t, w, s, c in lines]


def moment(lines: Column, part: Column) -> Column:
    """When the cumulative demand of a schedule reaches ``part`` of its whole: the integral of a line, inverted."""
    line = F.element_at(F.filter(lines, lambda x: x["before"] <= part), -1)
    rest = part - line["before"]
    under = line["weight"] * line["weight"] + 2.0 * line["slope"] * rest
    rise = line["weight"] + F.sqrt(F.greatest(under, F.lit(0.0)))
    return F.least(F.lit(1.0), line["start"] + F.when(rise > 0, 2.0 * rest / rise).otherwise(0.0))


def combined(schedules: Sequence, shares: Sequence[float]) -> list[tuple[float, float, float, float]]:
    """The lines of all schedules taken together, each schedule by its share of the whole."""
    times = sorted({float(t) for knots in schedules for t, _ in knots})
    whole = [segments(knots) for knots in schedules]

    def at(lines, t):
        start, weight, slope, _ = [x for x in lines if x[0] <= t][-1]
        return weight + slope * (t - start)

    return segments([(t, sum(s * at(lines, t) for s, lines in zip(shares, whole))) for t in times])


def demand(lines: Sequence[tuple[float, float, float, float]], time: Column) -> Column:
    """The part of the whole that is wanted by a moment: the integral up to it."""
    out = F.lit(0.0)
    for start, weight, slope, before in lines:
        since = time - start
        out = F.when(time >= start, before + since * (weight + since * slope / 2.0)).otherwise(out)
    return out


class Mix:
    """A mix over a table: its sources with their targets, and where each document stands in its source's stream.

    Rows without texts (id, source, size, order) are staged, so that texts are not counted again for each sum.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[float], schedules: Sequence, share: float, cap: float):
        self.docs, self.cap = docs, cap
        self.slim = staged(self._rows(docs.select("doc_id", "source", "text")))
        found = self.slim.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        weight = [weights[i % len(weights)] * integral(schedules[i % len(schedules)]) for i in range(len(found))]
        wanted = targets([r["size"] for r in found], weight, share, cap)
        self.words = sum(wanted)
        shares = [sum(wanted[k :: len(schedules)]) / (self.words or 1) for k in range(len(schedules))]
        self.lines = combined(schedules, shares) if self.words else []
        lines = [segments(schedules[i % len(schedules)]) for i in range(len(found))]
        sources = docs.sparkSession.createDataFrame(
            [("" if r["source"] is None else "=" + r["source"], r["size"], t, x) for r, t, x in zip(found, wanted, lines)],
            "_source string, source_size long, target double, lines array<struct<start:double,weight:double,slope:double,before:double>>",
        )
        self.digits = max(0, math.ceil(math.log(max(1, max((r["n"] for r in found), default=1) / RANGE_ROWS), 16)))
        before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sums = self._keyed(self.slim).groupBy("_source", "_range").agg(F.sum("size").alias("_in"))
        # A row for each range, with what its source wants: texts are then joined on one key that spreads evenly.
        self.ranges = sums.select("_source", "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start")).join(sources, "_source")

    @staticmethod
    def _rows(docs: DataFrame, *more: Column) -> DataFrame:
        order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("_order"), *more)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source")
        return rows.select("*", source, F.substring("_order", 1, self.digits).alias("_range"))

    def placed(self, carry: bool = False) -> DataFrame:
        """A row per document; with ``carry``, all of its columns go along in ``_carried``."""
        rows = self._rows(self.docs, F.struct(*map(named, self.docs.columns)).alias("_carried")) if carry else self.slim
        within = Window.partitionBy("_source", "_range").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0)
        rows = self._keyed(rows).withColumn("_run", F.sum("size").over(within) - F.col("size"))
        rows = rows.join(self.ranges, ["_source", "_range"]).withColumn("_at", F.col("_start") + F.col("_run"))
        most = math.ceil(self.cap)
        room = F.floor((F.col("target") - F.col("_at") - F.col("size") / 2.0) / F.col("source_size")) + 1
        passes = F.when(F.col("source_size") > 0, F.greatest(F.lit(0), F.least(F.lit(most), room))).otherwise(0)
        rows = rows.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0).cast("int"))
        part = lambda k: (F.col("_at") + k * F.col("source_size")) / F.col("target")
        positions = F.array(*[F.when(F.col("passes") > k, moment(F.col("lines"), part(k))) for k in range(most)])
        return rows.select(
            "doc_id",
            "source",
            F.col("_at").alias("start"),
            "size",
            "source_size",
            "target",
            "passes",
            (F.col("size") * F.col("passes")).cast("long").alias("taken"),
            F.filter(positions, lambda x: x.isNotNull()).alias("positions"),
            *(["_carried"] if carry else []),
        )

    def ordered(self, rows: DataFrame, tie: str | Column) -> DataFrame:
        """``rows``, one for each pass, by their ``position``: the training order.

        Where the ranges of positions end is known from the schedules, which say how many words are wanted by any moment;
        nothing is sampled.
        """
        most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, min(most, math.ceil(self.words / PART_WORDS)))
        place = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(demand(self.lines, F.col("position")) * parts))).cast("int")
        return rows.repartitionById(parts, place).sortWithinPartitions("position", tie)

    def sequence(self, placed: DataFrame) -> DataFrame:
        """The training order over rows of :meth:`placed`, without texts."""
        passes = placed.select("doc_id", "source", "start", "size", "source_size", "target", F.posexplode("positions").alias("pass", "position"))
        return self.ordered(passes, "doc_id")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row per document: doc_id, source, start (words of its source before it), size, source_size, target, passes,
    taken, positions (one for each pass)."""
    return Mix(docs, weights, schedules, share, cap).placed()


def sequence(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The training order without texts, a row for each pass: doc_id, source, start, size, source_size, target, pass
    (from 0), position."""
    own = Mix(docs, weights, schedules, share, cap)
    return own.sequence(own.placed())


def curriculum(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The documents that the mix takes, a row for each pass, sorted by training position; columns as in ``docs``.

    Texts move twice: to the range of their source that holds them, and to their place in training.
    """
    own = Mix(docs, weights, schedules, share, cap)
    rows = own.placed(carry=True).select(F.explode("positions").alias("position"), "_carried")
    return own.ordered(rows, F.col("_carried.doc_id")).select(*[F.col("_carried").getField(c).alias(c) for c in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    own = Mix(table(spark, sf_dir, "documents"), WEIGHTS, SCHEDULES, SHARE, CAP)
    placed = staged(own.placed())
    order = staged(own.sequence(placed))
    # Of the documents that are taken, no two of a source start at one word.
    taken = order.groupBy("source", "start", "doc_id", "size", "source_size", "target").agg(F.sum("size").alias("taken"), F.min("position").alias("first"))
    never = placed.filter("passes = 0").withColumns({"taken": F.lit(0).cast("long"), "first": F.lit(None).cast("double")})
    rows = taken.unionByName(never.select(taken.columns))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.round("first", 6).alias("first_position"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
w AS (
  SELECT source, source_size, k, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, k) AS i FROM w),
c AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS free FROM o),
f AS (
  SELECT *, min(CASE WHEN rest * w / free < 2.0::DOUBLE * source_size THEN i END) OVER () AS stop FROM c),
t AS (
  SELECT source, source_size, k % 3 AS kind,
         CASE WHEN stop IS NULL OR i < stop THEN 2.0::DOUBLE * source_size
              ELSE max(CASE WHEN i = stop THEN rest END) OVER () * w / max(CASE WHEN i = stop THEN free END) OVER () END AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.kind,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS begin
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(0, least(2, floor((target - begin - size / 2.0::DOUBLE) / source_size) + 1)) ELSE 0 END AS passes,
         begin / target AS part FROM p),
q AS (
  SELECT *, CASE kind WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE CASE WHEN part >= 0.4e0 THEN 0.4 ELSE 0.0 END END AS before FROM n)
SELECT doc_id, size, source_size, target, (size * passes)::BIGINT AS taken,
  round(CASE WHEN passes > 0 THEN CASE kind
    WHEN 0 THEN 2 * part / (1.4e0 + sqrt(1.4e0 * 1.4e0 - 1.6e0 * part)) WHEN 1 THEN part
    ELSE CASE WHEN part >= 0.4e0 THEN 0.5e0 + 2 * (part - 0.4e0) / (1 + sqrt(1 + 1.6e0 * (part - 0.4e0)))
              ELSE 2 * part / (0.6e0 + sqrt(0.36e0 + 1.6e0 * part)) END END END, 6) AS first_position
FROM q
"""
