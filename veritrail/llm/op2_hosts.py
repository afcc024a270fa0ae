"""Host-level quality rules, in DataFrame operations only.

Every document is judged by two rules on its own words (too few words; too many words inside repeated windows).
The failures are then summed by host, each host's failure rate is shrunk towards the corpus by a beta prior that is
fitted to all hosts (method of moments), and documents of hosts whose shrunk rate is above ``host_limit`` go too.
A host of few documents thus needs far worse documents than a host of many before it is condemned as a whole.

The measures are computed once and kept (a few numbers a row, no text); sums by host are combined before they are
shuffled, and only condemned hosts are joined back.

Null or empty text has no words and fails. A null host is a host of its own. Repeated rows and ids are judged
alike, each for itself. No rows give no rows. Clashing or extra columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough, staged, table

MIN_WORDS = 10
WINDOW = 5
#: Percent of the words that may lie in repeated windows.
MAX_REPEATED = 20
#: Shrunk failure rate above which a host is condemned.
HOST_LIMIT = 0.6
#: Strength of the prior where all hosts fail alike, so that no finite one can be fitted.
FLAT_PRIOR = 1_000.0
SPACE = r"[\x20\x09-\x0D]+"


def _repeated(windows: Column, width: int) -> Column:
    """Words inside windows that occur twice or more: equal hashes meet by sorting, then the starts are put in order."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("at"))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    starts = F.array_sort(
        F.transform(
            F.filter(
                F.zip_with(
                    pairs,
                    F.zip_with(
                        F.concat(F.array(F.lit(None).cast("struct<h:bigint,at:int>")), pairs),
                        F.concat(F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1))), F.array(F.lit(None).cast("struct<h:bigint,at:int>"))),
                        lambda before, after: F.struct(before.alias("b"), after.alias("a")),
                    ),
                    lambda x, y: F.struct(x.alias("x"), (same(x, y["b"]) | same(x, y["a"])).alias("twice")),
                ),
                lambda z: z["twice"] & z["x"].isNotNull(),
            ),
            lambda z: z["x"]["at"],
        )
    )
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda s, at: F.struct((s["n"] + F.least(F.lit(width), at - s["last"])).alias("n"), at.alias("last")),
        lambda s: s["n"].cast("long"),
    )


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the base measures of every row."""
    line = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    flat = docs.select(
        "doc_id",
        F.col(host).alias("_host"),
        F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")).alias("_flat"),
        F.when(F.instr("text", "\n") > 0, line).alias("_lines"),
    )
    worded = flat.select(
        "doc_id",
        "_host",
        F.when(F.col("_flat") != "", F.split("_flat", " ")).otherwise(F.array().cast("array<string>")).alias("_words"),
        F.length("_flat").alias("_chars"),
        (F.length("_flat") - F.length(F.regexp_replace("_flat", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
    ).withColumn("n_words", F.greatest(F.size("_words"), F.lit(0)).cast("long"))
    # Every word is hashed once, and a window is the hash of its words' hashes.
    starts = F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))
    worded = worded.withColumn("_codes", F.when(F.col("n_words") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w)))).drop("_words")
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_codes"), i + k) for k in range(WINDOW)]))
    hashed = worded.withColumn("_windows", F.when(F.col("n_words") > WINDOW, windows)).drop("_codes")
    several = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return hashed.select(
        "doc_id",
        "_host",
        "n_words",
        F.greatest(F.col("_chars") - F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(0)).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.when(F.col("_windows").isNotNull() & several, _repeated(F.col("_windows"), WINDOW)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def condemned(judged: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts with more than ``host_limit`` as their shrunk failure rate: _host, n, failed, rate."""
    hosts = judged.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    seen = hosts.agg(
        F.sum("failed").alias("failed"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"),
        F.sum(F.lit(1.0) / F.col("n")).alias("inverse"),
    ).first()
    if not seen["n"]:
        return hosts.withColumn("rate", F.lit(0.0)).limit(0)
    mean = seen["failed"] / seen["n"]
    # Between-host variance: the weighted variance of the rates less what sampling alone would give.
    sampling = mean * (1 - mean) * seen["hosts"] / seen["n"]
    between = seen["squares"] / seen["n"] - mean * mean - sampling
    strength = mean * (1 - mean) / between - 1 if between > 0 else FLAT_PRIOR
    strength = min(max(strength, 1.0), FLAT_PRIOR)
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate).filter(F.col("rate") > host_limit)


def host_rules(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The base measures with ``base_failed``, ``host_failed`` and ``kept`` for every row of ``docs``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = staged(measures(docs, host).withColumn("base_failed", failed))
    bad = staged(condemned(judged, host_limit).select(F.col("_host").alias("_bad"), F.lit(True).alias("_is_bad")))
    bad = F.broadcast(bad) if small_enough(bad) else bad
    joined = judged.join(bad, F.col("_host").eqNullSafe(F.col("_bad")), "left")
    host_failed = F.coalesce("_is_bad", F.lit(False))
    return joined.select(
        *[c for c in judged.columns if c != "_host"],
        host_failed.alias("host_failed"),
        (~F.col("base_failed") & ~host_failed).alias("kept"),
    )


def op2_hosts(spark, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT k, i, hash(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS h
  FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)),
r AS (
  SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, h) > 1),
n AS (
  SELECT k, sum(least(5, i - before))::BIGINT AS n_repeat_words
  FROM (SELECT k, i, coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), i - 5) AS before FROM r) GROUP BY k),
m AS (
  SELECT d.k, doc_id, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN n ON d.k = n.k),
j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM j GROUP BY source),
s AS (
  SELECT sum(failed) / sum(n) AS mean, count(*) AS hosts, sum(n) AS n, sum(failed * failed / n) AS squares FROM h),
v AS (
  SELECT mean, squares / n - mean * mean - mean * (1 - mean) * hosts / n AS b FROM s),
p AS (
  SELECT mean, least(greatest(CASE WHEN b > 0 THEN mean * (1 - mean) / b - 1 ELSE 1000 END, 1), 1000) AS strength FROM v),
bad AS (
  SELECT source FROM h, p WHERE (failed + mean * strength) / (n + strength) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM j.source) AS host_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM j.source) AS kept
FROM j
"""
