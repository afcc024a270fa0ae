"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting, fitting and scoring all see the same features: the text's letters in lower case (every other run of
characters is one blank), cut into n-grams of 1 to 3 characters, each hashed to one of ``BUCKETS`` columns.

* Fit. Of each language, a sample of at most about ``SAMPLE`` labelled documents is taken by a hash of doc_id (the
  share comes from counts over all rows). Executors count n-grams sparsely, Spark sums the counts by language and
  bucket, and the driver gets at most languages x BUCKETS sums: the size of the model, whatever the corpus.
* Score. The log-probability matrix is broadcast. Rows are scored in blocks: the bucket numbers of a block gather rows
  of the matrix, summed by document. The language is the one of the greatest log-likelihood plus log prior. Its score
  is its posterior, tempered so that long texts don't saturate: the sums are divided by the square root of the number
  of n-grams before they are normalised.

Null text, or text without a letter, is ``und`` with score 0; so is everything if nothing could be learned. Ties go to
the language that sorts first. A null doc_id counts as held out and is never learned from. Texts of any length are
read whole; long ones in pieces that carry their last characters on, so that no n-gram is lost. Repeated rows are scored
each for itself. Other columns are not looked at, and are kept by :func:`accepted` whatever their names.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, mixed, named, runs, table, utf8

BUCKETS = 1 << 15
SAMPLE = 3_000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Bytes of text that are worked on at once.
BLOCK = 1 << 18
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def _letters() -> np.ndarray:
    """For each code point its lower-case letter (itself, if that is several), or a blank if it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: list[np.ndarray] = []


def _folded(data: bytes) -> np.ndarray:
    """The characters of UTF-8 bytes as letters in lower case and blanks."""
    if not _table:
        _table.append(_letters())
    return _table[0][np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")]


def _grams(chars: np.ndarray, row: np.ndarray, seen: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each n-gram of characters in which blanks are single; those within the first ``seen`` are left out."""
    chars = chars.astype(np.uint64)
    found, owner = [], []
    code = chars
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * _FIRST + chars[n - 1 :] * _SECOND
            same = row[: len(code)] == row[n - 1 :]
        else:
            same = chars != 32
        same[: max(0, seen - n + 1)] = False
        found.append(mixed(code[same] + np.uint64(n)) & np.uint64(BUCKETS - 1))
        owner.append(row[: len(code)][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its row, letters of each row) of UTF-8 texts; no n-gram spans two of them."""
    parts = [_folded(t) for t in texts]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    chars = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    letters = np.bincount(row[chars != 32], minlength=len(parts))
    first = np.ones(len(chars), bool)
    first[1:] = (chars[1:] != 32) | (chars[:-1] != 32) | (row[1:] != row[:-1])
    return *_grams(chars[first], row[first]), letters


def long_features(text: np.ndarray, block: int):
    """What :func:`features` gives for one text, in pieces of about ``block`` bytes; each takes up the two characters before it."""
    at, last = 0, np.zeros(0, np.uint32)
    while at < len(text):
        end = min(at + block, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:  # not inside a character
            end += 1
        chars = np.concatenate([last, _folded(bytes(text[at:end]))])
        first = np.ones(len(chars), bool)
        first[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
        letters, chars = int((chars[len(last) :] != 32).sum()), chars[first]
        yield *_grams(chars, np.zeros(len(chars), np.int64), len(last)), np.array([letters])
        at, last = end, chars[-2:]


def _blocks(column: pa.Array):
    """(first row, last, buckets, owners, letters) over whole texts; a row's pieces may span blocks."""
    data, bounds = utf8(column)
    for start, end in runs(bounds, BLOCK):
        if bounds[end] - bounds[start] <= 4 * BLOCK:
            yield start, end, *features([bytes(data[bounds[k] : bounds[k + 1]]) for k in range(start, end)])
        else:
            for part in long_features(data[bounds[start] : bounds[end]], BLOCK):
                yield start, end, *part


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages learned, in order, and their log-probabilities with the log prior as the last row."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    if not found:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    place = {lang: k for k, (lang, _) in enumerate(found)}
    span = 1 << 20
    limit = F.create_map(*[F.lit(x) for lang, n in found for x in (lang, min(span, int(span * sample / n) + 1))])
    chosen = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(span)) < limit[F.col("lang")])

    def count(batches):
        claim("language", _table.clear)
        total = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            kind = np.array([place[x] for x in batch.column("lang").to_pylist()])
            for start, _, bucket, owner, _ in _blocks(batch.column("text")):
                np.add.at(total.reshape(-1), kind[start + owner] * BUCKETS + bucket, 1)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (lang, bucket, total[lang, bucket])], ["lang", "bucket", "n"])

    counts = chosen.filter(F.col("text").isNotNull()).select("lang", "text").mapInArrow(count, "lang long, bucket long, n long")
    sums = np.full((BUCKETS, len(place)), SMOOTHING)
    for r in counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        sums[r["bucket"], r["lang"]] += r["n"]
    prior = np.log(np.array([n for _, n in found], float) / sum(n for _, n in found))
    return list(place), np.vstack([np.log(sums / sums.sum(axis=0)), prior]).astype(np.float32)


def classify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep_text: bool = False) -> DataFrame:
    """``docs``, without the text if it isn't wanted, with lang_pred and score; other columns are called _0, _1, ..."""
    langs, logs = model
    sent = docs.sparkSession.sparkContext.broadcast(logs)
    own = [c for c in docs.columns if keep_text or c != "text"]
    names = ["text" if c == "text" else f"_{k}" for k, c in enumerate(own)]  # Python functions take plain names only
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, own))

    def score(batches):
        claim("language", _table.clear)
        matrix = sent.value
        for batch in batches:
            n = len(batch)
            total, grams, letters = np.zeros((n, len(langs))), np.zeros(n), np.zeros(n)
            for start, end, bucket, owner, seen in _blocks(batch.column("text")) if langs else ():
                size = np.bincount(owner, minlength=end - start)
                for k in range(len(langs)):
                    total[start:end, k] += np.bincount(owner, matrix[bucket, k], minlength=end - start)
                grams[start:end] += size
                letters[start:end] += seen
            best, sure = np.zeros(n, np.int64), np.zeros(n)
            if langs:
                total += matrix[-1]
                best = total.argmax(axis=1)
                total /= np.sqrt(np.maximum(grams, 1))[:, None]
                sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            some = letters > 0
            named = pa.array([langs[b] if s else UNKNOWN for b, s in zip(best, some)] if langs else [UNKNOWN] * n, pa.string())
            scores = pa.array(np.where(some, np.clip(sure, 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], named, scores], [*names, "lang_pred", "score"])

    rows = docs.select(*[named(c).alias(n) for n, c in zip(names, own)], *([] if keep_text else ["text"]))
    return rows.mapInArrow(score, fields + ", lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the rows that are not held out."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return classify(rows, fit(docs, sample)).toDF("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more; columns as in ``docs``.

    Where no language could be learned at all, texts with a letter are kept.
    """
    model = fit(docs)
    if not model[0]:
        model, least = ([""], np.zeros((BUCKETS + 1, 1), np.float32)), 0.0
    scored = classify(docs, model, keep_text=True).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return scored.drop("lang_pred", "score").toDF(*docs.columns)


def op6_language(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
