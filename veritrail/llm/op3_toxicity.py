"""Toxicity by a classifier chain.

Categories are predicted one after the other, each by a logistic model over the document's features and the
probabilities of the categories before it. While fitting, those probabilities are out-of-fold: each document's come
from a model that has not seen it, so that a later model learns how far an earlier one can be trusted.

* Features: the distinct words of a text and their first four and five bytes, as 64-bit hashes (letters beyond ASCII
  are bytes of a word like others). The ``FEATURES`` most telling ones are chosen by their log odds between toxic and
  clean documents times the toxic documents that hold them; a model is the weights of these.
* Folds: a document's fold comes from the least hash of its words, so that near copies of it are mostly in the same fold.
  Features are chosen once for each fold without its documents, so an out-of-fold model has seen them in no way.
* Categories: ``dense`` (toxic, with a share of telling words above the toxic median), ``sustained`` (toxic, with telling
  words in several quarters of the text), then ``toxic`` itself. Only the last is labelled; the first two are weak labels
  made of it and of the words that the other folds tell to be toxic.
* Fit on a sample of at most about ``SAMPLE`` toxic and twice as many clean labelled documents, taken by a hash of id
  and text; equal rows count once, so repeated ids don't let it grow. Executors make the features and count them. The
  driver fits on what the chosen features leave of the sample. Every document is then scored, whole, in one pass.

Null or empty text has no features and the models' base rates. A document with several labels counts as toxic if one
says so; null labels are none. Labels without a document are ignored. With no label of either kind nothing is toxic.
A fifth of all ids (by crc32) is never learned from, so that accuracy can be measured. Repeated rows are scored each for
itself; no rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, mixed, runs, staged, table, utf8
from .op5_superminhash import _powers, span_hashes, word_bounds
from .op6_language import held_out

CATEGORIES = ("dense", "sustained", "toxic")
FEATURES = 512
SAMPLE = 2_000
FOLDS = 5
#: Toxic documents that a feature must be in to be chosen.
SUPPORT = 4
PENALTY = 0.3
LIMIT = 0.5
BLOCK = 1 << 20
_APART = np.array([not (chr(b).isalpha() if b < 128 else True) for b in range(256)])


def hashed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes by word: whole, five bytes, four bytes), each word's row, its quarter of the text, and words by row."""
    start, end = word_bounds(data, bounds, _APART)
    row = np.searchsorted(bounds, start, side="right") - 1
    three = [span_hashes(data, start, np.minimum(end, start + n)) + np.uint64(k) for k, n in enumerate((1 << 30, 5, 4))]
    size = np.maximum(np.diff(bounds), 1)[row]
    return mixed(np.stack(three)), row, (start - bounds[row]) * 4 // size, np.bincount(row, minlength=len(bounds) - 1)


def _documents(batch):
    """(row, hashes, quarters, words) of every document of a batch; the hashes have three lines."""
    data, bounds = utf8(batch.column("text"))
    for first, last in runs(bounds, BLOCK):
        own = bounds[first : last + 1]
        codes, _, quarter, counts = hashed(data[own[0] : own[-1]], own - own[0])
        at = 0
        for k, n in enumerate(counts.tolist(), first):
            yield k, codes[:, at : at + n], quarter[at : at + n], n
            at += n


def _fold(codes: np.ndarray) -> int:
    """The fold of a document, from the least hash of its words."""
    return int(codes[0].min() % np.uint64(FOLDS)) if codes.size else 0


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of the documents to learn from: at most about three times ``sample``, whatever the corpus."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    keyed = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("_h"))
    pairs = staged(keyed.join(known, "doc_id").distinct())
    counts = {r["toxic"]: r["count"] for r in pairs.groupBy("toxic").count().collect()}
    span = 1 << 20
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "_h"), F.lit(span))
    share = F.lit(0)
    for toxic, n in counts.items():
        share = F.when(F.col("toxic") == toxic, min(span, span * sample * (1 if toxic else 2) // n + 1)).otherwise(share)
    chosen = pairs.filter(drawn < share)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text").join(F.broadcast(chosen), ["doc_id", "_h"])
    return staged(rows.groupBy("doc_id", "_h", "toxic").agg(F.first("text").alias("text")).select("text", "toxic"))


def _count(batches):
    """How many clean and toxic documents of each fold hold each feature, summed over a partition."""
    claim("shingles", _powers.clear)
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        kind = batch.column("toxic").to_pylist()
        for k, codes, _, _ in _documents(batch):
            held.setdefault((_fold(codes), kind[k]), []).append(np.unique(codes))
    for (fold, kind), parts in held.items():
        feature, n = np.unique(np.concatenate(parts), return_counts=True)
        for at in range(0, len(n), 100_000):
            part = slice(at, at + 100_000)
            columns = [pa.array(feature[part].view(np.int64)), pa.array(np.full(len(n[part]), fold, np.int32))]
            columns += [pa.array(np.where(kind, n[part], 0)), pa.array(np.where(kind, 0, n[part]))]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "fold", "toxic", "clean"])


def _telling(chosen: DataFrame) -> list[np.ndarray]:
    """The features chosen without each fold, then those chosen with all; sorted."""
    counts = chosen.mapInArrow(_count, "feature long, fold int, toxic long, clean long").groupBy("feature")
    of = lambda c, f: F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
    counts = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), *[of(c, f) for c in ("toxic", "clean") for f in range(FOLDS)])
    counts = staged(counts.filter(F.col("t") >= SUPPORT))
    out = []
    for f in range(FOLDS + 1):
        t, c = (F.col("t"), F.col("c")) if f == FOLDS else (F.col("t") - F.col(f"toxic{f}"), F.col("c") - F.col(f"clean{f}"))
        # Twice as many clean documents as toxic ones are drawn, which the half sets right.
        odds = F.log((t + 0.5) / (c / 2 + 0.5))
        best = counts.filter((t >= SUPPORT) & (odds > 1)).orderBy(F.desc(odds * t), "feature").limit(FEATURES).select("feature").collect()
        out.append(np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64)))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic model, the last one the intercept: Newton steps over few columns."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _with_ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, columns: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """One weight vector per category: features, the logits of the categories before it, the intercept.

    ``columns`` are the features to be used without each fold, and last those to be used with all.
    """
    columns = columns or [np.arange(x.shape[1])] * (FOLDS + 1)
    chain, earlier = [], np.zeros((len(x), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        chain.append(_logistic(np.hstack([x[:, columns[-1]], earlier]), y))
        unseen = np.zeros(len(x))
        for f in np.unique(folds):
            out = folds == f
            own = np.hstack([x[:, columns[f]], earlier])
            # All in one fold: nothing else to learn from but the base rate.
            w = _logistic(own[~out], y[~out]) if (~out).any() else np.r_[np.zeros(own.shape[1]), _logit(np.array([y.mean()]))]
            unseen[out] = _sigmoid(_with_ones(own[out]) @ w)
        earlier = np.hstack([earlier, _logit(unseen)[:, None]])
    return chain


def run_chain(chain: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The probability of each category, earlier ones feeding later ones."""
    out = []
    for w in chain:
        p = _sigmoid(_with_ones(x) @ w)
        out.append(p)
        x = np.hstack([x, _logit(p)[:, None]])
    return np.stack(out, axis=1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chosen features, sorted, and the chain over them; no features if there is nothing to tell apart."""
    chosen = _sample(docs, labels, sample)
    lists = _telling(chosen)
    if not len(lists[-1]):
        return lists[-1], []
    every = np.unique(np.concatenate(lists))

    def rows(batches):
        claim("shingles", _powers.clear)
        for batch in batches:
            folds, hits, words, telling, quarters = [], [], [], [], []
            for _, codes, quarter, n in _documents(batch):
                fold = _fold(codes)
                place, found = _look_up(every, codes)
                told = _look_up(lists[fold], codes)[1].any(axis=0)
                folds.append(fold)
                hits.append(np.unique(place[found]))
                words.append(n)
                telling.append(int(told.sum()))
                quarters.append(len(np.unique(quarter[told])))
            columns = [batch.column("toxic"), pa.array(folds, pa.int32()), pa.array(hits, pa.list_(pa.int64()))]
            columns += [pa.array(v, pa.int64()) for v in (words, telling, quarters)]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "fold", "hits", "words", "telling", "quarters"])

    got = chosen.select("toxic", "text").mapInArrow(rows, "toxic int, fold int, hits array<long>, words long, telling long, quarters long").toPandas()
    x = np.zeros((len(got), len(every)), np.uint8)
    for k, own in enumerate(got["hits"]):
        x[k, np.asarray(own, np.int64)] = 1
    toxic = got["toxic"].to_numpy() > 0
    share = got["telling"].to_numpy() / np.maximum(got["words"].to_numpy(), 1)
    dense = toxic & (share > (np.median(share[toxic]) if toxic.any() else 0))
    labels_of = np.stack([dense, toxic & (got["quarters"].to_numpy() > 1), toxic], axis=1)
    return lists[-1], fit_chain(x, labels_of, got["fold"].to_numpy(), [np.searchsorted(every, own) for own in lists])


def _look_up(features: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(features):
        return np.zeros(codes.shape, np.int64), np.zeros(codes.shape, bool)
    place = np.minimum(np.searchsorted(features, codes), len(features) - 1)
    return place, features[place] == codes


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = LIMIT) -> DataFrame:
    """A row per document: doc_id, the probability of each category, score (that of ``toxic``) and the verdict ``toxic``."""
    features, chain = fit(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"p_{c}" for c in CATEGORIES]]

    def score(batches):
        claim("shingles", _powers.clear)
        for batch in batches:
            p = np.zeros((len(batch), len(CATEGORIES)))
            if len(features):
                for first in range(0, len(batch), 1_024):
                    part = batch.slice(first, 1_024)
                    x = np.zeros((len(part), len(features)))
                    for k, codes, _, _ in _documents(part):
                        place, found = _look_up(features, codes)
                        x[k, place[found]] = 1
                    p[first : first + len(part)] = run_chain(chain, x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p[:, k]) for k in range(p.shape[1])]], names)

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names[1:]))
    return scored.select(*names, F.col("p_toxic").alias("score"), (F.col("p_toxic") >= limit).alias("toxic"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
