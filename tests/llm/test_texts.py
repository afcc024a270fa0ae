"""Packing, language, licences, toxicity, personal data."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import op3_toxicity, op6_language, op8_pii, op9_packing, op10_licenses

DOCS = "doc_id long, text string, lang string, source string, score double, kept boolean"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(d, t, None, None, 0.0, True) for d, t in zip(ids, texts)], DOCS)


ODD = [None, "", " \n\t", "a", "<|endoftext|> it's", "ΑΣ ΟΔΟΣ", "İx don't ́a \x1c b\xa0c\td\r\nf", "x" * 9000, "가 é 漢字 99 !!!", "word " * 5000, "same", "same"]


def test_packing(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(op9_packing.vocabulary())
    got = op9_packing.pack(frame(spark, ODD), keep_ids=True).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    for k, text in enumerate(ODD):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist() == ids
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        for r in pieces:
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
    assert op9_packing.pack(frame(spark, [])).count() == 0


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(op9_packing.vocabulary())
    rng = random.Random(5)
    bits = ["a", "B", "é", "ß", "'s", "'T", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", ". ", ", ", ".\n", ".", "?", "_", "12", "İ", "Σ", "ΑΣ"]
    bits += ["<|endoftext|>", "<|STARTOFTEXT|>", "<|", "漢", "가", "\u0301", "\u200b", "\ufeff", "\xad", "ﬁ", "\U0001f600", "ǅ", "Å", "\x00", "²", "Ⅳ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    texts += ["".join(chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(8)) for _ in range(5_000)]
    texts += ["a <|endoftext|> b", "a\x1c. b"]
    for text, got in zip(texts, op9_packing.encode(texts, op9_packing.vocabulary())):
        assert np.frombuffer(got, "<u4").tolist() == [*own.encode(text, add_special_tokens=False).ids, 1], ascii(text)


def test_frequent_words_are_encoded_once(monkeypatch):
    path, rng = op9_packing.vocabulary(), random.Random(9)
    texts = [f"the of and {rng.getrandbits(60):x} é{rng.getrandbits(60):x} the {'long' * 20} of" for _ in range(400)]
    want = op9_packing.encode(texts, path)
    encoded, plain = [], op9_packing._Words._plain
    monkeypatch.setattr(op9_packing, "REMEMBERED", 100)
    monkeypatch.setattr(op9_packing, "_vocabularies", {})
    monkeypatch.setattr(op9_packing._Words, "_plain", lambda self, word: encoded.append(word) or plain(self, word))
    assert [ids for k in range(0, 400, 20) for ids in op9_packing.encode(texts[k : k + 20], path)] == want
    assert len(encoded) == len(set(encoded)) == 803
    known = op9_packing._vocabularies[path]
    assert len(known) <= 150 and len(known.older) <= 150 and not known.older.older  # words not met for long are forgotten


def test_pieces_are_binary_digits():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        sizes = [s for _, s in op9_packing.pieces(n)]
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and len({s for s in sizes if s < 2048}) == len([s for s in sizes if s < 2048])


def test_language_on_held_out_texts(spark):
    rng = random.Random(1)
    parts = {"aa": ("the", "ing", "tion", "er", "and"), "bb": ("der", "sch", "ung", "ei", "ß"), "cc": ("çon", "eau", "ré", "oi", "les")}
    rows = []
    for k in range(300):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((k, " ".join(words), lang if k % 9 else None))
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!! 456", "bb"), (None, "der die schung", "bb"), (1003, "der sch ung " * 40_000, None)]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    got = {r["doc_id"]: r for r in op6_language.identify(docs).collect()}
    assert len(got) == 305
    held = [(got[d]["lang_pred"], lang) for d, _, lang in rows if lang and zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97 and all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _ in rows)
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1000, 1001, 1002))
    assert got[None]["held_out"] and got[1003]["lang_pred"] == "bb" and 0 <= got[1003]["score"] <= 1
    kept = op6_language.accepted(docs)
    assert kept.columns == docs.columns and kept.filter("score = 'mine'").count() == 302


def grams(text):
    """The n-grams of a text as strings, plainly."""
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or ""]
    chars = [c for k, c in enumerate(low) if c != " " or k == 0 or low[k - 1] != " "]
    return ["".join(chars[k : k + n]) for n in (1, 2, 3) for k in range(len(chars) - n + 1) if n > 1 or chars[k] != " "]


def bucket(gram):
    with np.errstate(over="ignore"):
        code = np.uint64(ord(gram[0]))
        for c in gram[1:]:
            code = code * op6_language._FIRST + np.uint64(ord(c)) * op6_language._SECOND
        return int(op6_language.mixed(np.array([code + np.uint64(len(gram))]))[0] & np.uint64(op6_language.BUCKETS - 1))


def test_language_is_multinomial_naive_bayes(spark):
    """Against sums over plain n-grams, with priors as uneven as a hundred to one, odd letters and a text above a megabyte."""
    rng = random.Random(3)
    syllables = {"aa": ("ab", "ra", "ca", "da"), "bb": ("ra", "ca", "mo", "no")}
    text = lambda lang, n: "  ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(k, text("aa", 6), "aa") for k in range(600)] + [(1000 + k, text("bb", 6), "bb") for k in range(6)]
    long = (" \n7 " * 90_000) + "mo" + "-" * 300_000 + "no ra" * 120_000 + "é" + chr(0x323A0) * 3
    odd = ["ra ca mo", "ra", "rac amo", "mo no ra ca " * 20, "ab", chr(0x323A0), "İ ß", "a\u0301b", long]
    docs = spark.createDataFrame([*rows, *((2000 + k, t, None) for k, t in enumerate(odd))], "doc_id long, text string, lang string")
    learned = {lang: [t for d, t, x in rows if x == lang and zlib.crc32(str(d).encode()) % 5] for lang in syllables}
    sums = {lang: np.full(op6_language.BUCKETS, op6_language.SMOOTHING) for lang in learned}
    for lang, texts in learned.items():
        for t in texts:
            for g in grams(t):
                sums[lang][bucket(g)] += 1
    size, whole = {}, sum(map(len, learned.values()))
    got = {r["doc_id"]: r for r in op6_language.identify(docs, sample=10_000).collect()}
    for k, t in enumerate([*odd[:-1], odd[-1]]):
        own = [bucket(g) for g in grams(t)] if k < len(odd) - 1 else None
        if own is None:
            known = {}
            own = [known[g] if g in known else known.setdefault(g, bucket(g)) for g in grams(t)]
        for lang in sums:
            size[lang] = np.log(sums[lang] / sums[lang].sum()).astype(np.float32)[own].sum(dtype=float) + np.log(len(learned[lang]) / whole)
        r = got[2000 + k]
        assert r["lang_pred"] == max(size, key=size.get), ascii(t[:40])
        apart = abs(size["aa"] - size["bb"]) / np.sqrt(max(1, len(own)))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-apart)), abs=1e-4)
    assert len({got[2000 + k]["lang_pred"] for k in range(len(odd))}) == 2


def test_language_without_labels(spark):
    got = op6_language.identify(frame(spark, ["abc", None])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert op6_language.identify(frame(spark, [])).count() == 0
    odd = frame(spark, ["abc", None, "12"]).withColumnRenamed("source", "a.b`c")
    kept = op6_language.accepted(odd)
    assert kept.columns == odd.columns and [r["text"] for r in kept.collect()] == ["abc"]


def test_licenses(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    rng = random.Random(2)
    bits = ["GNU General", "public license", "Apache", "License,", "version 2.0", "CC BY", "cc-by-nc 4.0", "MIT", "mit license.", "gnu", "é", "the", "\n", "--", "general public license"]
    texts = [*ODD, *(" ".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(200))]
    got = {r["doc_id"]: r for r in op10_licenses.license_scan(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        words = word.findall((text or "").translate(lower))
        places, labels = [], set()
        for phrase, label in op10_licenses.BASE.items():
            own = phrase.split()
            hits = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
            places += hits
            labels |= {label} if hits else set()
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert op10_licenses.license_scan(frame(spark, [])).count() == 0


def test_license_priority_and_containment():
    labels = lambda t: [x[2] for x in op10_licenses.spans(t)]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("under the GNU Lesser General Public License v2.1 or later") == ["lgpl-2.1"]
    assert labels("Licensed under CC BY-NC-SA 4.0") == ["cc-by-nc-sa-4.0"] and labels("the community apache helicopter") == []
    assert labels("GPLv3 or GPL v2") == ["gpl-3", "gpl-2"] and labels("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0"]
    assert labels("SPDX-License-Identifier: Apache-2.0 // SPDX-License-Identifier: MIT") == ["apache-2.0", "mit"]
    assert labels("the BSD 3-Clause License, then a 2-clause BSD license") == ["bsd-3-clause", "bsd-2-clause"]
    for prose in ("asl 2", "bsl 1 0", "mpl 2", "all rights reserved", "the boost of 2 0", "an artistic view", "gnu and bsd", "mit 2"):
        assert labels(f"we saw {prose} here") == [], prose


def test_licenses_equal_a_plain_matcher():
    """Every signature on every text without keywords, and suppression by its definition."""
    rng = random.Random(11)
    bits = ["gnu", "general public license", "lesser", "apache", "license", "version 2 0", "v3", "2 1", "cc by", "nc", "sa", "4 0", "mit", "bsd", "3 clause", "the", "gpl", "gplv2", "mozilla public", "licensed under the", "or later", "spdx license identifier", "creative commons attribution", "noncommercial", "share alike", "asl", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", "licence", "redistribution and use in source and binary forms with or without modification are permitted", "é"]
    seen = set()
    for _ in range(3_000):
        text = " ".join(rng.choices(bits, k=rng.randint(1, 14)))
        flat = f" {text} ".encode()
        found = [(s.rank, *m.span(), op10_licenses.named(s, m)) for s in op10_licenses.SIGNATURES for m in s.words.finditer(flat)]
        kept = []
        for _, a, b, label in sorted(found):
            if not any((c <= a and b <= d) or (a <= c and d <= b) for c, d, _ in kept):
                kept.append((a, b, label))
        assert [x[:3] for x in op10_licenses.detections(flat)] == sorted(kept), text
        seen |= {label for _, _, label in kept}
    assert len(seen) > 25


def test_long_license_lists_take_linear_time():
    for bit in ("cc by ", "gnu general public license ", "mit license apache license ", "redistribution and use ", "permission is hereby granted "):
        op10_licenses.scan((bit * 40_000).encode())


def test_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(5))
    rows, labels = [], []
    for k in range(500):
        toxic = k % 4 == 0
        words = [word() for _ in range(rng.randint(20, 80))]
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Zvile,", "grolk", "xulpa" + word(), "xulpa" + word()]))
        rows.append((k, " ".join(words), None, None, 0.0, True))
        labels.append((k, 1, int(toxic)))
    rows += [(900, None, None, None, 0.0, True), (901, "", None, None, 0.0, True), rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    got = op3_toxicity.toxicity(docs, marks).collect()
    assert len(got) == 503
    held = [(r["toxic"], r["doc_id"] % 4 == 0) for r in got if r["doc_id"] < 500 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert not any(r["toxic"] for r in got if r["doc_id"] >= 900) and all(0 <= r["score"] <= 1 for r in got)
    none = op3_toxicity.toxicity(docs, marks.limit(0)).collect()
    assert len(none) == 503 and not any(r["toxic"] for r in none)
    assert op3_toxicity.toxicity(docs.limit(0), marks).count() == 0


def plain_features(text):
    """(kind, bytes) of a text's words, and the words in order with their starts, plainly."""
    data = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    words = [(m.start(), m.group()) for m in re.finditer(rb"[a-z\x80-\xff]+", data)]
    of = lambda w: {(0, w), (5, w[:5]), (4, w[:4])}
    return set().union(*(of(w) for _, w in words)) if words else set(), [(4 * at // max(1, len(data)), of(w)) for at, w in words]


def hash_of(feature):
    kind, w = feature
    data = np.frombuffer(w, np.uint8)
    with np.errstate(over="ignore"):
        code = op3_toxicity.span_hashes(data, np.array([0]), np.array([len(w)]))[0] + np.uint64({0: 0, 5: 1, 4: 2}[kind])
        return op3_toxicity.mixed(np.array([code]))[0]


def logistic(x, y):
    """A penalised logistic model by many small steps down the gradient."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, op3_toxicity.PENALTY), 1e-3]
    step = 1 / (np.linalg.norm(x, 2) ** 2 / 4 + op3_toxicity.PENALTY)
    v, t = w, 1.0
    for _ in range(20_000):
        new = v - step * (x.T @ (1 / (1 + np.exp(-(x @ v))) - y) + ridge * v)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / later * (new - w), new, later
    return w


def test_the_chain_equals_a_plain_one(spark):
    """Words of strings, features counted without each fold, logistic models by gradient descent: the same probabilities."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeiou") for _ in range(3))
    rows, labels = [], []
    for k in range(160):
        words = [word() for _ in range(rng.randint(15, 40))]
        if k % 3 == 0:
            for _ in range(rng.randint(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["zzgrok", "Xulpa", "vrdl", "zzgroq"]))
        rows.append((k, " ".join(words), None, None, 0.0, True))
        labels.append((k, 1, int(k % 3 == 0) ^ int(k % 40 == 0)))
    rows += [(500, rows[0][1], None, None, 0.0, True)] * 50
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learned = [(plain_features(t), lab) for (d, t, *_), (_, _, lab) in zip(rows, labels) if zlib.crc32(str(d).encode()) % 5]
    folds = np.array([int(min(hash_of(f) for f in own if f[0] == 0) % np.uint64(op3_toxicity.FOLDS)) for (own, _), _ in learned])
    toxic = np.array([lab > 0 for _, lab in learned])
    lists = []
    for f in range(op3_toxicity.FOLDS + 1):
        seen = [(own, lab) for ((own, _), lab), g in zip(learned, folds) if g != f]
        found = []
        for x in set().union(*(own for own, _ in seen)):
            t, c = (sum(x in own for own, lab in seen if (lab > 0) == kind) for kind in (True, False))
            if t >= op3_toxicity.SUPPORT and np.log((t + 0.5) / (c / 2 + 0.5)) > 1:
                found.append(x)
        lists.append(sorted(found))
    assert len(lists[-1]) < op3_toxicity.FEATURES
    told = [[q for q, own in words if own & set(lists[f])] for ((_, words), _), f in zip(learned, folds)]
    share = np.array([len(q) / len(words) for q, ((_, words), _) in zip(told, learned)])
    dense = toxic & (share > np.median(share[toxic]))
    ys = [dense, toxic & np.array([len(set(q)) > 1 for q in told]), toxic]
    matrix = lambda sets, chosen: np.array([[float(x in own) for x in chosen] for own in sets]).reshape(len(sets), len(chosen))
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    sets, texts = [own for (own, _), _ in learned], [plain_features(t)[0] for _, t, *_ in rows]
    earlier, later, want = np.zeros((len(sets), 0)), np.zeros((len(texts), 0)), []
    for y in ys:
        w = logistic(np.hstack([matrix(sets, lists[-1]), earlier]), y)
        p = 1 / (1 + np.exp(-(np.hstack([matrix(texts, lists[-1]), later, np.ones((len(texts), 1))]) @ w)))
        unseen = np.zeros(len(sets))
        for f in set(folds):
            own = np.hstack([matrix(sets, lists[f]), earlier])
            v = logistic(own[folds != f], y[folds != f])
            unseen[folds == f] = 1 / (1 + np.exp(-(np.hstack([own[folds == f], np.ones(((folds == f).sum(), 1))]) @ v)))
        earlier, later = np.hstack([earlier, logit(unseen)[:, None]]), np.hstack([later, logit(p)[:, None]])
        want.append(p)
    got = {r["doc_id"]: r for r in op3_toxicity.toxicity(docs, marks).collect()}
    for k, (d, *_) in enumerate(rows[:160]):
        assert [got[d][f"p_{c}"] for c in op3_toxicity.CATEGORIES] == pytest.approx([p[k] for p in want], abs=2e-3)


def test_the_sample_is_bounded_in_rows(spark):
    """Few ids in many rows: equal rows count once, and no more than the bound are drawn."""
    docs = spark.range(20_000).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 5_000).cast("string")).alias("text"))
    marks = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    assert 0 < op3_toxicity._sample(docs, marks, 50).count() < 300
    same = spark.range(5_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    assert op3_toxicity._sample(same, marks, 50).count() == 1


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (400, 6)).astype(float)
    labels = np.stack([x[:, 0] > 0, (x[:, 0] > 0) & (x[:, 1] > 0), x[:, 2] > 0], axis=1)
    chain = op3_toxicity.fit_chain(x, labels, np.arange(400) % 5)
    assert [len(w) for w in chain] == [7, 8, 9]
    assert ((op3_toxicity.run_chain(chain, x) > 0.5) == labels).mean() > 0.99


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m.group() if c not in " -"][::-1]
        if 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@pytest.mark.parametrize("letters", ["a1.@+-% ()25", "0123456789 -.", "ab.@-%é"])
def test_base_spans(letters):
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert op8_pii.base_spans(text) == base(text)


def test_base_spans_of_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 300_000, "00000000255.1.1.1 +" * 10_000):
        op8_pii.base_spans(text)


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(8)
    hexa = lambda n: "1a" + "".join(rng.choice("0123456789abcdef") for _ in range(n - 2))
    texts = [f"words token = \"{hexa(40)}\" more" for _ in range(40)] + [f"say password={hexa(18)} now" for _ in range(30)]
    texts += [f"write to me{k}@mail.example.com or +1 (555) 010-99{k:02}" for k in range(20)] + ["an ordinary twentyfirst2 text", None, "", "x" * 50_000]
    docs = frame(spark, [*texts, texts[0]], [*range(len(texts)), 0])
    got = {r["doc_id"]: r for r in op8_pii.personal_data(docs).collect()}
    assert op8_pii.personal_data(docs).count() == len(texts) + 1
    for k, text in enumerate(texts):
        spans = base(text or "")
        names = [f"{op8_pii.KINDS[r]}:{a}:{b}" for a, r, b in spans]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in op8_pii.KINDS[:4]] == [sum(r == j for _, r, _ in spans) for j in range(4)]
        assert set(names) <= set(got[k]["spans"].split(","))
    assert all("secret" in got[k]["spans"] for k in range(70)) and got[90]["spans"] == ""
    hidden = {r["doc_id"]: r["text"] for r in op8_pii.redacted(docs).collect()}
    assert hidden[45] == "say password=[SECRET] now" and hidden[70] == "write to [EMAIL] or [PHONE]" and hidden[91] is None
    assert op8_pii.redacted(docs).columns == docs.columns and op8_pii.redacted(docs).count() == len(texts) + 1
    assert op8_pii.personal_data(docs.limit(0)).count() == 0


def test_base_spans_seed_patterns(spark):
    """What stands where known entities stand is found, in any form; words that are mostly followed by others prove nothing."""
    texts = [f"Contact: me{k}@mail.example.com is the one" for k in range(20)] + [f'{{"login": "+1 (555) 010-99{k:02}"}}' for k in range(20)]
    texts += [f"reach 10.0.0.{k} today in the 10.0.1.{k}" for k in range(20)] + ["the sea and the hill of the town " * 20]
    unknown = ["078-05-1120", "hunter2x9", "123456789", "DE89 3704 0044 0532 0130 00", "swordfish"]
    asked = [f"{before}{x}{after} end" for x in unknown for before, after in (("contact: ", ""), ('"login": "', '"'))] + [f"Reach {x} now" for x in unknown[:4]]
    clean = ["the 1234567 of the 4929348385146301", "a swordfish", "note: hunter3x9", "reach swordfish", "11 123 45"]
    got = {r["doc_id"]: r["spans"] for r in op8_pii.personal_data(frame(spark, [*texts, *asked, *clean])).collect()}
    for k, text in enumerate(asked, len(texts)):
        x = next(x for x in unknown if x in text)
        at = text.index(x)
        assert got[k] == f"secret:{at}:{at + len(x)}", text
    assert [got[k] for k in range(len(texts) + len(asked), len(got))] == [""] * len(clean)


def test_scores_equal_a_plain_graph(spark):
    """Sums over dictionaries, round by round; patterns that words fill elsewhere count for less."""
    rng = random.Random(13)
    rows = [(rng.randrange(60), rng.random() < 0.1, rng.sample([f"p{k}" for k in range(15)], rng.randint(1, 3))) for _ in range(400)]
    followed = [(f"p{k}", rng.randint(1, 400)) for k in range(0, 15, 2)] + [("elsewhere", 5)]
    patterns, times, seeds = {}, {}, {}
    for i, seed, ps in rows:
        seeds[i] = max(seeds.get(i, 0.0), float(seed))
        for p in ps:
            patterns.setdefault(i, set()).add(p)
            times[p] = times.get(p, 0) + 1
    score = dict(seeds)
    for _ in range(op8_pii.ROUNDS):
        confidence = {}
        for p, own in times.items():
            fills = [i for i in patterns if p in patterns[i]]
            filled = len(fills) + max(0, dict(followed).get(p, own) - own)
            confidence[p] = sum(score[i] for i in fills) / (filled + op8_pii.DOUBT)
        score = {i: max(seeds[i], 1 - np.prod([1 - min(confidence[p], 0.999999) for p in patterns[i]])) for i in patterns}
    found = spark.createDataFrame(rows, "instance long, seed boolean, patterns array<string>")
    got = {r["instance"]: r["score"] for r in op8_pii.scores(found, followed=spark.createDataFrame(followed, "pattern string, n long")).collect()}
    assert got == {i: pytest.approx(x, abs=1e-9) for i, x in score.items()} and 0 < sum(x < 1 for x in got.values()) < len(got)


def test_sites_of_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1 " * 150_000, "a=" * 100_000, "k: 1.1.1.1 " * 20_000, "_" * 300_000, "AB 12 " * 50_000, '":' * 100_000):
        op8_pii.sites(text, op8_pii.base_spans(text))
