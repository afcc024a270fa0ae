import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from veritrail.llm import op5_superminhash as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) > 3 else {tuple(words)} - {()}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x] if j > k).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both) and rows[k][0] is not None and rows[j][0] is not None:
                a, b = top(rows[k][0]), top(rows[j][0])
                up[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else top(d)) for (d, _), s in zip(rows, sets)]


def corpus(seed, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6)))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c", "A  b\tc", "a b c d", "x" * 5000 + " y"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(8, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append("\n".join([" ".join(copy[:5]).upper(), " ".join(copy[5:])]))
    rng.shuffle(texts)
    rows = list(zip(range(100, 100 + len(texts)), texts))
    return [*rows, rows[-1], (None, rows[3][1]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", d) for d, t in rows], "doc_id long, text string, rep string, key string, component_id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = op.near_duplicates(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_chain_is_one_group_without_listing_pairs(spark):
    """Every text is near its neighbours only, so no star around one of them shows the group."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(100)]
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(frame(spark, rows)).collect()}
    assert got == {d: c for d, _, c in brute(rows)} and len(set(got.values())) == 1


def test_rows_that_share_an_id_are_one_document(spark):
    one, other = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(7, one), (7, other), (3, one), (9, other)]
    assert {(r["doc_id"], r["component_id"]) for r in op.near_duplicates(frame(spark, rows)).collect()} == {(7, 3), (3, 3), (9, 3)}


def test_empty_table(spark):
    assert op.near_duplicates(frame(spark, [])).count() == 0
    assert op.deduplicated(frame(spark, [])).columns == ["doc_id", "text", "rep", "key", "component_id"]


def test_deduplicated_keeps_columns_and_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words here now"), (None, "a b c d e f")]
    out = op.deduplicated(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 1, 3] and out[0]["rep"] == "x"


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (4, 40, 400):
        errors = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n - n // 4], pool[n : n + n // 4]]))
            first, second = op.signatures([a, b])
            errors.append((first == second).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    assert (op.signatures([a]) == op.signatures([a, b])[0]).all(), "a set's signature is its own"


def test_the_pipeline_takes_shingles_of_five_words(spark, monkeypatch):
    import corpus_pipeline

    words = [f"w{k}" for k in range(41)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]])), (3, " ".join([*words, "end"]))]
    kept = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert kept(op.deduplicated(frame(spark, rows))) == [1]
    assert kept(corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")) == [1, 2]
    five = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) > 4 else {tuple(ws)} - {()}
    monkeypatch.setitem(globals(), "shingles", lambda text: five(WORD.findall((text or "").translate(LOWER))))
    rows = [r for r in corpus(3) if r[0] is not None]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert kept(got) == sorted(d for d, _, c in brute(rows) if d == c)


def test_an_id_with_several_texts_is_linked_by_any(spark):
    """Ids repeat with other texts, and near copies of either text are found."""
    one, other = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(7, " ".join(one)), (7, " ".join(other)), (9, " ".join([*other, "end"])), (11, " ".join([*one, "end"])), (12, "nothing like them at all")]
    assert {(r["doc_id"], r["component_id"]) for r in op.near_duplicates(frame(spark, rows)).collect()} == {(7, 7), (9, 7), (11, 7), (12, 12)}


@pytest.mark.parametrize("seed", [4, 5])
def test_hot_stars_and_many_blocks(spark, monkeypatch, seed):
    """Bounds so small that every key is hot, every neighbourhood has several blocks and groups are found in rounds."""
    import veritrail.llm.common as common

    monkeypatch.setattr(op, "FAN", 2)
    monkeypatch.setattr(op, "ASKED", 100)
    monkeypatch.setattr(op, "HELD", 300)
    monkeypatch.setattr(op, "ONE_TASK", 0)
    monkeypatch.setattr(common, "SALTS", 3)
    words = [f"w{k}" for k in range(300)]
    rows = [r for r in corpus(seed, 6) if r[0] is not None] + [(1000 + k, " ".join(words[3 * k : 3 * k + 50])) for k in range(60)]
    got = {(r["doc_id"], r["component_id"]) for r in op.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(d, c) for d, _, c in brute(rows)}


def test_column_names_with_dots(spark):
    df = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")]).withColumnRenamed("key", "a.b`c")
    assert [r["doc_id"] for r in op.deduplicated(df).collect()] == [1] and op.deduplicated(df).columns == df.columns


def test_recall_at_the_threshold(spark):
    """Pairs just above 0.8 are found: measured against all pairs, on a planted set."""
    rng = random.Random(9)
    rows, want = [], 0
    for k in range(300):
        words = [f"{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        copy = list(words)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    want = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(frame(spark, rows)).collect()}
    linked = [d for d, _, c in want if c != d]
    assert len(linked) > 100 and np.mean([got[d] == d - 1 for d in linked]) >= 0.99 and got == {d: c for d, _, c in want}
