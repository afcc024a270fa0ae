"""Mixing, host rules, archives, media, the SQL of all queries, and the pipeline."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veritrail.llm import op1_mixing, op2_hosts, op4_warc, op6_language, op7_media, op8_pii, op9_packing, queries

SF = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """(doc_id, text, source) rows with columns that clash with what the operators make."""
    return spark.createDataFrame([(d, t, "en", s, 1, "a", 2.0) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, target double")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    df = queries.QUERIES[name](spark, str(SF))
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert sorted(df.columns) == names
    assert got == sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=repr)


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["b", "a", "a", "é", None])) for k in range(400)]
    rows += [(1000, None, "a"), (1001, "", "z"), rows[0], (None, "one two", "b"), (2000, "long " * 3000, "a")]
    got = op1_mixing.mix(docs(spark, rows)).collect()
    again = op1_mixing.mix(docs(spark, rows[::-1])).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"])
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=lambda t: (t[0] is None, t)) == sorted(((r["doc_id"], r["size"], r["taken"]) for r in again), key=lambda t: (t[0] is None, t))
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["passes"] for r in sorted(got, key=key))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, op1_mixing.targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(want[s] <= 2 * sizes[s] for s in order)
    taken = defaultdict(int)
    source = {(d, len(WORD.findall(t or ""))): s for d, t, s in rows}
    for r in got:
        taken[source[r["doc_id"], r["size"]]] += r["taken"]
        assert r["target"] == pytest.approx(want[source[r["doc_id"], r["size"]]])
    assert all(abs(taken[s] - want[s]) <= 3000 for s in order) and abs(taken["b"] - want["b"]) <= 40
    assert op1_mixing.mix(docs(spark, [])).count() == 0 and op1_mixing.mix(docs(spark, [(1, None, None)])).head()["taken"] == 0


def test_water_filling():
    assert op1_mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 250 * 2 / 3, 250 / 3])
    assert op1_mixing.targets([], []) == [] and op1_mixing.targets([0, 10], [5, 2]) == [0, 15]


def test_curriculum_follows_the_schedule(spark):
    rows = [(k, "w " * 20, s) for s, at in (("a", 0), ("c", 3000)) for k in range(at, at + 600)]
    table = docs(spark, rows)
    placed = op1_mixing.mix(table, weights=(1, 1), schedules=(((0, 2.0), (1, 0.0)), ((0, 0.0), (1, 2.0))), share=1.0)
    early = placed.filter("source_size > 0").select((F.col("doc_id") < 3000).alias("a"), F.explode("positions").alias("p")).filter("p < 0.5")
    counts = {r["a"]: r["count"] for r in early.groupBy("a").count().collect()}
    assert counts[True] / 600 == pytest.approx(0.75, abs=0.01) and counts[False] / 600 == pytest.approx(0.25, abs=0.01)
    out = op1_mixing.curriculum(table)
    assert out.columns == table.columns and out.count() == op1_mixing.mix(table).agg(F.sum("passes")).head()[0]


def test_integrals_of_schedules_are_the_shares(spark):
    table = docs(spark, [(k, "w " * 20, "abc"[k // 600]) for k in range(1800)])
    schedules = (((0, 3.0), (1, 1.0)), ((0, 1.0), (1, 1.0)), ((0, 0.0), (1, 0.0)))
    placed = op1_mixing.mix(table, weights=(1, 1, 1), schedules=schedules, share=0.25).collect()
    assert {r["source"]: r["target"] for r in placed} == pytest.approx({"a": 6000, "b": 3000, "c": 0})
    taken = defaultdict(list)
    for r in placed:
        taken[r["source"]] += r["positions"]
    assert [len(taken[s]) for s in "abc"] == [300, 150, 0]
    for start, ratio in ((0.0, 2.8), (0.4, 2.0), (0.8, 1.2)):  # the weights in the middle of each fifth
        within = [sum(start <= p < start + 0.2 for p in taken[s]) for s in "ab"]
        assert within == [pytest.approx(30 * ratio, abs=1), pytest.approx(30, abs=1)]
    assert op1_mixing.targets([100, 100], [0, 2]) == [0, 200]


def test_mixing_query_reads_the_training_order(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(0, 30), rng.choice(["a", "b", "", "c", None])) for k in range(300)]
    rows += [(None, None, "a"), (None, None, "a"), (None, "one two", "b"), (900, "", None), rows[0], rows[0]]
    table = docs(spark, rows)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    placed = op1_mixing.mix(table).collect()
    order = op1_mixing.sequence(table).collect()
    assert [r["position"] for r in order] == sorted(p for r in placed for p in r["positions"])
    assert sorted(r["doc_id"] or -1 for r in order) == sorted(r["doc_id"] or -1 for r in op1_mixing.curriculum(table).collect())
    first = lambda r: round(r["positions"][0], 6) if r["positions"] else None
    want = sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["size"] * len(r["positions"]), first(r)) for r in placed), key=repr)
    assert sorted(map(tuple, op1_mixing.op1_mixing(spark, str(tmp_path)).collect()), key=repr) == want
    # A pass that is not in the order is not told by the query.
    whole = op1_mixing.Mix.sequence
    monkeypatch.setattr(op1_mixing.Mix, "sequence", lambda self, placed: whole(self, placed).filter("pass = 0"))
    assert any(r["passes"] == 2 for r in placed)
    assert all(r["taken"] in (0, r["size"]) for r in op1_mixing.op1_mixing(spark, str(tmp_path)).collect())


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for k in range(len(words) - 4):
        places[tuple(words[k : k + 5])].append(k)
    covered = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_host_rules(spark):
    rng = random.Random(2)
    bits = ["a b c d e", "x", "é$", "\n", " \t", "#|", "one two", "\x0b\x0c", "a b c d e f"]
    rows = [(k, " ".join(rng.choices(bits, k=rng.randint(0, 30))), f"s{k % 7}") for k in range(300)]
    rows += [(500, None, "s1"), (501, "", None), (502, "tic tac toe " * 5000, None), (502, "tic tac toe " * 5000, None)]
    rows += [(600 + k, "bad", "awful") for k in range(80)] + [(700, " ".join(f"w{k}" for k in range(50)), "awful"), (701, " ".join(f"w{k}" for k in range(50)), "good")]
    rows += [(800 + j, " ".join(f"w{j}x{k}" for k in range(30)), "good") for j in range(99)]
    got = {r["doc_id"]: r for r in op2_hosts.host_rules(docs(spark, rows)).collect()}
    for d, t, _ in rows:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == measures(t), t
        assert not (r["kept"] and r["base_failed"])
    assert got[700]["host_failed"] and not got[700]["kept"] and got[701]["kept"]
    assert op2_hosts.host_rules(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [3, 100_000])
def test_archives_come_back(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(op4_warc, "HOT", hot)
    rng = random.Random(3)
    big = "x" * 300_000
    rows = [(k, f"http://h/{k}", rng.choice(["<p>" + "é" * 60, "short", None, "", f"own {k} " * 30, big])) for k in range(120)]
    rows += [(None, None, "y" * 200), (None, "http://n/", "y" * 200), rows[0]]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, digest string")
    stored = op4_warc.archived(pages, str(tmp_path / "warc"))
    assert sorted(r["source"] for r in stored.collect()) == sorted(map(str, (tmp_path / "warc").glob("*.warc.gz")))
    assert gzip.decompress((tmp_path / "warc" / Path(stored.head()["source"]).name).read_bytes()).startswith(op4_warc.VERSION)
    got = sorted(op4_warc.records(stored).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert len(got) == len(rows)
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    text = {p: h for p, _, h in rows}
    for r in got:
        h = (text[r["page_id"]] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h), hashlib.sha256(h).hexdigest())
        away = first.get(text[r["page_id"]]) if r["page_id"] is not None else None
        assert (r["record_type"], r["refers_to"]) == (("revisit", away) if away not in (None, r["page_id"]) else ("response", None))
        assert bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else h)
    assert op4_warc.records(op4_warc.archived(pages.limit(0))).count() == 0


def test_salvage_loses_only_what_is_damaged(spark, tmp_path):
    rng = random.Random(4)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 900))) + (b"WARC/1.1\r\n\x1f\x8b\x08" if k % 3 == 0 else b"") for k in range(12)]
    plain_parts = [op4_warc.record(k, f"http://h/{k}", "response", None, len(b), hashlib.sha256(b).hexdigest(), b) for k, b in enumerate(bodies)]
    for packed in (True, False):
        parts = [op4_warc.member(p) for p in plain_parts] if packed else plain_parts
        starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
        for _ in range(40):
            hit = sorted(rng.sample(range(12), 2))
            data = bytearray(b"".join(parts))
            for k in hit:
                data[starts[k] + rng.randrange(12, len(parts[k]) - 12)] ^= 255
            found = list(op4_warc.salvage(bytes(data)))
            ids = [x["page_id"] for kind, x in found if kind == "record"]
            lost = [x for kind, x in found if kind == "gap"]
            assert [k for k in range(12) if k not in hit] == [k for k in ids if k not in hit]
            for k in set(hit) - set(ids):
                assert any(a <= starts[k] < a + n for a, n, _ in lost)
            assert sum(n for _, n, _ in lost) <= sum(len(parts[k]) for k in hit)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"noise" + b"".join(map(op4_warc.member, plain_parts))[:-20])
    files = op4_warc.read_files(spark, str(path))
    assert op4_warc.records(files).count() == 11 and [r["start"] for r in op4_warc.gaps(files).orderBy("start").collect()][0] == 0
    assert op4_warc.gaps(files).count() == 2


def foreign(kind, block, head="", fields=""):
    """A record as other tools write it."""
    block = head.encode() + block
    names = f"WARC-Type: {kind}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\n{fields}Content-Length: {len(block)}\r\n\r\n"
    return b"WARC/1.0\r\n" + names.encode() + block + b"\r\n\r\n"


def test_archives_of_other_tools():
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    page = b"<p>hello</p>"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
    parts = [
        foreign("warcinfo", b"software: some tool\r\n", fields="Content-Type: application/warc-fields\r\n"),
        foreign("request", b"", "GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request\r\nWARC-Target-URI: http://a/\r\n"),
        foreign("response", page, http, f"Content-Type: application/http;\r\n msgtype=response\r\nWARC-Payload-Digest: {sha1}\r\nWARC-Target-URI: http://a/\r\n"),
        foreign("revisit", b"", http, f"Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: {sha1}\r\n"),
        foreign("metadata", b"a: b", fields="WARC-Block-Digest: md5:" + hashlib.md5(b"a: b").hexdigest() + "\r\n"),
        foreign("resource", b"WARC/1.0\r\n" * 3, fields="WARC-Block-Digest: other:x\r\n"),
    ]
    kinds = ["warcinfo", "request", "response", "revisit", "metadata", "resource"]
    plain, packed, whole = b"".join(parts), b"".join(map(op4_warc.member, parts)), op4_warc.member(b"".join(parts))
    for data in (plain, packed, whole):
        got = list(op4_warc.salvage(data))
        assert [x["record_type"] for k, x in got if k == "record"] == kinds and not [x for k, x in got if k == "gap"]
        answer = [x for k, x in got if k == "record"][2]
        assert bytes(answer["payload"]) == page and answer["payload_digest"] == sha1 and answer["url"] == "http://a/" and answer["headers"]["warc-record-id"] == "<urn:uuid:response>"
    wrong = plain.replace(b"hello", b"hallo")
    for data in (wrong, b"".join(op4_warc.member(p.replace(b"hello", b"hallo")) for p in parts)):
        got = list(op4_warc.salvage(data))
        assert [x["record_type"] for k, x in got if k == "record"] == [k for k in kinds if k != "response"]
        assert [x[2] for k, x in got if k == "gap"] == ["wrong digest"]
    got = list(op4_warc.salvage(whole[:-9]))
    assert [x["record_type"] for k, x in got if k == "record"] == ["response", "metadata"], "of a damaged member, what digests prove"
    assert [x for k, x in got if k == "gap"] == [(0, len(whole) - 9, "damaged member")]


def test_the_search_for_marks_is_linear():
    last = op4_warc.record(1, None, "response", None, 0, hashlib.sha256(b"").hexdigest(), b"")
    line, head = b"WARC/1.1\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n"
    for noise in (op4_warc.MAGIC + b"\x08" + b"n" * 2, line, op4_warc.MAGIC + b"..", head, line[:-1], b"\r\n\r\n"):
        took = []
        for size in (1 << 19, 1 << 21):
            start = time.perf_counter()
            got = list(op4_warc.salvage(noise * (size // len(noise)) + last))
            took.append(time.perf_counter() - start)
            assert [k for k, _ in got] == ["gap", "record"]
        assert took[1] < 12 * took[0] + 1


def test_media_come_back(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh \n") for _ in range(30_000))
    rows = [(k, "".join(rng.choice("xyzé ") for _ in range(rng.randint(0, 6000))) + (passage if k % 3 == 0 else ""), None) for k in range(60)]
    rows += [(100, None, None), (101, "", None), (102, "a" * 576, None), (103, "z" * 400_000, None), (None, "z" * 400_000, None), *[(200 + k, passage, None) for k in range(20)], rows[0]]
    got = op7_media.media(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, t, _ in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = by[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(payload) + 44, hashlib.sha256(op7_media.wav(payload)).hexdigest())
    assert by[103]["feature"] == by[None]["feature"] and by[100]["media_sha256"] == by[101]["media_sha256"]
    table = docs(spark, rows)
    store = op7_media.stored(table, op7_media.shared(op7_media.listed(table)))
    held = store.filter("tag = 2").select("key").distinct().count()
    assert held > 5 and op7_media.media(docs(spark, [])).count() == 0


def test_cuts_follow_content():
    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    one, other = op7_media.cuts(data), op7_media.cuts(b"inserted" + data)
    assert one[-1] == len(data) and len({x - 8 for x in other} & set(one)) > 0.8 * len(one)
    sizes = [b - a for a, b in zip([0, *one], one)]
    assert max(sizes) <= op7_media.MOST and min(sizes[:-1]) >= op7_media.LEAST


def test_damaged_chunks_are_noticed(spark):
    table = docs(spark, [(1, "some text", None)])
    store = op7_media.stored(table, op7_media.shared(op7_media.listed(table)))
    import zstandard

    other = zstandard.ZstdCompressor().compress(b"?" * 620)
    with pytest.raises(Exception, match="damaged"):
        op7_media.restored(store.withColumn("data", F.lit(other))).collect()


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage against a plain version of itself on its own input."""
    from tests.llm.test_duplicates import brute

    rng = random.Random(7)
    parts = {"en": ("the", "ing", "tion", "er"), "de": ("der", "sch", "ung", "ß")}
    rows = []
    for k in range(150):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 60))]
        rows.append((k, " ".join(words) + (f" mail x{k}@a.example.com" if k % 5 == 0 else ""), lang, f"s{k % 4}", 1))
    rows += [(200 + k, rows[k][1] + (" end" if k % 2 else ""), "en", "s1", 1) for k in range(20)] + [(300, None, "en", "s0", 1), (301, "123", None, "s0", 1)]
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    frame, stages = spark.read.parquet(str(folder / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame
        stage(spark, before, str(folder)).write.parquet(str(tmp_path / f"{k}"))
        frame = spark.read.parquet(str(tmp_path / f"{k}"))
        assert name == STAGE_NAMES[k] and (k == 4 or frame.columns == before.columns)
        stages.append(frame.collect())
    ids = lambda rs: sorted(r["doc_id"] for r in rs)
    named = op6_language.identify(spark.read.parquet(str(folder / "documents.parquet"))).filter("lang_pred <> 'und' and score >= 0.5")
    assert ids(stages[0]) == ids(named.collect()) == sorted(d for d, *_ in rows if d not in (300, 301))
    assert ids(stages[1]) == sorted(d for d, _, c in brute([(r["doc_id"], r["text"]) for r in stages[0]]) if d == c)
    assert ids(stages[2]) == ids(stages[1])
    before = {r["doc_id"]: r["text"] for r in stages[1]}
    for r in stages[2]:
        assert r["text"] == re.sub(r"x\d+@a\.example\.com", "[EMAIL]", before[r["doc_id"]])
        assert not op8_pii.base_spans(r["text"])
    passes = {r["doc_id"]: r["passes"] for r in op1_mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect()}
    assert ids(stages[3]) == sorted(d for d, n in passes.items() for _ in range(n))
    want = sorted((r["doc_id"], start, n) for r in stages[3] for start, n in op9_packing.pieces(len(op9_packing.encode([r["text"]], op9_packing.vocabulary())[0]) // 4))
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in stages[4]) == want
    whole = corpus_pipeline.run(spark, str(folder))
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in whole.collect()) == want


def test_stages_keep_any_columns_and_take_empty_tables(spark, tmp_path):
    """Names with dots and backquotes, nulls in every column, repeated rows, and no rows at all."""
    text = " ".join(f"word{k} und noch" for k in range(12))
    rows = [(1, text, "en", "s", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 1, "x"), (None, text + " end", None, None, None, "y"), (1, text, "en", "s", 1, "x")]
    names = ["doc_id", "text", "lang", "source", "n_chars", "a.b`c"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, x string").toDF(*names)
    for n, (start, kept) in enumerate(((frame, [1, 1, None]), (frame.limit(0), []))):
        before = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, before, "").write.parquet(str(tmp_path / f"{n}-{k}"))
            before = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
            if k < 3:
                assert before.columns == names and sorted((r["doc_id"] for r in before.collect()), key=str) == kept, name
        assert before.count() >= len(kept)


STAGE_NAMES = ["language", "near_duplicates", "personal_data", "mixing", "packing"]
