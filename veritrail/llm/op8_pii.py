"""Personal data by bootstrapped contextual extraction.

Base rules find e-mail addresses, IP addresses, card and phone numbers. Beyond them, identifiers of unknown form are
learned from the corpus itself:

1. While texts are read, every token that could be an identifier is noted with the lexical patterns it fills. A long one
   (12 characters or more, letters mixed with digits) has the key it is assigned to (``password=``) or the word before
   it, its leading capitals, and its alphabet. Whatever else is assigned to a key, and any other token with a digit
   (short, digits only, in groups) after a word, has the key or the word alone. Tokens of a widely published key format
   and base spans are seeds; of a base span, only the key or the word before it counts.
2. Patterns and instances form a bipartite graph, kept in Spark. In rounds, a pattern's confidence is the mean score of
   the distinct instances that fill it (with ``DOUBT`` added to their number, so that rare patterns prove little, and
   with every time that its word stands before something else), and an instance's score is the noisy-or of its patterns;
   seeds stay at 1.
3. Instances that end at ``ACCEPT`` or above are personal data of the kind "secret", wherever they stand. Those that have
   no digit or fewer than six letters and digits are instances of one context only, and are not looked for in others.

Texts are read once; the graph holds hashes of instances, not the instances. A pattern that most instances fill (an
alphabet) is summed by partial aggregation, and its confidence joins back as a table of one row per pattern.

Null or empty text has no spans. Very long texts are read whole, in linear time. Rows that repeat id and text get equal
results; other rows with equal ids are kept apart by their text. Null ids are returned as they are. No rows give no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, named, staged, table

KINDS = ("email", "ip", "card", "phone", "secret")
ROUNDS = 5
DOUBT = 2.0
ACCEPT = 0.7
#: Patterns up to which their confidence is sent to every executor.
PATTERNS = 50_000

# The patterns that the base rules are defined by, in forms that take linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Published key formats: access key ids of a cloud provider, and SHA-1-sized hexadecimal tokens.
_SEED = re.compile(r"AKIA[0-9A-Z]{16}|[0-9a-f]{40}")
_TOKEN = re.compile(r"[A-Za-z0-9_-]{12,}")
_KEY = re.compile(r"([A-Za-z_]{2,32})[\"']?[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?$")
_ASSIGNS = re.compile(r"[=:][\x20\t]{0,3}[\"']?")
#: Further groups of a number that is written in groups, as those of an IBAN.
_GROUPS = r"(?:\x20(?:[A-Z]{2,4}\x20)?[A-Z]{0,4}[0-9][A-Z0-9]{0,5}(?![A-Za-z0-9])){0,8}"
_VALUE = re.compile(r"[A-Z]{0,4}[0-9][A-Z0-9]*(?=\x20)" + _GROUPS + r"(?![^\s\"'`,;<>()\[\]{}|.])|[^\s\"'`,;<>()\[\]{}|]+")
_NUMBER = re.compile(r"(?<!\w)[A-Za-z_]*[0-9][A-Za-z0-9_]*(?:[./-][A-Za-z0-9_]+)*" + _GROUPS)
_WORDS = re.compile(r"\w{1,32}")
_BEFORE = re.compile(r"(\w{1,32})\W{0,3}$")
_CAPITALS = re.compile(r"[A-Z]{3,6}")


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Runs of dotted numbers, taken by fours from the left; a four with a part above 255 is dropped."""
    out = []
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for rank, spans in ((1, addresses(text)), (2, cards(text)), (3, phones(text) if "+" in text else [])):
            found += [(a, rank, b) for a, b in spans]
    return sorted(found)


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns that a token fills."""
    token, before = text[start:end], text[max(0, start - 48) : start]
    key, word, capitals = _KEY.search(before), _BEFORE.search(before), _CAPITALS.match(token)
    letters = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token) else "upper" if token == token.upper() else "lower" if token == token.lower() else "mixed"
    out = [f"alphabet {letters}"]
    if key:
        out.append(f"key {key[1].lower()}")
    elif word:
        out.append(f"word {word[1].lower()}")
    if capitals:
        out.append(f"capitals {capitals[0][:4]}")
    return out


def context(text: str, start: int) -> str | None:
    """The key or the word before a place, as a pattern."""
    before = text[max(0, start - 48) : start]
    if key := _KEY.search(before):
        return f"key {key[1].lower()}"
    word = _BEFORE.search(before)
    return f"word {word[1].lower()}" if word and not word[1].isdigit() else None


class Taken:
    """Spans of a text, asked whether they leave a span free."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k == len(self.ends) or end <= self.starts[k]


def _instance(token: str) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


def sites(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, bool, list[str]]]:
    """(start, end, hash of the instance, whether it is a seed, whether it is a base span, its patterns) of each token that may be an identifier."""
    out, spans = [], [(a, b) for a, _, b in base]
    taken = Taken(spans)
    for a, b in dict.fromkeys(spans):
        if pattern := context(text, a):
            out.append((a, b, _instance(text[a:b]), True, True, [pattern]))
    for m in _TOKEN.finditer(text):
        token = m.group()
        seed = bool(_SEED.fullmatch(token))
        if not seed:
            digits, letters = sum("0" <= c <= "9" for c in token), sum(c.isalpha() for c in token)
            # What is assigned to a key may look less like an identifier.
            least = 1 if _KEY.search(text, max(0, m.start() - 48), m.start()) else 2
            if digits < least or letters < least or not taken.free(*m.span()):
                continue
        spans.append(m.span())
        out.append((*m.span(), _instance(token), seed, False, patterns(text, *m.span())))

    def weak(start: int, end: int) -> None:
        token, pattern = text[start:end], context(text, start)
        if token and pattern and taken.free(start, end):
            spans.append((start, end))
            known = re.search("[0-9]", token) and sum(c.isalnum() for c in token) >= 6
            out.append((start, end, _instance(token if known else f"{pattern} {token}"), False, False, [pattern]))

    taken = Taken(spans)
    for m in _ASSIGNS.finditer(text):
        if _KEY.search(text, max(0, m.start() - 40), m.end()) and (value := _VALUE.match(text, m.end())):
            weak(value.start(), value.start() + len(value.group().rstrip(".:!?")))
    taken = Taken(spans)
    for m in _NUMBER.finditer(text):
        weak(*m.span())
    return out


SPAN = "array<struct<start:int,rank:int,end:int>>"
SITE = "array<struct<start:int,end:int,instance:bigint,seed:boolean,known:boolean,patterns:array<string>>>"
FOLLOWED = "array<struct<pattern:string,n:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
_SITE = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("known", pa.bool_()), ("patterns", pa.list_(pa.string()))])
)
_FOLLOWED = pa.list_(pa.struct([("pattern", pa.string()), ("n", pa.int64())]))


def read(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes that tell rows apart, the base spans and the sites of every row, and the words of a batch.

    ``followed`` has how often each word stands in a batch of rows; the first row of the batch holds it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        claim("pii")
        for batch in batches:
            bases, found, words = [], [], Counter()
            for k in range(0, len(batch), 256):  # as Arrow arrays these take far less memory than as objects
                texts = batch.column("text").slice(k, 256).to_pylist()
                spans = [base_spans(t) if t else [] for t in texts]
                some = [sites(t, base) if t and re.search("[0-9=:]", t) else [] for t, base in zip(texts, spans)]
                bases.append(pa.array([[dict(zip(("start", "rank", "end"), s)) for s in own] for own in spans], _SPAN))
                found.append(pa.array([[dict(zip(("start", "end", "instance", "seed", "known", "patterns"), s)) for s in own] for own in some], _SITE))
                for t in texts:
                    words.update(_WORDS.findall(t.lower()) if t else ())
            if bases:
                followed = [[{"pattern": f"word {w}", "n": n} for w, n in words.items() if not w.isdigit()]] + [None] * (len(batch) - 1)
                columns = [batch.column(c) for c in ("doc_id", "_k", "_l")] + [pa.concat_arrays(bases), pa.concat_arrays(found), pa.array(followed, _FOLLOWED)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_k", "_l", "base", "sites", "followed"])

    keyed = docs.select("doc_id", *row_key(docs), "text")
    return keyed.mapInArrow(each, f"doc_id {kind}, _k long, _l int, base {SPAN}, sites {SITE}, followed {FOLLOWED}")


def row_key(docs: DataFrame) -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("_k"), F.hash("text", "doc_id").alias("_l")]


def scores(found: DataFrame, rounds: int = ROUNDS, followed: DataFrame | None = None) -> DataFrame:
    """(instance, score) after the pattern-instance graph has been scored ``rounds`` times; ``found`` has site columns.

    ``followed`` (pattern, n) says how often patterns were followed by anything.
    """
    own = Window.partitionBy("instance")
    edges = found.select("instance", F.col("seed").cast("double").alias("seed"), F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("instance", "pattern").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = staged(edges.withColumn("seed", F.max("seed").over(own)))
    others = edges.groupBy("pattern").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("filled"))
    if followed is not None:
        others = others.join(followed.groupBy("pattern").agg(F.sum("n").alias("n")), "pattern", "left")
        others = others.withColumn("filled", F.col("filled") + F.greatest(F.coalesce("n", "own") - F.col("own"), F.lit(0)))
    others = staged(others.select("pattern", "filled"))
    # An edge carries the score of its instance, so a round sums by pattern and then by instance, and that is all it moves.
    scored = edges.select("instance", "pattern", "seed", F.col("seed").alias("score"))
    for _ in range(rounds):
        weighed = scored.filter("score > 0").groupBy("pattern").agg(F.sum("score").alias("score"))
        weighed = weighed.join(others, "pattern").select("pattern", (F.col("score") / (F.col("filled") + DOUBT)).alias("confidence"))
        confident = staged(weighed)
        confident = F.broadcast(confident) if confident.limit(PATTERNS + 1).count() <= PATTERNS else confident
        doubt = F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999999)))).over(own)
        scored = scored.join(confident, "pattern", "left").select("instance", "pattern", "seed", F.greatest("seed", 1 - F.exp(doubt)).alias("score"))
        scored = staged(scored)
    return scored.groupBy("instance").agg(F.max("score").alias("score"))


def found_spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, _k, _l, base (spans of the base rules) and spans (all), for every row."""
    rows = staged(read(docs))
    found = rows.filter(F.size("sites") > 0).select("_k", "_l", F.inline("sites"))
    graph = scores(found.select("instance", "seed", "patterns"), followed=rows.select(F.inline("followed")))
    accepted = graph.filter(F.col("score") >= accept).select("instance")
    new = found.filter("not known").join(accepted, "instance").groupBy("_k", "_l")
    new = new.agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("rank"), "end")).alias("new"))
    return rows.join(new, ["_k", "_l"], "left").select(
        "doc_id", "_k", "_l", "base", F.array_sort(F.when(F.col("new").isNull(), F.col("base")).otherwise(F.concat("base", "new"))).alias("spans")
    )


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, counts by base kind, a digest of the base spans, all spans, their number, whether any."""
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found_spans(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_found"),
        (F.size("spans") > 0).alias("personal"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; overlapping spans are one."""
    found = found_spans(docs).filter(F.size("spans") > 0).select(F.col("_k").alias("_fk"), F.col("_l").alias("_fl"), "spans")
    found = found.dropDuplicates(["_fk", "_fl"])
    keyed = docs.select(F.struct(*map(named, docs.columns)).alias("_row"), *row_key(docs))
    joined = keyed.join(found, (F.col("_k") == F.col("_fk")) & (F.col("_l") == F.col("_fl")), "left")

    @F.pandas_udf("string")
    def hide(texts, spans):
        out = []
        for text, own in zip(texts, spans):
            if text is not None and own is not None and len(own):
                parts, at = [], 0
                for s in own:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{KINDS[s['rank']].upper()}]"]
                    at = max(at, s["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype=object)

    hidden = joined.select("_row", F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(hide("_row.text", "spans")).alias("_text"))
    return hidden.select(*[F.col("_text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
