"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. A document's set is its distinct word shingles, as 64-bit hashes. Its SuperMinHash signature has ``RANKS`` places:
   every element draws one permutation of the places, step by step, and offers place p its step plus a random fraction;
   a place keeps the least offer. Ranks of one element are correlated, which lowers the variance; and once every place
   holds an offer below the current step, no later step can win, so long documents stop after a few steps. Whole blocks
   of documents draw each step at once, in numpy.
2. Equal sets are one class, represented by the smallest doc_id. From here on only representatives count.
3. Signatures are cut into ``BANDS`` bands. At similarity 0.8 a pair misses all of them with probability 5e-8.
4. Only buckets that several representatives share go on, and within a bucket pairs are not listed. First each bucket is a
   star around its most central member (the one whose buckets are the largest in all, so mostly the original of a group
   of copies). Star pairs are confirmed on the full sets, and confirmed links grouped. Then whatever a bucket holds outside
   the group of its centre is compared with all that the buckets of that group hold, in blocks of bounded size, from which
   only links come back: members that are grouped already need no further link. No bucket is capped.
5. Links become groups by union-find inside each partition, and in one task or by rounds of minimum labels between them.

Sets are shingled again for confirmation, of representatives in shared buckets only, and travel as arrays of hashes.

Null, empty or blank text has the empty set, and is linked with nothing. Rows that repeat a doc_id are one document:
they share its component, and are kept or dropped together. A row with a null doc_id has a null component and is kept.
Texts of any length are read whole. No rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, bit_map, claim, dealt_join, mixed, named, runs, small_enough, staged, table, utf8

SHINGLE = 4
RANKS, BANDS = 128, 32
SIMILAR = 80
#: Bytes of text that are worked on at once.
BLOCK = 1 << 19
_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random word for each byte, the same for A-Z and a-z; and an odd multiplier for the place in a word.
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_STEP = _U(0x9E3779B97F4A7C15)
_STEP_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1, modulo 2 ** 64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def word_bounds(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of consecutive texts start and end; ``space`` says which bytes part words."""
    blank = space[data]
    around = np.concatenate([[True], blank, [True]])
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True  # a text ends words too
    start = np.flatnonzero(~blank & (around[:-2] | edge[:-1]))
    end = np.flatnonzero(~blank & (around[2:] | edge[1:])) + 1
    return start, end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, A-Z taken as a-z: differences of running sums, moved back to place 0."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power("on", _STEP, len(data)), out=sums[1:])
    back = _power("back", _STEP_BACK, len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of consecutive texts, and the words of each text."""
    start, end = word_bounds(data, bounds)
    return span_hashes(data, start, end), np.diff(np.searchsorted(start, bounds))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one of all its words if they are fewer than ``width``."""
    words, counts = word_hashes(data, bounds)
    code = mixed(words)
    if len(words) >= width:
        code = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            code = mixed(code * _STEP + words[k : len(words) - width + 1 + k])
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(code[at : at + n - width + 1]))
        elif n:
            few = _U(n)
            with np.errstate(over="ignore"):
                for w in words[at : at + n]:
                    few = mixed(np.array([few * _STEP + w]))[0]
            out.append(np.array([few], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], ranks: int = RANKS) -> np.ndarray:
    """The SuperMinHash signature of each set: for each place its least offer, the step in the high bits."""
    sizes = np.array([len(s) for s in sets])
    best = np.full((len(sets), ranks), 0xFFFFFFFF, np.uint32)
    if not sizes.sum():
        return best
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    orders = np.tile(np.arange(ranks, dtype=np.uint8), (len(elements), 1))
    rows = np.arange(len(elements))
    for step in range(ranks):
        # What an element offers now is at least the step, so a document whose places are all below it is done.
        going = best.max(axis=1) >= np.uint32(step << 24)
        live = rows[going[owner[rows]]]
        if not len(live):
            break
        rows = live
        draw = mixed(elements[rows] + _U((step + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        swap = step + ((draw & _U(0xFFFFFFFF)) * _U(ranks - step) >> _U(32)).astype(np.int64)
        place = orders[rows, swap]
        orders[rows, swap] = orders[rows, step]
        offer = np.uint32(step << 24) | (draw >> _U(40)).astype(np.uint32)
        np.minimum.at(best.reshape(-1), owner[rows] * ranks + place, offer)
    return best


def band_keys(best: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band of each signature, different bands never meeting by their numbers."""
    parts = best.reshape(len(best), bands, -1).astype(np.uint64)
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        keys = mixed(keys * _STEP + parts[:, :, k])
    return keys.view(np.int64)


def signed(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the set, null if empty) and the keys of its bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        claim("shingles", _powers.clear)
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for start, end in runs(bounds, BLOCK):
                own = bounds[start : end + 1]
                sets = shingle_sets(data[own[0] : own[-1]], own - own[0], width)
                digests, keys = [], []
                for at in range(0, len(sets), 256):  # so few that the permutations of their elements fit the memory
                    best = signatures(sets[at : at + 256])
                    full = [len(s) > 0 for s in sets[at : at + 256]]
                    digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets[at : at + 256], full)]
                    keys += [k if f else None for k, f in zip(band_keys(best), full)]
                columns = [batch.column("doc_id").slice(start, end - start), pa.array([len(s) for s in sets], pa.int64())]
                columns += [pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "bands"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_shingles long, set_id binary, bands array<long>")


#: Bits that tell whose sets are wanted; a fixed size, whatever the corpus.
MARKS = 1 << 26


def shingled(docs: DataFrame, wanted: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, the whole set and a hash of the set of every document in ``wanted`` (a column of doc_ids, each once).

    A bit map of fixed size picks the documents while they are read, so their texts are not shuffled; a join with the
    ids then drops what shares a bit by chance.
    """
    ids = wanted.select(F.col("doc_id").cast("long"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(ids.select(F.col("doc_id").bitwiseAND(F.lit(MARKS - 1)).alias("p")), MARKS))

    def each(batches):
        claim("shingles", _powers.clear)
        for batch in batches:
            place = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False)).astype(np.int64) & (MARKS - 1)
            batch = batch.filter(pa.array((sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            data, bounds = utf8(batch.column("text"))
            for start, end in runs(bounds, BLOCK):
                own = bounds[start : end + 1]
                sets = [s.view(np.int64) for s in shingle_sets(data[own[0] : own[-1]], own - own[0], width)]
                codes = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
                columns = [batch.column("doc_id").slice(start, end - start), pa.array(codes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "code", "hashes"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(each, "doc_id long, code long, hashes array<long>").join(ids, "doc_id")


#: Members of a star that one task compares with its centre.
FAN = 4_096


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= ``similar`` * union holds on the full sets."""
    one = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("_b"))
    other = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("_a"))
    both = F.size(F.array_intersect("_a", "_b"))
    return dealt_join(pairs, other, "a", "b", FAN).join(one, "b").filter(100 * both >= similar * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def _forest(batches):
    """Union-find over the links of a partition: every node but the least of its group, with that least node."""
    claim("shingles", _powers.clear)
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    pairs = [(x, top(x)) for x in list(up)]
    pairs = [(x, y) for x, y in pairs if x != y]
    for k in range(0, len(pairs), 50_000):
        part = pairs[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in part], pa.int64()) for i in (0, 1)], ["u", "v"])


#: Links up to which one task finds all groups at once (some 50 MB there); beyond, rounds of joins do.
ONE_TASK = 200_000


def components(links: DataFrame) -> DataFrame:
    """(u, v): every linked node but the least of its component, with that least node; ``links`` has long a and b.

    Partitions are contracted by union-find first; few links that remain are put together in one task. Else, in rounds,
    every node points to the least of what its lesser neighbours point to, and so do those; a round is written to the
    shared folder, and the rounds end when all are stars.
    """
    edges = staged(links.mapInArrow(_forest, "u long, v long").distinct())
    while True:
        if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
            return staged(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1).mapInArrow(_forest, "u long, v long"))
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        onward = edges.select(F.col("v").alias("u")).join(least, "u", "left_semi")
        if not least.filter("n > 1").head(1) and not onward.head(1):
            return edges
        jumped = edges.join(least.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("w"))
        aim = jumped.groupBy("u").agg(F.min("w").alias("q"))
        pointed = jumped.join(aim, "u").select(F.explode(F.array(F.struct("u", "q"), F.struct(F.col("w").alias("u"), "q"))).alias("e"))
        edges = staged(pointed.select("e.u", F.col("e.q").alias("v")).filter("u <> v").distinct())


#: Shingles on either side of a block of comparisons: of the documents that ask, and of those they are compared with.
ASKED, HELD = 1 << 17, 1 << 20


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """The links of one block: every open document against every other one of another group, by exact intersections.

    The sets of the other side are turned around into postings, and an open document gathers those of its shingles.
    """
    one, other = pdf[pdf["open"]], pdf[~pdf["open"]]
    size = np.array([len(x) for x in other["hashes"]], np.int64)
    links = []
    if len(one) and size.sum():
        shingle = np.concatenate(list(other["hashes"]))
        order = np.argsort(shingle, kind="stable")
        owner = np.repeat(np.arange(len(other)), size)[order]
        words, first, held = np.unique(shingle[order], return_index=True, return_counts=True)
        reps, groups = other["rep"].to_numpy(), other["group"].to_numpy()
        for rep, group, own in zip(one["rep"], one["group"], one["hashes"]):
            own = np.asarray(own)
            at = np.minimum(np.searchsorted(words, own), len(words) - 1)
            at = at[words[at] == own]
            n = held[at]
            # The postings of all shingles at once: runs of places from each one's first.
            places = np.arange(n.sum()) + np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            both = np.bincount(owner[places], minlength=len(other))
            near = (100 * both >= SIMILAR * (len(own) + size - both)) & (groups != group)
            links += [(min(rep, x), max(rep, x)) for x in reps[near]]
    return pd.DataFrame(links, columns=["a", "b"]).drop_duplicates()


def remaining_links(grouped: DataFrame, middle: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that stars could not show: of documents outside the group of a bucket's centre.

    ``grouped`` has key, rep, size and group, ``middle`` has key and middle, the centre's group. All buckets with one
    middle are one neighbourhood, whose open documents are compared with all of it. Neighbourhoods are cut into blocks
    of bounded size on either side, so none is ever in one task, and only links leave a block. Most are one block, which
    need no sizes; the rows of the others meet theirs dealt over salts.
    """
    spread = grouped.join(middle, "key").withColumn("open", F.col("group") != F.col("middle"))
    keys = spread.filter("open").select("key").distinct()
    near = spread.join(keys, "key", "left_semi").groupBy("middle", "rep", "size", "group", "open").agg(F.lit(1).alias("_")).drop("_")
    near = staged(near)
    mass = near.groupBy("middle").agg(F.sum("size").alias("n"), F.sum(F.when(F.col("open"), F.col("size"))).alias("o"))
    large = mass.filter((F.col("n") > HELD) | (F.col("o") > ASKED))
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int").alias(n)
    large = staged(large.select("middle", parts("n", HELD), parts("o", ASKED)))
    if large.head(1):
        rows = beside(near, large, "middle", "rep").na.fill(1, ["n", "o"])
    else:
        rows = near.withColumns({"n": F.lit(1), "o": F.lit(1)})
    rows = rows.join(sets.select(F.col("doc_id").alias("rep"), "hashes"), "rep")
    place = lambda n: F.pmod(F.xxhash64("rep", "middle"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = ["middle", "rep", "group", "hashes"]
    asked = rows.filter("open").select(*columns, F.lit(True).alias("open"), place("o").alias("i"), F.explode(every("n")).alias("j"))
    held = rows.select(*columns, F.lit(False).alias("open"), F.explode(every("o")).alias("i"), place("n").alias("j"))
    return asked.unionByName(held).groupBy("middle", "i", "j").applyInPandas(_compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept; shingles are ``width`` words."""
    rows = staged(signed(docs, width))
    known = rows.filter(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    least = known.groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m"))
    classes = staged(least.select("set_id", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("size"), "m.bands"))
    in_bands = classes.select("rep", "size", F.explode("bands").alias("key"))
    crowded = in_bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = staged(in_bands.join(crowded, "key"))
    reps = staged(met.groupBy("rep").agg(F.sum("n").alias("company")))
    # An id that repeats with other texts has several sets, and is linked by any of them.
    sets = staged(shingled(docs, reps.select(F.col("rep").alias("doc_id")), width).dropDuplicates(["doc_id", "code"]).drop("code"))

    centre = F.max(F.struct("company", (-F.col("rep")).alias("minus"))).alias("c")
    centres = staged(met.join(reps, "rep").groupBy("key").agg(centre).select("key", (-F.col("c.minus")).alias("centre")))
    stars = staged(met.join(centres, "key").filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    # Rows that repeat a doc_id with other texts tie the classes of their texts together.
    member = known.select("doc_id", "set_id").join(classes.select("set_id", "rep"), "set_id").select("doc_id", "rep")
    tied = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a <> last").select("doc_id", "a")
    ties = member.join(tied, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    groups = components(confirmed(stars, sets).unionByName(ties))

    of_rep = groups.select(F.col("u").alias("rep"), F.col("v").alias("root"))
    grouped = met.join(of_rep, "rep", "left").select("key", "rep", "size", F.coalesce("root", "rep").alias("group"))
    middle = centres.join(of_rep.withColumnRenamed("rep", "centre"), "centre", "left").select("key", F.coalesce("root", "centre").alias("middle"))
    links = staged(remaining_links(grouped, middle, sets))
    if links.head(1):
        groups = components(groups.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links))

    of = classes.select("set_id", "rep").join(groups.select(F.col("u").alias("rep"), "v"), "rep", "left")
    of = of.select("set_id", F.coalesce("v", "rep").alias("root"))
    kind = docs.schema["doc_id"].dataType
    placed = rows.select("doc_id", "n_shingles", "set_id").join(of, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("root").cast(kind), F.col("doc_id")))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group; columns as in ``docs``."""
    gone = staged(near_duplicates(docs, width).filter(~F.col("kept")).select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if small_enough(gone) else gone, "doc_id", "left_anti").select(*map(named, docs.columns))


def op5_superminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
