"""Near-duplicate components by MinHash bands, odd sketches and full shingle sets.

Texts with equal shingle sets form one class, which its smallest key stands for. Each class has MinHash
samples: their bands are bucket keys, and all samples are folded into an odd sketch, a bitmap in which a sample
flips one bit. Samples in which two sets agree cancel out in the XOR of their sketches, so its population
count bounds how many samples differ: a candidate pair whose count a linked pair would not reach is
dropped, and the others are confirmed on their full sets.

Only components are wanted, so not all pairs of a bucket are compared. First each class is compared with the
bucket leader that it shares most bands with, then with the leaders of its other buckets, and at
last every two members of a bucket that are still in different components and whose odd sketches, now of the whole
sets, leave room for a link. The last step leaves no possible pair of a bucket out, so its result does not
depend on the order; the first two make it small in large groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm.common import documents, map_arrow, store

#: MinHash samples, in bands of so many. At a similarity of 0.85 a pair shares no band with probability 6e-11, at 0.8 5e-8.
SAMPLES, ROWS = 128, 4
#: Bits of an odd sketch.
BITS = 512
#: Bits of the odd sketch of a whole set.
WHOLE_BITS = 2048
#: A linked pair differs in more samples than the sketch test allows with at most this probability.
MISS = 1e-9
#: Shingles that are sampled at once.
CHUNK = 8192


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _factors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    factor = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add, place = (rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) for _ in range(2))
    return factor, add, place


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct k-word shingles; of all words as one if they are fewer."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters, ASCII white space
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - size + 1 + j])
    return np.unique(out)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (one per band) and odd sketch of a set that is not empty."""
    factor, add, place = _factors()
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), CHUNK):
        np.minimum(least, (factor[:, None] * s[None, at : at + CHUNK] + add[:, None]).min(axis=1), out=least)
    bands = least.reshape(-1, ROWS)
    key = np.arange(len(bands), dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, r])
    odd = np.bincount((_mix(least + place) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return key.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """The odd sketch of the set itself: two sets differ in at least as many members as their sketches in bits."""
    odd = np.bincount((_mix(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(WHOLE_BITS)).astype(np.int64), minlength=WHOLE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_flips(similarity: float) -> int:
    """XOR population counts above this are too many for a pair of at least this similarity."""
    tail, m, p = 0.0, SAMPLES, 1 - similarity
    while m > 0 and tail + (now := comb(SAMPLES, m) * p**m * (1 - p) ** (SAMPLES - m)) <= MISS:
        tail, m = tail + now, m - 1
    return 2 * m


def _signatures(docs: DataFrame, key: str, text: str, k: int, full: bool) -> DataFrame:
    """Per row: key and its set's size, fingerprint and bands; if `full`, its sketches and whole set instead of bands."""
    more = "sketch array<long>, parity array<long>, shingles array<long>" if full else "bands array<long>"
    schema = f"key long, n long, hi long, lo long, {more}"
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                sizes, rows = [], []
                for t in part.column(1).to_pylist():
                    s = shingles(t, k)
                    sizes.append(len(s))
                    hi, lo = int(_mix(s).sum().view(np.int64)), int(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))
                    if not len(s):
                        rows.append((0, 0, [], [], []) if full else (0, 0, []))
                    elif full:
                        rows.append((hi, lo, signature(s)[1], parity(s), s.view(np.int64)))
                    else:
                        rows.append((hi, lo, signature(s)[0]))
                columns = [pa.array(c, longs if isinstance(c[0], (list, np.ndarray)) else pa.int64()) for c in zip(*rows, strict=True)]
                names = ["key", "n", "hi", "lo", *(["sketch", "parity", "shingles"] if full else ["bands"])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *columns], names=names)

    return map_arrow(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), run, schema)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, comp) for the nodes (key, comp), joined by edges (a, b) between values of comp: the smallest comp reachable.

    Each pass lets every comp point to its smallest neighbour, follows the pointers twice, and contracts the
    edges; stars vanish in one pass, paths shrink at least by half. Passes are stored.
    """
    edges = store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("old"), F.least("a", "b").alias("new"))
        to = store(to)
        for _ in range(2):
            over = to.select(F.col("old").alias("via"), F.col("new").alias("next"))
            to = store(to.join(over, F.col("new") == F.col("via")).select("old", F.col("next").alias("new")))
        nodes = nodes.join(to, F.col("comp") == F.col("old"), "left").select("key", F.coalesce("new", "comp").alias("comp"))
        nodes = store(nodes)
        left, right = to.toDF("a", "na"), to.toDF("b", "nb")
        moved = edges.join(left, "a").join(right, "b").where("na <> nb")
        edges = store(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    return nodes


def _flips(a: Column, b: Column) -> Column:
    counts = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(counts, F.lit(0), lambda total, x: total + x)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked."""
    sketches = sets.select("key", "sketch")
    near = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
    near = store(near.where(_flips(F.col("sa"), F.col("sb")) <= most_flips(percent / 100)).select("a", "b"))
    whole = sets.select("key", "n", "shingles")
    joined = near.join(whole.toDF("a", "na", "wa"), "a").join(whole.toDF("b", "nb", "wb"), "b")
    common = F.size(F.array_intersect("wa", "wb")).cast("long")
    return joined.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _still_possible(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (key, key2) of one bucket in different components that their odd sketches do not rule out.

    Linked sets of n and m shingles differ in at most (n + m)(100 - percent) / (100 + percent) of them, and the sketches
    of whole sets differ in no more bits than the sets in shingles: no linked pair is lost, and unlinked ones
    are seldom kept unless their sets are much larger than the sketch.
    """
    members = store(members)
    facts = sets.join(members.select("key").distinct(), "key", "left_semi").select("key", "n", "sketch", "parity")
    one = members.join(store(facts), "key")
    two = one.select(*[F.col(c).alias(f"{c}2") for c in one.columns])
    return one.join(
        two,
        (F.col("bucket") == F.col("bucket2"))
        & (F.col("key") < F.col("key2"))
        & (F.col("comp") != F.col("comp2"))
        & (_flips(F.col("sketch"), F.col("sketch2")) <= most_flips(percent / 100))
        & ((100 + percent) * _flips(F.col("parity"), F.col("parity2")) <= (100 - percent) * (F.col("n") + F.col("n2"))),
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable by links), kept.

    Two texts are linked if 100 * common shingles >= percent * all shingles. A missing, empty or blank
    text has no shingles and is linked with nothing. A row with a missing key takes no part: its component
    is missing and it is kept. Rows with the same key count as linked, whatever their texts: their links are those of the
    key. Columns other than key and text are not read. An empty table gives an empty result. Texts may have any
    length; a set of shingles must fit into a task.
    """
    rows = store(_signatures(docs, key, text, k, full=False))
    valid = rows.where("n > 0 AND key IS NOT NULL")
    classes = valid.groupBy("hi", "lo", "n").agg(F.min("key").alias("rep"))
    reps = valid.join(classes.select("rep"), F.col("key") == F.col("rep"), "left_semi").select("key", F.explode("bands").alias("bucket"))
    shared = reps.groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    members = store(reps.join(shared.select("bucket"), "bucket").distinct())
    involved = members.select("key").distinct()
    held = docs.join(involved, F.col(key).cast("long") == involved["key"], "left_semi")
    # A key that comes with several texts has several sets: what one of them is linked with holds for the key.
    sets = store(_signatures(held, key, text, k, full=True).dropDuplicates(["key", "hi", "lo", "n"]))

    comp = store(involved.withColumn("comp", F.col("key")))
    tested = None
    for step in ("most", "leaders", "all"):
        placed = members.join(comp, "key")
        leader = placed.groupBy("bucket").agg(F.min(F.struct("key", "comp")).alias("lead"))
        if step == "all":
            # Only buckets that span components matter.
            open_ = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
            pairs = _still_possible(placed.join(open_, "bucket", "left_semi"), sets, percent)
            pairs = pairs.select(F.col("key").alias("b"), F.col("key2").alias("a"))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            pairs = placed.join(leader, "bucket").where("comp <> lead.comp").select(F.col("key").alias("b"), F.col("lead.key").alias("a"))
            pairs = pairs.groupBy("b", "a").agg(F.count("*").alias("bands"))
            if step == "most":
                pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a"))
        pairs = pairs.select("a", "b")
        pairs = store(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        linked = _confirmed(pairs, sets, percent)
        named = linked.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b")
        comp = components(comp, named.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        tested = pairs if tested is None else tested.union(pairs)

    of_row = store(valid.join(classes, ["hi", "lo", "n"]).select("key", "rep"))
    comp = classes.select("rep").distinct().join(comp.toDF("rep", "comp"), "rep", "left").select(F.col("rep").alias("key"), F.coalesce("comp", "rep").alias("comp"))
    # Classes that share a key are linked by it.
    several = of_row.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key", "a")
    several = store(several.join(of_row, "key").where("a < rep").select("a", F.col("rep").alias("b")).distinct())
    if not several.isEmpty():
        comp = store(comp)
        named = several.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b")
        comp = components(comp, named.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    of_row = of_row.join(comp.toDF("rep", "comp"), "rep").groupBy("key").agg(F.min("comp").alias("component_id"))
    result = rows.join(of_row, "key", "left")
    result = result.withColumn("component_id", F.coalesce("component_id", "key"))
    kept = F.col("key").eqNullSafe(F.col("component_id"))
    return result.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of which one of each component stays: one row of its smallest key."""
    found = store(near_duplicates(docs, key, text, k, percent).select(F.col(key).alias("gone"), "kept"))
    gone = found.where(~F.col("kept")).select("gone").distinct()
    left = docs.join(gone, docs[key] == gone["gone"], "left_anti")
    repeated = found.where("gone IS NOT NULL").groupBy("gone").agg(F.count("*").alias("n")).where("n > 1").select("gone")
    repeated = store(repeated)
    if repeated.isEmpty():
        return left
    once = left.join(repeated, left[key] == repeated["gone"], "left_semi").dropDuplicates([key])
    return left.join(repeated, left[key] == repeated["gone"], "left_anti").unionByName(once)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=3, percent=85)
