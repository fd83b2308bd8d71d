"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most `max_bits` bits differ in at most as many of their eight bytes, so a pair shares
at least `8 - max_bits` positional bytes: the guaranteed minimum. The index posts each distinct fingerprint under its
bytes by position; the first of a pair's shared positions lies among the first `max_bits + 1`, so no more are posted.
In a posting list the positional bytes that two entries share are tallied, pairs that reach the minimum are verified
by their Hamming distance, and what links is kept as a spanning forest: no group is expanded into its pairs. Equal
fingerprints are one entry from the start.

A list of one positional byte holds a 256th of all entries. Beyond `LIST` entries a list on average, entries are
posted under the first two, three or at most `8 - max_bits` positional bytes that a pair must share, so that lists
stay as short. A list that is longer than `HOT` all the same is dealt over tasks as pairs of blocks. Neither changes
which pairs are found.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links like any other;
fewer words than a shingle make one shingle of them all; a very long text is hashed in blocks of shingles; repeated
rows and equal texts have one fingerprint and one component; rows without an id are in no component but keep a row
with their fingerprint; an empty table gives an empty table; further columns of the input don't matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, map_rows, partitions, whole_text
from .components import Forest, components, forest

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)
SEED = 42
#: Shingles whose bits are counted at once, so that a very long text needs little memory.
BLOCK = 1 << 14


def hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, lower-cased in A-Z, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()]
    return np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1:] - 1).tolist())), np.uint64, len(words) - width + 1)


def bits(h: np.ndarray) -> int:
    """The 64-bit SimHash of shingles with these hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at: at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes())


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash over the word shingles of a text; zero without words."""
    return bits(hashes(text, width))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id, fp: the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    return map_rows(whole_text(df, id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long")


#: Entries of a posting list on average, entries from which a list is split, entries compared with others at once.
LIST, HOT, PIVOTS = 2048, 1 << 16, 64
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs of a x b have few enough differing bits; only those that share enough positional bytes are verified."""
    apart = a[:, None] ^ b
    differing = np.bitwise_count((((apart & _LOW) + _LOW) | apart) & _HIGH)  # a byte's high bit is set if the byte isn't zero
    found = differing <= max_bits  # 8 - differing is the tally of shared positional bytes
    found[found] = np.bitwise_count(apart[found]) <= max_bits
    return found


def _within(fp: np.ndarray, ids: np.ndarray, max_bits: int, found: Forest) -> None:
    """Spanning links of one posting list. PIVOTS entries at a time are compared with one another and with all that are left.
    What they reach is followed one component at a time, so that only entries known to be in one component aren't compared."""
    left, alive = np.arange(len(fp)), np.ones(len(fp), bool)
    while len(left):
        pivots, left = left[:PIVOTS], left[PIVOTS:]
        near = _near(fp[pivots], fp[left], max_bits)
        hit = near.any(0)
        near, reached = near[:, hit], left[hit]
        shared = near.astype(np.float32)
        i, j = np.nonzero(np.triu(_near(fp[pivots], fp[pivots], max_bits) | (shared @ shared.T > 0), 1))
        found.add(ids[pivots[i]], ids[pivots[j]])
        if not len(reached):
            continue
        first = near.argmax(0)
        found.add(ids[pivots[first]], ids[reached])
        component = np.arange(len(pivots))
        moved, to = forest(i, j)
        component[moved] = to
        of = component[first]
        for c in np.unique(of):
            frontier = reached[(of == c) & alive[reached]]
            alive[frontier] = False
            while len(frontier):
                now, frontier = frontier[:PIVOTS], frontier[PIVOTS:]
                rest = left[alive[left]]
                near = _near(fp[now], fp[rest], max_bits)
                hit = near.any(0)
                if hit.any():
                    found.add(ids[now[near[:, hit].argmax(0)]], ids[rest[hit]])
                    alive[rest[hit]] = False
                    frontier = np.concatenate([frontier, rest[hit]])
        left = left[alive[left]]


def _depth(n: int, need: int) -> int:
    """Positional bytes of a key, so that a list has LIST entries at most on average."""
    depth = 1
    while depth < need and n > LIST << 8 * depth:
        depth += 1
    return depth


def _posted(distinct: DataFrame, depth: int, max_bits: int) -> DataFrame:
    """k, fp, id: a row for each set of positions that can be the first `depth` ones that a pair shares."""
    keys = []
    for n, places in enumerate(combinations(range(max_bits + depth), depth)):
        key = F.lit(n)
        for p in places:
            key = F.shiftleft(key.cast("long"), 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")))
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("k"), "fp", "id")


def links(scratch: Scratch, distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """Spanning edges (a, b) between the ids of distinct fingerprints (id, fp) at max_bits or fewer differing bits."""
    if not 0 <= max_bits < 8:
        raise ValueError("the index needs a positional byte that every pair shares: max_bits below 8")
    posted = _posted(distinct, _depth(distinct.count(), 8 - max_bits), max_bits)
    hot = scratch.table(posted.groupBy("k").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks")).where("blocks > 1"), "hot")
    if hot.isEmpty():
        cells = posted.withColumn("cell", F.lit(0))
    else:  # every two blocks of a long list meet in a cell
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
        pair = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array_remove(pair, own * F.col("blocks") + own))
        cells = posted.join(hot, "k", "left").select("k", "fp", "id", F.explode(pair).alias("cell"))

    def compare(batches):
        found, held, key = Forest(), [], None

        def judge():
            if sum(len(x[0]) for x in held) > 1:
                _within(*(np.concatenate(x) for x in zip(*held)), max_bits, found)

        for batch in batches:
            if not batch.num_rows:
                continue
            k, cell, fp, ids = (batch.column(i).to_numpy() for i in range(4))
            cuts = [0, *(np.flatnonzero((np.diff(k) != 0) | (np.diff(cell) != 0)) + 1).tolist(), len(k)]
            for s, e in zip(cuts, cuts[1:]):
                if (k[s], cell[s]) != key:
                    judge()
                    key, held = (k[s], cell[s]), []
                held.append((fp[s:e].view(np.uint64), ids[s:e]))
        judge()
        for a, b in found.edges():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    together = cells.select("k", "cell", "fp", "id").repartition(partitions(scratch.spark), "k", "cell").sortWithinPartitions("k", "cell")
    return together.mapInArrow(compare, "a long, b long")


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """id, fp, component_id: the smallest id that is reachable over links of max_bits or fewer differing bits."""
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.table(fingerprints(df, id_col, text_col, width).withColumnRenamed(id_col, "id"), "prints")
    distinct = scratch.table(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").cast("long").alias("id")), "distinct")
    found = components(scratch, links(scratch, distinct, max_bits))
    classes = scratch.table(distinct.join(found, distinct.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id")), "classes")
    kind = df.schema[id_col].dataType.simpleString()
    return prints.join(classes, "fp", "left").select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).cast(kind).alias("component_id"))
