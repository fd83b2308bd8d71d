"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash candidates, verified on the shingles.

Texts of one set of shingles are one entry. The byte-position index of `simhash` proposes first: fingerprints over the
same shingles that differ in a few bits are copies with little changed, and large groups of them become one component
at once. At similarity 0.8 fingerprints differ in ten bits on average, more than the index can guarantee to find, so
entries that are not in one component yet are posted under BANDS keys of ROWS minima; a pair of similarity 0.8 shares
no key with a probability of 5e-8. Each list's first entry is compared with the others next. What then is in a list of
several components goes to that list's task with its shingles and is compared there, in the first list that two have in
common, until it is linked. So candidates are rows of lists, never of pairs, and only an exact comparison links. Lists
of more than HOT entries are dealt over tasks as pairs of blocks.

Defined results: a null text counts as empty, and texts without words are copies of one another; fewer words than a
shingle make one shingle of them all; the minima of a very long text are taken in blocks; rows without an id stay.
Of a class one row stays: that of the smallest id and, among rows of equal id, of the smallest hash of the text;
rows of equal id whose texts are no near copies are different documents. Of rows equal in id and text the least by
its other columns stays. An empty table gives an empty table; columns of any name stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, map_rows, partitions, whole_text
from .components import components
from .simhash import SEED, bits, hashes, links

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Of 128 bits of a pair of similarity 0.8, 115 agree on average and fewer than 92 with a probability below 1e-8.
AGREE = 92
#: Entries from which a posting list is split.
HOT = 2048
#: Shingles whose minima are taken at once.
BLOCK = 1 << 12
_RANDOM = np.random.default_rng(SEED)
TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    return np.unique(hashes(text, width))


def set_key(h: np.ndarray) -> int:
    """The number of a set of shingles, as a signed long."""
    return int(np.uint64(xxh64_intdigest(h.tobytes(), SEED)).view(np.int64)) if len(h) else 0


def signature(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands, and 128 bits, one of each minimum."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), BLOCK):
        least = np.minimum(least, ((h[at: at + BLOCK, None] ^ FLIP) * TIMES).min(0))
    least = (least ^ (least >> np.uint64(31))) * MIX
    bands, keys = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = (keys ^ bands[:, i]) * MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64), np.packbits((least >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def _prints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the text, node: the number of the set of shingles, keys, s0, s1: its signature, fp: its fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = [hashes(t, WIDTH) for t in batch.column(2).to_pylist()]
        sets = [np.unique(h) for h in whole]
        signs = [signature(h) for h in sets]
        prints = np.array([bits(h) for h in whole], np.uint64).view(np.int64)
        keys = [k if len(h) else [] for h, (k, _) in zip(sets, signs)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([set_key(h) for h in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array([int(s[i]) for _, s in signs], pa.int64()) for i in (0, 1)), pa.array(prints)],
            names=["id", "digest", "node", "keys", "s0", "s1", "fp"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), _digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return map_rows(rows, run, f"id {kind}, digest string, node long, keys array<long>, s0 long, s1 long, fp long")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, h: the sorted hashes of its shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([set_key(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "h"])

    return map_rows(whole_text(df, id_col, text_col), run, "node long, h binary")


def _first(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's first entry, by node, and those that aren't in its component; a row a posting at most."""
    posted = entries.select(F.explode("keys").alias("k"), "node", "component", "s0", "s1")
    least = posted.groupBy("k").agg(F.min(F.struct("node", "component", "s0", "s1")).alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    rows = posted.join(least.where("lo <> hi"), "k").where(F.col("component") != F.col("p.component"))
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("p.s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("p.s1")))
    return rows.where(128 - differ >= AGREE).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()


def _members(entries: DataFrame) -> DataFrame:
    """k, cell, band, node: the entries of each list that has several components; every two of them meet in a cell."""
    posted = entries.select(F.posexplode("keys").alias("band", "k"), "node", "component")
    lists = posted.groupBy("k").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    rows = posted.join(lists.select("k", "blocks"), "k")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    pair = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(pair, own * F.col("blocks") + own))
    return rows.select("k", "band", "node", F.explode(pair).alias("cell"))


def _list_links(node: np.ndarray, comp: np.ndarray, keys: np.ndarray, sign: np.ndarray, sets: list[np.ndarray], band: int):
    """Links (a, b) that join the components of one list."""
    label = np.unique(comp, return_inverse=True)[1]
    for i in range(len(node) - 1):
        j = np.arange(i + 1, len(node))
        j = j[label[j] != label[i]]
        j = j[128 - np.bitwise_count(sign[j] ^ sign[i]).sum(1, dtype=np.int64) >= AGREE]
        j = j[~(keys[j, :band] == keys[i, :band]).any(1)]  # those met in an earlier list
        if not len(j):
            continue
        own, sizes = sets[i], np.array([len(sets[x]) for x in j])
        long_enough = 5 * np.minimum(sizes, len(own)) >= 4 * np.maximum(sizes, len(own))
        j, sizes = j[long_enough], sizes[long_enough]
        for s in range(0, len(j), 256):  # a bound for what is laid side by side
            part, size = j[s: s + 256], sizes[s: s + 256]
            every = np.concatenate([sets[x] for x in part])
            at = np.searchsorted(own, every)
            both = np.add.reduceat((own[np.minimum(at, len(own) - 1)] == every).astype(np.int64), np.cumsum(size) - size)
            for x in part[5 * both >= 4 * (size + len(own) - both)].tolist():
                if label[x] != label[i]:
                    yield node[i], node[x]
                    label[label == label[x]] = label[i]


def _compared(spark, members: DataFrame, entries: DataFrame) -> DataFrame:
    """Links (a, b) within the lists; entries: node, component, keys, s0, s1, h."""

    def compare(batches):
        held, at = [], None

        def judge():
            rows, band = held, at[2]
            links_ = [] if len(rows) < 2 else list(_list_links(
                np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64), np.array([x[2] for x in rows], np.int64),
                np.array([x[3:5] for x in rows], np.int64).view(np.uint64), [np.frombuffer(x[5], np.uint64) for x in rows], band))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links_], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for k, cell, band, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (k, cell, band):
                    if at is not None:
                        yield judge()
                    held, at = [], (k, cell, band)
                held.append(row)
        if at is not None:
            yield judge()

    rows = members.join(entries, "node").select("k", "cell", "band", "node", "component", "keys", "s0", "s1", "h")
    by = ["k", "cell", "band"]
    return rows.repartition(partitions(spark), *by).sortWithinPartitions(*by, "node").mapInArrow(compare, "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(5 * both >= 4 * (len(x) + len(y) - both))  # SIMILARITY without rounding
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("node").alias("a"), F.col("h").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("h").alias("y"))
    return map_rows(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y"), run, "a long, b long")


def near_classes(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """node, first (id, digest), component: each set of shingles with its least row, and the node that stands for its class.

    With it, id and digest of the rows that equal another one in both.
    """
    prints = scratch.table(_prints(df.where(F.col(id_col).isNotNull()), id_col, text_col), "prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct("id", "digest")).alias("first"), *(F.first(c).alias(c) for c in ("keys", "s0", "s1")), F.min("fp").alias("fp"))
    nodes = scratch.table(nodes, "nodes")
    again = scratch.table(prints.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("id", "digest"), "again")
    scratch.drop(prints)
    classes, edges = nodes.withColumn("component", F.col("node")), None

    def sets_of(wanted):
        """node, h of the wanted nodes, from the texts that stand for them."""
        ids = nodes.join(wanted, "node", "left_semi").select("first.id", "first.digest")
        rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("digest", _digest(F.col("text")))
        return scratch.table(_sets(rows.join(ids, ["id", "digest"], "left_semi"), "id", "text").dropDuplicates(["node"]), "sets")

    def link(new):
        nonlocal edges, classes
        edges = new if edges is None else edges.unionByName(new)
        moved = scratch.table(components(scratch, edges).withColumnRenamed("component", "to"), "moved")
        classes = scratch.table(nodes.join(moved, "node", "left").withColumn("component", F.coalesce("to", "node")).drop("to"), "classes")

    def verify(candidates):
        pairs = scratch.table(candidates, "pairs")
        if not pairs.isEmpty():
            sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
            link(scratch.table(_similar(pairs, sets), "edges"))
            scratch.drop(sets)
        scratch.drop(pairs)

    alike = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("id")), "alike")  # an entry of the index for each fingerprint
    same = nodes.join(alike, "fp").where("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    verify(links(scratch, alike).unionByName(same))
    verify(_first(classes))
    members = scratch.table(_members(classes), "members")
    if not members.isEmpty():
        sets = sets_of(members.select("node").distinct())
        link(scratch.table(_compared(scratch.spark, members, classes.select("node", "component", "keys", "s0", "s1").join(sets, "node")), "edges"))
        scratch.drop(sets)
    return classes.select("node", "first", "component"), again


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, by the rule in the module's text; rows without an id stay."""
    places = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # no name of df meets one made here
    id_at, text_at = (f"c{df.columns.index(c)}" for c in (id_col, text_col))
    scratch = Scratch(df.sparkSession, "nearcopies")
    classes, again = near_classes(scratch, places, id_at, text_at)
    first = scratch.table(classes.groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.digest"), "first")
    rows = places.withColumn("digest", _digest(F.col(text_at)))
    same = lambda t: (rows[id_at] == t.id) & (rows.digest == t.digest)
    kept = rows.join(first, same(first), "left_semi")
    if not again.isEmpty():
        least = kept.join(again, same(again), "left_semi").groupBy(id_at, "digest").agg(F.min_by(F.struct(*places.columns), F.to_json(F.struct(*places.columns))).alias("row"))
        kept = kept.join(again, same(again), "left_anti").select(places.columns).unionByName(least.select("row.*"))
    return kept.select(places.columns).unionByName(places.where(F.col(id_at).isNull())).toDF(*df.columns)
