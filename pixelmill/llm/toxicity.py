"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum over its hash and the hashes of its first four and five letters, so that unseen
endings of a known stem count; hashes that training texts share are learned, all others are zero. Filters of
several widths run over the whole text, their largest responses are pooled, and a logistic layer gives the score.
Thresholds are calibrated for each language on rows kept from fitting; language is never an input of the score.

The model learns from every labelled row outside fold 0, and every text is scored whole. Rows are dealt by hash to shards
of SHARD rows, at most SHARDS of them; in each epoch every shard trains on from the same state, and the states are
averaged, an embedding over the shards that touched it. Words are counted and thresholds are set over all shards. Beyond
MOST shared hashes, hashes are folded into as many places.

Defined results: a null or empty text has no words and gets the score of zero responses; very long texts are
scored in blocks that overlap by the widest filter; rows without a label are scored alike; labels that are null,
and labels of ids that occur in no document, are not learned from; with no labelled rows of both kinds all scores
are zero; an empty table gives an empty table; further columns of the inputs don't matter.
"""

from __future__ import annotations

import copy
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices

STRIP = ".,;:!?\"'()[]{}<>|*$%&#…«»¡¿"
BLOCK = 1 << 13
#: Words that a task keeps responses of.
KNOWN = 100_000
#: Labelled rows of a shard, shards at most, bytes of rows that a task holds at once, words whose responses are laid side by side.
SHARD, SHARDS, HELD_BYTES, ABREAST = 8000, 64, 1 << 26, 1 << 15
#: Labelled rows that are broadcast to the texts; more are joined by a shuffle.
NEAR = 1 << 21
#: Hashes with an embedding at most, embeddings that are averaged at once, steps of a logit that thresholds tell apart.
MOST, PART, STEPS = 1 << 19, 1 << 14, 64


def word_hashes(word: str) -> tuple[int, int, int]:
    """Hashes of a word and of its beginnings."""
    w = word.strip(STRIP) or word
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) for x in (w, "4" + w[:4], "5" + w[:5]))


def words(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Model:
    """Word rows (0: unknown), embeddings, filters by width, output layer, thresholds by language."""

    row_of: dict[int, int] = field(default_factory=dict)
    embeddings: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    filters: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -math.inf
    thresholds: dict[str, float] = field(default_factory=dict)
    mask: int = (1 << 32) - 1

    def ready(self) -> Model:
        """Responses of each row at each place of each filter, so that scoring is a sum of table rows."""
        places = [w[j] for w, _ in self.filters for j in range(len(w))]
        self.responses = self.embeddings @ np.concatenate(places, axis=1) if places else np.zeros((1, 0), np.float32)
        self.known: dict[str, int] = {}
        self.table = np.zeros((KNOWN, self.responses.shape[1]), np.float32)
        return self

    def sums(self, text: str) -> np.ndarray:
        """Rows of the table of known words; unknown ones join it first."""
        found = words(text)
        at = list(map(self.known.get, found))
        if None in at:
            new = list({w for w, i in zip(found, at) if i is None})
            if len(self.known) + len(new) > KNOWN:
                self.known, new = {}, list(set(found))
                if len(new) > len(self.table):  # a text of more words than the table has room for
                    self.table = np.zeros((len(new), self.table.shape[1]), np.float32)
            rows = np.array([[self.row_of.get(h & self.mask, 0) for h in word_hashes(w)] for w in new])
            n = len(self.known)
            self.table[n: n + len(new)] = self.responses[rows].sum(1)
            self.known.update(zip(new, range(n, n + len(new))))
            at = list(map(self.known.__getitem__, found))
        return np.array(at, np.int64)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        widest = max(len(w) for w, _ in self.filters)
        best = [np.zeros(w.shape[2], np.float32) for w, _ in self.filters]
        for at in range(0, len(rows), BLOCK):
            z = self.table[rows[at: at + BLOCK + widest - 1]]
            n, c = min(BLOCK, len(rows) - at), 0
            for k, (w, b) in enumerate(self.filters):
                width, f = len(w), w.shape[2]
                y = z[:n, c: c + f].copy()
                for j in range(1, width):
                    part = z[j: j + n, c + j * f: c + (j + 1) * f]
                    y[: len(part)] += part
                best[k] = np.maximum(best[k], y.max(0) + b)
                c += width * f
        return np.concatenate(best)

    def pool_of(self, hashed_rows: np.ndarray) -> np.ndarray:
        """Pooled responses of a text given by its rows, three a word."""
        self.table, kept = self.responses[hashed_rows].sum(1), self.table
        try:
            return self.pooled(np.arange(len(hashed_rows)))
        finally:
            self.table = kept

    def of_pool(self, pooled: np.ndarray) -> float:
        z = float(pooled @ self.out) + self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def score(self, text: str) -> float:
        return 0.0 if self.bias == -math.inf else self.of_pool(self.pooled(self.sums(text)))


def _rows(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of hashes from 1 on, 0 for unknown ones, three a word."""
    if not len(vocabulary):
        return np.zeros((len(hashes) // 3, 3), np.int32)
    i = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[i] == hashes, i + 1, 0).astype(np.int32).reshape(-1, 3)


class Net:
    """What training changes: embeddings by Adagrad, filters and the output layer by Adam."""

    def __init__(self, rng: np.random.Generator, words: int, mean: float, widths=(1, 2, 3), size: int = 8, n_filters: int = 8):
        self.widths, self.size, self.n = widths, size, n_filters
        self.E = rng.normal(0, 0.1, (words + 1, size)).astype(np.float32)
        self.E[0] = 0
        self.W = [rng.normal(0, 0.4, (k, size, n_filters)).astype(np.float32) for k in widths]
        self.B = np.zeros(n_filters * len(widths), np.float32)
        self.out = rng.normal(0, 0.3, n_filters * len(widths)).astype(np.float32)
        self.bias = np.array([math.log((mean + 1e-3) / (1.001 - mean))], np.float32)
        self.gE = np.full(words + 1, 1e-3, np.float32)
        self.weights = 0.5 / (1 - mean), 0.5 / mean
        self.moments, self.t = [(np.zeros_like(v), np.zeros_like(v)) for v in self.dense()], 0
        self.touches = np.zeros(words + 1, np.float32)

    def dense(self) -> list[np.ndarray]:
        return [*self.W, self.B, self.out, self.bias]

    def flat(self) -> np.ndarray:
        """All that isn't of one embedding: values and moments."""
        return np.concatenate([v.ravel() for v in (*self.dense(), *(m for pair in self.moments for m in pair))])

    def add(self, rows: np.ndarray, change: np.ndarray, dense: np.ndarray) -> None:
        """Changes of embeddings with their Adagrad state, and of the rest."""
        self.E[rows] += change[:, :-1]
        self.gE[rows] += change[:, -1]
        at = 0
        for v in (*self.dense(), *(m for pair in self.moments for m in pair)):
            v += dense[at: at + v.size].reshape(v.shape)
            at += v.size

    def places(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows (text, step, filter, part) of the words that the largest response of each filter covers."""
        steps, pad = sum(self.widths), max(self.widths) - 1
        out = np.zeros((len(texts), steps, self.n, 3), np.int32)
        gap = np.zeros((pad, 3), np.int32)
        ends = np.cumsum([len(t) + pad for t in texts])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ABREAST, "right")))
            r = np.concatenate([x for t in texts[at:to] for x in (t, gap)])
            x = self.E.take(r[:, 0], 0)
            x += self.E.take(r[:, 1], 0)
            x += self.E.take(r[:, 2], 0)
            n, z = len(x) - pad, []
            for w in self.W:
                z.append(x[:n] @ w[0])
                for j in range(1, len(w)):
                    z[-1] += x[j: j + n] @ w[j]
            z, start = np.concatenate(z, 1), 0
            for i in range(at, to):
                if len(texts[i]):
                    best = z[start: start + len(texts[i])].argmax(0) + start
                    step = 0
                    for k, width in enumerate(self.widths):
                        for j in range(width):
                            out[i, step] = r[best[k * self.n: (k + 1) * self.n] + j]
                            step += 1
                start += len(texts[i]) + pad
            at = to
        return out

    def step(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """One batch."""
        rows, full, m = self.places(texts), np.array([len(t) > 0 for t in texts]), len(texts)
        x = self.E[rows].sum(3)
        top, at = [], 0
        for k, width in enumerate(self.widths):
            top.append(sum(np.einsum("dfs,sf->df", x[:, at + j], self.W[k][j]) for j in range(width)))
            at += width
        h = np.maximum(np.concatenate(top, 1) + self.B, 0) * full[:, None]
        s = 1 / (1 + np.exp(-np.clip(h @ self.out + self.bias[0], -30, 30)))
        d = ((s - labels) * np.where(labels > 0, self.weights[1], self.weights[0])).astype(np.float32)
        dh = d[:, None] * self.out * (h > 0)
        grads, gE, at = [], np.zeros((*rows.shape[:3], self.size), np.float32), 0
        for k, width in enumerate(self.widths):
            g = dh[:, k * self.n: (k + 1) * self.n]
            grads.append(np.stack([np.einsum("dfs,df->sf", x[:, at + j], g) for j in range(width)]))
            for j in range(width):
                gE[:, at + j] = g[..., None] * self.W[k][j].T
            at += width
        on = np.concatenate([np.repeat((dh[:, None, k * self.n: (k + 1) * self.n] != 0), w, 1) for k, w in enumerate(self.widths)], 1)
        grads += [dh.sum(0), d @ h, d.sum(keepdims=True)]
        self.t += 1
        for n, (v, g) in enumerate(zip(self.dense(), grads)):
            one, two = self.moments[n]
            g = g / m
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            v -= self.rate * (one / (1 - 0.9**self.t)) / (np.sqrt(two / (1 - 0.99**self.t)) + 1e-6)
        touched = rows[on].ravel()
        if len(touched):
            order = np.argsort(touched, kind="stable")
            ids, first = np.unique(touched[order], return_index=True)
            g = np.add.reduceat(np.repeat(gE[on] / m, 3, 0)[order], first)
            self.gE[ids] += (g * g).mean(1)
            self.E[ids] -= 0.15 * g / np.sqrt(self.gE[ids])[:, None]
            self.touches[ids] += np.diff(np.append(first, len(touched)))
            self.E[0] = 0

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, order: np.ndarray, epoch: int) -> None:
        """Batches of the texts in an order."""
        self.rate = 0.02 * (0.6**epoch)
        for at in range(0, len(order), 32):
            batch = order[at: at + 32]
            self.step([texts[i] for i in batch], labels[batch])

    def model(self, vocabulary: np.ndarray, mask: int = (1 << 32) - 1) -> Model:
        b = [self.B[k * self.n: (k + 1) * self.n] for k in range(len(self.widths))]
        return Model({int(h): i + 1 for i, h in enumerate(vocabulary)}, self.E, list(zip(self.W, b)), self.out, float(self.bias[0]), mask=mask)


def fit(texts: list[np.ndarray], labels: np.ndarray, langs: list[str], widths=(1, 2, 3), size: int = 8, n_filters: int = 8, epochs: int = 6, min_docs: int = 3, seed: int = 7) -> Model:
    """texts: three hashes for each word of each text, in a row. A fifth of the rows is kept from fitting, to calibrate."""
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model().ready()
    rng = np.random.default_rng(seed)
    seen, docs = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
    vocabulary = seen[docs >= min_docs]
    rows = [_rows(vocabulary, t) for t in texts]
    order = rng.permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5:]
    net = Net(rng, len(vocabulary), float(labels.mean()), widths, size, n_filters)
    for epoch in range(epochs):
        net.learn(rows, labels, used, epoch)
        used = rng.permutation(used)
    model = net.model(vocabulary).ready()
    _calibrate(model, np.array([_logit(model.of_pool(model.pool_of(rows[i]))) for i in held]), labels[held], np.ones(len(held)), np.array([langs[i] for i in held], object), set(langs))
    return model


def _calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, n: np.ndarray, langs: np.ndarray, every: set[str]) -> None:
    """0.5 becomes the threshold that is best over all languages; then each gets its own. n: rows of a logit and label."""
    shift = _logit(best_threshold(_sigmoid(logits), labels, 0.5, n))
    model.bias -= shift
    scores = _sigmoid(logits - shift)
    for lang in sorted(every):
        mine = langs == lang
        model.thresholds[lang] = best_threshold(scores[mine], labels[mine], 0.5, n[mine]) if (labels[mine] * n[mine]).sum() >= 10 else 0.5


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def best_threshold(scores: np.ndarray, labels: np.ndarray, default: float, n: np.ndarray | None = None) -> float:
    """Middle of the widest gap between neighbouring scores among those with the highest F1; n: rows of each score and label."""
    n = np.ones(len(scores)) if n is None else n
    positive = labels * n
    if len(scores) == 0 or positive.sum() == 0 or positive.sum() == n.sum():
        return default
    order = np.argsort(-scores)
    s = scores[order]
    f1 = 2 * np.cumsum(positive[order]) / (np.cumsum(n[order]) + positive.sum())
    nxt = np.append(s[1:], 0.0)
    f1[s == nxt] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax(s[best] - nxt[best])]
    return float((s[k] + nxt[k]) / 2)


def fold(id_col: str) -> Column:
    """Fifth of an id; fold 0 is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


class _Words:
    """Three hashes for each word of a text, or with a vocabulary their numbers; those of words seen lately are kept."""

    def __init__(self, vocabulary: np.ndarray | None = None, mask: int = 0):
        self.vocabulary, self.mask = vocabulary, np.uint32(mask)
        self.known: dict[str, int] = {}
        self.table = np.zeros((4 * KNOWN, 3), np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        found = words(text)
        at = list(map(self.known.get, found))
        if None in at:
            new = list({w for w, i in zip(found, at) if i is None})
            if len(self.known) + len(new) > len(self.table):
                self.known, new = {}, list(set(found))
                if len(new) > len(self.table):
                    self.table = np.zeros((len(new), 3), np.uint32)
            n = len(self.known)
            hashes = np.array([word_hashes(w) for w in new], np.uint32)
            self.table[n: n + len(new)] = hashes if self.vocabulary is None else _rows(self.vocabulary, hashes.ravel() & self.mask)
            self.known.update(zip(new, range(n, n + len(new))))
            at = list(map(self.known.__getitem__, found))
        return self.table[np.array(at, np.int64)].ravel()


def _pack(a: np.ndarray) -> bytes:
    return len(a).to_bytes(8, "little") + pa.compress(a.tobytes(), "zstd", asbytes=True) if len(a) else b""


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], 4 * int.from_bytes(b[:8], "little"), "zstd"), kind) if b else np.empty(0, kind)


def _chunks(batches, columns: list[str]):
    """Columns of SHARD rows or HELD_BYTES at once, whatever the batches."""
    held, size = [], 0
    for batch in slices(batches):
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            held.append(row)
            size += len(row[0])
            if len(held) == SHARD or size >= HELD_BYTES:
                yield list(zip(*held))
                held, size = [], 0
    if held:
        yield list(zip(*held))


def _known(texts: DataFrame, min_docs: int) -> tuple[np.ndarray, int]:
    """The hashes, cut by a mask, that min_docs texts or more have."""

    def count(batches):
        own, held, size = _Words(), [], 0

        def tally():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in slices(batches):
            held += [np.unique(own(t or "")) for t in batch.column(0).to_pylist()]
            size += sum(map(len, held[-batch.num_rows:]))
            if size >= HELD_BYTES // 4:
                yield tally()
                held, size = [], 0
        if held:
            yield tally()

    shared = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("h").persist(StorageLevel.DISK_ONLY)
    mask = (1 << 32) - 1 if shared.count() <= MOST else MOST - 1
    found = shared.select(F.col("h").bitwiseAND(F.lit(mask)).alias("h")).distinct().toArrow()  # MOST rows at most
    shared.unpersist()
    return np.sort(found.column("h").to_numpy()).astype(np.uint32), mask


def _averaged(rows: DataFrame, net: Net, epoch: int, seed: int) -> None:
    """One epoch: each partition trains on from the net, which takes the mean of their changes."""
    from pyspark import TaskContext

    sent = rows.sparkSession.sparkContext.broadcast(net)  # gone after the epoch, unlike what a closure holds

    def learn(batches):
        start = sent.value
        mine, shard, n = copy.deepcopy(start), TaskContext.get().partitionId(), 0
        mine.touches[:] = 0
        for c, (packed, y) in enumerate(_chunks(batches, ["r", "y"])):
            order = np.random.default_rng((seed, epoch, shard, c)).permutation(len(y))
            mine.learn([_unpack(x, np.int32).reshape(-1, 3) for x in packed], np.array(y, np.float32), order, epoch)
            n += len(y)
        if not n:
            return
        ids = np.flatnonzero(mine.touches)
        change = np.concatenate([mine.E[ids] - start.E[ids], (mine.gE[ids] - start.gE[ids])[:, None]], 1)
        cuts = np.searchsorted(ids, np.arange(0, len(start.E) + PART, PART))
        parts = [(p, ids[s:e], mine.touches[ids[s:e]], change[s:e]) for p, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
        parts.append((-1, np.array([mine.t - start.t]), np.array([n], np.float32), (mine.flat() - start.flat())[None]))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, *_ in parts], pa.int32()), *(pa.array([x[i].astype(k).tobytes() for x in parts], pa.binary()) for i, k in ((1, np.int64), (2, np.float32), (3, np.float32)))], names=["part", "ids", "n", "change"])

    def mean(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        read = lambda c, k: [np.frombuffer(x, k) for x in table.column(c).to_pylist()]
        ids, n, change = read("ids", np.int64), read("n", np.float32), read("change", np.float32)
        if part < 0:
            ids, at = np.array([max(int(x[0]) for x in ids)]), np.zeros(len(n), int)
        else:
            ids, at = np.unique(np.concatenate(ids), return_inverse=True)
        n, change = np.concatenate(n).astype(float), np.concatenate([c.reshape(len(w), -1) for c, w in zip(change, n)]).astype(float)
        total, whole = np.zeros((len(ids), change.shape[1])), np.bincount(at, n)
        np.add.at(total, at, change * n[:, None])
        return pa.table({"part": pa.array([part], pa.int32()), "ids": [ids.astype(np.int64).tobytes()], "change": [(total / whole[:, None]).astype(np.float32).tobytes()]})

    changes = rows.where("NOT held").select("r", "y").mapInArrow(learn, "part int, ids binary, n binary, change binary")
    found = changes.groupBy("part").applyInArrow(mean, "part int, ids binary, change binary").toArrow().to_pylist()  # a net
    sent.destroy()
    ids, change, dense = [np.empty(0, np.int64)], [np.empty((0, net.size + 1), np.float32)], None
    for x in found:
        i, c = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["change"], np.float32)
        if x["part"] < 0:
            dense, net.t = c, net.t + int(i[0])
        else:
            ids.append(i)
            change.append(c.reshape(len(i), -1))
    if dense is not None:
        net.add(np.concatenate(ids), np.concatenate(change), dense)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", epochs: int = 6, min_docs: int = 3, seed: int = 7, **shape) -> Model:
    """A model of all labelled rows outside fold 0, of which a fifth sets the thresholds."""
    ids = labels.where(F.col(label_col).isNotNull() & (fold(id_col) != 0)).select(id_col, F.col(label_col).cast("int").alias("y"))
    n = ids.count()
    shards = min(SHARDS, max(1, math.ceil(n / SHARD)))
    ids = F.broadcast(ids) if n <= NEAR else ids  # else a join that shuffles the texts

    found = documents.select(id_col, F.col("text").alias("t"), F.coalesce("lang", F.lit("")).alias("l")).join(ids, id_col)
    state = found.agg(F.avg("y").alias("mean"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if state["lo"] == state["hi"]:  # or no rows
        return Model().ready()
    vocabulary, mask = _known(found.select("t"), min_docs)

    def numbered(batches):
        own = _Words(vocabulary, mask)
        for batch in slices(batches):
            r = [_pack(own(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()), *batch.columns[1:]], names=["r", "lang", "y", "held"])

    held = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(5)) == 0
    dealt = found.repartition(shards, F.xxhash64(id_col)).sortWithinPartitions(F.xxhash64(id_col), id_col, "y", "t").select("t", "l", "y", held.alias("held"))
    rows = dealt.mapInArrow(numbered, "r binary, lang string, y int, held boolean").persist(StorageLevel.DISK_ONLY)
    net = Net(np.random.default_rng(seed), len(vocabulary), float(state["mean"]), **shape)
    for epoch in range(epochs):
        _averaged(rows, net, epoch, seed)
    model = net.model(vocabulary, mask)

    judge_of = Model({}, model.embeddings, model.filters, model.out, model.bias)

    def judged(batches):
        judge = judge_of.ready()
        for batch in slices(batches):
            z = [round(STEPS * _logit(judge.of_pool(judge.pool_of(_unpack(x, np.int32).reshape(-1, 3))))) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), *batch.columns[1:]], names=["z", "lang", "y"])

    tally = rows.where("held").select("r", "lang", "y").mapInArrow(judged, "z int, lang string, y int").groupBy("z", "lang", "y").count().orderBy("z", "lang", "y").toArrow()  # steps of logits
    every = {r.lang for r in rows.select("lang").distinct().collect()}
    rows.unpersist()
    z, y, n = (tally.column(c).to_numpy().astype(float) for c in ("z", "y", "count"))
    _calibrate(model, z / STEPS, y, n, np.array(tally.column("lang").to_pylist(), object), every)
    return model.ready()


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """id, held_out, score, predicted; and by the language's threshold: threshold, flagged."""
    kind = documents.schema[id_col].dataType.simpleString()
    cargo = Model(model.row_of, model.embeddings, model.filters, model.out, model.bias, model.thresholds, model.mask)
    here: dict[str, Model] = {}
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = here.get("model") or here.setdefault("model", cargo.ready())
        s = [m.score(t or "") for t in batch.column(1).to_pylist()]
        limit = [m.thresholds.get(x, 0.5) for x in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array(limit, pa.float64()), pa.array([x >= y for x, y in zip(s, limit)], pa.bool_())],
            names=[id_col, "held_out", "score", "predicted", "threshold", "flagged"],
        )

    return map_rows(documents.select(id_col, text_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), lang.alias("lang")), run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, threshold double, flagged boolean")
