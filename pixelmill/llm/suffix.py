"""Suffix-array dedup by prefix-free parsing: bytes of passages that start in an earlier document go.

A byte goes if a string of `length` bytes covers it that also starts in a document with a smaller id; matches never
cross documents and are judged on the input.

Parse: a rolling hash runs over the text, and the least hash in each window of `length` bytes is its trigger. The
windows in a row that share a trigger make a phrase. Equal windows have equal triggers, so each window lies in one
phrase, and windows can be equal only in phrases of one trigger. Dictionary: equal phrases are one entry, owned by the
smallest document that has it; every other document loses the phrase whole. Corpus order: only triggers with several
distinct phrases are left; the suffixes of their phrases are sorted to a depth of `length`, and neighbours that
agree so far are the windows that different phrases share.

Phrases are resolved within a task first, so a passage that a third of all documents have moves once a task. Hashes
move as packed arrays. A trigger with very many distinct phrases is split: its windows are dealt by their own hashes.
Long texts are parsed in blocks; a phrase cut by a block's edge is resolved like any other. Documents are judged in
homes, whose number follows the bytes of the input, so that a home's texts stay few however large the corpus is; rows
without an id are spread over all homes by their texts.

Defined results: a null text counts as empty; a null id is larger than all others; rows of equal id are one
document to all others and none to each other; texts shorter than `length` bytes lose nothing; an empty table gives
an empty table; further columns of the input don't matter. The last values of a long, as many as there are homes, count
as null ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, slices, with_length

LENGTH, GRAM = 50, 16
#: Bytes parsed at once, bytes whose phrases are held before they are sent, windows in a phrase at most.
BLOCK, HOLD, LONGEST = 1 << 19, 1 << 24, 255
#: Verdicts that a task gathers over its parts before it sends them home.
GATHER = 1 << 19
#: Distinct phrases of a trigger from which its windows are dealt by their own hashes.
HOT = 4096
#: Bytes of stored input for each home of documents.
HOME = 32 << 20
LAST = (1 << 63) - 1

_random = np.random.default_rng(20240501)
BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xD6E8FEB86659FD93
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the base and of its inverse, modulo 2 to the 64th."""
    if cache.get("n", 0) < n:
        cache["n"] = n
        cache["up"], cache["down"] = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))))
    return cache["up"][:n], cache["down"][:n]


class Hasher:
    """Hashes of all substrings of a byte array."""

    def __init__(self, data: np.ndarray):
        self.up, down = _powers(len(data) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * down[:-1])])

    def grams(self, k: int) -> np.ndarray:
        """Of each k bytes; the factor brings sums that start anywhere to the same power."""
        return _mixed((self.sums[k:] - self.sums[:-k]) * self.up[: len(self.sums) - k])

    def spans(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.up[start] + size.astype(np.uint64))


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return np.minimum(h[: len(h) - (width - size)], h[width - size:]) if size < width else h


def phrases(data: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(part, start, windows, trigger, hash) of each phrase of the parts that lie in data one behind the other."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hasher = Hasher(data)
    trigger = least(hasher.grams(gram), length - gram + 1)
    part = np.repeat(np.arange(len(lengths)), lengths)
    inside = part[:n] == part[length - 1:]
    new = np.ones(n, bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (part[1:n] != part[: n - 1]) | ~inside[:-1]
    new |= ~inside
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    keep = inside[at]
    at, size = at[keep], size[keep]
    if len(size) and size.max() > LONGEST:  # periodic text
        pieces = -(-size // LONGEST)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, size = np.repeat(at, pieces) + k * LONGEST, np.minimum(LONGEST, np.repeat(size, pieces) - k * LONGEST)
    return part[at], at, size, trigger[at], hasher.spans(at, size + length - 1)


def blocks(rows: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, lengths, row numbers, offsets) of groups of parts; parts of one text overlap by length - 1 bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        row, offset, parts = zip(*held)
        return np.frombuffer(b"".join(parts), np.uint8), np.array([len(x) for x in parts]), np.array(row), np.array(offset)

    for i, text in rows:
        at = 0
        while len(text) - at >= length:
            part = text[at: at + BLOCK + length - 1]
            held.append((i, at, part))
            size += len(part)
            at += BLOCK
            if size >= BLOCK:
                yield out()
                held, size = [], 0
    if held:
        yield out()


# Packed arrays


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length; each is split into planes of its bytes, which compresses what varies little."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + b"".join(planes))


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in map(np.dtype, types):
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def _dealt(kind: int, part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(kind, part, packed rows) for each part."""
    if len(part):
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for rows in np.split(order, cuts):
            yield kind, int(part[rows[0]]), pack(*(c[rows] for c in columns))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, part, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "part", "blob"])


ROWS = "kind int, part int, blob binary"
# Kinds of rows: phrases for the dictionary; verdicts on a document's phrases: gone whole, to be resolved, to be resolved
# by window; phrases to be resolved; runs of a phrase's windows that are gone.
PHRASES, GONE, ASK, ASK_WINDOWS, CONTENT, RUNS = range(6)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _owners(trigger: np.ndarray, phrase: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by trigger, phrase and document, without repetitions; the smallest document of each row's phrase."""
    order = np.lexsort((doc, phrase, trigger))
    order = order[_heads(trigger[order], phrase[order], doc[order])]
    new = _heads(trigger[order], phrase[order])
    return order, doc[order][new][np.cumsum(new) - 1]


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class Parser:
    """The steps of the operator for given lengths and numbers of parts (of triggers) and homes (of documents)."""

    def __init__(self, length: int, gram: int, parts: int, homes: int):
        self.length, self.gram, self.parts, self.homes = length, gram, parts, homes

    def home(self, doc: np.ndarray) -> np.ndarray:
        """Home of a document; equal to that of _home."""
        return doc % self.homes

    def rank(self, doc: np.ndarray) -> np.ndarray:
        """The number that documents are compared by: one for all rows without an id."""
        return np.minimum(doc, LAST - self.homes + 1)

    def sent(self, verdicts: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
        """Gathered verdicts (kind, columns with the phrase and the document first) as rows for their homes."""
        rows = []
        for kind in sorted({k for k, _ in verdicts}):
            columns = [np.concatenate(x) for x in zip(*(c for k, c in verdicts if k == kind))]
            rows += _dealt(kind, self.home(columns[1]), *columns)
        return _batch(rows)

    def parse(self, batches):
        """Texts to phrases and, for those that a smaller document of the task has, verdicts."""
        held, size = [], 0

        def out():
            trigger, phrase, doc = (np.concatenate(x) for x in zip(*held))
            order, owner = _owners(trigger, phrase, doc)
            trigger, phrase, doc = trigger[order], phrase[order], doc[order]
            own = self.rank(doc) == self.rank(owner)
            t = trigger[own]
            low = t.view(np.uint8).reshape(-1, 8)[:, :5].copy().view("V5").reshape(-1)
            rows = [*_dealt(PHRASES, (t >> np.uint64(40)).astype(np.int64) % self.parts, low, phrase[own], doc[own]), *_dealt(GONE, self.home(doc[~own]), phrase[~own], doc[~own])]
            return _batch(rows)

        for batch in slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = (t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist())
            for data, lengths, row, _ in blocks(enumerate(texts), self.length):
                part, _, _, trigger, phrase = phrases(data, lengths, self.length, self.gram)
                held.append((trigger, phrase, ids[row[part]]))
                size += len(data)
                if size >= HOLD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def own(self, batches):
        """Phrases of a part to verdicts; rows of one part come one behind the other."""
        held: list[list[np.ndarray]] = []
        verdicts, gathered, at = [], 0, None

        def judge() -> int:
            trigger, phrase, doc = (np.concatenate(x) for x in zip(*held))
            trigger = np.pad(trigger.view(np.uint8).reshape(-1, 5), ((0, 0), (0, 3))).view(np.uint64).reshape(-1)
            order, owner = _owners(trigger, phrase, doc)
            trigger, phrase, doc = trigger[order], phrase[order], doc[order]
            own = self.rank(doc) == self.rank(owner)
            group = np.cumsum(_heads(trigger)) - 1
            n_phrases = np.bincount(group, _heads(trigger, phrase)).astype(np.int64)[group]
            ask, hot = own & (n_phrases > 1), n_phrases > HOT
            for kind, which in ((GONE, ~own), (ASK, ask & ~hot), (ASK_WINDOWS, ask & hot)):
                verdicts.append((kind, [phrase[which], doc[which]]))
            return int((~own | ask).sum())

        for batch in slices(batches, 64):
            rows = []
            for kind, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != PHRASES:
                    rows.append((kind, part, blob))
                    continue
                if part != at and held:
                    gathered += judge()
                    held = []
                    if gathered >= GATHER:
                        yield self.sent(verdicts)
                        verdicts, gathered = [], 0
                at = part
                held.append(unpack(blob, "V5", "u8", "i8"))
            if rows:
                yield _batch(rows)
        if held:
            judge()
        yield self.sent(verdicts)

    def verdicts(self, table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, first window, behind the last, kind) of each document's verdicts, in the order of phrases."""
        columns = []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            if kind == RUNS:
                phrase, doc, a, b = unpack(blob, "u8", "i8", "u1", "u1")
            else:
                phrase, doc = unpack(blob, "u8", "i8")
                a, b = np.zeros(len(doc), np.uint8), np.full(len(doc), 255, np.uint8)
            columns.append((doc, phrase, a, b, np.full(len(doc), kind, np.int8)))
        if not columns:
            return {}
        doc, phrase, a, b, kind = (np.concatenate(x) for x in zip(*columns))
        order = np.lexsort((phrase, doc))
        bounds = np.append(np.flatnonzero(_heads(doc[order])), len(order))
        return {int(doc[order[s]]): tuple(x[order[s:e]] for x in (phrase, a, b, kind)) for s, e in zip(bounds, bounds[1:])}

    def marked(self, ids: np.ndarray, texts: list[bytes], verdicts: dict) -> Iterator[tuple]:
        """(row, start in the text, windows, trigger, phrase, its verdict's a, b and kind) of phrases with verdicts, by block with its bytes and offsets."""
        concerned = ((i, t) for i, t in enumerate(texts) if int(ids[i]) in verdicts)
        for data, lengths, row, offset in blocks(concerned, self.length):
            part, at, size, trigger, phrase = phrases(data, lengths, self.length, self.gram)
            base = np.cumsum(lengths) - lengths
            bounds = np.searchsorted(part, np.arange(len(lengths) + 1))
            for p in range(len(lengths)):
                s, e = bounds[p], bounds[p + 1]
                keys, a, b, kind = verdicts[int(ids[row[p]])]
                first, behind = np.searchsorted(keys, phrase[s:e], "left"), np.searchsorted(keys, phrase[s:e], "right")
                many = behind - first
                which = np.repeat(np.arange(s, e), many)
                verdict = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield row[p], data, at[which], at[which] - base[p] + offset[p], size[which], trigger[which], phrase[which], a[verdict], b[verdict], kind[verdict]

    def content(self, left: pa.Table, right: pa.Table) -> pa.Table:
        """The phrases asked for, with their bytes."""
        ids, texts = left.column("__id").to_numpy(), [t.encode("utf-8", "surrogatepass") for t in left.column("__text").to_pylist()]
        parts, docs, hashes, starts, sizes, raw = [], [], [], [], [], []
        for row, data, at, _, size, trigger, phrase, _, _, kind in self.marked(ids, texts, self.verdicts(right)):
            part = (trigger >> np.uint64(40)).astype(np.int64) % self.parts
            for split in (False, True):
                which = kind == (ASK_WINDOWS if split else ASK)
                if not which.any():
                    continue
                s, n, h, p = at[which], size[which], phrase[which], part[which]
                first = np.zeros(len(s), np.int64)
                if split:  # a window is a phrase of its own, dealt by its hash
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    s, h, first, n = np.repeat(s, n) + k, np.repeat(h, n), k, np.ones(n.sum(), np.int64)
                    p = (Hasher(data).spans(s, np.full(len(s), self.length)) >> np.uint64(20)).astype(np.int64) % self.parts
                parts.append(p)
                docs.append(np.full(len(s), ids[row]))
                hashes.append(h)
                starts.append(first)
                sizes.append(n)
                raw += [data[x: x + y + self.length - 1].tobytes() for x, y in zip(s.tolist(), n.tolist())]
        if not parts:
            return pa.Table.from_batches([_batch([])])
        part, doc, phrase, first, size = (np.concatenate(x) for x in (parts, docs, hashes, starts, sizes))
        order = np.argsort(part, kind="stable")
        rows = []
        for r in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            blob = pack(phrase[r], doc[r], first[r].astype(np.uint8), size[r].astype(np.uint8))
            text = zstandard.ZstdCompressor(level=1).compress(b"".join([raw[i] for i in r.tolist()]))
            rows.append((CONTENT, int(part[r[0]]), len(blob).to_bytes(8, "little") + blob + text))
        return pa.Table.from_batches([_batch(rows)])

    def sort(self, batches):
        """Phrases of a part to runs of windows that a smaller document has too."""
        held: list[list] = []
        verdicts, gathered, at = [], 0, None

        def judge() -> int:
            phrase, doc, first, size = (np.concatenate(x) for x in list(zip(*held))[:4])
            text = np.frombuffer(b"".join(x[4] for x in held), np.uint8)
            width = size.astype(np.int64) + self.length - 1
            base = np.cumsum(width) - width
            n = size.astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            suffix = np.lib.stride_tricks.sliding_window_view(text, self.length)[base[owner] + k]
            keys = np.ascontiguousarray(suffix).view(f"S{self.length}").reshape(-1)
            order = np.argsort(keys, kind="stable")  # the suffix array, to the depth that matters
            new = _heads(keys[order])
            smallest = np.minimum.reduceat(doc[owner][order], np.flatnonzero(new))[np.cumsum(new) - 1]
            gone = np.zeros(len(order), bool)
            gone[order] = self.rank(doc[owner][order]) > self.rank(smallest)
            run = gone.copy()
            run[1:] &= ~(gone[:-1] & (owner[1:] == owner[:-1]))
            s = np.flatnonzero(run)
            last = gone.copy()
            last[:-1] &= ~(gone[1:] & (owner[1:] == owner[:-1]))
            e = np.flatnonzero(last)
            o = owner[s]
            a = (k[s] + first[o]).astype(np.uint8)
            b = (k[e] + first[o] + 1).astype(np.uint8)
            verdicts.append((RUNS, [phrase[o], doc[o], a, b]))
            return len(o)

        for batch in slices(batches, 64):
            for _, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at and held:
                    gathered += judge()
                    held = []
                    if gathered >= GATHER:
                        yield self.sent(verdicts)
                        verdicts, gathered = [], 0
                at = part
                n = int.from_bytes(blob[:8], "little")
                held.append([*unpack(blob[8: 8 + n], "u8", "i8", "u1", "u1"), zstandard.ZstdDecompressor().decompress(blob[8 + n:])])
        if held:
            judge()
        yield self.sent(verdicts)

    def removed(self, ids: np.ndarray, texts: list[bytes], verdicts: dict) -> Iterator[np.ndarray]:
        """For each text, which bytes go."""
        edges: dict[int, np.ndarray] = {}
        for row, _, _, start, size, _, _, a, b, _ in self.marked(ids, texts, verdicts):
            if row not in edges:
                edges[row] = np.zeros(len(texts[row]) + 1, np.int32)
            np.add.at(edges[row], start + a, 1)
            np.add.at(edges[row], start + np.minimum(b, size) - 1 + self.length, -1)
        for i, t in enumerate(texts):
            yield np.cumsum(edges[i][:-1]) > 0 if i in edges else np.zeros(len(t), bool)


def _home(doc: Column, homes: int) -> Column:
    return F.pmod(doc, F.lit(homes)).cast("int")


def _stored_bytes(df: DataFrame) -> int:
    """Size of the tables that df reads, as the planner knows it; none for rows that aren't stored."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(n for n in sizes if n < LAST)  # the planner's number for an unknown size


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None, kept: str | None = None) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256 of each row. carry: columns that stay (the id); kept: bytes or text, to have the rest too."""
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix")
    homes = _prime(max(2 * partitions(spark), _stored_bytes(df) // HOME))
    p = Parser(length, gram, _prime(4 * partitions(spark)), homes)
    carry = [id_col] if carry is None else carry
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST) - F.pmod(F.xxhash64(text), F.lit(homes)))

    by_part = lambda rows: rows.repartition(partitions(spark), "part").sortWithinPartitions("part")
    parsed = df.select(doc.alias("id"), text.alias("text")).mapInArrow(p.parse, ROWS)
    replies = scratch.table(by_part(parsed).mapInArrow(p.own, ROWS), "dictionary")

    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    docs = df.select(_home(doc, p.homes).alias("part"), doc.alias("__id"), text.alias("__text"), *carried)
    asked = replies.where(F.col("kind").isin(ASK, ASK_WINDOWS))
    content = docs.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lambda left, right: p.content(left, right), ROWS)
    runs = by_part(content).mapInArrow(p.sort, ROWS)
    gone = replies.where(F.col("kind") == GONE).unionByName(runs)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = left.column("__id").to_numpy(), [t.encode("utf-8", "surrogatepass") for t in left.column("__text").to_pylist()]
        rows = []
        for t, out in zip(texts, p.removed(ids, texts, p.verdicts(right))):
            rest = np.frombuffer(t, np.uint8)[~out].tobytes() if out.any() else t
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
            rows.append((len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest(), *([rest.decode("utf-8", "ignore")] if kept == "text" else [rest] if kept else [])))
        names = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string() if kept == "text" else pa.binary())] if kept else [])]
        made = [pa.array(c, t) for c, (_, t) in zip(list(zip(*rows)) or [()] * len(names), names)]
        return pa.Table.from_arrays([*(left.column(f"c{i}") for i in range(len(carry))), *made], names=[*(f"c{i}" for i in range(len(carry))), *(n for n, _ in names)])

    kinds = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    schema = ", ".join([*kinds, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"] + [f"kept {'string' if kept == 'text' else 'binary'}"] * bool(kept))
    out = docs.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(finish, schema)
    return out.toDF(*carry, *out.columns[len(carry):])


def keep_first_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """df with the remaining bytes as text; bytes that no longer make a character go too."""
    places = df.toDF(*(f"p{i}" for i in range(len(df.columns))))  # no name of df meets one made here
    id_at, text_at = (f"p{df.columns.index(c)}" for c in (id_col, text_col))
    out = remove_repeats(places, id_at, text_at, length, carry=[c for c in places.columns if c != text_at], kept="text")
    found = [F.col("kept" if f"p{i}" == text_at else f"p{i}").alias(c) for i, c in enumerate(df.columns)]
    return with_length(out.select(*found), text_col, length_col)
