"""Best-fit packing after Martello-Toth dominance reduction.

Whole documents are encoded once into pieces of at most `capacity` ids. Pieces of one length are interchangeable,
so the instance is the histogram of lengths: `capacity` numbers at most, whatever the corpus. On it the reduction
fixes sets that provably dominate every other set with the same largest piece, and best fit packs the rest into
patterns with multiplicities. Pieces then take the places of their length by rank; ranks come from salted counts,
so a length that a third of all pieces have is spread over many tasks.

Defined results: a null text counts as empty, and a document without ids is one piece with the end id alone;
repeated rows and equal ids are packed separately; pieces of equal length are dealt in order of id and piece; a very
long text is many pieces; rows without an id are packed like any other; an empty table gives an empty table; further
columns of the input don't matter. A text that holds the string of an added token of the tokenizer's file, such as
<|endoftext|>, gets that token's id there, as the library does by default.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, map_rows, partitions, whole_text

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how often), ...), number of such sequences

# The byte-to-character table of byte-level vocabularies keeps these ranges and shifts the rest.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in PRINTED)}

_ENCODERS: dict[str, object] = {}


def encode_batch_of(path: str):
    """Function from texts to arrays of ids by a tokenizer file.

    A byte-level BPE file whose ids are its merge order is read as a rank table, which encodes the same ids faster.
    Texts that hold an added token's string, and all texts under any other file, go through the file's own library.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens", [])
    special = {x["id"] for x in added}
    ranks = None
    if model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer"):
        vocab = {bytes(BYTE_OF[c] for c in k): v for k, v in model["vocab"].items() if v not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in pairs]
        if order == list(range(256, 256 + len(order))) and len(vocab) == 256 + len(order):
            ranks = vocab
    slow = Tokenizer.from_file(path)
    library = lambda t: np.array(slow.encode(t, add_special_tokens=False).ids, np.uint32)
    if ranks:
        import public_tokenizers

        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        strings = [x["content"] for x in added]
        found = lambda texts: [library(t) if any(x in t for x in strings) else np.array(fast.encode_ordinary(t), np.uint32) for t in texts]
    else:
        found = lambda texts: [library(t) for t in texts]
    _ENCODERS[path] = found
    return found


def pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece; only the first piece of a long document may be shorter."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(encode_batch_of(path)(batch.column(1).to_pylist())):
            raw = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
            n = len(raw) // 4
            cuts = [0, *range(n % capacity or capacity, n, capacity), n]
            for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                row.append(i)
                piece.append(k)
                start.append(s)
                length.append(e - s)
                crc.append(zlib.crc32(raw[4 * s: 4 * e]))
        ids_of = batch.column(0).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([ids_of, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return map_rows(whole_text(df, id_col, text_col), run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long", rows=128)


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that dominate all others with the same largest piece, and the counts that are left.

    For a largest piece s with room r beside it: alone, if nothing fits; with a piece of exactly r; with the largest
    piece that fits, if no two do; with the best two, if no three do and they are no smaller than any other pair.
    """
    left, fixed = {k: v for k, v in counts.items() if v}, []

    def fix(*sizes: int, times: int) -> None:
        fixed.append((tuple(sorted(Counter(sizes).items(), reverse=True)), times))
        for k, n in Counter(sizes).items():
            left[k] -= n * times
            if not left[k]:
                del left[k]

    def times(*sizes: int) -> int:
        return min(left.get(k, 0) // n for k, n in Counter(sizes).items())

    changed = True
    while changed:
        changed = False
        for s in sorted(left, reverse=True):
            while left.get(s):
                r = capacity - s
                if r == 0:
                    fix(s, times=left[s])
                elif (n := times(s, r)) > 0:
                    fix(s, r, times=n)
                elif s != max(left):  # the rules below need s to be the largest piece left
                    break
                else:
                    others = sorted(k for k in left if left[k] - (k == s) > 0)
                    small = [k for k in others for _ in range(min(3, left[k] - (k == s)))][:3]
                    if not small or small[0] > r:
                        fix(s, times=1 if small and small[0] == s else left[s])
                    elif len(small) < 2 or small[0] + small[1] > r:
                        best = others[bisect_right(others, r) - 1]
                        fix(s, best, times=max(1, min(times(s, best), left[best] - 1) if best != s else 1))
                    elif len(small) < 3 or sum(small) > r:
                        a = others[bisect_right(others, r) - 1]
                        rest = [k for k in others if left[k] - (k == s) - (k == a) > 0]
                        at = bisect_right(rest, r - a) - 1
                        lesser = [y for y in others if y <= r // 2 and any(x >= y and x + y <= r and (x != y or left[x] - (x == s) > 1) for x in others)]
                        if at < 0 or (lesser and lesser[-1] > rest[at]):
                            break
                        fix(s, a, rest[at], times=1)
                    else:
                        break
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in decreasing order over counts: sequences that look alike are filled together."""
    open_: dict[tuple[int, tuple], int] = {}  # (room, what is in it) -> number of sequences
    rooms: list[tuple[int, tuple]] = []

    def put(room: int, inside: tuple, n: int) -> None:
        if n:
            key = (room, inside)
            if key not in open_:
                rooms.insert(bisect_left(rooms, key), key)
            open_[key] = open_.get(key, 0) + n

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, (s, ()))
            room, inside = rooms[at] if at < len(rooms) else (capacity, ())
            each = room // s
            if at < len(rooms):
                have = open_.pop(rooms.pop(at))
                full = min(have, n // each)
                rest = n - full * each if full < have else 0
                put(room, inside, have - full - (rest > 0))
            else:
                full, rest = divmod(n, each)
            put(room - each * s, (*inside, (s, each)), full)
            if rest:
                put(room - rest * s, (*inside, (s, rest)), 1)
            n -= full * each + rest
    return [(inside, n) for (_, inside), n in open_.items()]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, pieces a sequence, first sequence, first offset) of each run of places."""
    used, base, out = Counter(), 0, []
    for inside, n in patterns:
        offset = 0
        for size, each in inside:
            out.append((size, used[size], used[size] + n * each, each, base, offset))
            used[size] += n * each
            offset += size * each
        base += n
    return out


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.table(pieces(df, path, capacity, end_id, id_col, text_col), "pieces")
    salts = max(64, partitions(spark), cut.count() >> 20)  # about a million pieces of one length in a window
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(places(plan(counts, capacity)), "length long, lo long, hi long, per long, base long, off long")  # a bound by capacity, whatever the corpus
    before = by_salt.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))  # `salts` rows a length
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "piece")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    found = ranked.join(F.broadcast(runs.withColumnRenamed("length", "size")), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    t = F.col("rank") - F.col("lo")
    return found.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(t / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("off") + (t % F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )
