"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece there is exactly one token that can end its encoding: the longest suffix token
whose left neighbour (the last token of the shorter prefix) would not be merged with it. Storing that token for
each prefix makes appends exact (only the new prefixes are computed) and lets an edit reuse all prefixes before it.
Prefixes of words are shared by many words, so the table of a task is a trie kept as a bounded dictionary.

Defined results: a null text counts as empty and has no ids; a lone surrogate is encoded as its replacement; very
long pieces are encoded by the same recurrence over an array; equal texts get equal ids; an empty table gives an
empty table; further columns of the input don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows, whole_text

#: A space before a visible character always starts a match of the pattern, so texts may be cut there.
CUT = re.compile(r" (?=\S)")
#: Entries of a task's caches.
CACHE = 420_000
#: Pieces up to this length share their prefixes through the dictionary.
SHARED = 48
NEVER = 1 << 60
SHORT = (2, 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of base64 token and rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Bounded(dict):
    """A cache that is emptied when it is full."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.size:
            self.clear()
        self[key] = value
        return value


class PrefixEncoder:
    """Encoder and decoder over a rank table and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        by_end: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) >= 3:
                by_end.setdefault(token[-3:], set()).add(len(token))
        #: Lengths, from the longest, of the tokens that end in three bytes.
        self.sizes = {k: (*sorted(v, reverse=True), 2, 1) for k, v in by_end.items()}
        self.spines: dict[bytes, tuple[list, list, bool]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.prefixes = Bounded(self._prefix, CACHE // 2)
        self.pieces = Bounded(self._piece, CACHE // 8)
        self.chunks = Bounded(self._chunk)

    def _spines(self, token: bytes) -> tuple[list, list, bool]:
        """Parts that held the first and the last byte while the token was merged, each with the rank that ends it."""
        if (known := self.spines.get(token)) is None:
            parts, first, last = [token[i: i + 1] for i in range(len(token))], [token[:1]], [token[-1:]]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                parts[at: at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    first.append(parts[0])
                if at == len(parts) - 1:
                    last.append(parts[-1])
            until = lambda x: list(zip(x, [self.ranks[y] for y in x[1:]] + [NEVER]))
            known = self.spines[token] = (until(first), until(last), len(parts) == 1)
        return known

    def _fit(self, left: bytes, right: bytes) -> bool:
        """True if merging makes the right token and never joins the two: at no time has their boundary the lowest rank."""
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= CACHE // 2:
                self.fits.clear()
            known = self.fits[key] = self._spines(right)[2] and self._stays(left, right)
        return known

    def _stays(self, left: bytes, right: bytes) -> bool:
        a, b, i, j, ranks = self._spines(left)[1], self._spines(right)[0], 0, 0, self.ranks
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = ranks.get(x + y, NEVER)
            if rank < x_ends and rank <= y_ends and rank != NEVER:  # of equal ranks the leftmost is merged first
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _prefix(self, prefix: bytes) -> tuple[bytes, str]:
        """The only token that can end the encoding of prefix, and its ids, joined by commas."""
        n, ranks = len(prefix), self.ranks
        for size in self.sizes.get(prefix[-3:], SHORT):
            if size > n or (rank := ranks.get(prefix[n - size:])) is None:
                continue
            token = self.tokens[rank]
            if size == n:
                if self._spines(token)[2]:
                    return token, str(rank)
            else:
                last, ids = self.prefixes[prefix[: n - size]]
                if self._fit(last, token):
                    return token, f"{ids},{rank}"
        raise ValueError("the table lacks a byte")

    def _grow(self, piece: bytes, ends: list[bytes]) -> None:
        """Add the last token of the next prefix to those of all shorter ones."""
        n = len(ends) + 1
        for size in self.sizes.get(piece[max(0, n - 3): n], SHORT):
            token = piece[n - size: n]
            if size <= n and token in self.ranks and (self._spines(token)[2] if size == n else self._fit(ends[n - size - 1], token)):
                ends.append(token)
                return
        raise ValueError("the table lacks a byte")

    def prefix_tokens(self, piece: bytes, known: list[bytes] | None = None) -> list[bytes]:
        """Last token of each prefix, by length from 1; known: those of a shorter prefix, which are kept as they are."""
        ends = list(known or [])
        while len(ends) < len(piece):
            self._grow(piece, ends)
        return ends

    def path(self, piece: bytes, ends: list[bytes]) -> list[int]:
        """Ids read back from the last tokens of the prefixes."""
        out, n = [], len(piece)
        while n:
            out.append(self.ranks[ends[n - 1]])
            n -= len(ends[n - 1])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        if len(piece) > SHARED:
            return self.path(piece, self.prefix_tokens(piece))
        return list(map(int, self._prefix(piece)[1].split(",")))

    def append(self, piece: bytes, ends: list[bytes], more: bytes) -> tuple[bytes, list[bytes]]:
        """The piece with more bytes, and its table; only the new prefixes are computed."""
        return piece + more, self.prefix_tokens(piece + more, ends)

    def edit(self, piece: bytes, ends: list[bytes], start: int, end: int, new: bytes) -> tuple[bytes, list[bytes]]:
        """The piece with bytes start..end replaced, and its table.

        Prefixes before the edit stay. Behind it, once the last tokens of as many prefixes as the longest token has
        bytes are those of the old table, all later ones are too.
        """
        out = piece[:start] + new + piece[end:]
        table, shift, same = ends[:start], len(new) - (end - start), 0
        for n in range(start + 1, len(out) + 1):
            self._grow(out, table)
            old = n - shift
            same = same + 1 if n > start + len(new) and 0 < old <= len(ends) and ends[old - 1] == table[-1] and len(table[-1]) <= n - start - len(new) else 0
            if same >= self.longest:
                return out, table + ends[old:]
        return out, table

    def encode(self, text: str) -> list[int]:
        return [x for m in self.pattern.findall(text) for x in self.encode_piece(m.encode("utf-8", "replace"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _piece(self, piece: str) -> tuple[str, bytes]:
        """Ids of one match of the pattern, joined by commas, and what they decode to."""
        ids = self.encode_piece(piece.encode("utf-8", "replace"))
        return ",".join(map(str, ids)), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[str, bytes]:
        """The same for a space and what follows it up to the next cut."""
        if chunk.isalpha():  # one match
            return self._piece(" " + chunk)
        parts = [self.chunks[m[1:]] if m[0] == " " and m[1:].isalpha() else self.pieces[m] for m in self.pattern.findall(" " + chunk)]
        if len(parts) == 1:
            return parts[0]
        ids, raw = zip(*parts)
        return ",".join(ids), b"".join(raw)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the decimal ids and of the decoded bytes, for texts of any length."""
        first, *rest = CUT.split(text)
        found = list(map(self.pieces.__getitem__, self.pattern.findall(first)))
        found += map(self.chunks.__getitem__, rest)
        ids, raw = zip(*found) if found else ((), ())
        joined = ",".join(ids)
        return joined.count(",") + bool(joined), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()


_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def encoder(path: str, pattern: str) -> PrefixEncoder:
    """The encoder of a worker process; its caches serve all its tasks."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(load_ranks(path), pattern)
    return _ENCODERS[key]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of each whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch):
        enc = encoder(path, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=[id_col, "ids"])

    return map_rows(whole_text(df, id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes: what the ids stand for; null ids give empty bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch):
        enc = encoder(path, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=[id_col, "bytes"])

    return map_rows(df.select(id_col, ids_col), run, f"`{id_col}` {kind}, bytes binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each whole text, without moving the ids."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch):
        enc = encoder(path, pattern)
        rows = [enc.digest(t) for t in batch.column(1).to_pylist()]
        n, a, b = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(whole_text(df, id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
