import hashlib
import random

import numpy as np
import pytest

from pixelmill.llm import suffix


def brute(rows, length):
    """rows: (id, bytes)."""
    where = {}
    for i, t in rows:
        for s in range(len(t) - length + 1):
            w = t[s: s + length]
            where[w] = min(where.get(w, i), i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if where[t[s: s + length]] < i:
                gone[s: s + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(df, **options):
    got = suffix.remove_repeats(df, **options)
    return sorted(((suffix.LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k, a="abé ": "".join(rng.choice(a) for _ in range(k))
    passages = [text(rng.randint(30, 300), "abcdefé ") for _ in range(8)] + ["x" * 700, "ab" * 200, text(4) * 60]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 80), "abcdefghé ")]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            parts += [p[a: rng.randint(a, len(p))] if rng.random() < 0.7 else p, text(rng.randint(0, 60), "abcdefghé ")]
        rows.append((rng.randrange(10 * n), "".join(parts), "t", 1))
    rows += [rows[0], rows[3], (None, rows[5][1], None, None), (rows[7][0], rows[8][1], "a", 2), (5, None, None, None), (6, "", None, None)]
    rows += [(None, text(60) + passages[k % 3] + text(70, "uvwxyz ") * 2, None, None) for k in range(9)]  # rows without an id share passages
    return rows


@pytest.mark.parametrize(("seed", "length", "gram", "block", "hot"), [(1, 50, 16, 1 << 19, 4096), (2, 50, 16, 70, 1), (3, 20, 5, 200, 2), (4, 50, 24, 64, 0)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, length, gram, block, hot):
    monkeypatch.setattr(suffix, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, blob int").repartition(5)
    want = brute([(suffix.LAST if i is None else i, (t or "").encode()) for i, t, *_ in rows], length)
    steps = local(rows, length, gram, hot, monkeypatch)
    assert steps == want
    if seed == 1:
        assert run(df, length=length, gram=gram) == want


def local(rows, length, gram, hot, monkeypatch):
    """The same steps without Spark, where constants can be small."""
    import pyarrow as pa

    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "HOLD", 3000)
    p = suffix.Parser(length, gram, 7, 3)
    ids, texts = [suffix.LAST - k % 3 if r[0] is None else r[0] for k, r in enumerate(rows)], [r[1] or "" for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["id", "text"])

    def dealt(batches):
        t = pa.Table.from_batches(list(batches), schema=suffix._batch([]).schema)
        return t.sort_by("part").to_batches()

    replies = pa.Table.from_batches(list(p.own(dealt(p.parse([batch])))))
    left = pa.Table.from_arrays([pa.array(ids), pa.array(texts)], names=["__id", "__text"])
    content = p.content(left, replies.filter(pa.compute.is_in(replies["kind"], pa.array([suffix.ASK, suffix.ASK_WINDOWS], pa.int32()))))
    gone = [*replies.filter(pa.compute.equal(replies["kind"], suffix.GONE)).to_batches(), *p.sort(dealt(content.to_batches()))]
    gone = pa.Table.from_batches(gone, schema=suffix._batch([]).schema)
    out = []
    raw = [t.encode() for t in texts]
    for i, t, g in zip(ids, raw, p.removed(np.array(ids), raw, p.verdicts(gone))):
        out.append((suffix.LAST if i > suffix.LAST - 3 else i, len(t), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_empty_table_and_carried_columns(spark, documents, empty):
    assert suffix.remove_repeats(empty).count() == 0
    got = suffix.remove_repeats(documents, carry=documents.columns, kept="bytes")
    assert got.columns[: len(documents.columns)] == documents.columns and got.count() == documents.count()


def test_homes_follow_the_bytes_stored(spark, documents, tmp_path, monkeypatch):
    documents.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    size = suffix._stored_bytes(stored)
    assert size > 1000 and suffix._stored_bytes(stored.select("doc_id").crossJoin(stored.select("text"))) == 2 * size
    want = run(stored)
    monkeypatch.setattr(suffix, "HOME", size // 200)
    assert run(stored) == want
