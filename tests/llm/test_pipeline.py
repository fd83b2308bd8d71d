import random
import sys
import zlib
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from test_nearcopies import brute_shingles, similar  # noqa: E402
from test_text_operators import base_spans, brute_components  # noqa: E402

import corpus_pipeline  # noqa: E402
from pixelmill.llm import quality, secrets  # noqa: E402


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage, rows = prose(30), []
    for i in range(60):
        text = "\n".join(prose(rng.randint(20, 90)) for _ in range(3))
        kind = i % 10
        if kind == 1:
            text = rows[-1][1]
        elif kind == 2:
            text = rows[-2][1].replace(" ", "  ", 1)
        elif kind == 3:
            text += "\n" + passage + " " + prose(20)
        elif kind == 4:
            text = "too short"
        elif kind == 5:
            text += "\npassword = " + "".join(rng.choice("0123456789abcdefXYZ") for _ in range(20)) + " " + word()
        elif kind == 6:
            text += "\nAll rights reserved."
        elif kind == 7:
            text = " ".join(x + " $$$" for x in text.split())
        rows.append((200 - i, text, "en", f"s{i % 4}", len(text)))
    return [*rows, (500, None, None, None, None), rows[8], (501, "", "xx", "s1", 0)]


def brute(rows):
    kept = {}
    for i, t, lang, source, _ in rows:
        judged = quality.judge(t or "", quality.LineRules())
        if judged[6]:
            kept[i] = (judged[9], source)
    sets = {i: brute_shingles(t) for i, (t, _) in kept.items()}
    first = brute_components(sets, lambda a, b: similar(sets[a], sets[b]))
    kept = {i: x for i, x in kept.items() if first[i] == i}
    where = {}
    raw = {i: t.encode() for i, (t, _) in kept.items()}
    for i in sorted(raw):
        for s in range(len(raw[i]) - 49):
            where.setdefault(raw[i][s: s + 50], i)
    for i, b in raw.items():
        gone = set()
        for s in range(len(b) - 49):
            if where[b[s: s + 50]] < i:
                gone.update(range(s, s + 50))
        kept[i] = (bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore"), kept[i][1])
    out = {}
    for i, (t, _) in kept.items():
        at, new = 0, ""
        for s, _, _, e in base_spans(t):
            if s >= at:
                new += t[at:s] + secrets.REDACTED
            at = max(at, e)
        out[i] = new + t[at:]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    want = brute(rows)
    assert 20 < len(want) < 50
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert docs.columns == columns and docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert {r.doc_id: r.text for r in docs.collect()} == want and docs.count() == len(want)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for i, t in want.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        pieces += [(i, k, s, e - s, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s:e]))) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    least = max(-(-sum(x[3] for x in pieces) // 1024), sum(x[3] > 512 for x in pieces))
    assert least <= len({r.sequence_id for r in got}) <= 11 / 9 * least + 1


def test_stages_take_odd_tables(spark, documents, empty, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        before, after = documents.count(), stage(spark, documents, "")
        if name == "best-fit packing":
            assert after.where("length < 1 OR length > 1024").count() == 0 and after.where("piece = 0").count() == before
        else:
            assert after.columns == documents.columns and 0 < after.count() <= before, name


def test_stages_keep_columns_of_any_name(spark):
    """Every stage on repeated rows, ties, null ids and columns named like those that operators make."""
    names = ["__key", "__spans", "__0", "__text", "key", "digest", "id", "first", "row", "p0", "c1", "part", "kept", "n", "spans", "a.b"]
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    long, other, passage = prose(120), prose(120), prose(30)
    texts = [(1, long), (1, long), (1, other), (2, long), (None, long), (None, None), (3, prose(90) + " " + passage), (4, prose(90) + " " + passage), (5, prose(80) + " password=abcd1234efgh"), (6, None), (7, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    own = lambda i: [f"{n}-{i}" for n in names]
    rows = [(i, t, "en", "s", None if t is None else len(t), *own(k)) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    whole = lambda df: sorted(map(tuple, df.collect()), key=repr)
    stages = dict(zip("qnsr", (f for _, f in corpus_pipeline.STAGES)))
    good = [r for r in rows if r[1] and len(r[1].split()) >= 50]
    assert whole(stages["q"](spark, docs, "")) == sorted(good, key=repr)
    empty_one = min((r for r in rows if r[0] in (6, 7)), key=lambda r: r[0])  # texts without words are copies of one another
    kept = [rows[0], rows[2], rows[4], rows[5], rows[6], rows[7], rows[8], empty_one]
    assert whole(stages["n"](spark, docs, "")) == sorted(kept, key=repr)
    got = {r[5]: tuple(r) for r in stages["s"](spark, docs, "").collect()}
    assert set(got) == {r[5] for r in rows} and all(got[r[5]][5:] == r[5:] for r in rows)
    assert [got[rows[k][5]][1] for k in (0, 1, 2)] == [long, long, other] and got[rows[3][5]][1] == "" == got[rows[4][5]][1]
    assert got[rows[6][5]][1] == rows[6][1] and passage[:-1] not in got[rows[7][5]][1]
    assert whole(stages["r"](spark, docs.drop("n_chars"), "")) == sorted(((*r[:4], *r[5:]) if r[0] != 5 else (5, r[1].replace("password=abcd1234efgh.", "[REDACTED]").replace("password=abcd1234efgh", "[REDACTED]"), *r[2:4], *r[5:]) for r in rows), key=repr)
    pieces = [(r.doc_id, r.length) for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()]
    assert sorted(map(str, (i for i, _ in pieces))) == sorted(str(i) for i, _ in texts)
