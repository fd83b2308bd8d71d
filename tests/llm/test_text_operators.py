import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelmill.llm import bpe, packing, quality, secrets, simhash, toxicity, warc

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 2: byte-level BPE


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})


def test_bpe_digests_equal_the_library(documents, pairs, empty):
    ref = reference()
    want = []
    for i, t in pairs:
        ids = ref.encode_ordinary(t)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t)))
    assert rows(bpe.digests(documents, MULTI, public_tokenizers.PATTERN)) == sorted(want, key=repr)
    assert bpe.digests(empty, MULTI, public_tokenizers.PATTERN).count() == 0


def test_bpe_round_trip_over_tables(documents, pairs):
    ids = bpe.encode(documents, MULTI, public_tokenizers.PATTERN)
    back = bpe.decode(ids, MULTI, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in back.collect()), key=repr) == sorted(((i, t.encode()) for i, t in pairs), key=repr)


def test_bpe_random_texts_equal_the_library():
    ref, enc, rng = reference(), bpe.encoder(MULTI, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice("ab 12'sltheing\n\t.é日\x1c\x85  ") for _ in range(rng.randint(0, 50)))
        ids = ref.encode_ordinary(t)
        assert enc.encode(t) == ids and enc.decode(ids) == t.encode()
        assert enc.digest(t)[:2] == (len(ids), sha(",".join(map(str, ids))))


def test_bpe_appends_and_edits_equal_a_new_table():
    enc, rng = bpe.encoder(MULTI, public_tokenizers.PATTERN), random.Random(2)
    piece = b"internationalization of the abcdefgh hello" * 3
    table = enc.prefix_tokens(piece)
    assert enc.append(piece, table, b"ing") == (piece + b"ing", enc.prefix_tokens(piece + b"ing"))
    for _ in range(150):
        i = rng.randint(0, len(piece))
        j = rng.randint(i, min(len(piece), i + 5))
        out, new = enc.edit(piece, table, i, j, bytes(rng.choice(b"abc the") for _ in range(rng.randint(0, 4))))
        assert new == enc.prefix_tokens(out)


# 3: secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_base_spans_equal_brute_force(documents, pairs, empty):
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.report(documents).collect()), key=repr)
    want = []
    for i, t in pairs:
        s = base_spans(t)
        n = Counter(x[2] for x in s)
        want.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in s))))
    assert got == sorted(want, key=repr)
    assert secrets.report(empty).count() == 0


def test_secret_frequency_separates_examples(spark):
    value = "ab12cd34ef56ab12cd34EF"
    wide = [(i, f"use {value} x password=samplevalue{'1' * 8}", "en", f"s{i}") for i in range(4)]
    own = [(10, "own zz98yy76xx54ww32vv10UU x password=mineonly99", "en", "s1"), (11, None, None, None)]
    df = spark.createDataFrame(wide + own, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secrets.report(df).collect()}
    assert got[0].n_live == 0 and got[0].n_example == 1 and got[10].n_live == 1 and got[10].n_example == 0
    assert "live:4:26" in got[10].spans and got[11].spans == ""
    text = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert secrets.redact(df.limit(0)).count() == 0
    assert text[0] == wide[0][1] and text[10] == "own [REDACTED] x [REDACTED]" and text[11] is None


def test_secret_examples_need_owners_and_repositories(spark):
    """Against a brute-force verdict: values of many owners in one repository, of one owner in many, and of many in many."""
    rng = random.Random(9)
    values = ["ab12cd34ef56ab12cd34EF", "one1owner2many3repos4X", "many1owners2one3repoX", "two1owners2many3repos4"]
    places = {0: [(f"o{k}", f"r{k}") for k in range(4)], 1: [("o1", f"r{k}") for k in range(6)], 2: [(f"o{k}", "shared") for k in range(6)], 3: [(f"o{k % 2}", f"r{k}") for k in range(6)]}
    rows_ = [(len(values) * k + v, f"see {values[v]} " + "x" * rng.randint(0, 5), repo, owner) for v in places for k, (owner, repo) in enumerate(places[v])]
    rows_ += [(r[0], r[1], r[2], r[3]) for r in rows_[:5]]  # repeated rows count once
    df = spark.createDataFrame(rows_, "doc_id long, text string, repo string, owner string")
    got = {r.doc_id: r.spans for r in secrets.report(df, repo_cols=["repo"], owner_col="owner").collect()}
    for i, t, _, _ in rows_:
        v = next(k for k, x in enumerate(values) if x in t)
        live = len({o for o, _ in places[v]}) < 3 or len({r for _, r in places[v]}) < 3
        assert got[i] == ("live:4:26" if live else "").replace("26", str(4 + len(values[v]))), v


# 4: WARC


def pages_of(spark, n=60):
    rng = random.Random(3)
    body = ["<p>" + "é日x"[k % 3] * rng.randint(0, 3000) + str(k) for k in range(12)]
    rows_ = [(i, f"http://h/é{i}\n", body[i % 12] if i % 5 else None, "x") for i in range(n)] + [(None, None, body[1], "y"), (3, "http://h/3", body[3], "z")]
    return spark.createDataFrame(rows_, "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, tmp_path):
    df = pages_of(spark)
    pages = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    for size in (256, 700, 1 << 20):
        at = f"file://{tmp_path}/{size}"
        warc.write_archives(df, at, segment_bytes=size)
        got = rows(warc.read_archives(spark, at))
        want = []
        for i, b in pages:
            last = max((p for p, c in pages if c == b and p is not None), default=None) if len(b) >= 1000 else None
            many = len(b) >= 1000 and sum(c == b for _, c in pages) > 1
            refers = last if many and last is not None and (i is None or i < last) else None
            want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers is not None else "response", refers, True, None if refers is not None else bytearray(b)))
        assert got == sorted(want, key=repr)
    warc.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_files_are_plain_gzip_members(spark, tmp_path):
    import gzip

    warc.write_archives(pages_of(spark), f"file://{tmp_path}/w", segment_bytes=300)
    raw = [gzip.open(f).read() for f in (tmp_path / "w").glob("part-*")]
    assert sum(x.count(b"WARC-Type: continuation") for x in raw) > 0 and all(x.startswith(b"WARC/1.1\r\n") for x in raw if x)


def test_warc_reports_a_lost_segment(spark, tmp_path):
    body = b"z" * 3000
    parts = list(warc.records(7, "http://h", body, hashlib.sha1(body).hexdigest(), None, 1000))
    (tmp_path / "a.gz").write_bytes(b"".join(parts[:1] + parts[2:]))
    assert [(r.page_id, r.intact) for r in warc.read_archives(spark, f"file://{tmp_path}/a.gz").collect()] == [(7, False)]
    (tmp_path / "b.gz").write_bytes(b"".join(parts[::-1]))
    assert [(r.page_id, r.intact, bytes(r.payload)) for r in warc.read_archives(spark, f"file://{tmp_path}/b.gz").collect()] == [(7, True, body)]


# 7: toxicity


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    data = []
    for i in range(900):
        w, bad = [word() for _ in range(rng.randint(5, 60))], rng.random() < 0.2
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vileness", "nastyword"]) + rng.choice(["", "s", "es"])
        data.append((i, " ".join(w), rng.choice(["en", "de", None]), int(bad), "clash"))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int, score string")
    docs = df.select("doc_id", "text", "lang", "score").unionByName(spark.createDataFrame([(5000, None, None, None), (5001, "", "xx", None)], "doc_id long, text string, lang string, score string"))
    model = toxicity.train(docs, df.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, _, _, y, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert got[5000].score == got[5001].score
    again = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("lang", F.lit("zz")), model).collect()}
    assert all(again[i] == got[i].score for i in got)  # language is no input of a score
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, df.select("doc_id", "toxic").limit(0))).collect()} == {0.0}


def test_toxicity_learns_from_every_labelled_row(spark):
    """A toxic word that only rows of the highest hashes have, past the 8 000 rows that were once all that training saw."""
    key = spark.range(13000).select("id", F.xxhash64("id").alias("h"), (toxicity.fold("id") == 0).alias("out"))
    order = [r.id for r in key.where("NOT out").orderBy("h", "id").collect()]
    assert len(order) > 10000
    late, rng = set(order[8200:]), random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    data = []
    for i in range(13000):
        bad = rng.random() < 0.2
        data.append((i, " ".join([word(), word(), *(["grimword" if i in late else "vileness"] if bad else []), word()]), "en", int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int").repartition(3)
    assert "grimword" in " ".join(t for i, t, _, _ in data if i in late)
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert model.score("abc dab grimword cab") > 0.5 > model.score("abc dab cab")
    assert model.score("abc dab vileness cab") > 0.5
    again = toxicity.train(df.drop("toxic").repartition(5), df.select("doc_id", "toxic").repartition(2))  # whatever the partitions
    assert again.score("abc dab grimword cab") == model.score("abc dab grimword cab")


def test_toxicity_blocks_equal_the_whole(monkeypatch):
    rng = random.Random(6)
    texts = [[rng.randrange(50) for _ in range(rng.randint(1, 40))] for _ in range(200)]
    import numpy as np

    model = toxicity.fit([np.repeat(np.array(t), 3) for t in texts], np.array([int(7 in t) for t in texts]), ["en"] * 200, min_docs=1)
    pool = model.pool_of(np.array([model.row_of[x] for x in texts[0] for _ in range(3)]).reshape(-1, 3))
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    assert np.allclose(pool, model.pool_of(np.array([model.row_of[x] for x in texts[0] for _ in range(3)]).reshape(-1, 3)))


def plain_score(model, text):
    """The classifier written out: sums of embeddings, each filter at each place, the largest response, the logistic layer."""
    import numpy as np

    x = [sum(model.embeddings[model.row_of.get(h, 0)] for h in toxicity.word_hashes(w)) for w in text.lower().split()]
    pooled = []
    for w, b in model.filters:
        for f in range(w.shape[2]):
            at = [sum(float(x[i + j] @ w[j][:, f]) for j in range(len(w)) if i + j < len(x)) + float(b[f]) for i in range(len(x))]
            pooled.append(max([0.0, *at]))
    return 1 / (1 + np.exp(-(float(np.dot(pooled, model.out)) + model.bias)))


def test_toxicity_scores_equal_a_plain_convolution():
    import numpy as np

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    labels = np.array([int(vocabulary[3] in t.split() or f"{vocabulary[5]} {vocabulary[6]}" in t) for t in texts])
    hashed = [np.array([h for w in toxicity.words(t) for h in toxicity.word_hashes(w)]) for t in texts]
    model = toxicity.fit(hashed, labels, ["en"] * len(texts))
    for t in [*texts[:60], "", vocabulary[3], "unseen words only", (vocabulary[3] + "! ") * 3, " ".join(texts)]:
        assert abs(model.score(t) - plain_score(model, t)) < 1e-4


# 8: quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_statistics_equal_brute_force(documents, pairs, empty):
    got = quality.clean_lines(documents, with_text=False)
    assert rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(((i, *brute_quality(t)) for i, t in pairs), key=repr)
    assert got.where("kept AND base_failed").count() == 0 and quality.clean_lines(empty).count() == 0


def test_quality_lines():
    good, other, third = (" ".join(f"{k}{i * i}" for i in range(40)) + "." for k in ("word", "other", "third"))
    judged = quality.judge("\n".join([good, "Home | News | Sport | About | Contact", "All rights reserved.", other, third, "Short line.", "Short line."]), quality.LineRules())
    assert judged[6] and judged[9] == "\n".join([good, other, third, "Short line."])
    assert quality.judge("\n".join([good, "Startseite", "Lire la suite ici", "Chapter one:", "Yes.", other]), quality.LineRules())[9] == "\n".join([good, "Chapter one:", "Yes.", other])
    junk = quality.judge("\n".join([good] + [" ".join(f"word{i}{j} $$$ |" for j in range(30)) for i in range(9)]), quality.LineRules())
    assert not junk[6] and junk[8] == "symbols"


# 9: SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = [" ".join(w[i: i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = dict(zip(nodes, nodes))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {x: find(x) for x in nodes}


def test_simhash_equals_brute_force(documents, pairs, empty):
    fps = {i: brute_fingerprint(t) for i, t in pairs if i is not None}
    comp = {**brute_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4), None: None}
    found = sorted(((i, brute_fingerprint(t), comp[i]) for i, t in pairs), key=repr)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_classes(documents).collect()), key=repr) == found
    assert simhash.simhash_classes(empty).count() == 0


@pytest.mark.parametrize(("most", "hot"), [(2048, 1 << 16), (8, 1 << 16), (0, 4), (8, 3)])
def test_simhash_links_of_chains_and_balls(spark, monkeypatch, most, hot):
    from pixelmill.llm.common import Scratch
    from pixelmill.llm.components import components

    monkeypatch.setattr(simhash, "LIST", most)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng, fps = random.Random(8), {}
    for c in range(40):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.setdefault(at, len(fps) * 3)
            for _ in range(rng.choice([1, 3, 4, 5, 6])):
                at ^= 1 << rng.randrange(64)
    by_id = {v: k for k, v in fps.items()}
    comp = brute_components(by_id, lambda a, b: (by_id[a] ^ by_id[b]).bit_count() <= 4)
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in by_id.items()], "id long, fp long").repartition(3)
    got = {r.node: r.component for r in components(scratch, simhash.links(scratch, df)).collect()}
    assert {i: got.get(i, i) for i in by_id} == comp
    if most:
        return
    path = spark.createDataFrame([((i * 7919) % 3001, ((i + 1) * 7919) % 3001) for i in range(3000)], "a long, b long")
    assert {(r.component) for r in components(scratch, path).collect()} == {0}


def test_simhash_links_entries_that_several_pivots_reach(spark):
    """One list of balls that hang together by single entries, none of which another list has: all differ in bytes 1 to 4 only."""
    import numpy as np

    from pixelmill.llm.common import Scratch
    from pixelmill.llm.components import Forest, components, forest

    middle = 0x1122334455667788
    ends = [middle ^ sum(1 << 8 * p + b for p in (1, 2, 3, 4)) for b in range(8)]  # four bits from the middle, eight from one another
    fps = dict(enumerate([*ends, middle]))
    for order in (list(fps), list(fps)[::-1]):
        found = Forest()
        simhash._within(np.array([fps[i] for i in order], np.uint64), np.array(order), 4, found)
        assert {(int(a), int(b)) for a, b in zip(*forest(*next(iter(found.edges()))))} == {(i, 0) for i in range(1, 9)}
    df = spark.createDataFrame(list(fps.items()), "id long, fp long").coalesce(1)
    got = {r.node: r.component for r in components(Scratch(spark, "t"), simhash.links(Scratch(spark, "t"), df)).collect()}
    assert got == {i: 0 for i in range(1, 9)}
    for seed in range(8):  # dense chains of more entries than are pivots at once
        rng = random.Random(seed)
        many = set()
        for _ in range(40):
            at = rng.getrandbits(64)
            for _ in range(7):
                many.add(at)
                at ^= sum(1 << b for b in rng.sample(range(64), 4))
        many = dict(enumerate(rng.sample(sorted(many), len(many))))
        found = Forest()
        simhash._within(np.array(list(many.values()), np.uint64), np.arange(len(many)), 4, found)
        to = {int(a): int(b) for a, b in zip(*forest(*next(iter(found.edges()))))}
        assert {i: to.get(i, i) for i in many} == brute_components(many, lambda a, b: (many[a] ^ many[b]).bit_count() <= 4)


# 10: packing


def test_packing_places_every_piece(documents, pairs, empty):
    tok = Tokenizer.from_file(JSON)
    got = packing.pack(documents, JSON, capacity=64)
    want = []
    for i, t in pairs:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        want += [(i, k, s, e - s, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s:e]))) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    found = got.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(want, key=repr)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
    assert len(by) <= 1.01 * sum(w[3] for w in want) / 64 + 1
    assert packing.pack(empty, JSON).count() == 0


def optimum(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1:])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(0)
    for _ in range(300):
        cap = rng.randint(5, 30)
        sizes = sorted((rng.randint(1, cap) for _ in range(rng.randint(0, 8))), reverse=True)
        fixed, left = packing.reduce_instance(Counter(sizes), cap)
        rest = sorted((k for k, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + optimum(rest, cap) == optimum(sizes, cap)
        plan = packing.plan(Counter(sizes), cap)
        used = Counter()
        for inside, n in plan:
            assert sum(k * c for k, c in inside) <= cap and n > 0
            for k, c in inside:
                used[k] += c * n
        assert used == Counter(sizes) and sum(n for _, n in plan) <= optimum(sizes, cap) + 1


def test_other_tokenizer_files_are_used_as_they_are():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for t in ("Hello there", "a <|startoftext|> b<|endoftext|>"):
        assert list(packing.encode_batch_of(path)([t])[0]) == tok.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_cut_as_the_library_does():
    end, tok, rng = "<|endoftext|>", Tokenizer.from_file(JSON), random.Random(7)
    texts = [end, end + end, f"{end} start", f"end {end}", f"hello {end} world", f"in{end}side", f"<|endoftext{end}|>", "<|endoftext|", f"a\n{end}\n b", f"{end[:-2]}"]
    texts += ["".join(rng.choice([end, "ab ", " the", "\n", "é", "12", "<|", "|>"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = packing.encode_batch_of(JSON)(texts)
    assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[4].tolist() == [31373, 220, 50256, 995]
