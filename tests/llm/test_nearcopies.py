import random

import pytest
from test_text_operators import brute_components

import corpus_pipeline
from pixelmill.llm import nearcopies


def brute_shingles(text, width=5):
    words = text.lower().split()
    return {" ".join(words[i: i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("hot", [2048, 3])
def test_stage_drops_near_copies_from_similarity_0_8(spark, monkeypatch, hot):
    monkeypatch.setattr(nearcopies, "HOT", hot)
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(rng.randint(80, 300))]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):  # below, at and beyond the similarity
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, int(share * len(words)))):
                changed[at] = "other"
            texts.append(" ".join(changed))
    texts += ["", " ", None, "one", "ONE", "one two"]
    rows = [(1000 - i, t, "en", "s", None) for i, t in enumerate(texts)]
    sets = {i: brute_shingles(t or "") for i, t, *_ in rows}
    first = brute_components(sets, lambda a, b: similar(sets[a], sets[b]))
    want = {i for i in sets if first[i] == i}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(want) and 34 < len(want) < 150
