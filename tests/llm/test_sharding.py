import pytest
from pyspark.sql import functions as F

from pixelmill.llm.sharding import ConflictError, Manifest, ShardStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_arrivals_are_merged_and_versions_stay_readable(spark, documents, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20)
    assert store.read().count() == 0 and store.compact().version == 0
    parts = [documents.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(6)) == k) for k in range(6)]
    for p in parts:
        store.append(p)
    assert store.versions() == [1, 2, 3, 4, 5, 6] and rows(store.read()) == rows(documents)
    last = store.compact()
    assert len(last.runs) < 6 and rows(store.read()) == rows(documents)
    assert rows(store.read(3)) == rows(parts[0].union(parts[1]).union(parts[2]))
    store.vacuum(keep=1)
    assert store.versions() == [last.version] and rows(store.read()) == rows(documents)
    live = {r.path.rsplit("/", 1)[1] for r in last.runs}
    assert {p.name for p in (tmp_path / "s" / "shards").iterdir()} == live


def test_vacuum_removes_what_failed_writers_left(spark, documents, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append_arrivals(documents, F.pmod("rank", F.lit(3)))
    with pytest.raises(ValueError):
        store.append(documents.select("doc_id"))  # its files are in no version
    before = {p.name for p in (tmp_path / "s" / "shards").iterdir()}
    store.vacuum(keep=1)
    assert {p.name for p in (tmp_path / "s" / "shards").iterdir()} == before and len(before) == 2
    store.vacuum(keep=1, orphan_seconds=-1)
    assert len(list((tmp_path / "s" / "shards").iterdir())) == 1 and rows(store.read()) == rows(documents)


def test_many_arrivals_in_one_pass(spark, documents, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    m = store.append_arrivals(documents, F.pmod("rank", F.lit(5)))
    assert m.version == 1 and len(m.runs) == 6  # rows without a rank are an arrival too
    assert store.compact(keep=1).version == 2 and rows(store.read()) == rows(documents)
    store.append(documents.limit(0))
    assert store.read().count() == documents.count()


def test_a_lost_race_is_seen(spark, documents, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    m = store.append(documents)
    with pytest.raises(ConflictError):
        store.commit(Manifest(m.version, m.schema, []))
    with pytest.raises(ConflictError):
        store._change(None, [m.runs[0].__class__("gone", 1, 1)], [])
    with pytest.raises(ValueError):
        store.append(documents.select("doc_id"))
    assert rows(store.read()) == rows(documents) and not [p for p in (tmp_path / "s" / "manifest").iterdir() if p.name.startswith(".") and p.suffix != ".crc"]


def test_tiers_hold_runs_of_similar_size(spark):
    from pixelmill.llm.sharding import Run

    store = ShardStore(spark, "file:///nowhere", target_bytes=1 << 20)
    small, large = [Run(f"a{i}", 9000 + i, 1) for i in range(4)], [Run(f"b{i}", 300_000, 1) for i in range(3)]
    assert store.candidates(small + large) == small and store.candidates(small[:3] + large) == []
    assert store.candidates([Run(f"c{i}", 5 << 20, 5) for i in range(9)]) == []
