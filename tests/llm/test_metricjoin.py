import numpy as np
import pytest

from pixelmill.llm import metricjoin


def brute(rows):
    """rows: (id, vector or None)."""
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    link = lambda a, b: len(a) == len(b) and float(np.dot(a, b)) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95
    near = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and link(np.array(rows[i][1], float), np.array(rows[j][1], float))] for i in range(len(rows))]
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((v, len(near[i]), least, v == least))
    return sorted(out)


def vectors(seed, n=300, dim=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            base = rows[rng.integers(len(rows))][1]
            v = [float(np.float32(x + rng.normal(0, 0.15))) for x in base] if rng.random() < 0.7 else list(base)
            if rng.random() < 0.2:
                v = [2 * x for x in v]
        else:
            v = [float(np.float32(x)) for x in rng.normal(0, 1, dim)]
        rows.append((int(i * 7 % n), v))
    nan = float("nan")
    return rows + [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [None] + [1.0] * (dim - 1)), (1004, [nan] * dim), (1005, [float("inf")] * dim), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, rows[0][1])]


@pytest.mark.parametrize(("seed", "pivots", "home", "batch"), [(1, 20, 7, 33), (2, None, 1 << 15, 4096), (3, 1, 11, 50), (4, 9, 1 << 15, 64)])
def test_links_and_components_equal_brute_force(spark, monkeypatch, seed, pivots, home, batch):
    monkeypatch.setattr(metricjoin, "HOME", home)
    monkeypatch.setattr(metricjoin, "OTHERS", 16)
    monkeypatch.setattr(metricjoin, "BATCH", batch)
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string").repartition(4)
    got = sorted(tuple(r) for r in metricjoin.near_classes(df, pivots=pivots).collect())
    assert got == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in metricjoin.near_classes(df).collect()), key=repr)
    assert got == [(2, 1, 2, True), (2, 1, 2, True), (None, 0, None, False)]
    assert metricjoin.near_classes(df.limit(0)).count() == 0


def test_very_long_vectors_and_ties(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, 20_000)
    at = np.array([0.95, (1 - 0.95**2) ** 0.5])  # on the threshold, up to rounding
    rows = [(1, base.tolist()), (2, (base * 3).tolist()), (3, rng.normal(0, 1, 20_000).tolist()), (4, [1.0, 0.0]), (5, at.tolist()), (6, (at * 1e-200).tolist()), (7, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in metricjoin.near_classes(df).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1) and got[3] == (0, 3)
    assert got[4][1] == got[7][1] == 4 and got[5][1] == got[6][1]


def test_each_pair_of_blocks_meets_once():
    for sizes in ([1], [5, 7], [1, 2, 3], [4] * 8):
        circle = metricjoin.Circle(sizes)
        goes = circle.visits(np.arange(circle.n))
        assert not goes.diagonal().any() and ((goes ^ goes.T) | np.eye(circle.n, dtype=bool)).all()
        assert goes.sum(0).max() - goes.sum(0).min() <= 1
