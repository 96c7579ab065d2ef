"""Neighbours, selection, calibration, components and PCA against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectlake.operators import anomaly as an


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(240, 8)).astype(np.float32)
    data[50:60] = data[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    return data.astype(np.float64), df.repartition(5).cache()


def test_exact_neighbours_in_one_and_many_slots(spark, vectors):
    data, df = vectors
    dist = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2))
    for slots in (1, 4):
        got = {}
        for r in an.knn_exact(df, df, 4, slots=slots).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["bank_id"], r["distance"]))
        for q in range(len(data)):
            want = sorted((round(d, 12), b) for b, d in enumerate(dist[q]))[:4]
            rows = sorted(got[q])
            assert [b for _, b, _ in rows] == [b for _, b in want]
            assert np.allclose([d for _, _, d in rows], [d for d, _ in want])


def test_k_larger_than_bank(spark, vectors):
    _, df = vectors
    small = df.where("vec_id < 3")
    assert an.knn_exact(df.where("vec_id = 9"), small, 10).count() == 3


def test_ivf_finds_most_neighbours(vectors):
    _, df = vectors
    exact = {(r["query_id"], r["bank_id"]) for r in an.knn_exact(df, df, 3).collect()}
    found = {(r["query_id"], r["bank_id"]) for r in an.knn_ivf(df, df, 3, probes=8).collect()}
    assert len(exact & found) / len(exact) > 0.7
    every = {(r["query_id"], r["bank_id"]) for r in an.knn_ivf(df, df, 3, probes=15).collect()}
    assert every == exact


def test_ivf_sends_a_query_once_a_slot(vectors, monkeypatch):
    """However many cells it visits; more slots and buckets change nothing."""
    data, df = vectors
    sent, plain = [], an._join_blocks
    monkeypatch.setattr(an, "_join_blocks", lambda q, *more: (sent.append(q.selectExpr("sum(size(ids))").first()[0]), plain(q, *more))[1])
    pairs = lambda: sorted((r["query_id"], r["rank"], r["bank_id"]) for r in an.knn_ivf(df, df, 3, probes=8).collect())
    one = pairs()
    assert sent[-1] == df.count()
    monkeypatch.setattr(an, "SLOT_ROWS", df.count() // 3 + 1)
    monkeypatch.setattr(an, "BLOCK_ROWS", 5)
    assert pairs() == one
    assert sent[-1] == 3 * df.count()


@pytest.mark.parametrize("shape", ["spread", "clustered"])
def test_ivf_default_reaches_its_recall(spark, shape):
    """The number of probes follows the data: many cells where vectors have no structure, few where they have."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(600, 12)) if shape == "spread" else rng.normal(size=(20, 12))[rng.integers(20, size=600)] * 6 + rng.normal(size=(600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    exact = {(r["query_id"], r["bank_id"]) for r in an.knn_exact(df, df, 5).collect()}
    found = {(r["query_id"], r["bank_id"]) for r in an.knn_ivf(df, df, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.95


def test_grid_cells_and_groups(spark):
    """Slots and buckets change nothing; with groups a query meets the vectors of its group only."""
    rng = np.random.default_rng(6)
    data = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(data)], "vec_id long, g string, embedding array<double>")
    pairs = lambda out: sorted((r["query_id"], r["rank"], r["bank_id"]) for r in out.collect())
    assert pairs(an.knn_exact(df, df, 2, slots=3, buckets=4)) == pairs(an.knn_exact(df, df, 2))
    grouped = pairs(an.knn_exact(df, df, 3, slots=2, buckets=3, groups=["g"]))
    small = data.astype(np.float32).astype(float)
    for q in range(300):
        near = sorted((j for j in range(300) if j % 2 == q % 2), key=lambda j: (((small[q] - small[j]) ** 2).sum(), j))[:3]
        assert [b for i, _, b in grouped if i == q] == near


def test_a_task_gets_one_cell_of_the_grid(vectors):
    _, df = vectors
    blocks = an.pack_vectors(df, "vec_id", "embedding", rows=4)
    *sides, on = an._grid(blocks, blocks, [], 3, 4)
    for side in sides:
        dealt = {tuple(r) for r in side.select(F.spark_partition_id(), *on).distinct().collect()}
        assert len(dealt) == len({task for task, _ in dealt}) == 12


def brute_greedy(data, keep):
    picks = [0]
    gap = ((data - data[0]) ** 2).sum(1)
    while len(picks) < keep:
        free = [i for i in range(len(data)) if i not in picks]
        best = max(free, key=lambda i: (gap[i], -i))
        picks.append(best)
        gap = np.minimum(gap, ((data - data[best]) ** 2).sum(1))
    return picks


def test_greedy_selection(vectors):
    data, df = vectors
    got = [r["vec_id"] for r in an.coreset_greedy(df, 0.25, frontier=16).orderBy("pick").collect()]
    assert got == brute_greedy(data, 60)
    assert an.coreset_greedy(df, 1.0).count() == 240


def test_stride_selection(spark, vectors):
    _, df = vectors
    for n, ratio in ((30, 0.5), (30, 1.0), (101, 0.37), (240, 0.013)):
        rows = df.where(F.col("vec_id") < n)
        keep = max(1, math.ceil(n * ratio))
        want = list(range(n)) if keep >= n else sorted({min(int(i * (n / keep)), n - 1) for i in range(keep)})
        for limit in (10**9, 7):
            assert sorted(r["vec_id"] for r in an.coreset_stride(rows, ratio, hot_rows=limit).collect()) == want


def test_halves_do_not_overlap(vectors):
    _, df = vectors
    reduced, held, half = an.split_halves(df)
    a, b = {r["vec_id"] for r in reduced.collect()}, {r["vec_id"] for r in held.collect()}
    assert len(a) == len(b) == half == 120 and not a & b


def test_thresholds_are_ordered(vectors):
    _, df = vectors
    r = an.calibrate_thresholds(an.calibrate_distances(df), 16, 50).first()
    assert 0 <= r["recheck_score"] <= r["ng_score"] <= 1 and r["distance_p99"] > r["distance_mean"]


def test_pca_against_numpy(vectors):
    data, df = vectors
    model = an.fit_pca(df, 3, "v1").orderBy("component").collect()
    centred = data - data.mean(0)
    values, basis = np.linalg.eigh(centred.T @ centred)
    for rank, r in enumerate(model):
        want = basis[:, -1 - rank]
        want = want * np.sign(want[np.abs(want).argmax()])
        assert np.allclose(r["weights"], want, atol=1e-6)
        assert abs(r["explained_ratio"] - values[-1 - rank] / values.sum()) < 1e-9
    out = {r["vec_id"]: r["embedding"] for r in an.pca_project(df, [r["weights"] for r in model], model[0]["mean"]).collect()}
    assert np.allclose([out[i] for i in range(240)], centred @ np.array([r["weights"] for r in model]).T, atol=1e-6)
    with pytest.raises(ValueError):
        an.fit_pca(df, 9, "v1")


def test_components_both_ways(spark):
    rng = np.random.default_rng(1)
    cells = [(i, int(r), int(c), float(rng.random())) for i in range(6) for r in range(12) for c in range(12) if rng.random() < 0.45]
    cells += [(9, 0, c, 0.5) for c in range(12)] + [(9, r, 11, 0.5) for r in range(1, 12)]
    hot = spark.createDataFrame(cells, "image long, patch_row int, patch_col int, score double")

    def flood(image):
        left = {(r, c): s for i, r, c, s in cells if i == image}
        boxes = []
        while left:
            stack, part = [next(iter(left))], {}
            while stack:
                p = stack.pop()
                if p in left:
                    part[p] = left.pop(p)
                    stack += [(p[0] + a, p[1] + b) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]
            rs, cs = [p[0] for p in part], [p[1] for p in part]
            boxes.append((image, min(cs), min(rs), max(cs) + 1, max(rs) + 1, len(part), round(max(part.values()), 9)))
        return boxes

    want = sorted(b for i in sorted({c[0] for c in cells}) for b in flood(i))
    for limit in (10**9, 3):
        out = an.patch_components(hot, "image", image_patches=limit).collect()
        assert sorted((r["image"], r["col0"], r["row0"], r["col1"], r["row1"], r["patches"], round(r["score"], 9)) for r in out) == want


def test_bad_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, []), (3, [1.0]), (4, [1.0, float("nan")]), (5, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["issue"] for r in an.check_vectors(df, "vec_id").collect()} == {2: "empty", 3: "dimension", 4: "not finite"}


@pytest.mark.parametrize("scale", [1e-25, 1.0, 1e25])
def test_candidates_hold_the_nearest_at_any_scale(scale):
    rng = np.random.default_rng(2)
    q, b = (rng.normal(size=(n, 8)).round(1) * scale for n in (40, 700))
    q, b = q.astype(np.float32), b.astype(np.float32)
    d = np.sqrt(((q[:, None].astype(np.float64) - b[None]) ** 2).sum(2))
    for k in (1, 3, 40):
        rows, at = an._candidates(q, b, k, np.full(len(q), np.inf))
        for i in range(len(q)):
            near = set(np.flatnonzero(d[i] <= np.sort(d[i])[k - 1]).tolist())
            assert near <= set(at[rows == i].tolist())


@pytest.mark.parametrize("k", [1, 3])
def test_a_search_is_dealt_over_cells(spark, monkeypatch, k):
    """More vectors than a cell may hold: many tasks, and the nearest of all of them, ties by id."""
    monkeypatch.setattr(an, "SLOT_ROWS", 300)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 6)).round(1).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(6)
    d = np.sqrt(((v[:, None].astype(np.float64) - v[None]) ** 2).sum(2))
    out = an.knn_exact(df, df, k)
    got = {(r["query_id"], r["rank"]): (r["bank_id"], round(r["distance"], 9)) for r in out.collect()}
    want = {}
    for i in range(len(v)):
        for rank, j in enumerate(np.lexsort((np.arange(len(v)), d[i]))[:k]):
            want[i, rank + 1] = (int(j), round(float(d[i][j]), 9))
    assert got == want


def test_frontiers_are_merged_before_the_driver(spark, vectors, monkeypatch):
    """A collected sort with a limit sends the limit from every partition; below a coalesce executors merge first."""
    _, df = vectors
    kind, plans = type(df), []
    real = kind.collect

    def collect(self):
        if "gap" in self.columns:
            plans.append(self._jdf.queryExecution().sparkPlan().toString())
        return real(self)

    monkeypatch.setattr(kind, "collect", collect)
    assert an.coreset_greedy(df, 0.2, frontier=16).count() == 48
    assert plans and all(p.startswith("Coalesce 1") and "TakeOrdered" in p for p in plans)
