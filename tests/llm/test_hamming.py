"""Multi-index hashing: retrieval against all codes, recall and scores against all products, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from inspectlake.llm import hamming

KIND = "vec_id long, embedding array<double>, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "r", "s") for i, v in rows], KIND)


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    size = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, size - len(v)))) for i, v in good]
    out = []
    for a, (i, q) in enumerate(good):
        if i is not None and i % every == 0:
            found = [(-float(q @ v), math.inf if j is None else j) for b, (j, v) in enumerate(good) if b != a]
            out += [(i, r + 1, None if j == math.inf else j, round(-s, 9)) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted([(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect()], key=str)


def clouds(seed, n, size, spread, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(12, size))[rng.integers(12, size=n)] + spread * rng.normal(size=(n, size))) * scale


def test_within_gives_every_code_of_a_radius():
    """Pigeonhole probing against the distances of all pairs, copies and radius 0 and all included."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**64, size=(300, hamming.SUBSTRINGS), dtype=np.uint64)
    codes[100:200] = codes[7]
    codes[200:250] ^= np.uint64(1) << rng.integers(0, 64, size=(50, hamming.SUBSTRINGS), dtype=np.uint64)
    queries = np.concatenate([codes[:40], rng.integers(0, 2**64, size=(20, hamming.SUBSTRINGS), dtype=np.uint64)])
    radius = rng.choice([0, 1, 3, 4, 90, 120, 140, hamming.CODE_BITS], size=60)
    away = np.bitwise_count(queries[:, None] ^ codes[None]).sum(axis=2)
    q, row = hamming.Index(codes).within(queries, radius)
    assert sorted(zip(q, row)) == sorted(zip(*np.nonzero(away <= radius[:, None])))


@pytest.mark.parametrize("table", ["0.01", "0.1"])
def test_recall_on_tables(spark, table, monkeypatch):
    """A sample of a tenth of the rows, so that most neighbours come through the codes."""
    monkeypatch.setattr(hamming, "SAMPLE", 200)
    monkeypatch.setattr(hamming, "SHARD_ROWS", 300)
    monkeypatch.setattr(hamming, "QUERY_ROWS", 40)
    df = spark.read.parquet(f"/root/testdata/sf{table}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, true = result(hamming.search(df, 20)), brute(rows, 20, 20)
    assert len(got) == len(true)
    score = {(q, j): s for q, _, j, s in true}
    assert all(score.get((q, j), s) == s for q, _, j, s in got)
    assert len({(q, j) for q, _, j, _ in got} & set(score)) >= 0.9 * len(true)


def test_recall_of_other_norms_and_copies(spark, monkeypatch):
    """Norms over many bands, one vector that is a third of all rows, ties by id; 70 dimensions."""
    monkeypatch.setattr(hamming, "SAMPLE", 250)
    monkeypatch.setattr(hamming, "SHARD_ROWS", 500)
    v = np.concatenate([clouds(2, 700, 70, 0.6), clouds(3, 200, 70, 0.6, 1e-3), clouds(4, 100, 70, 0.6, 40.0)])
    v[::3] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, true = result(hamming.search(frame(spark, rows), 10)), brute(rows, 10, 20)
    assert len(got) == len(true)
    assert len(set(got) & set(true)) >= 0.9 * len(true)


def test_odd_rows(spark):
    """Nulls, zeros, no numbers, ids that repeat or are missing, a short vector, fewer candidates than k."""
    rows = [
        (0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, None), (20, [0.0, 0.0]), (40, [1.0, None]), (60, [1.0, math.nan]), (80, [math.inf, 1.0]),
        (None, [1.0, 0.0]), (3, [2.0]), (100, [-1.0, 1.0]), (-20, [1e-160, 1e-160]), (120, []),
    ]
    got = result(hamming.search(frame(spark, rows), 20))
    assert got == brute(rows, 20, 20)
    assert hamming.search(frame(spark, []), 20).count() == 0
    assert hamming.search(frame(spark, [(0, [1.0])]), 20).count() == 0
    assert hamming.search(frame(spark, [(1, [1.0]), (2, [1.0])]), 20).count() == 0
    assert hamming.search(frame(spark, [(0, None)]), 20).columns == ["query_id", "rank", "vec_id", "score"]
