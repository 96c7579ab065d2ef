"""Row numbers hold when the cores of the cluster, and with them the splits of files, change between two scans."""

from __future__ import annotations

import pytest

from inspectlake.llm import naming, ngram_join

FOLDER = "/root/testdata/sf0.001"
SETTING = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture()
def many_files(spark, tmp_path):
    """Documents in 16 files, and a session whose scans are split by another number of cores each time they are asked for."""
    path = str(tmp_path / "docs")
    spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(16, "doc_id").write.parquet(path)
    yield path
    spark.conf.unset(SETTING)


def changing(monkeypatch, spark):
    """Each written table halves or doubles the splits of the scans after it."""
    from inspectlake.llm import common

    turn = iter([2, 7] * 500)
    for module in (common, naming, ngram_join):
        if hasattr(module, "written"):
            plain = common.written
            monkeypatch.setattr(module, "written", lambda df, name, plain=plain: (out := plain(df, name), spark.conf.set(SETTING, str(next(turn))))[0])


def test_results_with_changing_cores(spark, many_files, monkeypatch):
    docs = lambda: spark.read.parquet(many_files)
    groups = lambda: (
        sorted(map(tuple, naming.exact_groups(naming.numbered(docs())).drop("uid").collect())),
        sorted(map(tuple, ngram_join.near_groups(naming.numbered(docs())).drop("uid", "key").collect())),
        sorted(r.doc_id for r in naming.exact_dedup(docs()).collect()),
        sorted(r.doc_id for r in ngram_join.near_dedup(docs()).collect()),
    )
    whole = groups()
    changing(monkeypatch, spark)
    spark.conf.set(SETTING, "4")
    assert groups() == whole
    assert len(whole[2]) == len({r.text or "" for r in docs().collect()})


def test_many_shared_words_move_little(spark):
    """Texts that share most of their words and do not link: what is shuffled grows with the texts, not with their squares."""
    import random

    rng = random.Random(4)
    # Runs of 40 shared words between runs of 25 own ones: shingles in common, but below the threshold.
    runs = [" ".join(f"s{k}_{j}" for j in range(40)) for k in range(250)]
    text = lambda i: " ".join(f"{r} {' '.join(f'o{i}_{rng.random()}' for _ in range(25))}" for r in runs)
    docs = spark.createDataFrame([(i, text(i)) for i in range(4)], "doc_id long, text string")
    moved = []
    plain = ngram_join._tree_join
    try:
        ngram_join._tree_join = lambda rest: (moved.append(sum(8 * len(r.before) + len(r.vec) for r in rest.collect())), plain(rest))[1]
        groups = ngram_join.near_groups(naming.numbered(docs)).collect()
    finally:
        ngram_join._tree_join = plain
    assert sorted(r.component_id for r in groups) == [0, 1, 2, 3]
    assert moved and moved[0] < 20_000_000
