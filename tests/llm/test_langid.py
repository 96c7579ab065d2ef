"""The language network learns from every byte of every labelled row, in shards and rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectlake.llm import langid

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shard", [1 << 16, langid.SHARD_BYTES])
def test_all_labelled_text_is_learned(spark, monkeypatch, shard):
    monkeypatch.setattr(langid, "SHARD_BYTES", shard)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~langid.held_out(F.col("doc_id"), 4, 2))
    assert langid.train(docs).bytes == known.agg(F.sum(F.octet_length("text"))).first()[0]


def test_a_text_longer_than_a_pool_is_cut_into_all_its_bytes(monkeypatch):
    monkeypatch.setattr(langid, "POOL", 4)
    text = bytes(np.random.default_rng(0).integers(1, 256, 1000, np.uint8))
    pieces = list(langid._segments([text, b"", b"ab"], [1, 0, 2]))
    assert max(len(codes) for codes, _, _ in pieces) <= 4
    found = b"".join(bytes(row[:n]) for codes, sizes, labels in pieces for row, n, label in zip(codes, sizes, labels) if label == 1)
    assert found == text and sum(int(sizes.sum()) for _, sizes, _ in pieces) == 1002


def test_states_are_the_same_with_and_without_a_trace():
    rng = np.random.default_rng(0)
    layer = langid.Layer(rng)
    trace: list = []
    for _ in range(2):
        codes = rng.integers(0, 256, (20, 33)).astype(np.uint8)
        assert np.abs(layer.states(codes) - layer.states(codes, trace)).max() < 1e-5
