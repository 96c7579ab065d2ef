"""Whole jobs on the smallest tables: what must hold for every row."""

import math
import os

import pytest

from inspectlake.plans import catalog, jobs
from inspectlake.plans.views import Tables
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_inspection_decides_every_job_once(spark):
    """All ends of a job occur, and each has the code and quality that go with it."""
    t = Tables(spark, FOLDER)
    out = catalog.QUERIES["job_inspect"].build(t).collect()
    assert sorted(r["sequence_id"] for r in out) == sorted(r[0] for r in t.inspect_frames.select("sequence_id").distinct().collect())
    for r in out:
        if r["decision"] == "OK":
            assert (r["error_code"], r["quality_pass"], r["defect_count"]) == (0, True, 0)
        elif r["decision"] == "NG":
            assert r["quality_pass"] and r["error_code"] == 0 and r["defect_count"] > 0
        elif r["decision"] == "ERROR":
            assert r["error_code"] == 9 and not r["quality_pass"]
        else:
            assert r["error_code"] in (0, 7, 13) and (r["error_code"] == 7) == (not r["quality_pass"])
    assert {(r["decision"], r["error_code"]) for r in out} == {("OK", 0), ("NG", 0), ("RECHECK", 0), ("RECHECK", 7), ("RECHECK", 13), ("ERROR", 9)}


@pytest.mark.parametrize("greedy", [False, True])
def test_training_keeps_the_asked_share(spark, greedy):
    t = Tables(spark, FOLDER)
    samples = t.embeddings.withColumns({"decision": F.when(F.col("label") == 9, "NG").otherwise("OK"), "quality_pass": F.col("label") != 8})
    good = samples.where("decision = 'OK' AND quality_pass").count()
    bank, pca, thresholds = jobs.train_bank(samples, 4, 0.5, 16, 20, greedy=greedy)
    assert bank.count() == math.ceil(good * 0.5) and pca.count() == 4
    assert bank.select(F.max(F.size("embedding"))).first()[0] == 4
    r = thresholds.first()
    assert 0 <= r["recheck_score"] <= r["ng_score"] <= 1


def test_line_report_counts_copies_once(spark):
    t = Tables(spark, FOLDER)
    parts = jobs.line_report(t.results.unionByName(t.results), t.defects, t.actions, ["station_id"])
    assert parts["counts"].agg(F.sum("total")).first()[0] == t.results.count()
    assert set(parts) == {"counts", "labels", "counters", "alarms", "reviews"}
