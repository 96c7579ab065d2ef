"""Hot groups are sliced; the values must be those of a plain window."""

import random

import pytest
from pyspark.sql import functions as F

from inspectlake.operators import events as ev
from inspectlake.operators.asof import next_after
from inspectlake.operators.ordered import Ordered


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"
        data.append((key, rng.randrange(60), i, rng.choice([None, rng.randrange(20)])))
    return spark.createDataFrame(data, "k string, t long, id long, v long").repartition(6)


def both(build):
    return [sorted((tuple(r) for r in build(limit).collect()), key=str) for limit in (10**9, 20)]


@pytest.mark.parametrize("kind", ["sum", "count", "max", "min", "last"])
def test_running_values(log, kind):
    plain, sliced = both(lambda n: Ordered(log, ["k"], ["t", "id"], n).running(out=(kind, F.col("v"))).result())
    assert plain == sliced


def test_previous_and_row_number(log):
    plain, sliced = both(lambda n: Ordered(log, ["k"], ["t", "id"], n).previous(p=F.col("v")).row_number("rn").result())
    assert plain == sliced


def test_global_order_without_keys(log):
    plain, sliced = both(lambda n: Ordered(log, [], ["t", "id"], n).running(s=("sum", F.col("v"))).result())
    assert plain == sliced


def test_chained_scans(log):
    def build(limit):
        first = Ordered(log, ["k"], ["t", "id"], limit).running(seen=("sum", F.col("v")))
        return first.running(base=("last", F.when(F.col("v") > 15, F.col("seen")))).result()

    plain, sliced = both(build)
    assert plain == sliced


def test_tact_rate_of_a_hot_line(log):
    one = log.withColumn("t", F.col("t") * 1_000_000)
    plain, sliced = both(lambda n: ev.tact_rate(one, ["k"], "t", "id", 7, n))
    assert plain == sliced


def test_next_after_of_a_hot_key(log):
    right = log.withColumn("t2", F.col("t") + 3).select("k", "t2", F.col("id").alias("rid"), "v")
    plain, sliced = both(lambda n: next_after(log, right, ["k"], "t", "t2", "rid", ["rid", "v"], n).select("id", "next_match.at", "next_match.rid"))
    assert plain == sliced
    brute = {}
    r = [tuple(x) for x in right.collect()]
    for k, t, i, _ in [tuple(x) for x in log.collect()]:
        later = sorted((t2, rid) for kk, t2, rid, _v in r if kk == k and t2 >= t)
        brute[i] = later[0] if later else (None, None)
    assert {i: (at, rid) for i, at, rid in plain} == brute
