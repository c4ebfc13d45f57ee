"""Dense numbers and running values against plain Python, with hot keys, ties and no rows."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from tidelane.scan import dense_numbers, running

rng = random.Random(11)


def test_dense_numbers(spark):
    rows = [(rng.choice([1, 1, 1, None, rng.randint(0, 50)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, `a.b` int").repartition(5)
    found = dense_numbers(df, [F.col("k").asc_nulls_first(), F.col("`a.b`").desc()], start=1)
    assert found.columns == ["k", "a.b", "number"]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [tuple(r)[:2] for r in sorted(found.collect(), key=lambda r: r.number)] == want
    assert sorted(r.number for r in found.select("number").collect()) == list(range(1, 501))
    assert dense_numbers(df.where("false"), [F.col("k")]).count() == 0
    assert "SinglePartition" not in found.select("k", "number")._jdf.queryExecution().toString().split("Window", 1)[0]


def test_running(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(-9, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, at long, v long")
    values = {"total": ("sum", "v"), "mixed": ("bit_xor", "v"), "most": ("max", "v"), "least": ("min", "v")}
    ways = {"total": lambda a, b: a + b, "mixed": lambda a, b: a ^ b, "most": max, "least": min}
    for backwards in (False, True):
        found = {(r.key, r.at): r for r in running(df, "key", "at", values, backwards=backwards, block=16).collect()}
        assert len(found) == len(rows)
        for key in {r[0] for r in rows}:
            own = sorted((r[1:] for r in rows if r[0] == key), reverse=backwards)
            for name, way in ways.items():
                assert [found[key, at][name] for at, _ in own] == list(accumulate((v for _, v in own), way))
    before = {(r.key, r.at): r.most for r in running(df, "key", "at", {"most": ("max", "v")}, this_row=False, block=16).collect()}
    own = [r[1:] for r in rows if r[0] == "hot"]
    assert [before["hot", at] for at, _ in own] == [None, *accumulate((v for _, v in own), max)][:-1]
