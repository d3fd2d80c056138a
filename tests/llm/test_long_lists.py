"""Long lists of long texts: memory is bounded by elements, not by the number of sets."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sheetwise.llm import setjoin


def test_overlaps_hold_a_part_of_the_elements(monkeypatch):
    rng = np.random.default_rng(2)
    size = np.full(100, 8000)
    flat = np.concatenate([rng.choice(1 << 17, n, replace=False) for n in size]).astype(np.int32) - (1 << 16)
    left, right = np.arange(60), np.arange(60, 100)

    def peak():
        tracemalloc.start()
        out = setjoin.overlaps(flat, size, left, right)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    monkeypatch.setattr(setjoin, "HELD", 1 << 40)
    whole, before = peak()
    monkeypatch.setattr(setjoin, "HELD", 1 << 15)
    parts, after = peak()
    assert (whole == parts).all() and whole.max() > 0 and after < before / 2
    some = set(flat[:8000].tolist()) & set(flat[60 * 8000 : 61 * 8000].tolist())
    assert whole[0, 0] == len(some)


def test_long_sets_fill_more_chunks(spark, monkeypatch):
    """Twenty sets that weigh 100 each: no comparison holds all of them, and every link is found."""
    base = list(range(100))
    rows = [(k, [*base, 1000 + k]) for k in range(20)]
    sets = spark.createDataFrame(rows, "id long, shingles array<int>")
    heavy = spark.createDataFrame([(7, k, 2000, 100) for k in range(20)], "post long, id long, n long, weight int")
    volumes = []

    def seen(rows_, similarity, compared=setjoin._compared):
        volumes.extend(r["v"] for r in rows_.join(heavy.select("id", "weight"), "id").groupBy("post", "i", "j").agg(F.sum("weight").alias("v")).collect())
        return compared(rows_, similarity)

    monkeypatch.setattr(setjoin, "_compared", seen)
    none = spark.createDataFrame([], "u long, v long")
    groups = setjoin.linked(none, heavy, sets, 0.8)
    assert {r["component"] for r in groups.collect()} == {0} and groups.count() == 20
    assert max(volumes) < 2000
