"""Edit distances in array steps, and costs that don't leave the step that works them out."""

import random

import numpy as np
from pyspark.sql import functions as F

from sheetwise.config import Config
from sheetwise.functions import edits
from sheetwise.operators import matching

CONFIG = Config()
KEYS = "pair_id string, page int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def by_hand(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances_of_any_length():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ABCÄ\U0001f600 1") for _ in range(n)) for n in (0, 1, 2, 5, 20, 40, 63, 64, 64, 65, 70, 130)]
    i, j = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
    assert edits.levenshtein(edits.Texts(texts), i, j).tolist() == [by_hand(texts[a], texts[b]) for a, b in zip(i, j, strict=True)]
    assert edits.levenshtein(edits.Texts([]), np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_assigned_tells_what_matches_and_least_costs_tell(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("AB1 .") for _ in range(rng.choice((1, 6, 70))))
    ref = [("A", p, k, text(), rng.uniform(0, 90), rng.uniform(0, 90)) for p, n in ((1, 9), (2, 4), (3, 1), (4, 3)) for k in range(n)]
    cand = [("A", p, k, rng.choice(ref)[3], *(2 * [rng.uniform(0, 90)] + 2 * [rng.uniform(0, 90)])) for p, n in ((1, 6), (2, 7), (3, 1), (5, 2)) for k in range(n)]
    ref_df = spark.createDataFrame(ref, f"{KEYS}, run_idx int, norm string, mx double, my double")
    cand_df = spark.createDataFrame(cand, f"{KEYS}, run_idx int, norm string, x0 double, y0 double, x1 double, y1 double")
    ours, costs = matching.assigned(ref_df, cand_df, CONFIG), matching.costs(ref_df, cand_df, CONFIG)
    assert "levenshtein" not in plan(ours) and "Join" not in plan(ours) and "FlatMapGroupsInPandas" not in plan(ours)
    rounded = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert rounded(ours.select("pair_id", "page", "ref_idx", "min_cost").collect()) == rounded(matching.least_costs(costs).collect())
    assert rounded(matching.cheap(ours, CONFIG).collect()) == rounded(matching.matches(costs, CONFIG).collect())
    assert ours.where("page = 1 AND cand_idx IS NULL").count() == 3 and ours.where(F.col("page") > 3).count() == 0
