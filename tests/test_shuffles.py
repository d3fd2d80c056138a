"""What is dealt by page once stays so: detectors page by page shuffle and settle nothing more."""

import pytest

from sheetwise.functions import geometry as g
from sheetwise.plans import queries
from sheetwise.session import settled
from sheetwise.sources import fixtures

DIR = "/root/testdata/sf0.001"
KEYS = ["pair_id", "page"]
SLICE = ["scoreboard", "counts_by_status", "defect_records", "counts_by_class", "severity_counts", "pair_quality_score", "defect_ids", "pair_errors", "pair_summary"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SLICE)
def test_findings_are_not_settled(spark, monkeypatch, name):
    def refuse(df):
        raise AssertionError("settled")

    monkeypatch.setattr(queries, "settled", refuse)
    found = queries.QUERIES[name](spark, DIR)
    assert "part.parquet" in str(found.inputFiles())  # of the runs themselves, not of a table of them


def test_boxes_meet_without_a_shuffle(spark):
    rows = [("A", 1, k, 30.0 * k, 0.0, 30.0 * k + 40, 9.0) for k in range(30)] + [("A", 2, 0, 0.0, 0.0, 9.0, 9.0), ("A", None, 0, 0.0, 0.0, 9.0, 9.0), ("A", None, 1, 0.0, 0.0, 9.0, 9.0)]
    boxes = spark.createDataFrame(rows, "pair_id string, page int, run_idx int, x0 double, y0 double, x1 double, y1 double").repartition(*KEYS)
    near = g.close_boxes(boxes, KEYS, ["run_idx", "x0"], 0.0)
    assert plan(near).count("Exchange hashpartitioning") == 1
    for size in (16.0, 64.0, 1000.0):
        assert sorted((r["page"], r["a_run_idx"], r["b_run_idx"]) for r in g.close_boxes(boxes, KEYS, ["run_idx", "x0"], 0.0, size).collect()) == [(1, k, k + 1) for k in range(29)]
    side = lambda p: boxes.select(*KEYS, "run_idx", *(boxes[c].alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1"))).withColumnRenamed("run_idx", p)
    met = g.meeting(side("a"), side("b"), KEYS)
    assert plan(met).count("Exchange hashpartitioning") == 2  # of the two sides
    assert sorted((r["page"], r["a"], r["b"]) for r in met.collect()) == sorted((1, a, b) for a in range(30) for b in range(30) if abs(a - b) < 2) + [(2, 0, 0)]


def test_both_sides_come_from_one_dealing(spark):
    both = fixtures.sided_runs(spark, DIR)
    left = queries.matching.left_over(both.withColumn("norm", both["text"]), both["side"] == "ref")
    assert plan(left).count("REPARTITION_BY_COL") == 1 and plan(left).count("Exchange hashpartitioning") == plan(both).count("Exchange hashpartitioning")


def test_settled_tables_are_compressed(spark):
    df = spark.range(5).selectExpr("id", "array(1D, 2D) AS box")
    kept = settled(df)
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles()) and sorted(kept.collect()) == sorted(df.collect())
