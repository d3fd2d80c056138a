"""Small cases worked out by hand, and brute force where there is no SQL."""

import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetwise.config import Config, Settings
from sheetwise.functions import geometry as g
from sheetwise.functions.text import edit_distance, fill, normalized, sequence_ratio
from sheetwise.operators import clusters, defects, jobs, matching, raster, registration, report, tables, zones
from sheetwise.plans.compare import Inputs, compare
from sheetwise.sources import records

CONFIG = Config()
KEYS = ["pair_id", "page"]
RUN = "pair_id string, page int, run_idx int, block long, line int, text string, x0 double, y0 double, x1 double, y1 double"


def runs(spark, rows, page=1):
    return spark.createDataFrame([("A", page, i, b, i, t, *map(float, box)) for i, (b, t, box) in enumerate(rows)], RUN)


@pytest.mark.parametrize(
    "text, expected",
    [("  A  B ", "A B"), ("1,5", "1.5"), ("1.50", "1.5"), ("10.0", "10"), ("100", "100"), ("1.", "1"), ("1.05", "1.05"), ("1.500mm", "1.500mm"), ("3.00-4.10", "3-4.1"), ("0.500 +/- 0.010", "0.5 +/- 0.01"), ("1,000,5", "1.5"), ("Ø12", "DIA12"), ("½", "1/2"), ("12°", "12DEG"), ("12deg", "12DEG"), ("±0.10", "+/-0.1"), (" x y", "x y")],
)
def test_normalized(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(normalized(F.col("t"), CONFIG)).first()[0] == expected


def test_text_functions(spark):
    df = spark.createDataFrame([("1/2", "1#8"), ("", "ABC"), ("a", "a")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(edit_distance(F.col("a"), F.col("b"))).collect()] == [0.6667, 1.0, 0.0]
    ratio = spark.createDataFrame([("NOTE 3 PROMO", "#OTE 3 PROMO")], "a string, b string").select(sequence_ratio("a", "b")).first()[0]
    assert round(ratio, 4) == 0.9167
    slots = {"ref_text": F.lit("{zone}"), "zone": F.lit("C3")}
    assert spark.range(1).select(fill(F.lit("'{ref_text}' at {zone}."), slots)).first()[0] == "'{zone}' at C3."


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (0.0, 0.0, 50.0, 10.0, 40.0, 0.0, 90.0, 10.0)], "x0 double, y0 double, x1 double, y1 double, bx0 double, by0 double, bx1 double, by1 double")
    rows = df.select(g.overlap(g.box(), g.box("b")), g.inline_neighbours(g.box(), g.box("b"))).collect()
    assert rows[0][0] == 0.25 and not rows[0][1] and rows[1][1]
    m = [F.lit(v) for v in (0.0, -1.0, 5.0, 1.0, 0.0, 0.0)]
    assert df.select(*g.mapped_box(g.box(), m), g.rotation(m)).first()[:5] == (-5.0, 0.0, 5.0, 10.0, 90.0)


def test_zones(spark):
    labels = [(-1, str(k + 1), (80 + 140 * k, 10, 86 + 140 * k, 20)) for k in range(5)] + [(-2, "ABCDE"[k], (10, 70 + 100 * k, 16, 80 + 100 * k)) for k in range(5)]
    pages = spark.createDataFrame([("A", 1, 800.0, 600.0)], "pair_id string, page int, width double, height double")
    grids = zones.grids(pages, zones.labels(runs(spark, labels), pages, CONFIG))
    points = [(400.0, 300.0), (700.0, 500.0), (790.0, 590.0), (10.0, 300.0)]
    df = spark.createDataFrame([("A", 1, i, x, y) for i, (x, y) in enumerate(points)], "pair_id string, page int, i int, x double, y double")
    found = zones.with_zone(df, grids, F.col("x"), F.col("y"), CONFIG).orderBy("i").collect()
    assert [r["zone"] for r in found] == ["C3", "title-block", "title-block", "border"]
    none = zones.with_zone(df, zones.grids(pages, zones.labels(runs(spark, labels[:1]), pages, CONFIG)), F.col("x"), F.col("y"), CONFIG).orderBy("i").first()
    assert none["zone"] is None


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_cheapest(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    rows, columns = matching.assignment(cost)
    assert len(set(rows.tolist())) == len(set(columns.tolist())) == min(n, m)
    small, turned = (cost, False) if n <= m else (cost.T, True)
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert math.isclose(cost[rows, columns].sum(), best) and turned == (n > m)


def test_assignment_then_limit(spark):
    pairs = spark.createDataFrame([("A", 1, i, j, 0.0, False, float(c)) for i, r in enumerate([[0, 50], [50, 99]]) for j, c in enumerate(r)], "pair_id string, page int, ref_idx int, cand_idx int, distance double, equal boolean, cost double")
    assert [(r["ref_idx"], r["cand_idx"]) for r in matching.matches(pairs, CONFIG).collect()] in ([(0, 0)], [(0, 1), (1, 0)])
    rows, columns = matching.assignment(np.array([[0.0, 50.0], [50.0, 99.0]]))
    assert columns.tolist() == [0, 1]


def test_residuals():
    assert matching.split_pairs([(0, "ABCDEFGHIJ"), (1, "WXYZWXYZ")], [(0, "ABCDE"), (1, "FGHIJ"), (2, "WXYZ")]) == [(0, 0), (0, 1)]
    assert [x[:2] for x in matching.fuzzy_pairs([(0, "NOTE 3 PROMO")], [(1, "OTHER"), (2, "#OTE 3 PROMO")])] == [(0, 2)]


def test_views_of_two_moves():
    src = np.array([[x, y] for x in (0.0, 50.0, 130.0, 300.0) for y in (0.0, 40.0, 200.0, 500.0)])
    dst = src + np.where(src[:, 1:] > 100, [[40.0, -60.0]], [[5.0, 5.0]])
    found = registration.views(src, dst, CONFIG)
    assert len(found) == 2 and sum(len(a) for _, a in found) == 16
    assert registration.views(src[:2], dst[:2], CONFIG) == []
    one = registration.views(src, src + 3.0, CONFIG)
    assert len(one) == 1 and np.allclose(one[0][0], [[1, 0, 3], [0, 1, 3]])


def test_components_against_closure():
    rng = np.random.default_rng(3)
    for _ in range(20):
        i, j = rng.integers(0, 12, 8), rng.integers(0, 12, 8)
        label = np.arange(12)
        for _ in range(12):
            for a, b in zip(i, j, strict=True):
                label[[a, b]] = min(label[a], label[b])
        assert clusters.least_members(12, i, j).tolist() == label.tolist()


def test_missing_groups(spark):
    ref = runs(spark, [(1, "a", (0, 0, 5, 5)), (1, "b", (0, 6, 5, 9)), (1, "c", (0, 10, 5, 14))])
    one = spark.createDataFrame([("A", 1, i, 0) for i in range(3)], "pair_id string, page int, run_idx int, cluster int")
    least = spark.createDataFrame([("A", 1, 0, 30.0), ("A", 1, 1, 60.0)], "pair_id string, page int, ref_idx int, min_cost double")
    single = defects.missing_groups(ref.where("run_idx = 0"), one, least, CONFIG).first()
    both = defects.missing_groups(ref.where("run_idx < 2"), one, least, CONFIG).first()
    rest = defects.missing_groups(ref.where("run_idx = 2"), one, least, CONFIG).first()
    assert (single["class"], single["confidence"]) == ("missing_text", 0.25)
    assert (both["class"], both["text"]) == ("missing_annotation", "a b")
    assert rest["confidence"] == 0.5


def test_filters(spark):
    rows = [("A", 1, "missing_text", 1.0, z, t, None, None, [10.0, 10.0, 20.0, 20.0], None, None) for z, t in (("border", "x"), (None, "x"), ("C3", "x"), ("C3", "BOM / Table Structure"))]
    df = spark.createDataFrame(rows, "pair_id string, page int, class string, confidence double, zone string, ref_text string, cand_text string, ref_box array<double>, cand_box array<double>, score double, rotation double")
    assert defects.without_border(df).count() == 3
    box = spark.createDataFrame([("A", 1, 0.0, 0.0, 50.0, 50.0)], "pair_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r["ref_text"] for r in defects.without_tables(df, box).collect()] == ["BOM / Table Structure"]
    assert defects.without_regions(df, Config(ignore_regions=[[0, 0, 15, 15]])).count() == 0


def test_scores(spark):
    pages = spark.createDataFrame([("A", 1, 800.0, 600.0), ("A", 2, 800.0, 600.0)], "pair_id string, page int, width double, height double")
    rows = spark.createDataFrame([("A", 1, "Notes & Annotations")] * 2 + [("A", 1, "Symbols & Standards")], "pair_id string, page int, category string")
    assert {r["page"]: r["score"] for r in report.page_scores(rows, pages).collect()} == {1: 85, 2: 100}
    means = spark.createDataFrame([("A", 80), ("A", 85)], "pair_id string, score long")
    assert report.pair_scores(means).first()["quality_score"] == 82


def test_row_breaks(spark):
    words = [("A", 1, "ref", i, t, float(x), y - 5.0, x + 6.0, y + 5.0) for i, (t, x, y) in enumerate([("ITEM", 0, 10.0), ("QTY", 50, 10.0), ("1", 0, 20.0), ("2", 0, 33.0), ("3", 0, 45.0)])]
    df = spark.createDataFrame(words, "pair_id string, page int, side string, word_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    rows = {r["text"]: r["row_no"] for r in tables.table_words(df, tables.headers(df, CONFIG)).collect()}
    assert rows == {"ITEM": 0, "QTY": 0, "1": 0, "2": 1, "3": 1}


def test_rasters():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (12, 15), dtype=np.uint8)
    assert raster.difference(a, a) == 0.0
    x, y = a.astype(float) / 255, (255 - a).astype(float) / 255
    total = []
    for r in range(12 - 6):
        for c in range(15 - 6):
            p, q = x[r : r + 7, c : c + 7].ravel(), y[r : r + 7, c : c + 7].ravel()
            v = np.cov(p, q)
            total.append((2 * p.mean() * q.mean() + 1e-4) * (2 * v[0, 1] + 9e-4) / ((p.mean() ** 2 + q.mean() ** 2 + 1e-4) * (v[0, 0] + v[1, 1] + 9e-4)))
    assert math.isclose(raster.similarity(x, y, 7), np.mean(total), rel_tol=1e-6)
    assert raster.clip(a, (15.0, 12.0), (20.0, 20.0, 30.0, 30.0), 0.0).shape == (2, 2)


def test_sources(spark):
    df = runs(spark, [(1, "AB", (0, 0, 5, 5)), (2, " C ", (0, 6, 5, 9))])
    out = records.runs(records.nested(df)).orderBy("run_idx").collect()
    assert [r["text"] for r in out] == ["AB", "C"]
    items = spark.createDataFrame([("A", 1, 1, "re", [(0.0, 0.0), (2.0, 1.0)]), ("A", 1, 2, "c", [(0.0, 0.0), (1.0, 1.0)])], "pair_id string, page int, item int, kind string, pts array<struct<x:double,y:double>>")
    assert records.segments(items).count() == 4


def test_jobs(spark):
    rows = [("ref", "/r/A.pdf", 1, 5), ("ref", "/r/b.PDF", 2, 5), ("cand", "/c/a.pdf", 1, 7), ("cand", "/c/c.pdf", 2, 5), ("cand", "/c/x.txt", 3, 5)]
    files = spark.createDataFrame(rows, "side string, path string, upload_seq long, bytes long")
    pdfs = jobs.pdf_files(files)
    assert [r["name"] for r in jobs.paired(pdfs).collect()] == ["A.pdf"]
    assert {(r["side"], r["name"]) for r in jobs.unmatched(pdfs).collect()} == {("ref", "b.PDF"), ("cand", "c.pdf")}
    state = spark.createDataFrame([(1, "completed", 0, 0), (2, "running", 0, 0), (3, "failed", 0, 9000)], "job_id long, status string, created_at long, updated_at long")
    assert {r["job_id"] for r in jobs.evicted(state, F.lit(9999), Settings()).collect()} == {2, 3}
    assert jobs.pending(state).first()[0] == 1
    with pytest.raises(jobs.JobError) as e:
        jobs.check_upload(files, state, Settings(max_file_bytes=6))
    assert e.value.status == 413


def test_same_pages_have_no_missing_text(spark):
    rows = [(i, f"NOTE {i} TEXT", (100 + 90 * (i % 5), 100 + 40 * i, 160 + 90 * (i % 5), 110 + 40 * i)) for i in range(8)]
    pages = spark.createDataFrame([("A", 1, 800.0, 600.0)], "pair_id string, page int, width double, height double")
    out = compare(Inputs(runs(spark, rows), runs(spark, rows), pages))
    assert out.records.count() == 0 and out.pair_scores.first()["quality_score"] == 100
    less = compare(Inputs(runs(spark, rows), runs(spark, rows[:-1]), pages))
    assert [r["class"] for r in less.records.collect()] == ["missing_text"]
    numbered = report.numbered(less.records)
    text = report.report_json(numbered, less.pair_scores).first()["json"]
    assert json.loads(text)["defects"][0]["id"] == "D-001"


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text('{"match_max_cost": 10, "zone": {"row_first": false}, "unknown": 1}')
    c = Config.load(tmp_path / "c.yaml")
    assert c.match_max_cost == 10 and not c.zone.row_first
    with pytest.raises(ValueError):
        Config.from_dict({"confidence_threshold": 2})


def test_ids_run_over_pages_that_are_ranked_apart(spark):
    box = [0.0, 0.0, 1.0, 1.0]
    rows = [("P", page, "x", f"t{k}", None, box, [float(k), float(k), k + 1.0, k + 1.0]) for page in range(12) for k in range(page % 4)]
    df = spark.createDataFrame(rows, "pair_id string, page int, class string, ref_text string, cand_text string, ref_box array<double>, cand_box array<double>")
    out = report.numbered(df)
    got = sorted((r["id"], r["page"], r["ref_text"]) for r in out.collect())
    assert got == [(f"D-{n:03d}", r[1], r[3]) for n, r in enumerate(rows, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("row_number" in x and "[pair_id" in x and "page" not in x.split("[pair_id", 1)[1].split("]")[0] for x in plan.splitlines())
