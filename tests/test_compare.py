"""The whole comparison with every optional input, on a page worked out by hand; routing, messages and job functions against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sheetwise.config import Config, Settings
from sheetwise.functions import geometry as g
from sheetwise.operators import defects, jobs, registration, visual
from sheetwise.plans import compare as plan
from sheetwise.plans.compare import Inputs, compare

RUN = "pair_id string, page int, run_idx int, block long, line int, text string, x0 double, y0 double, x1 double, y1 double"
KEYS = ["pair_id", "page"]
SAME = [("ALPHA", 100, 100), ("BRAVO", 300, 100), ("CHARLIE", 500, 100), ("DELTA", 100, 200), ("ECHO", 300, 200), ("FOXTROT", 500, 200), ("OVER A", 600, 400), ("OVER B", 603, 403)]
REF = [*SAME, ("MOVED NOTE", 100, 300), ("LOST LABEL", 300, 300), ("LOST ONE", 480, 300), ("LOST TWO", 480, 312), ("VALUE 12.50", 100, 400), ("SAME SHAPE", 300, 460)]
CAND = [*SAME, ("MOVED NOTE", 110, 300), ("VALUE 12.80", 100, 400), ("SAME SHAPF", 300, 460), ("EXTRA TEXT", 300, 380)]


def runs(spark, rows):
    return spark.createDataFrame([("A", 1, i, i, 0, t, float(x), float(y), x + 6.0 * len(t), y + 10.0) for i, (t, x, y) in enumerate(rows)], RUN)


def pictures():
    """Both pages at a pixel a point: patterns under the texts, and a block that only the candidate has."""
    rng = np.random.default_rng(1)
    ref = np.full((600, 800), 255, np.uint8)
    for _, x, y in REF:
        ref[y : y + 10, x : x + 40] = rng.integers(0, 2, (10, 40)) * 255
    cand = ref.copy()
    cand[400:410, 100:140] = 255 - ref[400:410, 100:140]
    cand[500:520, 400:440] = 0
    return ref, cand


def full(spark, config):
    ref, cand = pictures()
    rasters = spark.createDataFrame([("A", 1, s, 800, 600, 800.0, 600.0, bytearray(p.tobytes())) for s, p in (("ref", ref), ("cand", cand))], "pair_id string, page int, side string, width int, height int, page_width double, page_height double, pixels binary")
    lines = [(660.0, y, 760.0, y) for y in (230.0, 250.0, 270.0)] + [(x, 230.0, x, 270.0) for x in (660.0, 710.0, 760.0)]
    rulings = spark.createDataFrame([("A", 1, s, *x) for s in ("ref", "cand") for x in lines], "pair_id string, page int, side string, ax double, ay double, bx double, by double")
    cells = [("P1", 665, 235), ("M8", 715, 235), ("P2", 665, 255), ("M10", 715, 255)]
    words = [("A", 1, s, k, "M12" if s == "cand" and t == "M10" else t, float(x), float(y), x + 18.0, y + 10.0) for s in ("ref", "cand") for k, (t, x, y) in enumerate(cells)]
    words = spark.createDataFrame(words, "pair_id string, page int, side string, word_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    drawing = spark.createDataFrame([("A", 1, "l", [(90.0, 205.0), (140.0, 205.0)], 1.0), ("A", 1, "re", [(700.0, 20.0), (720.0, 30.0)], None)], "pair_id string, page int, kind string, pts array<struct<x:double,y:double>>, width double")
    pages = spark.createDataFrame([("A", 1, 800.0, 600.0)], "pair_id string, page int, width double, height double")
    segments = spark.createDataFrame([("A", 1, 1, 90.0, 205.0, 140.0, 205.0)], "pair_id string, page int, seg_idx int, ax double, ay double, bx double, by double")
    return compare(Inputs(runs(spark, REF), runs(spark, CAND), pages, segments, words, rasters, drawing, rulings=rulings, tiles=visual.tiles(rasters, 64), tile=64), config)


def test_every_class_of_finding(spark):
    out = full(spark, Config(render_dpi=72, report_misplacement=True, report_table_cells=True))
    rows = out.records.collect()
    got = sorted((r["class"], r["ref_text"] or "", r["cand_text"] or "") for r in rows)
    assert got == sorted([
        ("added_text", "", "EXTRA TEXT"),
        ("font_glyph_corruption", "VALUE 12.50", "VALUE 12.80"),
        ("font_glyph_corruption", "M10", "M12"),
        ("missing_annotation", "LOST ONE LOST TWO", ""),
        ("missing_text", "LOST LABEL", ""),
        ("text_misplacement", "MOVED NOTE", "MOVED NOTE"),
        ("text_overlap", "", "OVER A / OVER B"),
        ("text_overlap", "", "Text 'DELTA' overlaps drawing geometry"),
        ("visual_defect", "", ""),
    ])
    by = {(r["class"], r["ref_text"]): r for r in rows}
    assert np.allclose(by["visual_defect", None]["cand_box"], [400.0, 500.0, 440.0, 520.0]) and by["visual_defect", None]["score"] == 1.0
    assert np.allclose(by["font_glyph_corruption", "M10"]["ref_box"], [710.0, 250.0, 760.0, 270.0]) and by["font_glyph_corruption", "VALUE 12.50"]["score"] > 0.12
    assert by["text_misplacement", "MOVED NOTE"]["confidence"] == 1.0 and out.errors.count() == 0
    plain = {r["class"] for r in full(spark, Config(render_dpi=72)).records.collect()}
    assert "text_misplacement" not in plain


def test_a_pair_that_breaks_is_found_by_halves(spark, monkeypatch):
    names = [f"P{k}" for k in range(9)]
    rows = runs(spark, SAME).drop("pair_id").crossJoin(spark.createDataFrame([(n,) for n in names], "pair_id string"))
    pages = spark.createDataFrame([(n, 1, 800.0, 600.0) for n in names], "pair_id string, page int, width double, height double")
    monkeypatch.setattr(plan, "compare", lambda inputs, config: [r["pair_id"] for r in inputs.pages.select("pair_id").collect()])
    saved, calls = [], []

    def save(found, part):
        calls.append(part)
        if {"P3", "P7"} & set(found):
            raise ArithmeticError("broken " + ",".join(sorted(set(found) & {"P3", "P7"})))
        saved.extend(found)

    failed = plan.compare_in_parts(Inputs(rows, rows, pages), save)
    assert sorted(failed) == [("P3", "broken P3"), ("P7", "broken P7")] and sorted(saved) == sorted(set(names) - {"P3", "P7"}) and len(set(calls)) == len(calls)


def test_routing_takes_the_view_with_the_nearest_anchor(spark):
    rng = random.Random(5)
    views = [(v, [1.0, 0.0, float(v), 0.0, 1.0, 0.0], [(rng.uniform(0, 400), rng.uniform(0, 300)) for _ in range(rng.randint(1, 6))]) for v in range(4)]
    rows = [("A", 1, v, *m, 0.0, len(a), [p[0] for p in a], [p[1] for p in a]) for v, m, a in views]
    pages = spark.createDataFrame([("A", 1, 400.0, 300.0), ("A", 2, 400.0, 300.0)], "pair_id string, page int, width double, height double")
    regs = registration.registrations(pages, spark.createDataFrame(rows, registration.VIEW))
    points = [(k % 2 + 1, k, rng.uniform(0, 400), rng.uniform(0, 300)) for k in range(200)]
    df = spark.createDataFrame([("A", *p) for p in points], "pair_id string, page int, k int, x double, y double")
    got = {r["k"]: r for r in registration.with_map(df, regs, F.col("x"), F.col("y")).collect()}
    for page, k, x, y in points:
        nearest = min(views, key=lambda v: min((a - x) ** 2 + (b - y) ** 2 for a, b in v[2]))
        assert (got[k]["view"], got[k]["m02"]) == ((nearest[0], float(nearest[0])) if page == 1 else (None, 0.0))


def test_messages_tell_turned_views(spark):
    turns = [None, 0.5, 1.0, 12.34, -90.0]
    rows = [("A", 1, "missing_text", 1.0, "C3", "T", None, None, None, None, t) for t in turns]
    found = spark.createDataFrame(rows, "pair_id string, page int, class string, confidence double, zone string, ref_text string, cand_text string, ref_box array<double>, cand_box array<double>, score double, rotation double")
    tails = [re.sub(r".*\(zone C3\)\.", "", r["message"]) for r in defects.records(found, Config()).collect()]
    assert sorted(tails) == sorted(["", "", "", " (view rotated 12.3° clockwise)", " (view rotated 90.0° counterclockwise)"])


def test_view_maps_of_pages(spark):
    pages = spark.createDataFrame([("A", 1, 400.0, 300.0), ("A", 2, 200.0, 300.0)], "pair_id string, page int, width double, height double").withColumns({"ref_width": F.lit(400.0), "ref_height": F.lit(300.0)})
    models = spark.createDataFrame([("A", 1, v, 1.0, 0.0, 5.0, 0.0, 1.0, 0.0, 0.0, 2, [10.0 + 200 * v, 100.0 + 200 * v], [20.0, 280.0]) for v in (0, 1)], registration.VIEW)
    got = {(r["page"], r["map_id"]): (r["m00"], r["m02"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in visual.maps_of(registration.registrations(pages, models)).collect()}
    assert got == {(1, 0): (1.0, 5.0, 0.0, 0.0, 130.0, 300.0), (1, 1): (1.0, 5.0, 180.0, 0.0, 330.0, 300.0), (1, -1): (1.0, 0.0, None, None, None, None), (2, -1): (0.5, 0.0, None, None, None, None)}


def test_boxes_that_meet_equal_all_pairs(spark):
    rng = random.Random(8)
    make = lambda n: [(rng.randint(1, 2), k, *(lambda x, y, w, h: (x, y, x + w, y + h))(rng.uniform(-50, 300), rng.uniform(-50, 300), rng.choice([0, 5, 90]), rng.choice([1, 40, 200]))) for k in range(n)]
    a, b = make(60), make(70)
    frame = lambda rows, p: spark.createDataFrame([("A", *r) for r in rows], f"pair_id string, page int, {p}k int, {p}_x0 double, {p}_y0 double, {p}_x1 double, {p}_y1 double")
    got = sorted((r["ak"], r["bk"]) for r in g.meeting(frame(a, "a"), frame(b, "b"), KEYS).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and max(p[2], q[2]) < min(p[4], q[4]) and max(p[3], q[3]) < min(p[5], q[5]))


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("SHEETWISE_MAX_PAIRS", "7")
    monkeypatch.setenv("SHEETWISE_ALLOWED_ORIGINS", "a, b,")
    out = Settings.from_environment()
    assert out.max_pairs == 7 and out.allowed_origins == ["a", "b"] and out.max_workers == 1 and jobs.ACTIVE
