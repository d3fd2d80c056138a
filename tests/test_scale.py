"""What a query's plan must not do on large tables: send derived rows through the driver, or derive them over and over."""


from pyspark.sql import functions as F

from sheetwise.config import Config
from sheetwise.operators import clusters, defects, lattice, matching, raster, report, tables
from sheetwise.plans import queries
from sheetwise.sources import fixtures, records

CONFIG = Config()
DIR = "/root/testdata/sf0.001"
KEYS = "pair_id string, page int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_not_broadcast(spark):
    words = spark.range(1).selectExpr("'A' AS pair_id", "1 AS page", "'ref' AS side", "0 AS word_idx", "'ITEM' AS text", "0D AS x0", "0D AS y0", "9D AS x1", "9D AS y1")
    cells, boxes = tables.grid(words, CONFIG)
    side = lambda df: df.drop("side")
    pairs = tables.paired(side(boxes).withColumn("mx", F.col("x0")).withColumn("my", F.col("y0")), side(boxes))
    columns = tables.matched_columns(side(cells), side(cells), pairs, CONFIG)
    for df in (cells, boxes, pairs, columns, tables.cell_differences(side(cells), side(cells), columns, CONFIG)):
        assert "BroadcastHashJoin" not in plan(df)


def test_strokes_are_not_broadcast(spark):
    runs = spark.createDataFrame([("A", 1, 0, 0.0, 0.0, 40.0, 10.0)], f"{KEYS}, run_idx int, x0 double, y0 double, x1 double, y1 double")
    items = spark.createDataFrame([("A", 1, "l", [(0.0, 5.0), (90.0, 5.0)], 1.0)], f"{KEYS}, kind string, pts array<struct<x:double,y:double>>, width double")
    pages = spark.createDataFrame([("A", 1, 800.0, 600.0)], f"{KEYS}, width double, height double")
    found = raster.over_geometry(runs, items, pages)
    assert "BroadcastHashJoin" not in plan(found)
    assert [tuple(r)[:3] for r in found.collect()] == [("A", 1, 0)]


def test_cost_rows_without_pairs(spark):
    ref = spark.createDataFrame([("A", 1, k, t, 9.0 * k, 4.0) for k, t in enumerate(["A1", "B2", "C"])] + [("A", 2, 0, "X", 1.0, 1.0)], f"{KEYS}, run_idx int, norm string, mx double, my double")
    cand = spark.createDataFrame([("A", 1, k, t, 8.0 * k, 0.0, 8.0 * k + 6, 10.0) for k, t in enumerate(["B2", "A1", "#", ""])] + [("B", 1, 0, "X", 0.0, 0.0, 1.0, 1.0)], f"{KEYS}, run_idx int, norm string, x0 double, y0 double, x1 double, y1 double")
    ours = matching.costs_by_run(ref, cand, CONFIG)
    assert sorted(ours.collect()) == sorted(matching.cost_rows(matching.costs(ref, cand, CONFIG)).collect())


def test_residual_and_sizes_read_little(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(queries, "settled", lambda df: kept.append(df.columns) or df)
    queries.residual_split(spark, DIR)
    assert kept[:2] == [["pair_id", "page", "run_idx", "norm"]] * 2 and len(kept) == 4
    p = queries.Pages(spark, DIR)
    assert "part.parquet" not in str(p.sizes.inputFiles()) and sorted(p.sizes.collect()) == sorted(fixtures.page_sizes(p.ref).collect())


def test_documents_gather_runs_not_characters(spark):
    """One gathering by page, of flat runs; maps of pages are hashed, so lines with their characters are never sorted."""
    runs = spark.createDataFrame([("A", 1, k, k % 2, k // 2, f"T{k} x", 9.0 * k, 0.0, 9.0 * k + 8, 9.0, 1.0, 0.0) for k in range(6)], f"{KEYS}, run_idx int, block long, line int, text string, x0 double, y0 double, x1 double, y1 double, dir_x double, dir_y double")
    for df in (records.nested(runs), records.character_documents(runs, F.col("line") == 1)):
        assert plan(df).count("ObjectHashAggregate") == 2 and "array<struct<c:" not in str(df._jdf.queryExecution().optimizedPlan().children().head().schema().simpleString())
    maps = runs.select("pair_id", "page", *(F.lit(v).alias(c) for c, v in zip(("m00", "m01", "m02", "m10", "m11", "m12"), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), strict=True))).distinct()
    found = records.words(records.character_documents(runs), maps)
    assert "ShuffledHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    assert sorted(r["text"] for r in found.collect()) == sorted([f"T{k}" for k in range(6)] + ["x"] * 6)


def test_components_of_many_pages_at_once(spark):
    """Equal numbers on different pages are different runs; a page costs no call of its own."""
    runs = spark.createDataFrame([("A", p, i) for p in (1, 2) for i in (-3, 0, 1, 2)] + [("B", 1, 7)], f"{KEYS}, run_idx int")
    edges = spark.createDataFrame([("A", 1, -3, 2), ("A", 1, 1, 2), ("A", 2, 0, 1)], f"{KEYS}, i int, j int")
    found = clusters.components(runs, edges)
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("A", 1, -3, -3), ("A", 1, 0, 0), ("A", 1, 1, -3), ("A", 1, 2, -3), ("A", 2, -3, -3), ("A", 2, 0, 0), ("A", 2, 1, 0), ("A", 2, 2, 2), ("B", 1, 7, 7)]
    assert clusters.components(runs.limit(0), edges.limit(0)).count() == 0


def test_ruled_tables_of_many_pages_at_once(spark):
    """The same corners on two page sides are different tables; a cell alone is none."""
    corners = lambda a, d: [(a, d), (a, d + 1), (a + 1, d), (a + 1, d + 1)]
    rows = [("A", 1, s, k, 10.0 * d, 10.0 * a, corners(a, d)) for s in ("ref", "cand") for k, (a, d) in enumerate([(1, 1), (1, 2), (5, 1), (5, 2), (9, 9)])] + [("A", 2, "ref", 0, 0.0, 0.0, corners(1, 1))]
    cells = spark.createDataFrame(rows, f"{KEYS}, side string, cell int, x0 double, y0 double, corners array<struct<across:int,down:int>>")
    found = lattice.tables_of(cells)
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("A", 1, s, k, k // 2) for s in ("cand", "ref") for k in range(4)]
    assert lattice.tables_of(cells.limit(0)).count() == 0


def test_words_are_normalised_once(spark):
    words = spark.createDataFrame([("A", 1, "ref", 0, "Q.TY"), ("A", 1, "ref", 1, "Items")], f"{KEYS}, side string, word_idx int, text string")
    found = tables.header_words(words, CONFIG)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r["text"] for r in found.collect()] == ["Items"]


def test_what_exact_matching_leaves_without_joins(spark):
    side = lambda rows: spark.createDataFrame(rows, f"{KEYS}, run_idx int, norm string, text string")
    ref = side([("A", 1, k, n, f"r{k}") for k, n in enumerate(["x", "x", "x", "y", None, "z"])] + [("A", 2, 0, "x", "q")])
    cand = side([("A", 1, k, n, f"c{k}") for k, n in enumerate(["z", "x", None, "w", "z"])] + [("B", 2, 0, "x", "q")])
    exact = matching.residual_exact(ref, cand)
    for ours, theirs in zip(matching.residual_unmatched(ref, cand), (matching.unmatched(ref, exact, "ref"), matching.unmatched(cand, exact, "cand")), strict=True):
        assert "Join" not in plan(ours)
        assert sorted(map(repr, ours.collect())) == sorted(map(repr, theirs.collect()))


def test_block_zones_without_join(spark):
    runs = spark.createDataFrame([("A", 1, k, k // 2, f"t{k}", 9.0 * k, 0.0, 9.0 * k + 8, 9.0) for k in range(4)], f"{KEYS}, run_idx int, block long, norm string, x0 double, y0 double, x1 double, y1 double")
    found = queries._block_zones(runs)
    assert "Join" not in plan(found)
    assert sorted((r["cluster"], r["text"]) for r in found.collect()) == [(0, "t0 t1"), (2, "t2 t3")]


def test_costs_of_unmatched_runs_only(spark, monkeypatch):
    read = []
    monkeypatch.setattr(queries, "settled", lambda df: df)
    monkeypatch.setattr(matching, "costs", lambda ref, cand, config, costs=matching.costs: read.append(ref) or costs(ref, cand, config))
    queries.missing_groups(spark, DIR)
    assert 0 < read[0].count() < queries.Pages(spark, DIR).ref.count() / 2


def test_few_rows_start_no_python(spark):
    for df in (defects.templates(spark, CONFIG), report.weights(spark), report.counts_by_class(spark.range(1).select(F.lit("missing_text").alias("class")))):
        assert "ExistingRDD" not in plan(df)
    assert {r["category"]: r["weight"] for r in report.weights(spark).collect()} == report.CATEGORY_WEIGHTS


def test_categories_read_one_text(spark):
    columns = ", ".join(f"CAST(NULL AS string) AS {c}" for c in ("message", "ref_text", "zone"))
    rows = spark.sql(f"SELECT 'A' AS pair_id, 1 AS page, 'missing_text' AS class, 'Rev 5' AS cand_text, {columns}, array(600D, 9D, 700D, 19D) AS cand_box, CAST(NULL AS array<double>) AS ref_box FROM range(1)")
    found = report.categorised(rows, spark.createDataFrame([("A", 1, 800.0, 600.0)], f"{KEYS}, width double, height double"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(") <= 1
    assert [r["category"] for r in found.collect()] == ["Revision History"]
