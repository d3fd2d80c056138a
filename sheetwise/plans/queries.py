"""The engine's operators as named queries over pages derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, Settings
from ..functions import geometry as g
from ..functions.text import edit_distance
from ..operators import clusters, defects, jobs, lattice, matching, raster, registration, report, tables, visual, zones
from ..session import settled
from ..sources import fixtures, records
from . import compare as plan

KEYS = ["pair_id", "page"]
CONFIG = Config()
BOX = ["x0", "y0", "x1", "y1"]


class Pages:
    """The derived runs with their norms, page sizes and zone grids. numbered: only pages with a number, for queries that join by page: all readers of the runs then share one shuffle, as no join asks for that below it."""

    def __init__(self, spark: SparkSession, sf_dir: str, numbered: bool = False):
        self.both = plan.prepared(fixtures.sided_runs(spark, sf_dir), CONFIG)
        if numbered:
            self.both = self.both.where("page IS NOT NULL")
        self.ref, self.cand = (self.both.where(F.col("side") == side).drop("side") for side in ("ref", "cand"))
        self.sizes = fixtures.pages(spark, sf_dir)

    @property
    def labels(self) -> DataFrame:
        return zones.labels(self.cand, self.sizes, CONFIG)

    @property
    def grids(self) -> DataFrame:
        return zones.grids(self.sizes, self.labels)

    def level(self) -> DataFrame:
        """Reference runs with their own centre as the mapped one: pages of equal size under the scale map."""
        cx, cy = g.center(g.box())
        return self.ref.withColumn("mx", cx).withColumn("my", cy)


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    both = p.ref.select(F.lit("ref").alias("side"), *KEYS, "run_idx", "norm").unionAll(p.cand.select(F.lit("cand").alias("side"), *KEYS, "run_idx", "norm"))
    return both


def symbol_equivalence(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    a = p.ref.select(*KEYS, "block", "line", F.col("text").alias("ref_text"), F.col("norm").alias("a"))
    b = p.cand.select(*KEYS, "block", "line", F.col("text").alias("cand_text"), F.col("norm").alias("b"))
    return a.join(b, [*KEYS, "block", "line"]).where("ref_text <> cand_text").select(*KEYS, "block", "line", "ref_text", "cand_text", (F.col("a") == F.col("b")).alias("equal"))


def edit_distance_norm(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    a = p.ref.select(*KEYS, "block", "line", F.col("norm").alias("a"))
    b = p.cand.select(*KEYS, "block", "line", F.col("norm").alias("b"))
    both = a.join(b, [*KEYS, "block", "line"]).select(*KEYS, "block", "line", edit_distance(F.col("a"), F.col("b")).alias("distance"))
    return _rounded(both.where("distance > 0"), "distance", digits=6)


def bbox_centers(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = g.center(g.box())
    return Pages(spark, d).cand.select(*KEYS, "run_idx", cx.alias("cx"), cy.alias("cy"))


def overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of each candidate run with the run that follows it on the page."""
    down = Window.partitionBy(*KEYS).orderBy("run_idx")
    rows = Pages(spark, d).cand.select(*KEYS, "run_idx", *BOX, *(F.lead(c).over(down).alias(f"n{c}") for c in BOX)).where("nx0 is not null")
    return _rounded(rows.select(*KEYS, "run_idx", g.overlap(g.box(), g.box("n")).alias("ratio")).where("ratio > 0"), "ratio", digits=6)


def anchors(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    return registration.anchors(p.ref, p.cand).drop("cand_idx")


def affine_fit(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    return _rounded(registration.least_squares(registration.anchors(p.ref, p.cand)), *g.MATRIX, digits=4)


def map_bbox(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    maps = registration.least_squares(registration.anchors(p.ref, p.cand)).drop("n_anchors")
    box = g.mapped_box(g.box(), [F.col(c) for c in g.MATRIX])
    return _rounded(p.ref.join(maps, KEYS).select(*KEYS, "run_idx", *(b.alias(c) for b, c in zip(box, BOX, strict=True))), *BOX, digits=3)


def scale_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every eleventh candidate page has no width: its map is not valid."""
    sizes = Pages(spark, d).sizes.withColumn("cand_width", F.when(F.col("page") % 11 == 0, 0.0).otherwise(F.col("width") + F.col("page") % 7)).withColumn("cand_height", F.col("height") - F.col("page") % 5)
    m = g.scale_map(F.col("width"), F.col("height"), F.col("cand_width"), F.col("cand_height"))
    return sizes.select(*KEYS, *(v.alias(k) for k, v in m.items()), g.valid(list(m.values())).alias("valid"))


def zone_labels(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(Pages(spark, d).labels, "center", digits=6)


def zone_assign(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    return zones.with_zone(p.cand, p.grids, *g.center(g.box()), CONFIG).select(*KEYS, "run_idx", "zone")


def _costs(p: Pages) -> DataFrame:
    return matching.costs(p.level(), p.cand, CONFIG)


def match_cost_stats(spark: SparkSession, d: str) -> DataFrame:
    costs = _costs(Pages(spark, d))
    return costs.groupBy(*KEYS).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("cost") <= CONFIG.match_max_cost).alias("n_cheap"), F.count_if("equal").alias("n_equal"), F.round(F.sum("cost"), 3).alias("total"))


def min_ref_cost(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(matching.least_costs(_costs(Pages(spark, d))), "min_cost", digits=6)


def assignment(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    return _rounded(matching.cheap(matching.assigned(p.level(), p.cand, CONFIG), CONFIG), "distance", "cost", digits=6)


def residual_exact(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    return matching.residual_exact(p.ref, p.cand)


def _unpaired(p: Pages) -> tuple[DataFrame, DataFrame]:
    return matching.residual_unmatched(p.ref, p.cand)


def unmatched_runs(spark: SparkSession, d: str) -> DataFrame:
    return matching.left_over(Pages(spark, d).both, F.col("side") == "ref").select("side", *KEYS, "run_idx", "text")


def _residual(spark: SparkSession, d: str, kind: str) -> DataFrame:
    # Only what matching reads is kept, and once: what exact matching leaves, of both sides in one pass. It is far less than the runs, and leaves the same if it is matched again.
    p = Pages(spark, d)
    left = plan.keep(matching.left_over(p.both.select("side", *KEYS, "run_idx", "norm"), F.col("side") == "ref"))
    p.ref, p.cand = (settled(left.where(F.col("side") == side).select(*KEYS, "run_idx", "norm")) for side in ("ref", "cand"))
    return matching.residual(*map(settled, _unpaired(p))).where(F.col("kind") == kind).select(*KEYS, "ref_idx", "cand_idx", "ratio")


def residual_split(spark: SparkSession, d: str) -> DataFrame:
    return _residual(spark, d, "split").drop("ratio")


def residual_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _residual(spark, d, "fuzzy")


def text_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d, numbered=True)
    out = defects.overlaps(p.cand, p.grids, CONFIG)
    return _rounded(out.select(*KEYS, "zone", "cand_text", "confidence", *(F.get("cand_box", F.lit(k)).alias(c) for k, c in enumerate(BOX))), "confidence", digits=6)


def stack_edges(spark: SparkSession, d: str) -> DataFrame:
    return clusters.stack_edges(Pages(spark, d).ref, CONFIG)


def leader_edges(spark: SparkSession, d: str) -> DataFrame:
    return clusters.leader_edges(Pages(spark, d).ref, fixtures.segments(spark, d), CONFIG)


def annotation_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.annotation_clusters(Pages(spark, d).ref, fixtures.segments(spark, d), CONFIG)


def dbscan_zones(spark: SparkSession, d: str) -> DataFrame:
    return clusters.dbscan(Pages(spark, d).ref, CONFIG)


def _block_zones(runs: DataFrame) -> DataFrame:
    """Zones by source block, so that the signature can be checked apart from the clustering."""
    first = F.min("run_idx").over(Window.partitionBy(*KEYS, "block"))
    return clusters.signatures(runs.withColumn("cluster", first))


def zone_signature(spark: SparkSession, d: str) -> DataFrame:
    return _block_zones(Pages(spark, d).ref)


def missing_zones_exact(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    return clusters.missing_exact(_block_zones(p.ref), _block_zones(p.cand)).select(*KEYS, "cluster", "text")


def missing_zones(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    cx, cy = g.center(g.box())
    ref = settled(_block_zones(p.ref)).withColumn("mx", cx).withColumn("my", cy)
    return clusters.missing_zones(ref, settled(_block_zones(p.cand))).select(*KEYS, "cluster", "message")


def missing_groups(spark: SparkSession, d: str) -> DataFrame:
    """Runs that exact matching leaves, in groups by source block."""
    p = Pages(spark, d, numbered=True)
    left = settled(_unpaired(p)[0])
    x, y = g.center(g.box())
    costs = matching.costs(left.withColumn("mx", x).withColumn("my", y), p.cand, CONFIG)  # of what is left only
    blocks = p.ref.select(*KEYS, "run_idx", F.min("run_idx").over(Window.partitionBy(*KEYS, "block")).alias("cluster"))
    return _rounded(defects.missing_groups(left, blocks, matching.least_costs(costs), CONFIG), "confidence", digits=6)


def view_models(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    return registration.models(registration.anchors(p.ref, p.cand), CONFIG).drop("xs", "ys")


def routed_points(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d, numbered=True)
    regs = registration.registrations(p.sizes, registration.models(registration.anchors(p.ref, p.cand), CONFIG))
    return plan.with_center_map(p.ref, regs).select(*KEYS, "run_idx", "view", "rotation", "mx", "my")


def bom_rows(spark: SparkSession, d: str) -> DataFrame:
    words = fixtures.words(spark, d)
    return tables.table_words(words, tables.headers(words, CONFIG)).select(*tables.SIDE, "word_idx", "text", "row_no")


def bom_cells(spark: SparkSession, d: str) -> DataFrame:
    return tables.grid(fixtures.words(spark, d), CONFIG)[0]


def words_scan(spark: SparkSession, d: str) -> DataFrame:
    """Words out of page documents with characters, every fifth page stored as turned by a quarter; blanks of every second line are gaps only."""
    p = Pages(spark, d)
    documents, pages = fixtures.turned(records.character_documents(p.ref, F.col("line") % 2 == 0), p.sizes)
    return records.words(documents, pages).select(*KEYS, "block", "line", "word", "text", *BOX)


def bom_scan(spark: SparkSession, d: str) -> DataFrame:
    """Parts tables from words that are scanned out of documents: each row of a table is a line."""
    w = fixtures.words(spark, d)
    runs = w.withColumns({"run_idx": F.col("word_idx"), "block": F.expr("word_idx div 3"), "line": F.lit(0), "dir_x": F.lit(1.0), "dir_y": F.lit(0.0)})
    scanned = [records.words(records.character_documents(runs.where(F.col("side") == side))).withColumn("side", F.lit(side)) for side in ("ref", "cand")]
    return tables.grid(settled(records.in_order(scanned[0].unionByName(scanned[1]))), CONFIG)[0]


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    cells, boxes = map(settled, tables.grid(settled(fixtures.words(spark, d)), CONFIG, settled))
    side = lambda df, s: df.where(F.col("side") == s).drop("side")
    return side(cells, "ref"), side(cells, "cand"), side(boxes, "ref"), side(boxes, "cand")


def table_match(spark: SparkSession, d: str) -> DataFrame:
    _, _, ref, cand = _sides(spark, d)
    cx, cy = g.center(g.box())
    return _rounded(tables.paired(ref.withColumn("mx", cx).withColumn("my", cy), cand), "distance", digits=6)


def table_columns(spark: SparkSession, d: str) -> DataFrame:
    ref_cells, cand_cells, ref, _ = _sides(spark, d)
    pairs = ref.select(*KEYS, "table_id", F.lit(0).alias("cand_id"))
    return tables.matched_columns(ref_cells, cand_cells, pairs, CONFIG)


def table_cell_diff(spark: SparkSession, d: str) -> DataFrame:
    ref_cells, cand_cells, ref, _ = _sides(spark, d)
    pairs = ref.select(*KEYS, "table_id", F.lit(0).alias("cand_id"))
    return tables.cell_differences(ref_cells, cand_cells, tables.matched_columns(ref_cells, cand_cells, pairs, CONFIG), CONFIG)


def table_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Cells of ruled tables."""
    return lattice.lattice(*fixtures.ruled(spark, d))[0]


def table_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Tables of each page side: by header words, or else by rulings."""
    rulings, ruled = fixtures.ruled(spark, d)
    cells, boxes = tables.grid(settled(fixtures.words(spark, d)), CONFIG, settled)
    sizes = ruled.select(*KEYS).distinct().select(*KEYS, F.lit(fixtures.WIDTH).alias("width"), F.lit(fixtures.HEIGHT).alias("height"))
    found = tables.or_else(cells, settled(boxes), *lattice.lattice(rulings, ruled), sizes)[1]
    return found.select(*tables.SIDE, "table_id", *BOX, "n_rows", "n_cols")


def _findings(p: Pages) -> DataFrame:
    """Findings of the smallest slice: what exact matching leaves, on both sides, and overlaps. All get their zones at once, so that grids are worked out once."""
    left = matching.left_over(p.both, F.col("side") == "ref")
    rows = left.select(*KEYS, F.when(F.col("side") == "ref", "missing_text").otherwise("added_text").alias("_class"), F.lit(None).cast("double").alias("ratio"), "text", *BOX)
    rows = rows.unionByName(defects.overlapping(p.cand, CONFIG).withColumn("_class", F.lit("text_overlap")))
    is_ = lambda c: F.col("_class") == c
    zoned = zones.with_zone(rows, p.grids, *g.center(g.box()), CONFIG).where(~is_("added_text") | defects.counts_as_added())
    confidence = F.when(is_("missing_text"), 0.5).when(is_("added_text"), 1.0).otherwise(defects.overlap_confidence(F.col("ratio"), CONFIG))
    box, text = defects.box_array(g.box()), F.col("text")
    found = defects.finding("", confidence, zone=F.col("zone"), ref_text=F.when(is_("missing_text"), text), cand_text=F.when(~is_("missing_text"), text), ref_box=F.when(is_("missing_text"), box), cand_box=box)
    return zoned.select(*found, "_class").withColumn("class", F.col("_class")).drop("_class")


def _slice(spark: SparkSession, d: str) -> tuple[Pages, DataFrame]:
    p = Pages(spark, d, numbered=True)
    return p, defects.records(defects.without_border(_findings(p)), CONFIG)


def added_text(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d, numbered=True)
    return defects.added(_unpaired(p)[1], p.grids, CONFIG).select(*KEYS, "zone", "cand_text", *(F.get("cand_box", F.lit(k)).alias(c) for k, c in enumerate(BOX)))


def defect_filters(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d, numbered=True)
    _, boxes = tables.grid(settled(fixtures.words(spark, d)), CONFIG, settled)
    kept = defects.without_tables(defects.without_border(_findings(p)), boxes.where("side = 'cand'"))
    return kept.groupBy(*KEYS, "class").agg(F.count("*").alias("n"))


def ignore_regions(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d, numbered=True)
    config = Config(ignore_regions=[[100.0, 100.0, 300.0, 250.0], [500.0, 300.0, 560.0, 420.0]])
    return defects.without_regions(_findings(p), config).groupBy(*KEYS, "class").agg(F.count("*").alias("n"))


def defect_records(spark: SparkSession, d: str) -> DataFrame:
    _, rows = _slice(spark, d)
    return rows.select(*KEYS, "class", "severity", "confidence", "status", "zone", "ref_text", "cand_text", "message", "cause", "fix")


def defect_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids in report order; runs that tie in every key of the order are told apart by nothing, so only the order's keys are shown."""
    _, rows = _slice(spark, d)
    out = report.numbered(rows)
    return out.select("pair_id", "id", "page", "class", F.when(F.coalesce("cand_text", F.lit("")) != "", F.col("cand_text")).otherwise(F.coalesce("ref_text", F.lit(""))).alias("text"))


def _categorised(spark: SparkSession, d: str) -> tuple[Pages, DataFrame]:
    p, rows = _slice(spark, d)
    return p, report.categorised(rows, p.sizes)


def audit_categories(spark: SparkSession, d: str) -> DataFrame:
    return _categorised(spark, d)[1].groupBy(*KEYS, "class", "category").agg(F.count("*").alias("n"))


def category_matrix(spark: SparkSession, d: str) -> DataFrame:
    return report.category_matrix(_categorised(spark, d)[1])


def page_quality_score(spark: SparkSession, d: str) -> DataFrame:
    p, rows = _categorised(spark, d)
    return report.page_scores(rows, p.sizes)


def pair_quality_score(spark: SparkSession, d: str) -> DataFrame:
    p, rows = _categorised(spark, d)
    return report.pair_scores(report.page_scores(rows, p.sizes))


def page_summaries(spark: SparkSession, d: str) -> DataFrame:
    p, rows = _categorised(spark, d)
    return report.page_summaries(rows, p.sizes)


def counts_by_class(spark: SparkSession, d: str) -> DataFrame:
    return report.counts_by_class(_slice(spark, d)[1])


def counts_by_status(spark: SparkSession, d: str) -> DataFrame:
    return report.counts_by_status(_slice(spark, d)[1])


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.severity_counts(_slice(spark, d)[1])


def pair_summary(spark: SparkSession, d: str) -> DataFrame:
    p, rows = _categorised(spark, d)
    return jobs.pair_summary(rows, p.sizes.select("pair_id").distinct(), report.pair_scores(report.page_scores(rows, p.sizes)))


def box_layer(spark: SparkSession, d: str) -> DataFrame:
    rows = report.box_layer(_slice(spark, d)[1])
    return rows.groupBy(*KEYS, "class", "color").agg(F.count("*").alias("n"))


def file_pairing(spark: SparkSession, d: str) -> DataFrame:
    return jobs.paired(jobs.pdf_files(fixtures.uploads(spark, d)))


def unmatched_files(spark: SparkSession, d: str) -> DataFrame:
    return jobs.unmatched(jobs.pdf_files(fixtures.uploads(spark, d)))


def upload_totals(spark: SparkSession, d: str) -> DataFrame:
    return jobs.running_bytes(jobs.paired(jobs.pdf_files(fixtures.uploads(spark, d)))).select("name_key", "total")


def job_ttl_eviction(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.jobs(spark, d)
    now: Column = F.lit(rows.agg(F.max("updated_at")).first()[0])
    return jobs.evicted(rows, now, Settings(job_ttl_seconds=7 * 86_400, max_retained_jobs=500))


def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.pending(fixtures.jobs(spark, d))


def mean_abs_diff(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(raster.mean_difference(fixtures.rasters(spark, d)), "diff", digits=9)


def ssim_score(spark: SparkSession, d: str) -> DataFrame:
    return raster.scores(fixtures.rasters(spark, d))


def text_over_geometry(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    items = records.drawings(fixtures.segments(spark, d)).withColumn("width", (F.col("item") % 4).cast("double"))
    return raster.over_geometry(p.cand, items, p.sizes)


def visual_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions in which tiled pages differ, over pages of up to 64 tiles."""
    cells = fixtures.page_tiles(spark, d)
    sizes = cells.where("side = 'ref'").groupBy(*KEYS).agg((F.max("tj") * 8 + 8).alias("width"), (F.max("ti") * 8 + 8).alias("height"))
    scale = g.scale_map(*(F.lit(1.0) for _ in range(4)))
    maps = sizes.select(*KEYS, F.lit(0).alias("map_id"), *(scale[c].alias(c) for c in g.MATRIX), *(F.lit(None).cast("double").alias(c) for c in BOX))
    parts = settled(visual.pieces(visual.masks(cells, maps, 8, 1.0), sizes, 8))
    return visual.regions(parts, 8, Config(cv_min_contour_area=4.0)).drop("region")


def visual_merge(spark: SparkSession, d: str) -> DataFrame:
    """Visual differences and findings: scores taken over, and what is left over."""
    p = Pages(spark, d, numbered=True)
    out = visual.merged(settled(_findings(p)), fixtures.visual_boxes(spark, d), p.cand, p.ref, p.grids, CONFIG)
    return out.select(*KEYS, "class", "zone", "ref_text", "cand_text", F.round("confidence", 6).alias("confidence"), "score", *(F.get("cand_box", F.lit(k)).alias(c) for k, c in enumerate(BOX)))


def nested_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs put into nested page documents and scanned out of them again."""
    return records.runs(records.nested(Pages(spark, d).ref)).select(*KEYS, "block", "line", "text", *BOX)


def drawing_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of lines and rectangles: each order draws its line, each third one a rectangle too."""
    return records.segments(records.drawings(fixtures.segments(spark, d)))


def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Pages that both sides have, with the map that fits their sizes."""
    pages = plan.compared_pages(*fixtures.both_page_sizes(Pages(spark, d).ref))
    none = registration.models(registration.anchors(Pages(spark, d).ref, Pages(spark, d).cand).limit(0), CONFIG)
    first = F.get("views", F.lit(0))
    return _rounded(registration.registrations(pages, none).select(*KEYS, "width", "height", "ref_width", "ref_height", first["m00"].alias("m00"), first["m11"].alias("m11")), "m00", "m11", digits=6)


def pair_pages(spark: SparkSession, d: str) -> DataFrame:
    return plan.pair_pages(*fixtures.both_page_sizes(Pages(spark, d).ref))


def page_errors(spark: SparkSession, d: str) -> DataFrame:
    p = Pages(spark, d)
    return plan.page_errors(fixtures.damaged(p.ref), p.cand, p.sizes.withColumn("height", F.when(F.col("page") % 13 != 0, F.col("height"))))


def pair_errors(spark: SparkSession, d: str) -> DataFrame:
    """The roll-up of pairs where the pages of one pair can't be compared."""
    p, rows = _categorised(spark, d)
    errors = plan.page_errors(fixtures.damaged(p.ref).where("pair_id = 'B'"), p.cand, p.sizes)
    out = jobs.pair_summary(rows, p.sizes.select("pair_id").distinct(), report.pair_scores(report.page_scores(rows, p.sizes)), errors)
    return out.select("pair_id", "total_defects", "quality_score", "status", "error")


def scoreboard(spark: SparkSession, d: str) -> DataFrame:
    return jobs.scoreboard(page_quality_score(spark, d))


def page_states(spark: SparkSession, d: str) -> DataFrame:
    p, rows = _categorised(spark, d)
    return jobs.page_states(p.sizes, rows)


def compare_pages(spark: SparkSession, d: str) -> DataFrame:
    """The whole comparison, with parts tables."""
    ref, cand = fixtures.runs(spark, d)
    inputs = plan.Inputs(ref, cand, fixtures.page_sizes(ref), segments=fixtures.segments(spark, d), words=fixtures.words(spark, d))
    return plan.compare(inputs, CONFIG).categorised.select(*KEYS, "class", "category", "severity", "confidence", "status", "zone", "ref_text", "cand_text", "message")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, symbol_equivalence, edit_distance_norm, bbox_centers, overlap_ratio, anchors, affine_fit, map_bbox, scale_fallback, zone_labels, zone_assign, match_cost_stats, min_ref_cost, assignment,
        residual_exact, unmatched_runs, residual_split, residual_fuzzy, text_overlap, stack_edges, leader_edges, annotation_clusters, dbscan_zones, zone_signature, missing_zones_exact, missing_zones, missing_groups,
        view_models, routed_points, bom_rows, bom_cells, words_scan, bom_scan, table_match, table_columns, table_cell_diff, table_lattice, table_fallback, added_text, defect_filters, ignore_regions, defect_records, defect_ids, audit_categories, category_matrix,
        page_quality_score, pair_quality_score, page_summaries, counts_by_class, counts_by_status, severity_counts, pair_summary, box_layer, file_pairing, unmatched_files, upload_totals, job_ttl_eviction, pending_jobs,
        mean_abs_diff, ssim_score, text_over_geometry, visual_regions, visual_merge, nested_runs, drawing_segments, page_sizes, pair_pages, page_errors, pair_errors, scoreboard, page_states, compare_pages,
    )
}
