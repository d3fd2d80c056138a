"""The whole comparison of page pairs as one lazily built plan: register, match, detect, filter, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as g
from ..functions.text import normalized
from ..operators import clusters, defects, lattice, matching, raster, registration, report, tables, visual, zones
from ..session import settled as keep

KEYS = ["pair_id", "page"]


@dataclass
class Inputs:
    """ref and cand: run_idx, block, line, text, box, and optionally dir_x, dir_y; pages: width, height of candidate pages; the rest is optional. ref_pages: width, height of reference pages, where they aren't the same.

    rulings: side, ax, ay, bx, by of drawn lines of both sides, for tables without header words (with words). tiles: side, ti, tj, width, height, pixels of rendered pages in squares of ``tile`` pixels, at config.render_dpi; without them pages aren't
    compared by their looks."""

    ref: DataFrame
    cand: DataFrame
    pages: DataFrame
    segments: DataFrame | None = None
    words: DataFrame | None = None
    rasters: DataFrame | None = None
    drawing: DataFrame | None = None
    ref_pages: DataFrame | None = None
    rulings: DataFrame | None = None
    tiles: DataFrame | None = None
    tile: int = 256


@dataclass
class Comparison:
    """pair_pages: pages_compared and page_count_mismatch of each pair; errors: pairs that couldn't be compared, and why."""

    records: DataFrame
    categorised: DataFrame
    page_scores: DataFrame
    pair_scores: DataFrame
    pair_pages: DataFrame
    errors: DataFrame


def pair_pages(pages: DataFrame, ref_pages: DataFrame) -> DataFrame:
    """(pair_id, pages_compared, page_count_mismatch): pages that both sides have are compared."""
    both = pages.select(*KEYS, F.lit(1).alias("c")).join(ref_pages.select(*KEYS, F.lit(1).alias("r")), KEYS, "full_outer")
    n = both.groupBy("pair_id").agg(F.count("c").alias("c"), F.count("r").alias("r"), F.count_if(F.col("c").isNotNull() & F.col("r").isNotNull()).alias("pages_compared"))
    return n.select("pair_id", "pages_compared", (F.col("c") != F.col("r")).alias("page_count_mismatch"))


def compared_pages(pages: DataFrame, ref_pages: DataFrame) -> DataFrame:
    """Pages that both sides have, with the sizes of both."""
    return pages.select(*KEYS, "width", "height").join(ref_pages.select(*KEYS, F.col("width").alias("ref_width"), F.col("height").alias("ref_height")), KEYS)


def page_errors(ref: DataFrame, cand: DataFrame, pages: DataFrame) -> DataFrame:
    """(keys, error) of pages that can't be compared: a run without a text or without a box of finite numbers, a page without a size. One row for each page and error."""
    finite = F.lit(True)
    for c in g.box():
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    said = F.when(F.col("text").isNull(), "a run has no text").when(~F.coalesce(finite, F.lit(False)), "a run has no box")
    runs = ref.select(*KEYS, said.alias("error")).unionAll(cand.select(*KEYS, said.alias("error")))
    sizes = [F.col(c) for c in pages.columns if c.endswith(("width", "height"))]
    sized = F.lit(True)
    for c in sizes:
        sized = sized & F.coalesce(c > 0, F.lit(False)) & (c < float("inf"))
    return runs.unionAll(pages.select(*KEYS, F.when(~sized, "a page has no size").alias("error"))).where("error is not null").distinct()


def prepared(runs: DataFrame, config: Config) -> DataFrame:
    """runs with ``norm`` and, where missing, a level direction."""
    out = runs.withColumn("norm", normalized(F.col("text"), config))
    return out if "dir_x" in runs.columns else out.withColumn("dir_x", F.lit(1.0)).withColumn("dir_y", F.lit(0.0))


def with_center_map(df: DataFrame, regs: DataFrame) -> DataFrame:
    """df with its box's view, map, and the mapped centre mx, my."""
    x, y = g.center(g.box())
    m = [F.col(c) for c in g.MATRIX]
    mx, my = g.mapped(x, y, m)
    return registration.with_map(df, regs, x, y).withColumn("mx", mx).withColumn("my", my)


def compare(inputs: Inputs, config: Config | None = None) -> Comparison:
    """All records of all pairs. Frames that several detectors read are computed once, into the shared folder, which also keeps plans short."""
    config = config or Config()
    ref_pages = inputs.ref_pages if inputs.ref_pages is not None else inputs.pages
    told, pages = pair_pages(inputs.pages, ref_pages), compared_pages(inputs.pages, ref_pages)
    both = lambda df: df.join(pages.select(*KEYS), KEYS, "left_semi")
    # A pair with a page that can't be compared is left out as a whole, and said so; the other pairs go on.
    errors = keep(page_errors(both(inputs.ref), both(inputs.cand), pages))
    sound = lambda df: both(df).join(errors.select("pair_id").distinct(), "pair_id", "left_anti")
    pages = keep(sound(pages))
    inputs = replace(inputs, pages=pages.select(*KEYS, "width", "height"))
    ref, cand = keep(prepared(sound(inputs.ref), config)), keep(prepared(sound(inputs.cand), config))
    regs = keep(registration.registrations(pages, registration.models(registration.anchors(ref, cand), config)))
    grids = keep(zones.grids(inputs.pages, zones.labels(cand, inputs.pages, config)))
    mapped = keep(with_center_map(ref, regs))
    assigned = keep(matching.assigned(mapped, cand, config))
    least, matches = assigned.select(*KEYS, "ref_idx", "min_cost"), matching.cheap(assigned, config)
    free_ref, free_cand = matching.unmatched(mapped, matches, "ref"), matching.unmatched(cand, matches, "cand")
    residual = keep(matching.residual(free_ref, free_cand))
    left_ref, left_cand = matching.unmatched(free_ref, residual, "ref"), matching.unmatched(free_cand, residual, "cand")
    found = [
        _glyphs(ref, cand, residual, regs, grids, config),
        _missing(left_ref, ref, inputs.segments, least, regs, grids, config),
        defects.added(left_cand, grids, config),
        defects.overlaps(cand, grids, config),
    ]
    if inputs.rasters is not None:
        found.append(_rendered(ref, cand, matches, inputs.rasters, regs, grids, config))
    if config.report_misplacement:
        found.append(_misplaced(mapped, cand, matches, grids, config))
    cand_tables = None
    if inputs.words is not None:
        table_found, cand_tables = _tables(inputs.words, inputs.rulings, pages, regs, grids, config)
        found.append(table_found)
    if inputs.drawing is not None:
        found.append(_geometry(cand, inputs.drawing, inputs.pages, cand_tables, grids, config))
    findings = keep(reduce(DataFrame.unionByName, found))  # zones read them again
    if inputs.tiles is not None:
        findings = visual.merged(findings, _looks(inputs, cand_tables, pages, regs, config), cand, _on_candidate(ref, regs), grids, config)
    findings = keep(findings.unionByName(_zones(ref, cand, findings, regs, grids, config)))
    kept = defects.without_border(findings)
    if cand_tables is not None and not config.report_table_cells:
        kept = defects.without_tables(kept, cand_tables)
    records = keep(defects.records(defects.without_regions(kept, config), config))
    categorised = report.categorised(records, inputs.pages)
    scores = report.page_scores(categorised, inputs.pages)
    return Comparison(records, categorised, scores, report.pair_scores(scores), told, errors)


def compare_in_parts(inputs: Inputs, save: Callable[[Comparison, str], None], config: Config | None = None, most: int = 20) -> list[tuple[str, str]]:
    """save(comparison, name of the part) of all pairs at once; where that or the saving fails, of both halves of the pairs, and so on, until the pairs that fail stand alone: (pair_id, error) of these. Pairs are halved by hash, so one that
    breaks costs about twice the logarithm of their number in runs, and no list of pairs comes to the driver. After ``most`` halvings what still fails together is named together."""

    def attempt(depth: int, part: int) -> list[tuple[str, str]]:
        mine = lambda df: df.where(F.pmod(F.xxhash64("pair_id"), F.lit(1 << depth)) == part)
        frames = {f.name: getattr(inputs, f.name) for f in fields(inputs)}
        here = inputs if depth == 0 else Inputs(**{n: mine(v) if isinstance(v, DataFrame) else v for n, v in frames.items()})
        try:
            save(compare(here, config), f"{depth}-{part}")
            return []
        except Exception as failure:  # noqa: BLE001 - whatever it is, other pairs must go on
            names = [r["pair_id"] for r in here.pages.select("pair_id").distinct().limit(1 if depth < most else 1000).collect()]
            if depth < most and here.pages.select("pair_id").distinct().limit(2).count() > 1:
                return attempt(depth + 1, part) + attempt(depth + 1, part + (1 << depth))
            return [(name, str(failure).splitlines()[0][:500]) for name in names]

    return attempt(0, 0)


def _pair_boxes(ref: DataFrame, cand: DataFrame, pairs: DataFrame) -> DataFrame:
    a = ref.select(*KEYS, F.col("run_idx").alias("ref_idx"), F.col("text").alias("ref_text"), *(F.col(c).alias(f"r{k}") for k, c in enumerate(("x0", "y0", "x1", "y1"))))
    b = cand.select(*KEYS, F.col("run_idx").alias("cand_idx"), F.col("text").alias("cand_text"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(("x0", "y0", "x1", "y1"))))
    return pairs.join(a, [*KEYS, "ref_idx"]).join(b, [*KEYS, "cand_idx"])


def _zoned_pairs(rows: DataFrame, regs: DataFrame, grids: DataFrame, config: Config) -> DataFrame:
    r, c = [F.col(f"r{k}") for k in range(4)], [F.col(f"c{k}") for k in range(4)]
    return zones.with_zone(registration.with_map(rows, regs, *g.center(r)), grids, *g.center(c), config)


def _glyphs(ref: DataFrame, cand: DataFrame, residual: DataFrame, regs: DataFrame, grids: DataFrame, config: Config) -> DataFrame:
    rows = _zoned_pairs(_pair_boxes(ref, cand, residual.where("kind = 'fuzzy'")), regs, grids, config)
    return rows.select(*defects.finding("font_glyph_corruption", 0.8, zone=F.col("zone"), ref_text=F.col("ref_text"), cand_text=F.col("cand_text"), ref_box=F.array(*(f"r{k}" for k in range(4))), cand_box=F.array(*(f"c{k}" for k in range(4))), rotation=F.col("rotation")))


def _rendered(ref: DataFrame, cand: DataFrame, matches: DataFrame, rasters: DataFrame, regs: DataFrame, grids: DataFrame, config: Config) -> DataFrame:
    """Matched runs of different text whose pictures differ too."""
    boxes = _pair_boxes(ref, cand, matches.where("NOT equal"))
    scored = raster.match_scores(boxes, rasters, config).where("different").drop("different")
    rows = _zoned_pairs(boxes.join(scored, [*KEYS, "ref_idx", "cand_idx"]), regs, grids, config)
    confidence = g.clamp(F.col("score") / (2 * max(config.pixel_diff_threshold, 1e-6)))
    return rows.select(*defects.finding("font_glyph_corruption", confidence, zone=F.col("zone"), ref_text=F.col("ref_text"), cand_text=F.col("cand_text"), ref_box=F.array(*(f"r{k}" for k in range(4))), cand_box=F.array(*(f"c{k}" for k in range(4))), score=F.col("score"), rotation=F.col("rotation")))


def _misplaced(mapped: DataFrame, cand: DataFrame, matches: DataFrame, grids: DataFrame, config: Config) -> DataFrame:
    rows = _pair_boxes(mapped, cand, matches.where(F.col("distance") > config.position_tolerance_pts))
    zoned = zones.with_zone(rows, grids, *g.center([F.col(f"c{k}") for k in range(4)]), config)
    confidence = g.clamp(F.col("distance") / (2 * max(config.position_tolerance_pts, 1e-6)))
    return zoned.select(*defects.finding("text_misplacement", confidence, zone=F.col("zone"), ref_text=F.col("ref_text"), cand_text=F.col("cand_text"), ref_box=F.array(*(f"r{k}" for k in range(4))), cand_box=F.array(*(f"c{k}" for k in range(4)))))


def _expected(rows: DataFrame, regs: DataFrame, grids: DataFrame, config: Config) -> DataFrame:
    """rows (box) with rotation, the expected candidate box e0..e3, and its zone."""
    routed = registration.with_map(rows, regs, *g.center(g.box()))
    box = g.mapped_box(g.box(), [F.col(c) for c in g.MATRIX])
    out = routed.select("*", *(b.alias(f"e{k}") for k, b in enumerate(box)))
    return zones.with_zone(out, grids, *g.center([F.col(f"e{k}") for k in range(4)]), config)


def _missing(left: DataFrame, ref: DataFrame, segments: DataFrame | None, least: DataFrame, regs: DataFrame, grids: DataFrame, config: Config) -> DataFrame:
    stacks = clusters.stack_edges(ref, config)
    edges = stacks if segments is None else stacks.unionAll(clusters.leader_edges(ref, segments, config))
    groups = defects.missing_groups(left, clusters.components(ref, edges), least, config)
    rows = _expected(groups, regs, grids, config)
    out = rows.select(*defects.finding("", F.col("confidence"), zone=F.col("zone"), ref_text=F.col("text"), ref_box=defects.box_array(g.box()), cand_box=F.array(*(f"e{k}" for k in range(4))), rotation=F.col("rotation")), F.col("class").alias("_class"))
    return out.withColumn("class", F.col("_class")).drop("_class")


def _zones(ref: DataFrame, cand: DataFrame, findings: DataFrame, regs: DataFrame, grids: DataFrame, config: Config) -> DataFrame:
    """Zones that are missing as a whole, but for those that a missing text or annotation already covers."""
    ref_zones = keep(with_center_map(clusters.signatures(ref, clusters.dbscan(ref, config)), regs).drop("view", "rotation", *g.MATRIX))
    gone = clusters.missing_zones(ref_zones, keep(clusters.signatures(cand, clusters.dbscan(cand, config))))
    rows = _expected(gone.drop("mx", "my"), regs, grids, config)
    flagged = findings.where(F.col("class").isin("missing_text", "missing_annotation") & F.col("cand_box").isNotNull()).select(*(F.col(k).alias(f"_{k}") for k in KEYS), *(F.get("cand_box", F.lit(k)).alias(f"_f{k}") for k in range(4)))
    covered = g.overlap([F.col(f"e{k}") for k in range(4)], [F.col(f"_f{k}") for k in range(4)]) > 0.3
    rest = rows.join(flagged, (rows["pair_id"] == flagged["_pair_id"]) & (rows["page"] == flagged["_page"]) & covered, "left_anti")
    return rest.select(*defects.finding("missing_annotation", 0.9, zone=F.col("zone"), ref_text=F.col("message"), ref_box=defects.box_array(g.box()), cand_box=F.array(*(f"e{k}" for k in range(4)))))


def _on_candidate(ref: DataFrame, regs: DataFrame) -> DataFrame:
    """(keys, box) of reference runs on the candidate's page."""
    routed = registration.with_map(ref.select(*KEYS, "x0", "y0", "x1", "y1"), regs, *g.center(g.box()))
    return routed.select(*KEYS, *(b.alias(c) for b, c in zip(g.mapped_box(g.box(), [F.col(c) for c in g.MATRIX]), ("x0", "y0", "x1", "y1"), strict=True)))


def _looks(inputs: Inputs, cand_tables: DataFrame | None, pages: DataFrame, regs: DataFrame, config: Config) -> DataFrame:
    """Differences of the rendered pages, outside candidate tables. Tables are boxes of the candidate, which the inverse of a page's first map leads to the reference."""
    zoom, maps = config.render_dpi / 72.0, visual.maps_of(regs)
    tiles_ = inputs.tiles.join(pages.select(*KEYS), KEYS, "left_semi")
    ref = tiles_.where("side = 'ref'")
    sizes = ref.groupBy(*KEYS).agg(F.sum(F.when(F.col("ti") == 0, F.col("width"))).cast("int").alias("width"), F.sum(F.when(F.col("tj") == 0, F.col("height"))).cast("int").alias("height"))
    masks = visual.masks(tiles_, maps, inputs.tile, zoom)
    if cand_tables is not None:
        a, b, c, d = (F.col(m) for m in ("m00", "m01", "m10", "m11"))
        det = a * d - b * c
        back = [d / det, -b / det, (b * F.col("m12") - d * F.col("m02")) / det, -c / det, a / det, (c * F.col("m02") - a * F.col("m12")) / det]
        first = maps.groupBy(*KEYS).agg(F.min(F.struct("map_id", *g.MATRIX)).alias("m")).select(*KEYS, *(F.col(f"m.{m}").alias(m) for m in g.MATRIX))
        moved = cand_tables.join(first, KEYS).select(*KEYS, *(v.alias(k) for v, k in zip(g.mapped_box(g.box(), back), ("x0", "y0", "x1", "y1"), strict=True)))
        masks = visual.without_boxes(masks, moved, inputs.tile, zoom)
    found = keep(visual.regions(keep(visual.pieces(masks, sizes, inputs.tile)), inputs.tile, config))
    return visual.visual_differences(found, maps, pages, zoom)


def _tables(words: DataFrame, rulings: DataFrame | None, pages: DataFrame, regs: DataFrame, grids: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(findings, candidate tables): missing tables, and cells that differ. Page sides without a table by header words take ruled ones, if rulings are given."""
    words = keep(words)
    cells, boxes = map(keep, tables.grid(words, config, keep))
    if rulings is not None:
        sized = pages.select(*KEYS, F.lit("cand").alias("side"), "width", "height").unionByName(pages.select(*KEYS, F.lit("ref").alias("side"), F.col("ref_width").alias("width"), F.col("ref_height").alias("height")))
        cells, boxes = map(keep, tables.or_else(cells, boxes, *map(keep, lattice.lattice(rulings, words)), sized))
    side = lambda df, s: df.where(F.col("side") == s).drop("side")
    ref_tables, cand_tables = side(boxes, "ref"), side(boxes, "cand")
    expected = keep(_expected(ref_tables, regs, grids, config))
    mx, my = g.center([F.col(f"e{k}") for k in range(4)])
    pairs = keep(tables.paired(expected.withColumn("mx", mx).withColumn("my", my), cand_tables))
    lost = expected.join(pairs.where("cand_id is null").select(*KEYS, "table_id"), [*KEYS, "table_id"])
    missing = lost.select(*defects.finding("missing_annotation", 1.0, zone=F.col("zone"), ref_text=F.lit(defects.TABLE_TEXT), ref_box=defects.box_array(g.box()), cand_box=F.array(*(f"e{k}" for k in range(4)))))
    columns = keep(tables.matched_columns(side(cells, "ref"), side(cells, "cand"), pairs, config))
    diffs = tables.cell_differences(side(cells, "ref"), side(cells, "cand"), columns, config)
    shape = lambda df, p, idx: df.select(*KEYS, F.col("table_id").alias(idx), *(F.col(c).alias(f"{p}{k}") for k, c in enumerate(("x0", "y0", "x1", "y1"))), F.col("n_rows").alias(f"{p}_rows"), F.col("n_cols").alias(f"{p}_cols"))
    rows = diffs.join(shape(ref_tables, "r", "table_id"), [*KEYS, "table_id"]).join(shape(cand_tables, "c", "cand_id"), [*KEYS, "cand_id"])
    whole = F.col("kind") == "missing_row"
    boxed = {}
    for p, col in (("r", F.col("col")), ("c", F.col("cand_col"))):
        b = [F.col(f"{p}{k}") for k in range(4)]
        boxed[p] = [F.when(whole, old).otherwise(new) for old, new in zip(b, tables.cell_box(b, F.col("row"), col, F.col(f"{p}_rows"), F.col(f"{p}_cols")), strict=True)]
    rows = rows.select("*", *(v.alias(f"{p}b{k}") for p in "rc" for k, v in enumerate(boxed[p])))
    zoned = zones.with_zone(rows, grids, *g.center([F.col(f"cb{k}") for k in range(4)]), config)
    cell = zoned.select(*defects.finding("", 0.9, zone=F.col("zone"), ref_text=F.col("ref_value"), cand_text=F.when((F.col("cand_value") != "") & ~whole, F.col("cand_value")), ref_box=F.array(*(f"rb{k}" for k in range(4))), cand_box=F.array(*(f"cb{k}" for k in range(4)))), F.when(F.col("kind") == "changed", "font_glyph_corruption").otherwise("missing_text").alias("_class"))
    return missing.unionByName(cell.withColumn("class", F.col("_class")).drop("_class")), cand_tables


def _geometry(cand: DataFrame, drawing: DataFrame, pages: DataFrame, cand_tables: DataFrame | None, grids: DataFrame, config: Config) -> DataFrame:
    """Texts over drawn lines, outside the title block, the margin and tables."""
    x, y = g.center(g.box())
    rows = zones.with_zone(cand, grids, x, y, config).where((F.length(F.trim("text")) > 1) & ~F.col("zone").eqNullSafe("title-block") & ~defects.in_margin(x, y))
    if cand_tables is not None:
        boxes = cand_tables.select(*(F.col(k).alias(f"_{k}") for k in KEYS), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
        rows = rows.join(boxes, (rows["pair_id"] == boxes["_pair_id"]) & (rows["page"] == boxes["_page"]) & (g.overlap(g.box(), g.box("_")) > 0.5), "left_anti")
    found = rows.join(raster.over_geometry(rows, drawing, pages), [*KEYS, "run_idx"])
    text = F.concat(F.lit("Text '"), F.col("text"), F.lit("' overlaps drawing geometry"))
    return found.select(*defects.finding("text_overlap", 0.8, zone=F.col("zone"), cand_text=text, cand_box=defects.box_array(g.box())))
