"""Defect records: detectors' findings get severity, texts, status and message from one place, and are filtered.

A finding has: keys, class, confidence, zone, ref_text, cand_text, ref_box and cand_box (arrays of four doubles, or null), score, rotation (degrees, or null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as g
from ..functions.text import fill
from ..session import literal
from .zones import with_zone

KEYS = ["pair_id", "page"]
FINDING = [*KEYS, "class", "confidence", "zone", "ref_text", "cand_text", "ref_box", "cand_box", "score", "rotation"]
NO_ZONE = "—"
TABLE_TEXT = "BOM / Table Structure"
# Messages by class, before the zone.
MESSAGES = {
    "added_text": "Extra text '{cand_text}' added in candidate",
    "missing_text": "Text '{ref_text}' missing in candidate",
    "missing_annotation": "Annotation '{ref_text}' missing in candidate",
    "text_overlap": "Overlapping candidate text '{cand_text}'",
    "text_misplacement": "Text '{ref_text}' misplaced",
    "font_glyph_corruption": "Text '{ref_text}' renders as '{cand_text}'",
    "visual_defect": "Visual discrepancy detected in candidate drawing",
}


def finding(kind: str, confidence: Column | float, **columns: Column) -> list[Column]:
    """The columns of a finding; what isn't given is null."""
    types = {"zone": "string", "ref_text": "string", "cand_text": "string", "ref_box": "array<double>", "cand_box": "array<double>", "score": "double", "rotation": "double"}
    rest = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return [*(F.col(k) for k in KEYS), F.lit(kind).alias("class"), (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"), *rest]


def box_array(b: list[Column]) -> Column:
    return F.array(*(c.cast("double") for c in b))


def templates(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(c, t.get("severity", "medium"), t.get("cause", ""), t.get("fix", ""), MESSAGES.get(c, c)) for c, t in {**{k: {} for k in MESSAGES}, **config.templates}.items()]
    return literal(spark, ["class", "severity", "cause", "fix", "message"], rows)


def records(findings: DataFrame, config: Config) -> DataFrame:
    """Findings with severity, status, cause, fix and message, numbers rounded. One row of templates for each class is sent to every task."""
    out = findings.join(F.broadcast(templates(findings.sparkSession, config)), "class", "left")
    slots = {"ref_text": F.coalesce("ref_text", F.lit("")), "cand_text": F.coalesce("cand_text", F.lit("")), "zone": F.coalesce("zone", F.lit(NO_ZONE))}
    where = F.when(slots["zone"] != NO_ZONE, F.concat(F.lit(" (zone "), slots["zone"], F.lit(")"))).otherwise("")
    turn = F.when(F.abs("rotation") > 1.0, F.concat(F.lit(" (view rotated "), F.format_string("%.1f", F.abs("rotation")), F.lit("° "), F.when(F.col("rotation") > 0, "clockwise").otherwise("counterclockwise"), F.lit(")"))).otherwise("")
    message = F.concat(fill(F.coalesce("message", "class"), slots), where, F.lit("."), turn)
    return out.select(
        *KEYS, "class", F.coalesce("severity", F.lit("medium")).alias("severity"), F.bround("confidence", 3).alias("confidence"), F.when(F.col("confidence") >= config.confidence_threshold, "defect").otherwise("review").alias("status"),
        "zone", "ref_text", "cand_text", "ref_box", "cand_box", F.bround("score", 3).alias("score"), fill(F.coalesce("cause", F.lit("")), slots).alias("cause"), fill(F.coalesce("fix", F.lit("")), slots).alias("fix"), message.alias("message"),
    )


def in_margin(x: Column, y: Column, band: float = 0.06) -> Column:
    """Within the outer 6 % of the page; over columns width and height."""
    w, h = F.col("width"), F.col("height")
    return (x < w * band) | (x > w * (1 - band)) | (y < h * band) | (y > h * (1 - band))


def overlapping(cand: DataFrame, config: Config) -> DataFrame:
    """(keys, ratio, text, box) of two runs of different blocks whose boxes share over the limit of the smaller one. cand: run_idx, block, text, box."""
    names = ["run_idx", "block", "text", "x0", "y0", "x1", "y1"]
    p, q = g.box("a_"), g.box("b_")
    pairs = g.close_boxes(cand, KEYS, names, 0.0).where(F.col("a_block") != F.col("b_block"))
    pairs = pairs.where((F.least(p[2], q[2]) > F.greatest(p[0], q[0])) & (F.least(p[3], q[3]) > F.greatest(p[1], q[1]))).where(~g.inline_neighbours(p, q))
    pairs = pairs.withColumn("ratio", g.overlap(p, q)).where(F.col("ratio") > config.overlap_ratio_threshold)
    return pairs.select(*KEYS, "ratio", F.concat("a_text", F.lit(" / "), "b_text").alias("text"), *(f(x, y).alias(c) for f, x, y, c in zip((F.least, F.least, F.greatest, F.greatest), p, q, ("x0", "y0", "x1", "y1"), strict=True)))


def overlap_confidence(ratio: Column, config: Config) -> Column:
    return g.clamp(ratio / (2 * max(config.overlap_ratio_threshold, 1e-6)))


def overlaps(cand: DataFrame, grids: DataFrame, config: Config) -> DataFrame:
    """Findings of overlapping()."""
    zoned = with_zone(overlapping(cand, config), grids, *g.center(g.box()), config)
    return zoned.select(*finding("text_overlap", overlap_confidence(F.col("ratio"), config), zone=F.col("zone"), cand_text=F.col("text"), cand_box=box_array(g.box())))


def counts_as_added() -> Column:
    """Of an unmatched candidate run with its zone: it has over one character and is outside the title block and the margin."""
    return (F.length(F.trim("text")) > 1) & ~F.col("zone").eqNullSafe("title-block") & ~in_margin(*g.center(g.box()))


def added(cand: DataFrame, grids: DataFrame, config: Config) -> DataFrame:
    """Findings: unmatched candidate runs that count as added."""
    zoned = with_zone(cand, grids, *g.center(g.box()), config).where(counts_as_added())
    return zoned.select(*finding("added_text", 1.0, zone=F.col("zone"), cand_text=F.col("text"), cand_box=box_array(g.box())))


def missing_groups(ref: DataFrame, clusters: DataFrame, least_costs: DataFrame, config: Config) -> DataFrame:
    """(keys, class, text, box, confidence) of unmatched reference runs: several of a cluster are one annotation. ref: run_idx, text, box."""
    rows = ref.join(clusters, [*KEYS, "run_idx"]).join(least_costs.withColumnRenamed("ref_idx", "run_idx"), [*KEYS, "run_idx"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "run_idx", "text"))), lambda r: r["text"]), " ")
    cost = F.min(F.coalesce("min_cost", F.lit(config.match_max_cost)))
    found = rows.groupBy(*KEYS, "cluster").agg(F.count("*").alias("n"), text.alias("text"), cost.alias("cost"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return found.select(*KEYS, "cluster", F.when(F.col("n") > 1, "missing_annotation").otherwise("missing_text").alias("class"), "text", "x0", "y0", "x1", "y1", g.clamp(F.col("cost") / (2 * max(config.match_max_cost, 1e-6))).alias("confidence"))


def without_border(findings: DataFrame) -> DataFrame:
    """A finding without a zone stays."""
    return findings.where(~F.col("zone").eqNullSafe("border"))


def _center(b: str) -> tuple[Column, Column]:
    at = lambda k: F.get(b, F.lit(k))
    return (at(0) + at(2)) / 2, (at(1) + at(3)) / 2


def without_tables(findings: DataFrame, tables: DataFrame) -> DataFrame:
    """Drop findings whose candidate centre is in a candidate table of the page, but for missing table structures. tables: keys, box."""
    x, y = _center("cand_box")
    exempt = F.col("ref_text").eqNullSafe(TABLE_TEXT) | ((F.col("class") == "missing_annotation") & F.coalesce(F.contains("ref_text", F.lit("BOM")), F.lit(False)))
    boxes = tables.select(*(F.col(k).alias(f"_{k}") for k in KEYS), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    on = (findings["pair_id"] == boxes["_pair_id"]) & (findings["page"] == boxes["_page"]) & g.inside(x, y, g.box("_")) & ~exempt
    return findings.join(boxes, on, "left_anti")


def without_regions(findings: DataFrame, config: Config) -> DataFrame:
    """Drop findings whose candidate centre is in a region to ignore; those without a candidate box stay. Regions are a few literals of the plan."""
    x, y = _center("cand_box")
    hit = F.lit(False)
    for r in config.ignore_regions:
        hit = hit | g.inside(x, y, [F.lit(float(v)) for v in r])
    return findings.where(F.col("cand_box").isNull() | ~hit)
