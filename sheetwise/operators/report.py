"""Reports: order and ids, audit categories, page and pair scores, counts, and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..session import literal

KEYS = ["pair_id", "page"]
# Classes in the order of reports, categories with their weights, and the words and patterns of categories.
CLASS_ORDER = ["missing_text", "missing_annotation", "text_overlap", "text_misplacement", "font_glyph_corruption", "visual_defect"]
CATEGORY_WEIGHTS = {
    "Drawing Layout": 10,
    "Views & Geometry": 15,
    "Dimensions & Tolerances": 15,
    "Notes & Annotations": 10,
    "Title Block": 10,
    "Revision History": 5,
    "BOM / Tables": 10,
    "Symbols & Standards": 5,
    "Styling & Layers": 5,
    "Scale & Proportion": 5,
    "Visual Quality": 5,
    "Conversion Integrity": 3,
    "Compliance Rules": 2,
}
TITLE_WORDS = ["MATERIAL", "WEIGHT", "SCALE", "UNIT", "DRAWN", "CHECKED", "APPROVED", "FINISH", "COATING", "PART NO", "ASSY", "SIZE", "TITLE", "DWG"]
TABLE_WORDS = ["QTY", "PART NUMBER", "DESCRIPTION", "ITEM", "FERRULE", "HOSE", "WELDED PIPE", "ACTUATOR", "LIST"]
REVISION_WORDS = ["REV", "REVISION", "ZONE", "DATE", "HISTORY"]
SYMBOLS = r"[Øø⌀φф°±¼½¾]|\bDIA\b|\bDEG\b|\bRAD\b|GD&T|\bSYMBOL\b"
DIMENSIONS = r"(\d+/\d+|\d+\.\d+|\b\d+\b|±|ø|DIA|MM|INCH|DEG|RAD|°|UNITS)"
CLASS_COLORS = {"missing_text": (239, 68, 68), "missing_annotation": (217, 70, 239), "text_overlap": (249, 115, 22), "text_misplacement": (59, 130, 246), "font_glyph_corruption": (245, 158, 11), "visual_defect": (220, 38, 38)}


def _at(b: str, k: int) -> Column:
    return F.get(b, F.lit(k))


def _place(k: int) -> Column:
    return F.coalesce(_at("cand_box", k), _at("ref_box", k), F.lit(0.0))


def told() -> Column:
    """What a record says, in capitals: message and texts."""
    return F.upper(F.concat_ws(" ", F.coalesce("message", F.lit("")), F.coalesce("ref_text", F.lit("")), F.coalesce("cand_text", F.lit(""))))


def category(page_width: Column, page_height: Column, text: Column | None = None) -> Column:
    """The audit category of a record, by class, zone, place on the page, and words of message and texts. text: a column that holds told(), which is read many times."""
    text = told() if text is None else text
    w, h = F.greatest(F.lit(1.0), page_width), F.greatest(F.lit(1.0), page_height)
    x0, y0, x1, y1 = (_place(k) for k in range(4))
    symbols, dimensions = text.rlike("(?U)" + SYMBOLS), text.rlike("(?U)" + DIMENSIONS) | contains_any(text, ["DIMENSION", "TOLERANCE"])
    title = F.col("zone").eqNullSafe("title-block")
    cx, cy = (x0 + x1) / 2 / w, (y0 + y1) / 2 / h
    edge = (cx < 0.06) | (cx > 0.94) | (cy < 0.06) | (cy > 0.94)
    words = F.size(F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda v: v.rlike(r"^\p{L}+$")))
    is_ = lambda c: F.col("class") == c
    return (
        F.when(is_("added_text"), F.when(title, "Title Block").when(symbols | dimensions, "Dimensions & Tolerances").otherwise("Notes & Annotations"))
        .when(is_("text_overlap"), "Visual Quality")
        .when(is_("font_glyph_corruption"), F.when(symbols, "Symbols & Standards").otherwise("Conversion Integrity"))
        .when(is_("visual_defect"), F.when(title, "Title Block").when(edge, "Drawing Layout").otherwise("Views & Geometry"))
        .when(title, "Title Block")
        .when((x0 / w > 0.7) & (y1 / h < 0.35) & contains_any(text, REVISION_WORDS), "Revision History")
        .when((x0 / w > 0.65) & (y0 / h > 0.65) & contains_any(text, TITLE_WORDS), "Title Block")
        .when(((x0 / w > 0.6) | contains_any(text, ["BOM", "TABLE"])) & contains_any(text, TABLE_WORDS), "BOM / Tables")
        .when(dimensions, "Dimensions & Tolerances")
        .when(is_("missing_annotation") | contains_any(text, ["NOTE", "BALLOON", "CALLOUT"]) | (words > 1), "Notes & Annotations")
        .otherwise("Visual Quality")
    )


def categorised(records: DataFrame, pages: DataFrame) -> DataFrame:
    """records with ``category``. pages: keys, width, height."""
    return records.join(pages, KEYS).withColumn("_told", told()).withColumn("category", category(F.col("width"), F.col("height"), F.col("_told"))).drop("width", "height", "_told")


def numbered(records: DataFrame) -> DataFrame:
    """records with ``id`` in the report's order: page, place from the top and the left, class, text. A pair is one person's report; ids run within it."""
    rank = F.coalesce(*(F.when(F.col("class") == c, i) for i, c in enumerate(CLASS_ORDER)), F.lit(99))
    text = F.when(F.coalesce("cand_text", F.lit("")) != "", F.col("cand_text")).otherwise(F.coalesce("ref_text", F.lit("")))
    order = Window.partitionBy("pair_id", "page").orderBy(F.bround(_place(1), 1), F.bround(_place(0), 1), rank, text)
    boxes = [F.transform(b, lambda v: F.bround(v, 2)).alias(b) for b in ("ref_box", "cand_box")]
    # Ranks within the page, and a row for each page with the findings of the pages before it.
    before = Window.partitionBy("_pair").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    pages = records.groupBy(F.col("pair_id").alias("_pair"), F.col("page").alias("_page")).agg(F.count("*").alias("_n"))
    pages = pages.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = records.withColumn("_rank", F.row_number().over(order)).join(pages, F.col("pair_id").eqNullSafe(F.col("_pair")) & F.col("page").eqNullSafe(F.col("_page")))
    return ranked.withColumn("id", F.format_string("D-%03d", F.col("_before") + F.col("_rank"))).select("id", *(c for c in records.columns if c not in ("ref_box", "cand_box")), *boxes)


def weights(spark: SparkSession) -> DataFrame:
    return literal(spark, ["category", "weight"], CATEGORY_WEIGHTS.items())


def page_scores(categorised_: DataFrame, pages: DataFrame) -> DataFrame:
    """(keys, score): 100 less the weights of the categories that fail on the page, 0 at least."""
    lost = categorised_.select(*KEYS, "category").distinct().join(F.broadcast(weights(pages.sparkSession)), "category", "left").groupBy(*KEYS).agg(F.sum("weight").alias("lost"))
    return pages.select(*KEYS).join(lost, KEYS, "left").select(*KEYS, F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).cast("long").alias("score"))


def pair_scores(page_scores_: DataFrame) -> DataFrame:
    """(pair_id, quality_score): the mean of the pages, halves to the even number."""
    return page_scores_.groupBy("pair_id").agg(F.bround(F.avg("score"), 0).cast("long").alias("quality_score"))


def counts_by_class(records: DataFrame) -> DataFrame:
    """(class, n): classes of reports have a row each, others if they occur."""
    known = literal(records.sparkSession, ["class"], [(c,) for c in CLASS_ORDER])
    return records.groupBy("class").agg(F.count("*").alias("n")).join(F.broadcast(known), "class", "full_outer").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counts_by_status(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("status") == "defect").alias("defect"), F.count_if(F.col("status") == "review").alias("review"))


def severity_counts(records: DataFrame) -> DataFrame:
    return records.agg(*(F.count_if(F.lower("severity") == s).alias(s) for s in ("high", "medium", "low")))


def category_matrix(categorised_: DataFrame) -> DataFrame:
    """(category, failed_pages, status, justification) for each category."""
    spark = categorised_.sparkSession
    failed = categorised_.groupBy("category").agg(F.count_distinct(*KEYS).alias("n"))
    out = weights(spark).select("category").join(failed, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("failed_pages"))
    status = F.when(F.col("failed_pages") > 0, "FAIL").otherwise("PASS")
    return out.withColumn("status", status).withColumn("justification", F.when(F.col("failed_pages") > 0, F.concat(F.lit("FAIL: Discrepancies found on "), F.col("failed_pages").cast("string"), F.lit(" page(s)."))).otherwise("PASS: No discrepancies detected."))


def page_summaries(categorised_: DataFrame, pages: DataFrame) -> DataFrame:
    """(keys, n_issues, status, summary) for each page."""
    names = list(CATEGORY_WEIGHTS)
    found = categorised_.groupBy(*KEYS).agg(F.count("*").alias("n"), F.collect_set("category").alias("set"))
    failed = F.array_join(F.filter(F.array(*(F.lit(c) for c in names)), lambda c: F.array_contains("set", c)), ", ")
    out = pages.select(*KEYS).join(found, KEYS, "left").withColumn("n_issues", F.coalesce("n", F.lit(0)).cast("long"))
    noun = F.when(F.col("n_issues") == 1, "discrepancy").otherwise("discrepancies")
    page = F.concat(F.lit("Page "), F.col("page").cast("string"))
    text = F.when(F.col("n_issues") > 0, F.concat(page, F.lit(" has "), F.col("n_issues").cast("string"), F.lit(" identified "), noun, F.lit(". Failed categories: "), failed, F.lit("."))).otherwise(F.concat(page, F.lit(" matches the reference drawing in all audit categories.")))
    return out.select(*KEYS, "n_issues", F.when(F.col("n_issues") > 0, "FAIL").otherwise("PASS").alias("status"), text.alias("summary"))


def report_json(numbered_: DataFrame, scores: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """(pair_id, json): one report document for each pair. scores: pair_scores(); told: what else the head of a pair's report says (pair_id, and for instance reference, candidate, generated_at, pages_compared)."""
    fields = ["id", "page", "zone", "class", "severity", "confidence", "status", "ref_text", "cand_text", "ref_box", "cand_box", "score", "cause", "fix", "message"]
    docs = numbered_.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(F.length("id").alias("_l"), *fields))).alias("defects"))
    tally = lambda column: numbered_.groupBy("pair_id", column).agg(F.count("*").alias("n")).groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias(f"_{column}"))
    both = scores.join(docs, "pair_id", "left").join(tally("class"), "pair_id", "left").join(tally("status"), "pair_id", "left")
    head = []
    if told is not None:
        both = both.join(told, "pair_id", "left")
        head = [c for c in told.columns if c != "pair_id"]
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))

    def counts(column: str, known: list[str]) -> Column:
        """Known values with 0 where none occurs, then others in the order of names."""
        found = F.coalesce(F.col(column), none)
        rest = F.map_filter(found, lambda k, _: ~k.isin(known))
        first = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*(F.coalesce(F.element_at(found, F.lit(k)), F.lit(0).cast("long")) for k in known)))
        return F.map_concat(first, F.map_from_entries(F.array_sort(F.map_entries(rest))))

    meta = F.struct(*head, "quality_score", F.coalesce(F.size("defects"), F.lit(0)).alias("total_defects"), counts("_class", CLASS_ORDER).alias("counts_by_class"), counts("_status", ["defect", "review"]).alias("counts_by_status"))
    plain = F.transform("defects", lambda d: F.struct(*(d[c].alias(c) for c in fields)))
    return both.select("pair_id", F.to_json(F.struct(meta.alias("meta"), F.coalesce(plain, F.array()).alias("defects")), {"ignoreNullFields": "false"}).alias("json"))


def box_layer(records: DataFrame) -> DataFrame:
    """(keys, class, color, box): what an annotated page picture draws; candidate boxes, in the class's colour or grey."""
    color = F.coalesce(*(F.when(F.col("class") == c, F.lit("#%02x%02x%02x" % rgb)) for c, rgb in CLASS_COLORS.items()), F.lit("#808080"))
    return records.where("cand_box is not null").select(*KEYS, "class", color.alias("color"), F.col("cand_box").alias("box"))


