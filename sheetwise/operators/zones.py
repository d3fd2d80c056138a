"""Zones of the drawing border: labels, equal cells between the bands, and the zone of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as g

KEYS = ["pair_id", "page"]


def labels(runs: DataFrame, pages: DataFrame, config: Config) -> DataFrame:
    """(keys, axis, label, center): numbers in the top or bottom band head columns, single letters in the left or right band head rows; cells are equally wide, in the order of the labels' medians."""
    band = config.zone.margin_band_frac
    w, h = F.col("width"), F.col("height")
    x, y = g.center(g.box())
    flat = (y < h * band) | (y > h * (1 - band))
    side = (x < w * band) | (x > w * (1 - band))
    number = flat & ~side & F.col("text").rlike(r"(?U)^\d{1,3}$")  # places first, they cost least
    letter = side & ~flat & F.col("text").rlike(r"^[A-Za-z]$")
    seen = runs.join(pages, KEYS).where(number | letter)
    seen = seen.select(*KEYS, "width", "height", "run_idx", F.when(number, "col").otherwise("row").alias("axis"), F.when(number, F.col("text")).otherwise(F.upper("text")).alias("label"), F.when(number, x).otherwise(y).alias("at"))
    found = seen.groupBy(*KEYS, "width", "height", "axis", "label").agg(F.median("at").alias("at"), F.min("run_idx").alias("first"))
    place = F.row_number().over(Window.partitionBy(*KEYS, "axis").orderBy("at", "first")) - 1
    count = F.count("*").over(Window.partitionBy(*KEYS, "axis"))
    size = F.when(F.col("axis") == "col", w).otherwise(h)
    low, high = size * band, size * (1 - band)
    return found.withColumn("place", place).withColumn("n", count).select(*KEYS, "axis", "label", (low + (F.col("place") + 0.5) * ((high - low) / F.col("n"))).alias("center"))


def grids(pages: DataFrame, labels_: DataFrame) -> DataFrame:
    """pages with ``cols`` and ``rows``: arrays of (center, label) in order."""
    of = lambda axis: F.array_sort(F.collect_list(F.when(F.col("axis") == axis, F.struct("center", "label"))))
    found = labels_.groupBy(*KEYS).agg(of("col").alias("cols"), of("row").alias("rows"))
    empty = F.array().cast("array<struct<center:double,label:string>>")
    return pages.join(found, KEYS, "left").withColumn("cols", F.coalesce("cols", empty)).withColumn("rows", F.coalesce("rows", empty))


def zone(x: Column, y: Column, config: Config) -> Column:
    """The zone of a point over columns width, height, cols, rows: title block, border, null without a grid, or the nearest row and column."""
    w, h, band, block = F.col("width"), F.col("height"), config.zone.margin_band_frac, 1 - config.zone.title_block_frac
    nearest = lambda cells, v: F.array_min(F.transform(cells, lambda c, i: F.struct(F.abs(c["center"] - v).alias("d"), i.alias("i"), c["label"].alias("label"))))["label"]
    row, col = nearest(F.col("rows"), y), nearest(F.col("cols"), x)
    return (
        F.when((x > w * block) & (y > h * block), "title-block")
        .when((x < w * band) | (x > w * (1 - band)) | (y < h * band) | (y > h * (1 - band)), "border")
        .when((F.size("cols") >= 2) & (F.size("rows") >= 2), F.concat(row, col) if config.zone.row_first else F.concat(col, row))
    )


def with_zone(df: DataFrame, grids_: DataFrame, x: Column, y: Column, config: Config) -> DataFrame:
    """df with ``zone``, ``width`` and ``height`` of its page."""
    out = df.join(grids_, KEYS).withColumn("zone", zone(x, y, config))
    return out.drop("cols", "rows")
