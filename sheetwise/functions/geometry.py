"""Boxes, points and affine maps as column expressions. A box is four columns x0, y0, x1, y1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = Sequence[Column]
#: Columns of an affine map: x' = m00 x + m01 y + m02, y' = m10 x + m11 y + m12.
MATRIX = ["m00", "m01", "m02", "m10", "m11", "m12"]


def box(prefix: str = "", suffix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")]


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def overlap(a: Box, b: Box) -> Column:
    """Common area over the smaller area; 0 for boxes apart or without area."""
    dx, dy = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    smaller = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when((dx > 0) & (dy > 0) & (smaller > 0), dx * dy / smaller).otherwise(0.0)


def inline_neighbours(a: Box, b: Box) -> Column:
    """Side by side on one line: they share over 0.8 of the lower height and are near. A negative gap is near too."""
    height = F.least(a[3] - a[1], b[3] - b[1])
    shared = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    gap = F.greatest(a[0], b[0]) - F.least(a[2], b[2])
    return (height > 0) & (shared / F.when(height > 0, height) > 0.8) & (gap < F.greatest(F.lit(12.0), height * 1.5))


def distance(x: Column, y: Column, u: Column, v: Column) -> Column:
    return F.sqrt((x - u) * (x - u) + (y - v) * (y - v))


def inside(x: Column, y: Column, b: Box) -> Column:
    """Borders belong to the box."""
    return (b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3])


def mapped(x: Column, y: Column, m: Sequence[Column]) -> tuple[Column, Column]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def mapped_box(b: Box, m: Sequence[Column]) -> list[Column]:
    """The envelope of the four mapped corners."""
    # Sums are rounded in one order, so the extremes of the sums are the sums of the extremes, to the last bit.
    ends = lambda f, k: f(m[k] * b[0], m[k] * b[2]) + f(m[k + 1] * b[1], m[k + 1] * b[3]) + m[k + 2]
    return [ends(F.least, 0), ends(F.least, 3), ends(F.greatest, 0), ends(F.greatest, 3)]


def rotation(m: Sequence[Column]) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(F.degrees(F.atan2(m[3], m[0])) + 180.0, F.lit(360.0)) - 180.0


def valid(m: Sequence[Column]) -> Column:
    finite = F.lit(True)
    for c in m:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return finite & (F.abs(m[0] * m[4] - m[1] * m[3]) >= 1e-6)


def scale_map(ref_w: Column, ref_h: Column, cand_w: Column, cand_h: Column) -> dict[str, Column]:
    """The map that only fits page sizes, for pages with too few anchors."""
    zero = F.lit(0.0)
    return {"m00": cand_w / F.greatest(F.lit(1.0), ref_w), "m01": zero, "m02": zero, "m10": zero, "m11": cand_h / F.greatest(F.lit(1.0), ref_h), "m12": zero}


def turned(x: Column, y: Column, m: Sequence[Column]) -> tuple[Column, Column]:
    """A direction under a map, of length 1; (1, 0) where nothing is left of it."""
    dx, dy = m[0] * x + m[1] * y, m[3] * x + m[4] * y
    length = F.sqrt(dx * dx + dy * dy)
    return F.when(length > 1e-9, dx / F.when(length > 1e-9, length)).otherwise(1.0), F.when(length > 1e-9, dy / F.when(length > 1e-9, length)).otherwise(0.0)


def _span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def close_boxes(boxes: DataFrame, keys: Sequence[str], names: Sequence[str], reach: float, size: float = 192.0) -> DataFrame:
    """Pairs of rows of equal keys whose boxes (x0, y0, x1, y1) are at most ``reach`` apart in either axis: keys, a_<name>, b_<name>. names hold run_idx, of which a has the smaller one.

    Boxes, each wider by half the reach, are put into the squares of a grid that they touch, and rows meet square by square; a pair counts only in the square of the lower corner of what
    its boxes share. So rows far from one another never meet. The rows of a square are gathered, not joined: where boxes are dealt by keys already, nothing is shuffled."""
    x0, y0, x1, y1 = (F.col(c) + d * (reach / 2 + 1e-6) for c, d in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1)))
    placed = boxes.select(*keys, *names, x0.alias("_x"), y0.alias("_y"), x1.alias("_u"), y1.alias("_v"), F.explode(_span(x0, x1, size)).alias("_i"), _span(y0, y1, size).alias("_js")).select("*", F.explode("_js").alias("_j"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    squares = placed.where(known).groupBy(*keys, "_i", "_j").agg(F.collect_list(F.struct("_x", "_y", "_u", "_v", *names)).alias("_l")).where(F.size("_l") > 1)
    one = squares.select(*keys, "_i", "_j", "_l", F.explode("_l").alias("_a"))

    def meets(b: Column) -> Column:
        low = {c: F.greatest(F.col(f"_a.{c}"), b[c]) for c in ("_x", "_y")}
        share = (low["_x"] <= F.least(F.col("_a._u"), b["_u"])) & (low["_y"] <= F.least(F.col("_a._v"), b["_v"]))
        return (F.col("_a.run_idx") < b["run_idx"]) & share & (F.floor(low["_x"] / size) == F.col("_i")) & (F.floor(low["_y"] / size) == F.col("_j"))

    met = one.select(*keys, "_a", F.explode(F.filter("_l", meets)).alias("_b"))
    return met.select(*keys, *(F.col(f"_{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in names))


def meeting(a: DataFrame, b: DataFrame, keys: Sequence[str], size: float = 192.0) -> DataFrame:
    """Pairs of rows of a and b of equal keys whose boxes (a_x0 to a_y1, b_x0 to b_y1) share some area, each pair once; they meet square by square, and the rows of a square are gathered, as in close_boxes."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    mine = {p: [c for c in df.columns if c not in keys] for p, df in (("a", a), ("b", b))}

    def placed(df: DataFrame, p: str) -> DataFrame:
        sound = df.where(known & (F.col(f"{p}_x0") <= F.col(f"{p}_x1")) & (F.col(f"{p}_y0") <= F.col(f"{p}_y1")))
        spans = [_span(F.col(f"{p}_{c}0"), F.col(f"{p}_{c}1"), size) for c in "xy"]
        out = sound.select(*keys, F.struct(*mine[p]).alias(f"_{p}"), F.explode(spans[0]).alias("_i"), spans[1].alias("_js"))
        return out.select(*keys, "_i", F.explode("_js").alias("_j"), f"_{p}")

    both = placed(a, "a").unionByName(placed(b, "b"), allowMissingColumns=True)
    squares = both.groupBy(*keys, "_i", "_j").agg(F.collect_list("_a").alias("_as"), F.collect_list("_b").alias("_bs")).where((F.size("_as") > 0) & (F.size("_bs") > 0))
    one = squares.select(*keys, "_i", "_j", "_bs", F.explode("_as").alias("_a"))

    def meets(v: Column) -> Column:
        low = {c: F.greatest(F.col(f"_a.a_{c}0"), v[f"b_{c}0"]) for c in "xy"}
        share = (low["x"] < F.least(F.col("_a.a_x1"), v["b_x1"])) & (low["y"] < F.least(F.col("_a.a_y1"), v["b_y1"]))
        return share & (F.floor(low["x"] / size) == F.col("_i")) & (F.floor(low["y"] / size) == F.col("_j"))

    met = one.select(*keys, "_a", F.explode(F.filter("_bs", meets)).alias("_b"))
    return met.select(*keys, *(F.col(f"_{p}.{c}").alias(c) for p in "ab" for c in mine[p]))
