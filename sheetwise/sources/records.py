"""Sources in the shape that extractors leave: nested page documents, drawing items, files, and PDF files where a parser is installed."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

KEYS = ["pair_id", "page"]


def read_documents(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Nested page documents in any format that Spark reads."""
    return spark.read.format(kind).load(path)


def read_files(spark: SparkSession, path: str, side: str) -> DataFrame:
    """An upload folder as the job layer wants it: side, path, upload_seq, bytes, content."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.lit(side).alias("side"), "path", F.xxhash64("path").alias("upload_seq"), F.col("length").alias("bytes"), "content")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, document) of PDF files, through PyMuPDF on the executors; it isn't needed for anything else."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF; use already extracted documents") from e

    def run(batches):
        import json

        import fitz
        import pandas as pd

        for frame in batches:
            rows = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    rows += [(p, i + 1, json.dumps(page.get_text("rawdict"), default=str)) for i, page in enumerate(doc)]
            yield pd.DataFrame(rows, columns=["path", "page", "document"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, document string")


def _parts(rows: Column, *names: str) -> Column:
    """rows (an array of structs in order) as an array of arrays: cut where one of the named fields changes. rows is a column or a variable, as it is read often."""
    differs = lambda i, j: ~reduce(and_, (F.get(rows, i)[n].eqNullSafe(F.get(rows, j)[n]) for n in names))
    places = F.sequence(F.lit(1), F.size(rows))
    begins = F.filter(places, lambda i: (i == 1) | differs(i - 1, i - 2))
    ends = F.filter(places, lambda i: (i == F.size(rows)) | differs(i - 1, i))
    return F.zip_with(begins, ends, lambda b, e: F.slice(rows, b, e - b + 1))


def _gathered(runs_: DataFrame, *columns: Column | str) -> DataFrame:
    """(keys, r): the runs of a page in one array in the order of the columns. Documents are made of it without a further shuffle or sort, so none of them carries characters."""
    return runs_.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("r"))


def nested(runs: DataFrame) -> DataFrame:
    """(keys, blocks) from runs: blocks of lines of spans of characters, as text extractors give them."""
    number = lambda rows, name: F.get(rows, F.lit(0))[name].alias("number")
    span = lambda r: F.struct(r["at"].alias("at"), F.transform(F.split(r["text"], ""), lambda c: F.struct(c.alias("c"))).alias("chars"), F.array(*(r[c] for c in ("x0", "y0", "x1", "y1"))).alias("bbox"))
    line = lambda rows: F.struct(number(rows, "line"), F.transform(rows, span).alias("spans"))
    block = lambda rows: F.struct(number(rows, "block"), F.lit(0).alias("type"), F.transform(_parts(rows, "line"), line).alias("lines"))
    flat = _gathered(runs, "block", "line", F.col("run_idx").alias("at"), "text", "x0", "y0", "x1", "y1")
    return flat.select(*KEYS, F.transform(_parts(F.col("r"), "block"), block).alias("blocks"))


def runs(documents: DataFrame) -> DataFrame:
    """(keys, block, line, text, box, run_idx) of text spans of nested documents: characters joined, outer white space cut, empty ones left out."""
    blocks = documents.select(*KEYS, F.explode("blocks").alias("b")).where("b.type = 0")
    lines = blocks.select(*KEYS, F.col("b.number").alias("block"), F.explode("b.lines").alias("l"))
    spans = lines.select(*KEYS, "block", F.col("l.number").alias("line"), F.posexplode("l.spans").alias("k", "s"))
    text = F.regexp_replace(F.array_join(F.transform("s.chars", lambda c: c["c"]), ""), r"(?U)^\s+|\s+$", "")
    box = [F.get("s.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return spans.select(*KEYS, "block", "line", text.alias("text"), *box, F.col("s.at").alias("run_idx")).where("text <> ''")


#: Characters that part words (fixed values: white space, and spaces of fixed width).
BLANKS = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def character_documents(runs_: DataFrame, dropped: Column | bool = False) -> DataFrame:
    """(keys, blocks) from runs, with a box for each character (an equal share of the run's) and a direction for each line. A run is two spans, cut after its fifth character; where ``dropped`` holds, blanks are given by their gaps only."""
    share = (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), F.length("text"))
    flat = _gathered(runs_, "block", "line", "dir_x", "dir_y", "run_idx", "text", "x0", "y0", "y1", share.alias("share"), (F.lit(dropped) if isinstance(dropped, bool) else dropped).alias("dropped"))
    box = lambda r, i: F.array(r["x0"] + i * r["share"], r["y0"], r["x0"] + (i + 1) * r["share"], r["y1"])
    chars = lambda r: F.filter(F.transform(F.split(r["text"], ""), lambda c, i: F.struct(c.alias("c"), box(r, i).alias("bbox"))), lambda c: ~r["dropped"] | (c["c"] != " "))
    spans = lambda c: F.array(F.struct(F.slice(c, 1, 5).alias("chars")), F.struct(F.slice(c, 6, 1 << 20).alias("chars")))
    first = lambda rows, name: F.get(rows, F.lit(0))[name]
    line = lambda rows: F.struct(first(rows, "line").alias("number"), F.array(first(rows, "dir_x"), first(rows, "dir_y")).alias("dir"), F.flatten(F.transform(F.transform(rows, chars), spans)).alias("spans"))
    block = lambda rows: F.struct(first(rows, "block").alias("number"), F.lit(0).alias("type"), F.transform(_parts(rows, "line", "dir_x", "dir_y"), line).alias("lines"))
    return flat.select(*KEYS, F.transform(_parts(F.col("r"), "block"), block).alias("blocks"))


def words(documents: DataFrame, pages: DataFrame | None = None, gap: float = 0.2) -> DataFrame:
    """(keys, block, line, word, text, box): words of nested documents (lines with dir, spans of characters with boxes), numbered within a line. Spans of a line go on from one to the next; words end at blanks, and where the next character
    is further along the line than ``gap`` of its size. pages: keys and the map to the visible orientation, by which boxes and directions are turned first.

    A line's characters stay in one array: nothing is exploded but words, and nothing is shuffled but for the maps."""
    blocks = documents.select(*KEYS, F.explode("blocks").alias("b")).where("b.type = 0")
    lines = blocks.select(*KEYS, F.col("b.number").alias("block"), F.explode("b.lines").alias("l"))
    rows = lines.select(*KEYS, "block", F.col("l.number").alias("line"), F.get("l.dir", F.lit(0)).alias("dx"), F.get("l.dir", F.lit(1)).alias("dy"), F.flatten(F.transform("l.spans", lambda s: s["chars"])).alias("chars"))
    corner = lambda c, k: F.get(c["bbox"], F.lit(k))
    placed = lambda c, b: F.struct(c["c"].alias("c"), *(v.alias(n) for v, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)))
    if pages is None:
        rows = rows.withColumn("a", F.transform("chars", lambda c: placed(c, [corner(c, k) for k in range(4)])))
    else:
        m = [F.col(c) for c in g.MATRIX]
        rows = rows.join(pages.select(*KEYS, *g.MATRIX).hint("shuffle_hash"), KEYS)  # a row for each page is hashed; characters are not sorted
        dx, dy = g.turned(F.col("dx"), F.col("dy"), m)
        rows = rows.withColumns({"a": F.transform("chars", lambda c: placed(c, g.mapped_box([corner(c, k) for k in range(4)], m))), "dx": dx, "dy": dy})
    level = F.abs(F.col("dx")) >= F.abs(F.col("dy"))
    low = lambda c: F.when(level, F.when(F.col("dx") >= 0, c["x0"]).otherwise(-c["x1"])).otherwise(F.when(F.col("dy") >= 0, c["y0"]).otherwise(-c["y1"]))
    high = lambda c: F.when(level, F.when(F.col("dx") >= 0, c["x1"]).otherwise(-c["x0"])).otherwise(F.when(F.col("dy") >= 0, c["y1"]).otherwise(-c["y0"]))
    size = lambda c: F.when(level, c["y1"] - c["y0"]).otherwise(c["x1"] - c["x0"])
    # What a character begins or goes on is told once: 0 for a blank, 1 for the first of a word, 2 for any other.
    ink = lambda c: ~F.contains(F.lit(BLANKS), c["c"])
    joined = lambda before, c: ink(before) & (low(c) - high(before) <= gap * size(c))
    rows = rows.withColumn("_k", F.transform("a", lambda c, i: F.when(~F.coalesce(ink(c), F.lit(False)), 0).when((i > 0) & F.coalesce(joined(F.get("a", i - 1), c), F.lit(False)), 2).otherwise(1)))
    places = F.when(F.size("a") > 0, F.sequence(F.lit(1), F.size("a"))).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: F.get("_k", i - 1) == 1)
    ends = F.filter(places, lambda i: (F.get("_k", i - 1) > 0) & (F.coalesce(F.get("_k", i), F.lit(0)) < 2))
    found = rows.withColumns({"_b": begins, "_e": ends}).select(*KEYS, "block", "line", F.posexplode(F.zip_with("_b", "_e", lambda b, e: F.slice("a", b, e - b + 1))).alias("word", "w"))
    edge = lambda f, n: f(F.transform("w", lambda c: c[n]))
    return found.select(*KEYS, "block", "line", "word", F.array_join(F.transform("w", lambda c: c["c"]), "").alias("text"), edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1"))


def in_order(words_: DataFrame) -> DataFrame:
    """words with ``word_idx``: their order on the page side, by block, line and word."""
    keys = [*KEYS, *(["side"] if "side" in words_.columns else [])]
    return words_.withColumn("word_idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("block", "line", "word")) - 1).cast("int"))


def rotated(runs_: DataFrame, pages: DataFrame) -> DataFrame:
    """runs with box and direction (dir_x, dir_y) turned to the visible orientation. pages: keys and the six columns of the rotation map."""
    m = [F.col(c) for c in g.MATRIX]
    box = g.mapped_box(g.box(), m)
    dx, dy = g.turned(F.col("dir_x"), F.col("dir_y"), m)
    out = runs_.join(pages.select(*KEYS, *g.MATRIX), KEYS)
    turned = {**dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)), "dir_x": dx, "dir_y": dy}
    return out.select(*(turned[c].alias(c) if c in turned else F.col(c) for c in runs_.columns))


def drawings(segments_: DataFrame) -> DataFrame:
    """Drawing items (keys, item, kind, pts) from segments: a line each, a rectangle over every third, a curve over every fifth."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = F.array(point("ax", "ay"), point("bx", "by"))
    kinds = F.array_compact(F.array(F.lit("l"), F.when(F.col("seg_idx") % 3 == 0, "re"), F.when(F.col("seg_idx") % 5 == 0, "c")))
    return segments_.select(*KEYS, F.col("seg_idx").alias("item"), ends.alias("pts"), F.explode(kinds).alias("kind"))


def segments(items: DataFrame) -> DataFrame:
    """(keys, item, edge, ax, ay, bx, by): a line is one segment, a rectangle four; curves and quads give none."""
    a, b = F.get("pts", F.lit(0)), F.get("pts", F.lit(1))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = [corner(a["x"], a["y"]), corner(b["x"], a["y"]), corner(b["x"], b["y"]), corner(a["x"], b["y"])]
    edges = F.when(F.col("kind") == "l", F.array(F.struct(a.alias("p"), b.alias("q")))).when(F.col("kind") == "re", F.array(*(F.struct(corners[k].alias("p"), corners[(k + 1) % 4].alias("q")) for k in range(4))))
    rows = items.select(*KEYS, "item", "kind", F.posexplode(edges).alias("edge", "s"))
    return rows.select(*KEYS, "item", "kind", "edge", F.col("s.p.x").alias("ax"), F.col("s.p.y").alias("ay"), F.col("s.q.x").alias("bx"), F.col("s.q.y").alias("by"))
