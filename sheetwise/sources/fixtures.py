"""Drawing pages derived from the star-schema tables by arithmetic: text runs, segments, words, pages, jobs, rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["pair_id", "page"]
WIDTH, HEIGHT = 800.0, 600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair_of(page: Column) -> Column:
    """Every third page belongs to the pair B, the others to A."""
    return F.when(page % 3 == 0, "B").otherwise("A").alias("pair_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"))
    lines = lines.agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.floor(F.min("l_quantity")).cast("long").alias("qty"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_name", "p_type")
    text = (
        F.when(F.col("ln") % 4 == 0, F.concat_ws(" ", "p_name", "p_type"))
        .when(F.col("ln") % 4 == 1, F.concat(F.lit("DIA "), F.col("qty").cast("string"), F.lit(".50")))
        .when(F.col("ln") % 4 == 2, F.concat(F.col("qty").cast("string"), F.lit(".00 +/- 0."), F.col("ln").cast("string")))
        .otherwise(F.concat(F.lit("NOTE "), F.col("ok").cast("string"), F.lit(" "), F.col("p_type")))
    )
    out = lines.join(part.hint("merge"), "pk").withColumn("text", text)
    return out.select("ok", "ln", "text", (60 + (37 * F.col("pk") + 101 * F.col("ln")) % 640).cast("double").alias("x"), (60 + (53 * F.col("sk") + 67 * F.col("ln") + 29 * F.col("ok")) % 460).cast("double").alias("y"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows (side, keys, block, line, text, x, y) as runs with boxes and directions."""
    line, text, x, y = (F.col(c) for c in ("line", "text", "x", "y"))
    level = line % 6 != 5
    return rows.select("side", *KEYS, F.col("block").cast("long").alias("block"), line.cast("int").alias("line"), text, x.alias("x0"), y.alias("y0"), (x + 6 * F.length(text)).alias("x1"), (y + 10).alias("y1"), F.when(level, 1.0).otherwise(0.0).alias("dir_x"), F.when(level, 0.0).otherwise(1.0).alias("dir_y"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers along the top and letters along the left of each page, one for each region: (keys, block, line, text, x, y). Only pages are shuffled, labels are made where these arrive."""
    page = (F.floor(F.col("l_orderkey") / 10) + 1).cast("int")
    pages = table(spark, sf_dir, "lineitem").select(pair_of(page), page.alias("page")).distinct()
    k = F.col("r_regionkey")
    number = F.struct(F.lit(-1).alias("block"), (k + 1).cast("string").alias("text"), (80 + 140 * k).cast("double").alias("x"), F.lit(10.0).alias("y"))
    letter = F.struct(F.lit(-2).alias("block"), F.chr(65 + k).alias("text"), F.lit(10.0).alias("x"), (70 + 100 * k).cast("double").alias("y"))
    labels = table(spark, sf_dir, "region").select(k.alias("line"), F.explode(F.array(number, letter)).alias("l")).select("line", "l.*")
    return pages.join(F.broadcast(labels), F.lit(True)).select(*KEYS, F.col("block").cast("long").alias("block"), F.col("line").cast("long").alias("line"), "text", "x", "y")  # ten rows for each page


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("run_idx", (F.row_number().over(Window.partitionBy("side", *KEYS).orderBy("block", "line")) - 1).cast("int"))


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference runs, candidate runs) of sided_runs(), without ``side``."""
    both = sided_runs(spark, sf_dir)
    return tuple(both.where(F.col("side") == side).drop("side") for side in ("ref", "cand"))


def sided_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of both sides: side (ref or cand), pair_id, page, block, line, text, x0, y0, x1, y1, dir_x, dir_y, run_idx. Partitioned by page. Every sixth line is upright; some candidate texts are broken, written otherwise, split in two, missing or new.

    Items are dealt by page once, then each becomes all its runs of both sides: both sides, and all that goes page by page on them, share the shuffles and joins below, and no run is shuffled."""
    v = (7 * F.col("ok") + 11 * F.col("ln")) % 23
    lower = F.col("y") > 300
    x, y = F.col("x") + 6 + F.when(lower, 20.0).otherwise(0.0), F.col("y") + 4 - F.when(lower, 15.0).otherwise(0.0)
    text = (
        F.when(v == 1, F.concat(F.lit("#"), F.substring("text", 2, 10_000)))
        .when(v == 2, F.replace(F.replace("text", F.lit("DIA "), F.lit("Ø")), F.lit("+/-"), F.lit("±")))
        .when(v == 3, F.replace("text", F.lit(".50"), F.lit(".5")))
        .when(v == 5, F.substring_index("text", " ", 1))
        .otherwise(F.col("text"))
    )
    one = lambda side, add, t, u, w: F.struct(F.lit(side).alias("side"), (F.col("ok") + add).alias("block"), F.col("ln").alias("line"), t.alias("text"), u.alias("x"), w.alias("y"))
    variants = [
        one("ref", 0, F.col("text"), F.col("x"), F.col("y")),
        F.when(v != 0, one("cand", 0, text, x, y)),
        F.when(v == 4, one("cand", 1_000_000, F.concat(F.lit("EXTRA "), F.col("ok").cast("string")), x + 3, y + 3)),
        F.when(v == 5, one("cand", 2_000_000, F.expr("substring(text, instr(text, ' ') + 1)"), x + 6 * F.instr("text", " "), y)),
    ]
    page = (F.floor(F.col("ok") / 10) + 1).cast("int")
    items = _items(spark, sf_dir).select(pair_of(page), page.alias("page"), "ok", "ln", "text", "x", "y").repartition(*KEYS)
    rows = items.select(*KEYS, F.explode(F.array_compact(F.array(*variants))).alias("r")).select(*KEYS, "r.*")
    labels = _labels(spark, sf_dir).select("*", F.explode(F.array(F.lit("ref"), F.lit("cand"))).alias("side"))
    return _numbered(_placed(rows.unionByName(labels)))


def page_sizes(ref: DataFrame) -> DataFrame:
    return ref.select(*KEYS).distinct().select(*KEYS, F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_sizes() of both sides' runs, from order numbers alone: every page has labels."""
    page = (F.floor(F.col("l_orderkey") / 10) + 1).cast("int")
    return page_sizes(table(spark, sf_dir, "lineitem").select(pair_of(page), page.alias("page")))


def both_page_sizes(ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate pages, reference pages): every ninth page is missing on the one side, every tenth on the other, and sizes differ."""
    sizes = page_sizes(ref)
    other = sizes.select(*KEYS, (F.col("width") - F.col("page") % 7).alias("width"), (F.col("height") + F.col("page") % 5).alias("height"))
    return sizes.where("page % 9 <> 0"), other.where("page % 10 <> 0")


def damaged(runs_: DataFrame) -> DataFrame:
    """runs of which some have no text, no box or a box that isn't a number."""
    at = lambda n: (F.col("block") % 97 == n) & (F.col("line") == 1)
    x0 = F.when(at(9), None).when(at(11), float("nan")).otherwise(F.col("x0"))
    return runs_.withColumn("text", F.when(~at(7), F.col("text"))).withColumn("x0", x0)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader lines from orders: pair_id, page, seg_idx, ax, ay, bx, by."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        pair_of((F.floor(o / 10) + 1).cast("int")), (F.floor(o / 10) + 1).cast("int").alias("page"), o.alias("seg_idx"),
        (60 + (17 * o) % 640).cast("double").alias("ax"), (60 + (29 * o) % 460).cast("double").alias("ay"), (60 + (41 * o + 31) % 640).cast("double").alias("bx"), (60 + (23 * o + 11) % 460).cast("double").alias("by"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a parts table on each page, on both sides: pair_id, page, side, word_idx, text, x0, y0, x1, y1.

    Every 17th candidate part has another quantity, every 19th no description, the last row of every third full page is gone, and on every fourth page the last header is in the plural."""
    p, cand = F.col("p_partkey"), F.col("o.side") == "cand"
    part = table(spark, sf_dir, "part").select(p, "p_size", F.replace("p_type", F.lit(" "), F.lit("-")).alias("kind"), (F.floor(p / 20) + 1).cast("int").alias("page"), (p % 20).alias("row"))
    sides = F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.lit(0).alias("s")), F.struct(F.lit("cand").alias("side"), F.lit(1).alias("s"))))
    both = part.select("*", sides.alias("o"))
    quantity = F.col("p_size") + F.when(cand & (p % 17 == 0), 1).otherwise(0)
    cells = F.array(*(F.struct(t.cast("string").alias("text"), F.lit(float(x)).alias("x")) for t, x in ((p, 60), (quantity, 160), (F.when(~(cand & (p % 19 == 0)), F.col("kind")), 300))))
    body = both.where(~(cand & (F.col("row") == 19) & (F.col("page") % 3 == 0))).select("page", F.col("o.side").alias("side"), F.col("o.s").alias("s"), (F.col("row") + 1).alias("r"), F.posexplode(cells).alias("c", "cell")).where("cell.text is not null")
    plural = F.when(cand & (F.col("page") % 4 == 0), "DESCRIPTIONS").otherwise("DESCRIPTION")
    heads = F.array(*(F.struct(t.alias("text"), F.lit(float(x)).alias("x")) for t, x in ((F.lit("ITEM"), 60), (F.lit("QTY"), 160), (plural, 300))))
    head = both.select("page", "o").distinct().select("page", F.col("o.side").alias("side"), F.col("o.s").alias("s"), F.lit(0).cast("long").alias("r"), F.posexplode(heads).alias("c", "cell"))
    every = head.unionAll(body)
    x, y, t = F.col("cell.x") + 6 * F.col("s"), (100 + 20 * F.col("r") + 4 * F.col("s")).cast("double"), F.col("cell.text")
    return every.select(pair_of(F.col("page")), "page", "side", (3 * F.col("r") + F.col("c")).cast("int").alias("word_idx"), t.alias("text"), x.alias("x0"), y.alias("y0"), (x + 6 * F.length(t)).alias("x1"), (y + 10).alias("y1"))


def turned(documents: DataFrame, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pages): documents with characters as they are stored on pages of which every fifth is shown turned by a quarter; pages are keys and the map from stored to visible places. keys: of the pages, if they come more cheaply than from the documents."""
    side = F.col("page") % 5 == 0
    maps = (("m00", 0.0, 1.0), ("m01", -1.0, 0.0), ("m02", WIDTH, 0.0), ("m10", 1.0, 0.0), ("m11", 0.0, 1.0), ("m12", 0.0, 0.0))
    pages = (documents if keys is None else keys).select(*KEYS, *(F.when(side, v).otherwise(w).cast("double").alias(c) for c, v, w in maps))
    box = lambda b: F.when(side, F.array(b[1], WIDTH - b[2], b[3], WIDTH - b[0])).otherwise(b)
    char = lambda c: F.struct(c["c"].alias("c"), box(c["bbox"]).alias("bbox"))
    span = lambda s: F.struct(F.transform(s["chars"], char).alias("chars"))
    along = lambda d: F.when(side, F.array(d[1], -d[0])).otherwise(d)
    line = lambda x: F.struct(x["number"].alias("number"), along(x["dir"]).alias("dir"), F.transform(x["spans"], span).alias("spans"))
    block = lambda x: F.struct(x["number"].alias("number"), x["type"].alias("type"), F.transform(x["lines"], line).alias("lines"))
    return documents.select(*KEYS, F.transform("blocks", block).alias("blocks")), pages


def ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rulings, words) of two ruled tables without header words on each page, twelve customers to a page, on both sides: rulings are pair_id, page, side, ax, ay, bx, by.

    Rulings come in pieces that nearly touch, a little off their places. In every seventh row of the first table two cells are one, every fifth has a stroke that ends within a cell; every fifth candidate page
    lacks the second table, every 17th candidate customer has another number."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"), (F.floor(k / 12) + 1).cast("int").alias("page"), (k % 12).cast("int").alias("r"))
    sides = F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.lit(0).alias("s")), F.struct(F.lit("cand").alias("side"), F.lit(1).alias("s"))))
    rows = rows.select("*", sides.alias("o")).select("*", "o.side", (6.0 * F.col("o.s")).alias("sx"), (4.0 * F.col("o.s")).alias("sy")).where("r < 8 or side = 'ref' or page % 5 <> 0")
    first = F.col("r") < 8
    bounds = F.when(first, F.array(*(F.lit(float(x)) for x in (500, 560, 640, 780)))).otherwise(F.array(*(F.lit(float(x)) for x in (520, 600, 700))))
    top = F.when(first, 100.0 + 20 * F.col("r")).otherwise(320.0 + 20 * (F.col("r") - 8)) + F.col("sy")
    off = ((7 * F.col("k")) % 3 - 1) * 0.5
    rows = rows.select("*", F.transform(bounds, lambda x: x + F.col("sx")).alias("b"), top.alias("top"), off.alias("off"), (off * 0.8).alias("aside"))
    line = lambda a, b, c, d: F.struct(a.alias("ax"), b.alias("ay"), c.alias("bx"), d.alias("by"))
    left, middle, right = F.get("b", F.lit(0)), F.get("b", F.lit(1)), F.element_at("b", -1)
    level = [line(x, y + F.col("off"), u, y + F.col("off")) for y in (F.col("top"), F.col("top") + 20) for x, u in ((left, middle - 1), (middle + 1, right))]
    split = lambda x, i: ~((i == 2) & (F.col("k") % 7 == 0) & (F.col("r") < 8))
    upright = F.transform(F.filter("b", split), lambda x: line(x + F.col("aside"), F.col("top"), x + F.col("aside"), F.col("top") + 20))
    stroke = F.when((F.col("k") % 5 == 0) & (F.col("r") < 8), line(middle + 40, F.col("top"), middle + 40, F.col("top") + 10))
    slant = F.when(F.col("k") % 4 == 0, line(left, F.col("top"), right, F.col("top") + 20))
    rulings = rows.select(pair_of(F.col("page")), "page", "side", F.explode(F.array_compact(F.concat(F.array(*level), upright, F.array(stroke, slant)))).alias("l")).select(*KEYS, "side", "l.*")
    word = lambda t, x: F.struct(t.cast("string").alias("text"), x.alias("x"))
    at = lambda c: F.get("b", F.lit(c)) + 4
    changed = F.col("n") + F.when((F.col("side") == "cand") & (F.col("k") % 17 == 0), 1).otherwise(0)
    texts = F.when(first, F.array(word(F.col("k"), at(0)), word(changed, at(1)), word(F.col("m"), at(2)), F.when(F.col("k") % 4 == 0, word(F.concat(F.lit("N"), F.col("n").cast("string")), at(2) + 64)))).otherwise(F.array(word(F.col("k"), at(0)), word(F.col("m"), at(1))))
    words_ = rows.select(pair_of(F.col("page")), "page", "side", "r", "top", F.posexplode(texts).alias("c", "w")).where("w is not null")
    x, y = F.col("w.x"), F.col("top") + 5
    return rulings, words_.select(*KEYS, "side", (10 * F.col("r") + F.col("c")).alias("word_idx"), F.col("w.text").alias("text"), x.alias("x0"), y.alias("y0"), (x + 5 * F.length("w.text")).alias("x1"), (y + 8).alias("y1"))


def visual_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of visual differences from orders: pair_id, page, region, score, r0 to r3 and c0 to c3 (the same)."""
    o = F.col("o_orderkey")
    x, y = (60 + (19 * o) % 640).cast("double"), (20 + (31 * o) % 560).cast("double")
    box = [x, y, x + 2 + o % 60, y + 2 + o % 25]
    page = (F.floor(o / 10) + 1).cast("int")
    return table(spark, sf_dir, "orders").select(pair_of(page), page.alias("page"), o.alias("region"), ((o % 100) / 100.0).alias("score"), *(b.alias(f"{p}{k}") for p in "rc" for k, b in enumerate(box)))


def page_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of up to 64 tiles of 8 x 8 grey pixels from embeddings, and changed candidates: pair_id, page, side, ti, tj, width, height, pixels. Three of six neighbouring tiles have a band of other pixels."""
    e = rasters(spark, sf_dir).select(F.floor(F.col("id") / 64).cast("int").alias("page"), (F.col("id") % 64).cast("int").alias("k"), "id", "a")
    band = lambda v, i: F.when((F.floor(F.col("id") / 3) % 2 == 0) & (i >= 16) & (i < 40 + 8 * (F.col("id") % 3)), (v + 100) % 256).otherwise(v)
    sides = F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.col("a").alias("v")), F.struct(F.lit("cand").alias("side"), F.transform("a", band).alias("v"))))
    rows = e.select(pair_of(F.col("page")), "page", "k", sides.alias("o"))
    hexed = F.array_join(F.transform("o.v", lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return rows.select(*KEYS, "o.side", F.floor(F.col("k") / 8).cast("int").alias("ti"), (F.col("k") % 8).alias("tj"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(hexed).alias("pixels"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from events: job_id, status, created_at, updated_at (seconds)."""
    kind = F.pmod(F.col("event_id"), F.lit(4))
    status = F.when(kind == 0, "queued").when(kind == 1, "running").when(kind == 2, "completed").otherwise("failed")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), at.alias("created_at"), at.alias("updated_at"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files from pages: side, path, upload_seq, bytes."""
    i = F.col("page_id")
    name = F.concat(F.when(i % 3 == 0, "Sheet").otherwise("sheet"), F.floor(i / 2).cast("string"), F.when(i % 7 == 0, ".txt").when(i % 5 == 0, ".PDF").otherwise(".pdf"))
    return table(spark, sf_dir, "pages").select(F.when((i % 2 == 0) | (i % 11 == 0), "ref").otherwise("cand").alias("side"), F.concat(F.lit("/in/"), name).alias("path"), i.alias("upload_seq"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey 8 x 8 clips from embeddings, and a changed copy: id, width, height, a, b (arrays of numbers 0 to 255)."""
    grey = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 256 * x.cast("double")))).cast("int")
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    a = F.transform("embedding", grey)
    b = F.transform(a, lambda v, i: F.when((i + F.col("vec_id")) % 5 == 0, 255 - v).otherwise(v))
    return e.select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), a.alias("a"), b.alias("b"))
