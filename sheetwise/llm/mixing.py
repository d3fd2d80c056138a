"""Mixing sources to target weights along a low-discrepancy schedule.

Sources, in code point order with null last, weigh 1, 2, 3 and again 1, 2, 3. Targets are shares of all words, held at ``repeats`` times a
source's size; what is held back goes to the others by weight until nothing is above.

A source's texts, in an order shuffled by hash, are one stream that is cut into blocks of equal size (to within a word). A block has BLOCK_WORDS words, or fewer in a
source whose target would give fewer than LEAST_SLOTS slots; so a small source has small blocks, and doesn't make those of others small. A source needs so many slots as blocks
make up its target. The schedule is the van der Corput sequence over 2^m points: slot i belongs to the source whose stretch of the cumulative
slot counts has the point. As those stretches have whole numbers of points, each source gets its number of slots exactly, evenly spread.
The r-th slot of a source takes block r, and begins again after the last block. Slots are ranked by counts of fixed spans of the schedule and
running numbers within a span, texts are placed the same way by spans of their hash, so a source with most of the rows is spread over tasks.

Only one row for each source reaches the driver (its name and size).

Defined cases: a null or blank text has size 0 and is never taken; a text of any length is counted whole and may lie in many blocks; texts with the same hash follow one another by key and size;
a row without key is a row like others; a null source is a source of its own; repeated rows are rows of their own
(equal rows share what is taken in an order that doesn't matter); an empty table gives an empty result; other columns pass ``slots`` unread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table, word_array, written

#: Words in a block at most, and slots that a source should have at least where there is that much text.
BLOCK_WORDS, LEAST_SLOTS = 4096, 2000
#: Rows that one running count holds, of the schedule and of a source's texts.
SLOT_SPAN, TEXT_SPAN = 1 << 12, 1000


def water_fill(sizes: list[int], weights: list[int], total: float, repeats: int = 3) -> list[float]:
    """Targets: total by weight, none above repeats times its size; the excess is shared again by weight among the others."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > repeats * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(repeats * sizes[i])
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


def _running(df: DataFrame, by: list[str], span: str, amount: str, order: list[Column], whole: str) -> DataFrame:
    """df with ``whole``: the sum of amount over the rows before, in the order of (span, order) within by. A task holds one span at a time."""
    totals = df.groupBy(*by, span).agg(F.sum(amount).alias("_amount"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_amount").over(Window.partitionBy(*by).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_amount")
    within = Window.partitionBy(*by, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return ranked.join(before, [*by, span]).withColumn(whole, F.col("_before") + F.col("_within")).drop("_before", "_within")


def plan(sized: DataFrame, repeats: int = 3) -> list[dict]:
    """One dict for each source: name, size, target, blocks, slots, first (point of the schedule). sized: source, size."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes, weights = [int(r["size"] or 0) for r in rows], [1 + i % 3 for i in range(len(rows))]
    total = sum(sizes)
    targets = water_fill(sizes, weights, total, repeats)
    out, first = [], 0
    for n, (row, size, target) in enumerate(zip(rows, sizes, targets, strict=True)):
        words = max(1, min(BLOCK_WORDS, math.floor(target / LEAST_SLOTS)))
        blocks = -(-size // words)
        slots = min(repeats * blocks, round(target * blocks / size)) if size else 0
        out.append({"n": n, "source": row["source"], "size": size, "target": target, "blocks": blocks, "slots": slots, "first": first})
        first += slots
    return out


def schedule(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """(slot, n, rank): the source of each slot of the mix, and the slot's rank among those of its source; empty slots are left out."""
    total = sum(s["slots"] for s in sources)
    bits = max(1, (total - 1).bit_length())
    text = F.lpad(F.conv(F.col("slot").cast("string"), 10, 2), bits, "0")
    point = F.conv(F.reverse(text), 2, 10).cast("long")
    has = [s for s in sources if s["slots"]]
    firsts = F.array(*(F.lit(s["first"]) for s in has)) if has else F.array(F.lit(0))
    numbers = F.array(*(F.lit(s["n"]) for s in has)) if has else F.array(F.lit(0))
    # The last source that begins at or before the point.
    owner = F.element_at(numbers, F.greatest(F.lit(1), F.size(F.filter(firsts, lambda x: x <= F.col("point")))))
    slots = spark.range(1 << bits).select(F.col("id").alias("slot"), point.alias("point")).where(F.col("point") < total)
    slots = slots.select("slot", owner.alias("n"), F.lit(1).cast("long").alias("one"), F.floor(F.col("slot") / SLOT_SPAN).alias("span"))
    return _running(slots, ["n"], "span", "one", [F.col("slot")], "rank").select("slot", "n", "rank")


def _source_table(spark: SparkSession, sources: list[dict]) -> DataFrame:
    rows = [(s["n"], s["source"], s["size"], s["target"], s["blocks"], s["slots"]) for s in sources]
    return spark.createDataFrame(rows, "n int, source string, source_size long, target double, blocks long, slots long")


def block_begin(b: Column) -> Column:
    """Where block b begins in its source's stream, whole numbers throughout; the first r blocks have q + 1 words, the others q."""
    return b * F.col("q") + F.least(b, F.col("r"))


def block_of(at: Column) -> Column:
    """The block that has place ``at`` of the stream."""
    long_ = F.col("r") * (F.col("q") + 1)
    return F.when(at < long_, _div(at, F.col("q") + 1)).otherwise(F.col("r") + _div(at - long_, F.col("q")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def mix(df: DataFrame, repeats: int = 3, key: str = "doc_id", text: str = "text", source: str = "source", with_order: bool = False) -> DataFrame:
    """(key, size, source, source_size, target, taken) for each row; with_order: and the hash that shuffles texts."""
    spark = df.sparkSession
    sized = written(df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.size(word_array(F.col(text))).cast("long").alias("size"), F.xxhash64(key, text).alias("_order")), "sized")
    sources = plan(sized, repeats)
    names = F.broadcast(_source_table(spark, sources))  # one row for each source, as many as the driver holds in the plan
    count = sized.count()
    spans = max(1, math.ceil(count / TEXT_SPAN))
    placed = sized.join(names, sized["source"].eqNullSafe(names["source"])).drop(names["source"]).withColumn("span", F.floor((F.shiftrightunsigned("_order", 1) / float(1 << 63)) * spans))
    placed = _running(placed, ["n"], "span", "size", [F.col("_order"), F.col("key"), F.col("size")], "begin")
    used = schedule(spark, sources).join(names.select("n", "blocks"), "n").groupBy("n", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("uses"))
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    parts = placed.where("size > 0").select("n", "row", "begin", (F.col("begin") + F.col("size")).alias("end"), F.expr("source_size div blocks").alias("q"), F.expr("source_size % blocks").alias("r"))
    parts = parts.select("*", F.explode(F.sequence(block_of(F.col("begin")), block_of(F.col("end") - 1))).alias("block"))
    parts = parts.select("n", "row", "block", (F.least("end", block_begin(F.col("block") + 1)) - F.greatest("begin", block_begin(F.col("block")))).alias("words"))
    taken = parts.join(used, ["n", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    out = placed.join(taken, "row", "left")
    return out.select(F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *(["_order"] if with_order else []))


def repeated(df: DataFrame, repeats: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of df as often as the mix takes its words, to the nearest whole number; equal rows are taken alike."""
    taken = mix(df, repeats, key, text, source, with_order=True).groupBy(F.col(key).alias("_sw_key"), F.col("_order").alias("_sw_order"))
    times = taken.agg(F.avg(F.col("taken") / F.greatest("size", F.lit(1))).alias("_sw_times")).select("_sw_key", "_sw_order", F.floor(F.col("_sw_times") + 0.5).cast("int").alias("_sw_times")).where("_sw_times > 0")
    rows = df.withColumn("_sw_order", F.xxhash64(key, text))
    joined = rows.join(times, (rows["_sw_order"] == times["_sw_order"]) & rows[key].eqNullSafe(times["_sw_key"]))
    return joined.select(*(df.columns), F.explode(F.sequence(F.lit(1), F.col("_sw_times"))).alias("_sw_copy")).drop("_sw_copy")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as tables:
        return tables.kept(mix(table(spark, sf_dir, "documents")).drop("source"), "mix")
