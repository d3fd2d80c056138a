"""SimHash near-dedup over a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits agree in at least six of them, so at least
two of the four two-byte positions agree: each fingerprint is posted under its six pairs of two-byte positions, and any linked pair meets in
a posting list. Pairs that meet are tallied by shared positional bytes; those with the guaranteed minimum of six or more are verified bit by bit.

A posting list with more than ``light`` fingerprints (a large group of near copies) isn't expanded into pairs. Its fingerprints are posted again
under the 65 values within one bit of each: two of them share a value exactly if they differ in at most two bits, and no value can have over 65
fingerprints. Both ways lose no link. Equal fingerprints are one row from the start, so exact copies cost nothing.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; a text of fewer words than a shingle is one
shingle; texts of any length are hashed whole; a bit that exactly half of the shingles have is 0; a row without doc_id gets the component of its fingerprint (null if no row of it has a doc_id);
repeated rows keep their rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, gathered, scratch, table, written
from .components import connected_components

SEED = 42
POSITIONS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle of every text, number of shingles by text)"""
    w = Words(column)
    size = w.ends - w.starts
    total = int((size + 1).sum())
    at = np.cumsum(size + 1) - (size + 1)  # of each word in a buffer of words with one blank after each
    flat = w.low[np.repeat(w.starts - at, size + 1) + np.arange(total)]
    flat[at + size] = 32
    count = np.where(w.per_doc > 0, np.maximum(w.per_doc - words + 1, 1), 0)
    begin = np.cumsum(count) - count
    first = np.repeat(w.first[:-1] - begin, count) + np.arange(int(count.sum()))
    last = np.minimum(first + words - 1, np.repeat(w.first[1:] - 1, count))
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    ends = (at + size)[last].tolist()
    return np.array([digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), ends, strict=True)], dtype=np.uint64), count


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each group of hashes the bits that over half of them have, as one unsigned number."""
    out = np.zeros(len(count), dtype=np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = (np.cumsum(count) - count)[full]
        votes = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * votes > count[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint long) for each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, 4_000_000, text):
            prints = majority(*shingle_hashes(t.column(text), words))
            yield from pa.table({key: t.column(key), "fingerprint": pa.array(prints.view(np.int64))}).to_batches()

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, fingerprint long")


def _shared_bytes(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(8))


def links(prints: DataFrame, light: int = 24) -> DataFrame:
    """prints: distinct ``fingerprint`` -> (u, v) pairs that connect whatever differs in at most two bits; all such pairs of light posting lists are among them."""
    block = [F.shiftrightunsigned("fingerprint", 16 * p).bitwiseAND(F.lit(0xFFFF)) for p in range(4)]
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n, (i, j) in enumerate(POSITIONS)]
    postings = prints.select("fingerprint", F.explode(F.array(*keys)).alias("post"))
    sizes = postings.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    listed = written(postings.join(sizes, "post"), "postings")
    lists = listed.where(F.col("n") <= light).groupBy("post").agg(F.collect_list("fingerprint").alias("list"))
    pairs = lists.select("list", F.explode("list").alias("u")).select("u", F.explode(F.filter("list", lambda v: v > F.col("u"))).alias("v"))
    near = pairs.where(_shared_bytes(F.col("u"), F.col("v")) >= 6).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2).distinct()
    heavy = listed.where(F.col("n") > light).select("fingerprint").distinct()
    around = F.array(F.col("fingerprint"), *(F.col("fingerprint").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)))
    middles = heavy.select("fingerprint", F.explode(around).alias("middle")).groupBy("middle").agg(F.collect_list("fingerprint").alias("list")).where(F.size("list") > 1)
    stars = middles.select(F.array_min("list").alias("u"), F.explode("list").alias("v")).where("u <> v").where(_shared_bytes(F.col("u"), F.col("v")) >= 6).distinct()
    return near.unionAll(stars)


def near_duplicates(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text", light: int = 24) -> DataFrame:
    """(key, fingerprint long, component_id) for each row: the least key of all rows that are reachable over links."""
    rows = written(fingerprints(df, words, key, text), "prints")
    prints = written(rows.groupBy("fingerprint").agg(F.min(key).alias("least")), "classes")
    groups = connected_components(links(prints, light)).withColumnRenamed("node", "fingerprint")
    labelled = prints.join(groups, "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "label").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(key, "fingerprint", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as tables:
        found = near_duplicates(table(spark, sf_dir, "documents"))
        return tables.kept(found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"), "near")
