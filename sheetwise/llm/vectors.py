"""Exact top-k search by inner product over vector-approximation files.

Vectors are turned into whole numbers, floor(scale * x). The approximation file holds, for every vector, the cell of each component among
``cells`` equal cells between that component's least and greatest value over all rows, one byte each; the exact numbers stand beside it in columns of their own.
Queries are taken in blocks of bounded size. For each block, a first scan reads cells only: cell edges bound each score from below, and the k-th
greatest lower bound over all rows is what a result must reach at least. A second scan takes the upper bounds: a task goes through its rows in tiles, keeps the k best exact scores of each query so far, and
multiplies exact numbers only of pairs whose bound reaches what is needed, in falling order of that bound, until no pair left can be among the k best. What is left, k rows for each query and task, is ranked.
Rows are tiled so that bounds of all queries of a block and all rows of a tile take TILE numbers at most.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without vec_id, take no part; vectors of different lengths are
compared as if the shorter ones went on with zeros; components beyond 2^28 after scaling count as 2^28; ties go to the smaller vec_id; all rows with the query's
vec_id are its own; with fewer than k candidates all are returned; of repeated rows of one vec_id each is a candidate, and one is the query; tables without rows or without queries give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table, written

MOST = 1 << 28
NONE = np.iinfo(np.int64).min
#: Bounds (queries by rows) that are held at once; exact products that are taken at once; the first and later numbers of a query's pairs in a tile that are taken before bounds are looked at again.
TILE, PAIRS, STEPS = 1 << 22, 1 << 15, (8, 32, 128)


def whole_numbers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid by row, length of the valid rows, their components one after another)"""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(length)), length)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~np.isfinite(x)], minlength=len(length)) == 0)
    with np.errstate(over="ignore", invalid="ignore"):
        numbers = np.clip(np.floor(scale * x), -MOST, MOST)
    return valid, length[valid], numbers[valid[row]].astype(np.int64)


def padded(length: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    if len(length) and (length == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(length), width), dtype=np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly; in doubles wherever these hold every sum."""
    greatest = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if greatest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Grid:
    """Cells of the approximation file: component d has the values low[d] + c * step[d] and up to step[d] - 1 more in cell c, none over high[d]."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int):
        self.low, self.high = low, high
        self.step = np.maximum(1, -(-(high - low + 1) // cells))

    def cell(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers - self.low) // self.step).astype(np.uint8)

    def bounds(self, queries: np.ndarray, cells: np.ndarray, upper: bool) -> np.ndarray:
        """The least (or, upper, the greatest) score of each query with anything in each row's cells."""
        near = self.low + cells.astype(np.int64) * self.step
        far = np.minimum(near + self.step - 1, self.high)
        signed = np.hstack((np.maximum(queries, 0), np.minimum(queries, 0)))
        return product(signed, np.hstack((far, near) if upper else (near, far)))


class Best:
    """The k greatest scores of each query so far, ties to the smaller vec_id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.names = k, np.full((n, k), NONE), np.zeros((n, k), dtype=np.int64)

    def add(self, q: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(q)
        q = np.concatenate((q, np.repeat(touched, self.k)))
        names, scores = np.concatenate((names, self.names[touched].ravel())), np.concatenate((scores, self.scores[touched].ravel()))
        order = np.lexsort((names, -scores.astype(np.float64) if np.abs(scores[scores > NONE]).max(initial=0) < 1 << 53 else _falling(scores), q))
        q, names, scores = q[order], names[order], scores[order]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        keep = place < self.k  # every touched query has k at least
        self.scores[touched], self.names[touched] = scores[keep].reshape(-1, self.k), names[keep].reshape(-1, self.k)


def _falling(scores: np.ndarray) -> np.ndarray:
    """Whole numbers that fall where scores rise."""
    return -np.unique(scores, return_inverse=True)[1]


def _prepared(df: DataFrame, scale: float, key: str, vector: str) -> DataFrame:
    """(vec_id, length, numbers binary) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, length, flat = whole_numbers(batch.column(1), scale)
            cuts = np.concatenate(([0], np.cumsum(length)))
            raw = [flat[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            ids = batch.column(0).filter(pa.array(valid))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(length, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "length", "numbers"])

    return df.where(F.col(key).isNotNull()).select(F.col(key), F.col(vector)).mapInArrow(run, "vec_id long, length int, numbers binary")


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    raw = batch.column(batch.schema.get_field_index("numbers"))
    length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
    return padded(length, np.frombuffer(b"".join(raw.to_pylist()), dtype="<i4").astype(np.int64), width)


def build(df: DataFrame, scale: float = 256.0, cells: int = 64, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Grid]:
    """The approximation file (vec_id, cells, length, numbers) of all rows that take part, and its grid. cells is at most 256."""
    prepared = written(_prepared(df, scale, key, vector), "numbers")
    width = prepared.agg(F.max("length")).first()[0] or 0

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch, width)
            if len(x) and width:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["d", "low", "high"])

    found = prepared.mapInArrow(ranges, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    grid = Grid(np.array([r["low"] for r in found], dtype=np.int64), np.array([r["high"] for r in found], dtype=np.int64), cells)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = grid.cell(_unpacked(batch, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in c], pa.binary()), batch.column(1), batch.column(2)], names=["vec_id", "cells", "length", "numbers"])

    return written(prepared.mapInArrow(approximate, "vec_id long, cells binary, length int, numbers binary"), "va-file"), grid


def _cells(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)


def _search_block(file: DataFrame, grid: Grid, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) among which the k best of each query are. ids, queries: one bounded block."""
    spark, width = file.sparkSession, len(grid.low)
    sent = spark.sparkContext.broadcast((ids, queries))

    tile = max(1, TILE // max(1, len(ids)))

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        best = np.full((len(ids), k), NONE)
        for whole in batches:
            for batch in (whole.slice(a, tile) for a in range(0, whole.num_rows, tile)):
                low = grid.bounds(queries, _cells(batch, width), upper=False)
                low[ids[:, None] == batch.column(0).to_numpy()[None, :]] = NONE
                if low.shape[1] > k:
                    low.partition(low.shape[1] - k, axis=1)
                best = np.sort(np.hstack((best, low[:, -k:])), axis=1)[:, -k:]
        row, _ = np.nonzero(best > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best[best > NONE])], names=["query_id", "low"])

    kth = file.select("vec_id", "cells").mapInArrow(lower, "query_id long, low long").groupBy("query_id").agg(F.sort_array(F.collect_list("low"), False).alias("low"))
    reach = {r["query_id"]: r["low"] for r in kth.select("query_id", F.get("low", F.lit(k - 1)).alias("low")).collect() if r["low"] is not None}
    floor = spark.sparkContext.broadcast(np.array([reach.get(int(i), NONE) for i in ids], dtype=np.int64))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, queries), best = sent.value, Best(len(sent.value[0]), k)
        for whole in batches:
            for batch in (whole.slice(a, tile) for a in range(0, whole.num_rows, tile)):
                names = batch.column(0).to_numpy()
                high = grid.bounds(queries, _cells(batch, width), upper=True)
                q, at = np.nonzero((high >= np.maximum(floor.value, best.scores[:, -1])[:, None]) & (ids[:, None] != names[None, :]))
                if not len(q):
                    continue
                bound, numbers = high[q, at], _unpacked(batch, width)
                order = np.lexsort((_falling(bound), q))  # a query's pairs in falling order of bounds
                q, at, bound = q[order], at[order], bound[order]
                steps = iter(STEPS)
                take = next(steps)
                while len(q):
                    begin = np.flatnonzero(np.diff(q, prepend=-1))
                    now = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < take
                    for a in range(0, int(now.sum()), PAIRS):
                        some = np.flatnonzero(now)[a : a + PAIRS]
                        best.add(q[some], names[at[some]], np.einsum("ij,ij->i", queries[q[some]], numbers[at[some]]))
                    left = ~now & (bound >= np.maximum(floor.value, best.scores[:, -1])[q])
                    q, at, bound = q[left], at[left], bound[left]
                    take = next(steps, STEPS[-1])
        row, _ = np.nonzero(best.scores > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best.names[best.scores > NONE]), pa.array(best.scores[best.scores > NONE])], names=["query_id", "vec_id", "score"])

    return file.select("vec_id", "cells", "length", "numbers").mapInArrow(exact, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: str, k: int = 5, scale: float = 256.0, cells: int = 64, block: int = 8192, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of which the SQL condition is_query (on vec_id) holds, searched in blocks of about ``block`` queries."""
    spark = df.sparkSession
    file, grid = build(df, scale, cells, key, vector)
    asked = file.where(is_query).select("vec_id", "length", "numbers")
    blocks = -(-asked.count() // block)
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).dropDuplicates(["vec_id"]).collect()
        if rows:
            ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
            matrix = padded(np.array([r["length"] for r in rows], dtype=np.int64), np.frombuffer(b"".join(r["numbers"] for r in rows), dtype="<i4").astype(np.int64), len(grid.low))
            found.append(_search_block(file, grid, ids, matrix, k))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as tables:
        return tables.kept(top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0"), "nearest")
