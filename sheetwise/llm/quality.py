"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A row's features are its words' log counts (hashed to BUCKETS columns, unit length), a few statistics of the text's structure and the table's n_chars. All pairs of
features interact through vectors of FACTORS numbers; with s_f = sum of v_if * x_i and q_f = sum of (v_if * x_i)^2, the pairs' part of the score is half the sum of s_f^2 - q_f,
so a row costs as much as it has features. The model is fitted by Adagrad on at most SAMPLE labelled rows, chosen by hash from the training fold; it is a few hundred kB whatever the input, and is sent to every task.

Defined cases: a null or blank text has no words and gets the score of its statistics; a null n_chars counts as 0; rows without doc_id or label teach nothing, a repeated doc_id in labels counts once, with its greatest label; a row without doc_id is scored and
not held out; texts of any length are read whole; repeated rows score alike, and a score of 0.5 counts as label 1; an empty table gives an empty result; without labels of both kinds the score is the share of label 1 (0.5 without any). Labels, lang, source and doc_id are never inputs; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, gathered, held_out, labelled_sample, release_memory, sent_out, table

#: Hashed columns; length of a feature's vector; labelled rows to learn from at most; passes over them; rows in a step.
BUCKETS, FACTORS, SAMPLE, EPOCHS, STEP = 1 << 14, 8, 6_000, 12, 64
#: Bytes that structure statistics count, by statistic.
COUNTED = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!?", ".,;:", "\n", "|", "@/_"]
DENSE = len(COUNTED) + 7


def features(t: pa.Table, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the hashed words and a matrix of statistics, for each row of t (text, n_chars)."""
    w = Words(t.column(text), lower=False)
    rows = t.num_rows
    keys, counts = np.unique(w.doc * BUCKETS + (w.hashes() & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    row, column, value = keys // BUCKETS, keys % BUCKETS, np.log1p(counts)
    norm = np.sqrt(np.bincount(row, value**2, rows))
    value = value / np.maximum(norm, 1e-12)[row]
    raw, bounds = w.low[:-8], w.offsets
    size = np.diff(bounds).astype(np.float64)

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), bounds)).astype(np.float64)

    share = lambda x: x / np.maximum(size, 1)
    kinds = np.zeros((len(COUNTED), 256), dtype=bool)
    for i, c in enumerate(COUNTED):
        kinds[i, list(c.encode())] = True
    words = w.per_doc.astype(np.float64)
    letters = np.bincount(w.doc, w.ends - w.starts, rows)
    told = np.nan_to_num(t.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64))
    distinct = np.bincount(row, minlength=rows)
    columns = [share(per_row(k[raw])) for k in kinds]
    columns += [np.log1p(words), np.log1p(np.maximum(told, 0)), letters / np.maximum(words, 1), distinct / np.maximum(words, 1), share(per_row(raw >= 128)), np.minimum(told / np.maximum(size, 1), 4), (words < 20).astype(np.float64)]
    return row, column, value, np.stack(columns, axis=1)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) * self.scale, -4, 4) / DENSE**0.5

    def margin(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Linear part and pairs' part; row is in rising order."""
        n, d = len(dense), self.standard(dense)
        out = self.bias + d @ self.linear[BUCKETS:] + np.bincount(row, self.linear[column] * value, n)
        for f in range(FACTORS):
            weights, tail = self.vectors[:BUCKETS, f], self.vectors[BUCKETS:, f]
            part = weights[column] * value
            s = np.bincount(row, part, n) + d @ tail
            q = np.bincount(row, part * part, n) + (d * d) @ (tail * tail)
            out += 0.5 * (s * s - q)
        return out

    def score(self, *x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*x), -30, 30)))


def train(labels: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, dense: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss. labels: 0 or 1 for each row."""
    rng, n, width = np.random.default_rng(seed), len(labels), BUCKETS + DENSE
    share = float(labels.mean()) if n else 0.5
    deviation = dense.std(axis=0) if n else np.ones(DENSE)
    m = Machine(0.0, np.zeros(width), rng.normal(0, 0.05, (width, FACTORS)), dense.mean(axis=0) if n else np.zeros(DENSE), 1 / np.where(deviation > 1e-9, deviation, 1.0))
    if not n or not 0 < share < 1:
        m.vectors[:] = 0
        m.bias = 30.0 if share == 1 else -30.0 if share == 0 else 0.0
        return m
    m.bias = float(np.log(share / (1 - share)))
    standard, begin = m.standard(dense), np.searchsorted(row, np.arange(n + 1))
    past_linear, past_vectors, past_bias = np.full(width, 1e-6), np.full((width, FACTORS), 1e-6), 1e-6
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(n), 0.2 / (1 + 0.1 * epoch)
        for a in range(0, n, STEP):
            rows = order[a : a + STEP]
            at = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows])
            local = np.concatenate((local, np.repeat(np.arange(len(rows)), DENSE)))
            index = np.concatenate((column[at], np.tile(BUCKETS + np.arange(DENSE), len(rows))))
            x = np.concatenate((value[at], standard[rows].ravel()))
            vx = m.vectors[index] * x[:, None]
            s = np.stack([np.bincount(local, vx[:, f], len(rows)) for f in range(FACTORS)], axis=1)
            q = np.bincount(local, (vx * vx).sum(axis=1), len(rows))
            margin = m.bias + np.bincount(local, m.linear[index] * x, len(rows)) + 0.5 * ((s * s).sum(axis=1) - q)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]
            used, place = np.unique(index, return_inverse=True)
            g_linear = np.bincount(place, error[local] * x) / len(rows) + 1e-6 * m.linear[used]
            inner = (error[local] * x)[:, None] * (s[local] - vx)
            g_vectors = np.stack([np.bincount(place, inner[:, f]) for f in range(FACTORS)], axis=1) / len(rows) + 1e-5 * m.vectors[used]
            past_linear[used] += g_linear**2
            past_vectors[used] += g_vectors**2
            m.linear[used] -= rate * g_linear / np.sqrt(past_linear[used])
            m.vectors[used] -= 0.25 * rate * g_vectors / np.sqrt(past_vectors[used])
            g = error.mean()
            past_bias += g * g
            m.bias -= rate * g / past_bias**0.5
    return m


def fit(documents: DataFrame, labels: DataFrame, fold: int = 3, bound: int = SAMPLE) -> Machine:
    """Features of the sampled rows come to the driver, a bounded number of rows; training runs there."""
    chosen = labelled_sample(labels, "quality", bound, ~held_out(F.col("doc_id"), fold))
    rows = documents.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, 2_000_000):
            row, column, value, dense = features(t)
            cuts = np.searchsorted(row, np.arange(t.num_rows + 1)).tolist()
            lists = lambda x, kind: pa.array([x[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.list_(kind))
            yield from pa.table({"doc_id": t.column("doc_id"), "label": t.column("_label"), "columns": lists(column, pa.int32()), "values": lists(value, pa.float32()), "dense": pa.array(list(dense), pa.list_(pa.float64()))}).to_batches()

    found = rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, label int, columns array<int>, values array<float>, dense array<double>").toArrow().sort_by("doc_id")
    # Numbers stay in Arrow's buffers: as Python objects they take ten times the memory, which the driver doesn't give back.
    lists = {k: found.column(k).combine_chunks() for k in ("columns", "values", "dense")}
    column, value, dense = (x.flatten().to_numpy() for x in lists.values())
    row = np.repeat(np.arange(found.num_rows), lists["columns"].value_lengths().to_numpy(zero_copy_only=False))
    machine = train(found.column("label").to_numpy().astype(np.float64), row, column, value, dense.reshape(-1, DENSE))
    del found, lists, row, column, value, dense
    release_memory()
    return machine


def scored(df: DataFrame, machine: Machine) -> DataFrame:
    """df with ``quality_score`` (double) for each row; its columns pass unread but for text and n_chars."""
    sent = sent_out(df.sparkSession, machine)
    names = [c for c in df.columns if c != "quality_score"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for t in gathered(batches, 4_000_000):
            yield from t.select(names).append_column("quality_score", pa.array(m.score(*features(t)))).to_batches()

    return df.select(*names).mapInArrow(run, f"{fields}, quality_score double")


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    machine = fit(documents, table(spark, sf_dir, "labels"))
    # Texts are read and scored, and only the scores go back.
    sent = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for t in gathered(batches, 4_000_000):
            yield from t.select(["doc_id"]).append_column("score", pa.array(m.score(*features(t)))).to_batches()

    rows = documents.select("doc_id", "text", "n_chars").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 3), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
