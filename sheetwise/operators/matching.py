"""Matching reference runs to candidate runs: costs by join, the optimal assignment, and what is left over."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import edits
from ..functions import geometry as g
from ..functions.text import edit_distance

KEYS = ["pair_id", "page"]


def costs(ref: DataFrame, cand: DataFrame, config: Config) -> DataFrame:
    """(keys, ref_idx, cand_idx, distance, equal, cost) for every pair of runs of a page. ref: run_idx, norm, mx, my (mapped centre); cand: run_idx, norm, box.

    An equi-join on the page; nothing is pruned, as the best assignment is one over all pairs."""
    a = ref.select(*KEYS, F.col("run_idx").alias("ref_idx"), F.col("norm").alias("a"), "mx", "my")
    cx, cy = g.center(g.box())
    b = cand.select(*KEYS, F.col("run_idx").alias("cand_idx"), F.col("norm").alias("b"), cx.alias("cx"), cy.alias("cy"))
    d = g.distance(F.col("mx"), F.col("my"), F.col("cx"), F.col("cy"))
    pairs = a.join(b, KEYS).select(*KEYS, "ref_idx", "cand_idx", d.alias("distance"), (F.col("a") == F.col("b")).alias("equal"), edit_distance(F.col("a"), F.col("b")).alias("edit"))
    return pairs.select(*KEYS, "ref_idx", "cand_idx", "distance", "equal", (F.col("distance") * config.match_position_weight + F.col("edit") * config.match_string_weight).alias("cost"))


def costs_by_run(ref: DataFrame, cand: DataFrame, config: Config) -> DataFrame:
    """cost_rows() of costs(), without a row for each pair: the candidate runs of a page are one array, which meets the page's reference runs."""
    cx, cy = g.center(g.box())
    one = F.struct(F.col("run_idx").alias("cand_idx"), F.col("norm").alias("b"), cx.alias("cx"), cy.alias("cy"))
    page = cand.groupBy(*KEYS).agg(F.array_sort(F.collect_list(one)).alias("_c"))

    def cost(c: Column) -> Column:
        d = g.distance(F.col("mx"), F.col("my"), c["cx"], c["cy"])
        return F.struct(c["cand_idx"].alias("cand_idx"), d.alias("distance"), (F.col("norm") == c["b"]).alias("equal"), (d * config.match_position_weight + edit_distance(F.col("norm"), c["b"]) * config.match_string_weight).alias("cost"))

    rows = ref.select(*KEYS, F.col("run_idx").alias("ref_idx"), "norm", "mx", "my").join(page.hint("merge"), KEYS).select(*KEYS, "ref_idx", F.transform("_c", cost).alias("c"))
    return rows.select(*KEYS, "ref_idx", *(F.col(f"c.{n}").alias(n) for n in ("cand_idx", "cost", "distance", "equal")))


def cost_rows(pairs: DataFrame) -> DataFrame:
    """(keys, ref_idx, cand_idx, cost, distance, equal): a row for each reference run, with arrays over the candidate runs of its page in their order. What the least costs and the assignment both read, so that costs are computed once."""
    by_run = pairs.groupBy(*KEYS, "ref_idx").agg(F.array_sort(F.collect_list(F.struct("cand_idx", "cost", "distance", "equal"))).alias("c"))
    return by_run.select(*KEYS, "ref_idx", *(F.col(f"c.{n}").alias(n) for n in ("cand_idx", "cost", "distance", "equal")))


def least_costs(pairs: DataFrame) -> DataFrame:
    """(keys, ref_idx, min_cost), of pairs or of cost_rows()."""
    if dict(pairs.dtypes)["cost"].startswith("array"):
        return pairs.select(*KEYS, "ref_idx", F.array_min("cost").alias("min_cost"))
    return pairs.groupBy(*KEYS, "ref_idx").agg(F.min("cost").alias("min_cost"))


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the cheapest one-to-one assignment of a rectangular matrix, min(shape) pairs.

    Shortest augmenting paths over reduced costs. Rows that can have their cheapest column without a quarrel take it first; paths are searched for the others only."""
    if cost.shape[0] > cost.shape[1]:
        columns, rows = assignment(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    u, v = cost.min(axis=1), np.zeros(m)
    row_of, col_of = np.full(m, -1), np.full(n, -1)
    for i in np.argsort(u, kind="stable"):
        j = int(np.argmin(cost[i]))
        if row_of[j] < 0:
            row_of[j], col_of[i] = i, j
    for start in np.flatnonzero(col_of < 0):
        far, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        i, length, path_rows = start, 0.0, [start]
        while True:
            step = length + cost[i] - u[i] - v
            closer = ~done & (step < far)
            far[closer], came[closer] = step[closer], i
            j = int(np.argmin(np.where(done, np.inf, far)))
            length, done[j] = far[j], True
            if row_of[j] < 0:
                break
            i = row_of[j]
            path_rows.append(i)
        tree = np.array(path_rows)
        u[start] += length
        inner = tree[1:]
        u[inner] += length - far[col_of[inner]]
        v[done] -= length - far[done]
        while True:  # turn the path round
            i = came[j]
            row_of[j], j, col_of[i] = i, col_of[i], j
            if i == start:
                break
    return np.arange(n), col_of


def matches(pairs: DataFrame, config: Config) -> DataFrame:
    """(keys, ref_idx, cand_idx, distance, equal, cost) of the best assignment of each page, without what costs over the limit; of pairs or of cost_rows()."""
    rows = pairs if dict(pairs.dtypes)["cost"].startswith("array") else cost_rows(pairs)

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("ref_idx")
        refs, cands = page["ref_idx"].to_numpy(), np.asarray(page["cand_idx"].iloc[0])
        cost, distance, equal = (np.stack(page[c].to_list()) for c in ("cost", "distance", "equal"))
        i, j = assignment(cost)
        out = pd.DataFrame({"pair_id": page["pair_id"].iloc[0], "page": page["page"].iloc[0], "ref_idx": refs[i], "cand_idx": cands[j], "distance": distance[i, j], "equal": equal[i, j], "cost": cost[i, j]})
        return out[out["cost"] <= config.match_max_cost]

    return rows.groupBy(*KEYS).applyInPandas(run, "pair_id string, page int, ref_idx int, cand_idx int, distance double, equal boolean, cost double")


ASSIGNED = "pair_id string, page int, ref_idx int, cand_idx int, distance double, equal boolean, cost double, min_cost double"


def page_costs(texts: edits.Texts, a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, equal, cost) matrices of costs(): a, b numbers of norms (negative: null, like no other), u, v centres, of reference and candidate runs."""
    x, y = (u[:, None, k] - v[None, :, k] for k in (0, 1))
    distance, equal = np.sqrt(x * x + y * y), (a[:, None] == b[None, :]) & (a[:, None] >= 0)
    edit = np.where(equal, 0.0, 1.0)
    i, j = np.nonzero(~equal & (a[:, None] >= 0) & (b[None, :] >= 0))
    edit[i, j] = edits.levenshtein(texts, a[i], b[j]) / np.maximum(np.maximum(texts.length[a[i]], texts.length[b[j]]), 1)
    return distance, equal, distance * config.match_position_weight + edit * config.match_string_weight


def assigned(ref: DataFrame, cand: DataFrame, config: Config) -> DataFrame:
    """(ASSIGNED) a row for each reference run of a page that has candidate runs: what the best assignment gives it (null: nothing, where candidates are fewer), and its least cost. What matches() and least_costs() tell, without costs outside of the
    step that works them out: a page's runs are one row."""
    cx, cy = g.center(g.box())
    one = lambda df, is_ref, x, y: df.select(*KEYS, F.struct(F.lit(not is_ref).alias("cand"), F.col("run_idx").cast("int").alias("idx"), "norm", x.cast("double").alias("x"), y.cast("double").alias("y")).alias("r"))
    both = one(ref, True, F.col("mx"), F.col("my")).unionAll(one(cand, False, cx, cy)).where("pair_id IS NOT NULL AND page IS NOT NULL")
    pages = both.groupBy(*KEYS).agg(F.array_sort(F.collect_list("r")).alias("runs")).where(F.exists("runs", lambda r: r["cand"]) & F.exists("runs", lambda r: ~r["cand"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 32) for k in range(0, whole.num_rows, 32)):
                flat = pc.list_flatten(batch.column(2))
                ends = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())))
                is_cand, idx, x, y = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
                norms = flat.field(2).dictionary_encode()
                texts, number = edits.Texts(norms.dictionary.to_pylist()), norms.indices.fill_null(-1).to_numpy().astype(np.int64)
                at, centre = ends[:-1] + np.array([int(np.argmax(is_cand[i:j])) for i, j in zip(ends[:-1], ends[1:], strict=True)], dtype=np.int64), np.column_stack((x, y))
                columns: list[list[np.ndarray]] = [[] for _ in range(7)]
                for page, (i, k, j) in enumerate(zip(ends[:-1], at, ends[1:], strict=True)):
                    distance, equal, cost = page_costs(texts, number[i:k], number[k:j], centre[i:k], centre[k:j], config)
                    rows, of = assignment(cost)
                    taken = np.full(k - i, -1)
                    taken[rows] = of
                    r, c = np.arange(k - i), np.maximum(taken, 0)
                    for column, values in zip(columns, (np.full(k - i, page), idx[i:k], np.where(taken >= 0, idx[k:j][c], 0), distance[r, c], equal[r, c], cost[r, c], cost.min(axis=1)), strict=True):
                        column.append(values)
                    columns[2][-1] = np.ma.masked_array(columns[2][-1], taken < 0)
                page, ref_idx, cand_idx, *rest = (np.ma.concatenate(c) for c in columns)
                none = np.ma.getmaskarray(cand_idx)
                of = pa.array(page.data)
                values = [pa.array(v.data, mask=none) for v in (cand_idx.astype(np.int32), *rest[:3])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(ref_idx.data.astype(np.int32)), *values, pa.array(rest[3].data)], names=[f.split(" ")[0] for f in ASSIGNED.split(", ")])

    return pages.mapInArrow(run, ASSIGNED)


def cheap(assigned_: DataFrame, config: Config) -> DataFrame:
    """matches() of assigned() rows."""
    return assigned_.where(F.col("cost") <= config.match_max_cost).drop("min_cost")


def unmatched(runs: DataFrame, matches_: DataFrame, side: str) -> DataFrame:
    """Runs without a match. side: ref or cand."""
    return runs.join(matches_.select(*KEYS, F.col(f"{side}_idx").alias("run_idx")), [*KEYS, "run_idx"], "left_anti")


def residual_exact(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """(keys, ref_idx, cand_idx): the k-th run of a text on one side with the k-th on the other, wherever they are."""

    def numbered(df: DataFrame, idx: str) -> DataFrame:
        return df.select(*KEYS, "norm", F.col("run_idx").alias(idx), F.row_number().over(Window.partitionBy(*KEYS, "norm").orderBy("run_idx")).alias("k"))

    return numbered(ref, "ref_idx").join(numbered(cand, "cand_idx"), [*KEYS, "norm", "k"]).select(*KEYS, "ref_idx", "cand_idx")


def residual_unmatched(ref: DataFrame, cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref, cand): what residual_exact() leaves of both sides. Both have the same columns."""
    left = left_over(ref.withColumn("_ref", F.lit(True)).unionByName(cand.withColumn("_ref", F.lit(False))), F.col("_ref"))
    return tuple(left.where(side).select(*df.columns) for side, df in ((F.col("_ref"), ref), (~F.col("_ref"), cand)))


def left_over(both: DataFrame, is_ref: Column) -> DataFrame:
    """The runs of both sides that residual_exact() leaves, without its joins: the k-th run of a text is left if the other side has the text under k times."""
    both = both.withColumn("_ref", is_ref)
    text = Window.partitionBy(*KEYS, "norm")
    other = F.when(F.col("_ref"), F.count_if(~F.col("_ref")).over(text)).otherwise(F.count_if("_ref").over(text))
    k = F.row_number().over(Window.partitionBy(*KEYS, "norm", "_ref").orderBy("run_idx"))
    # The order of the numbers serves the counts too.
    null = F.col("pair_id").isNull() | F.col("page").isNull() | F.col("norm").isNull()
    return both.withColumn("_k", k).withColumn("_n", other).where(null | (F.col("_k") > F.col("_n"))).drop("_k", "_n")


RESIDUAL = "pair_id string, page int, kind string, ref_idx int, cand_idx int, ratio double"


def split_pairs(refs: list[tuple[int, str]], cands: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Reference texts that candidates, longest first, make up but for less than a fifth; a candidate serves one text. In rising order of index."""
    free, out = dict(cands), []
    for i, text in refs:
        if len(text) < 5:
            continue
        rest, used = text, []
        for j, piece in sorted(free.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(piece) >= 4 and piece in rest:
                rest = rest.replace(piece, "", 1)
                used.append(j)
        if used and len(rest) / len(text) < 0.2:
            out += [(i, j) for j in used]
            for j in used:
                del free[j]
    return out


def fuzzy_pairs(refs: list[tuple[int, str]], cands: list[tuple[int, str]]) -> list[tuple[int, int, float]]:
    """The most similar free candidate of each reference text, if over 0.85; the first of equals. In rising order of index."""
    free, out = dict(cands), []
    for i, text in refs:
        if len(text) < 5:
            continue
        best, ratio = None, 0.0
        for j, other in free.items():
            matcher = difflib.SequenceMatcher(None, text, other)
            if matcher.real_quick_ratio() > max(ratio, 0.85) and matcher.quick_ratio() > max(ratio, 0.85) and (r := matcher.ratio()) > ratio:
                best, ratio = j, r
        if best is not None and ratio > 0.85:
            out.append((i, best, ratio))
            del free[best]
    return out


def residual(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """(RESIDUAL) exact, split and fuzzy matches among the unmatched runs of each page, in this order, each on what the one before left."""
    exact = residual_exact(ref, cand)
    left_ref, left_cand = (unmatched(df, exact, side).select(*KEYS, F.lit(side).alias("side"), "run_idx", "norm") for df, side in ((ref, "ref"), (cand, "cand")))

    def run(keys: tuple, page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("run_idx")
        refs, cands = ([(int(i), t) for i, t in zip(p["run_idx"], p["norm"], strict=True)] for p in (page[page["side"] == "ref"], page[page["side"] == "cand"]))
        split = split_pairs(refs, cands)
        gone = {i for i, _ in split}, {j for _, j in split}
        fuzzy = fuzzy_pairs([x for x in refs if x[0] not in gone[0]], [x for x in cands if x[0] not in gone[1]])
        rows = [(*keys, "split", i, j, None) for i, j in split] + [(*keys, "fuzzy", i, j, r) for i, j, r in fuzzy]
        return pd.DataFrame(rows, columns=["pair_id", "page", "kind", "ref_idx", "cand_idx", "ratio"])

    rest = left_ref.unionAll(left_cand).groupBy(*KEYS).applyInPandas(run, RESIDUAL)
    return exact.select(*KEYS, F.lit("exact").alias("kind"), "ref_idx", "cand_idx", F.lit(None).cast("double").alias("ratio")).unionAll(rest)
