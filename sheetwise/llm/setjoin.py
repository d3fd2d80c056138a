"""Comparing sets that meet in posting lists: exact Jaccard similarity, and components of what is similar, without pairs of long lists.

Pairs of short lists (LIGHT sets at most) are compared one by one. Longer lists are compared in blocks: the sets of a list are dealt into chunks of about CHUNK, and two chunks are compared as a whole, from one
matrix of overlaps, which gives enough links to connect what is similar. In LINKING rounds each set chooses one of its long lists, and what chose a list is compared within its chunks, dealt anew; that joins large
groups of copies. At last every long list that still has sets of different components is compared in full. If all but FEW of its sets are of one component, those few are paired with all sets of the list
that are not of their component, each pair once for all lists. In other lists sets go into chunks in the order of components: two chunks of one component are left out, as what they could link is linked already.
So no link between components is lost, whatever the length of lists.

Sets are compared by 32-bit hashes of their elements, kept different within a set: two different elements of a pair are taken for one in some ten thousandth of the pairs of 500 elements.

Sets weigh by their elements (LONG of them weigh as one set), and chunks are filled by weight, so a list of long texts has more chunks, not larger ones; overlaps are added up over ranges of hashes, HELD elements at a time.

Defined cases: a set that comes twice is compared twice; a list of one set links nothing; an empty set is similar to none; tables without rows give no components.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, written
from .components import connected_components

#: Sets in a list that is compared pair by pair, in a chunk, rounds of chosen lists within chunks, sets outside of a list's largest component that are paired with the others.
LIGHT, CHUNK, LINKING, FEW = 10, 512, 2, 16
#: Columns of a matrix of overlaps, and elements of its sets, that are held at once; elements of a set that weighs as one.
COLUMNS, HELD, LONG = 4096, 1 << 19, 1000


def distinct(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of every text in rising order, their number by text)"""
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(count))


def set_classes(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """63 bits for each set, whatever the order."""
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets), dtype=np.uint64)))
    ends = np.cumsum(count)
    return (mix(running[ends] - running[ends - count] + count.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def short(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """32 bits of each shingle; where two of a set are the same, the later one by rank is changed by a rule, so that a set keeps its size."""
    out = (sets >> np.uint64(32)).astype(np.uint32)  # in rising order within a set
    first = np.zeros(len(out), dtype=bool)
    first[(np.cumsum(count) - count)[count > 0]] = True
    for _ in range(64):
        same = np.flatnonzero((out[1:] == out[:-1]) & ~first[1:]) + 1
        if not len(same):
            break
        out[same] = (mix(out[same].astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of that Jaccard similarity or more."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= similarity * (F.size("a") + F.size("b") - common) - 1e-9).select("u", "v")


def overlaps(flat: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared elements of each set of left with each of right (numbers of sets; flat: all sets, one after another)."""
    parts = -(-len(flat) // HELD)
    if parts <= 1:
        return _overlaps(flat, np.repeat(np.arange(len(size), dtype=np.int32), size), len(size), left, right)
    owner, part = np.repeat(np.arange(len(size), dtype=np.int32), size), (mix(flat.view(np.uint32)) % np.uint64(parts)).astype(np.int32)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for k in range(parts):
        mine = np.flatnonzero(part == k)
        out += _overlaps(flat[mine], owner[mine], len(size), left, right)
    return out


def _overlaps(flat: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """overlaps() of elements with the numbers of their sets, of n sets."""
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1  # others are in one set
    column, owner = column[keep], owner[keep]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        matrix = np.zeros((n, COLUMNS), dtype=np.float32)
        matrix[owner[i:j], column[i:j] - a] = 1
        out += matrix[left] @ matrix[right].T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) of a matrix of links between rows and columns, as many as connect the same."""
    rows_left, columns_left, out = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool), []
    for start in np.flatnonzero(linked.any(axis=1)):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        todo = [(int(start), True)]
        while todo:
            x, is_row = todo.pop()
            found = np.flatnonzero(linked[x] & columns_left) if is_row else np.flatnonzero(linked[:, x] & rows_left)
            (columns_left if is_row else rows_left)[found] = False
            out += [(x, int(y)) if is_row else (int(y), x) for y in found]
            todo += [(int(y), not is_row) for y in found]
    return out


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """rows (post, i, j, chunk, id, component, shingles) -> links (u, v) between sets of chunks i and j of a list that are of different components."""

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, component, chunk = (t.column(k).to_numpy() for k in ("id", "component", "chunk"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        links = []
        apart = component[left][:, None] != component[right][None, :]
        if apart.any():
            shingles = t.column("shingles").combine_chunks()
            size = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            common = overlaps(shingles.flatten().to_numpy(), size, left, right).astype(np.float64)
            links = forest(apart & (common >= similarity * (size[left][:, None] + size[right][None, :] - common) - 1e-9))
        return pa.table({"u": pa.array([ids[left[a]] for a, _ in links], pa.int64()), "v": pa.array([ids[right[b]] for _, b in links], pa.int64())})

    return rows.groupBy("post", "i", "j").applyInArrow(compare, "u long, v long")


def _within(lists: DataFrame, sets: DataFrame, similarity: float, salt: int) -> DataFrame:
    """Links within chunks of lists (post, id, n, component), dealt by hash. Each set is in the one list that it chooses, so a set is sent once."""
    lists = lists.groupBy("id", "component").agg(F.min_by(F.struct("post", "n"), F.xxhash64("post", F.lit(salt))).alias("x")).select("id", "component", "x.*")
    chunk = F.pmod(F.xxhash64("id", "post", F.lit(salt)), F.ceil(F.col("n") / CHUNK)).cast("int")
    dealt = lists.withColumn("chunk", chunk).select("post", F.col("chunk").alias("i"), F.col("chunk").alias("j"), "chunk", "id", "component")
    return _compared(dealt.join(sets, "id"), similarity)


def _across(lists: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between any two sets of a list that are of different components. A list's sets are put into chunks in the order of components, each chunk of one component where that has CHUNK sets or more; chunks of one and the same component don't meet."""
    parts = lists.groupBy("post", "component").agg(F.sum("weight").alias("m"))
    before = Window.partitionBy("post").orderBy(F.desc("m"), "component").rowsBetween(Window.unboundedPreceding, -1)
    # Large components have chunks of their own, numbered one after another; the small ones of a list share the chunks after these.
    parts = parts.withColumn("own", F.when(F.col("m") >= CHUNK, F.ceil(F.col("m") / CHUNK)).otherwise(0)).withColumn("small", F.when(F.col("m") < CHUNK, F.col("m")).otherwise(0))
    parts = parts.withColumn("base", F.coalesce(F.sum("own").over(before), F.lit(0))).withColumn("place", F.coalesce(F.sum("small").over(before), F.lit(0)))
    totals = parts.groupBy("post").agg(F.sum("own").alias("large"), F.sum("small").alias("rest")).withColumn("chunks", F.col("large") + F.ceil(F.col("rest") / CHUNK))
    dealt = lists.join(parts.drop("small"), ["post", "component"]).join(totals, "post")
    chunk = F.when(F.col("own") > 0, F.col("base") + F.pmod(F.xxhash64("id"), F.greatest("own", F.lit(1)))).otherwise(F.col("large") + F.floor(F.col("place") / CHUNK)).cast("int")
    # A set is sent once for each chunk that it meets: not for the chunks of its own component, so sets of the main component go to the few chunks of the others only.
    every = F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)
    others = F.filter(every, lambda c: (c < F.col("base")) | (c >= F.col("base") + F.col("own")))
    met = dealt.withColumn("chunk", chunk).withColumn("other", F.explode(others))
    return _compared(met.select("post", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "component").join(sets, "id"), similarity)


def _apart(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """(post, id, n, weight, component) of the lists that have sets of more than one component."""
    labelled = lists.join(groups, lists["id"] == groups["node"], "left").select("post", "id", "n", "weight", F.coalesce("component", "id").alias("component"))
    several = labelled.groupBy("post").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("post")
    return labelled.join(several, "post")


def linked(pairs: DataFrame, heavy: DataFrame, sets: DataFrame, similarity: float, heavy_sets: DataFrame | None = None) -> DataFrame:
    """(node, component) of sets that are connected by similar pairs: pairs (u, v), and any two sets of a list of heavy (post, id, n, and weight unless that is 1; n: the list's weight). sets: id, shingles; heavy_sets: those of heavy, where these are few beside all sets, as they are sent several times."""
    found, groups = [_similar(pairs, sets, similarity)], None
    sets = sets if heavy_sets is None else heavy_sets
    heavy = heavy if "weight" in heavy.columns else heavy.withColumn("weight", F.lit(1))
    for k in range(LINKING + 1):
        now = heavy.withColumn("component", F.col("id")) if groups is None else written(_apart(heavy, groups), "apart")
        if k < LINKING:
            found.append(_within(now, sets, similarity, k))
        else:
            parts = now.groupBy("post", "component").agg(F.count("*").alias("m")).groupBy("post").agg(F.max_by("component", F.struct("m", "component")).alias("main"), (F.sum("m") - F.max("m")).alias("rest"))
            now = written(now.join(parts, "post"), "apart")
            many = now.where(F.col("rest") > FEW).drop("main", "rest")
            a = now.where((F.col("rest") <= FEW) & (F.col("component") != F.col("main"))).select("post", F.col("id").alias("a"), F.col("component").alias("_a"))
            b = now.where(F.col("rest") <= FEW).select("post", F.col("id").alias("b"), F.col("component").alias("_b"))
            few = a.join(b, "post").where("_a <> _b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
            found += [_similar(few, sets, similarity), _across(many, sets, similarity)]
        edges, found = written(reduce(DataFrame.unionAll, found), "links"), []
        if groups is None or not edges.isEmpty():
            groups = written(_relabelled(edges, groups), "groups")
    return groups


def _relabelled(edges: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(node, component) after more links: components of the components that they join."""
    if groups is None:
        return connected_components(edges)
    label = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    told = edges.join(label("u"), "u", "left").join(label("v"), "v", "left").select("u", "v", F.coalesce("u_label", "u").alias("a"), F.coalesce("v_label", "v").alias("b"))
    joined = connected_components(told.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("after"))
    nodes = groups.unionByName(told.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("a").alias("component")), F.struct(F.col("v").alias("node"), F.col("b").alias("component")))).alias("x")).select("x.*")).distinct()
    return nodes.join(joined, "component", "left").select("node", F.coalesce("after", "component").alias("component"))
