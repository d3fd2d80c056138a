"""Substring dedup: MinHash banding over paragraphs, and over content-defined windows for passages inside them.

Units are of two kinds. A paragraph is a line of at least PARAGRAPH + SHINGLE - 1 (24) words, as the set of its five-word shingles, whatever its length. A window is PARAGRAPH consecutive shingles;
where windows begin follows from the words alone: in every stretch of WINDOW shingles the one of least hash begins one. Any passage of PARAGRAPH + WINDOW + 3 (51) words therefore holds the same
window wherever it stands, in the middle of a line too.

Bands of MinHash values are tuned for recall at the similarity threshold. First, band keys alone are counted over all texts. Keys that repeat are put into a
bit map of bounded size, at two places each, and in a second pass only units with a key in it are written, and units that such a one can bring into its group within its text
(so a wrong hit costs a row, and neither adds nor changes a result). A document counts once for each key, so that units of one text that overlap don't count as repeats. Equal units become one class; classes that share a band key are compared, by exact Jaccard over 32-bit hashes of shingles.
What is sent to the lists is a class and a mark of 64 bits, not its shingles. A window's mark has a bit for each shingle: sets that agree in all but D shingles differ in 2 D bits at most, so marks that differ in more rule a pair out and lose none.
A paragraph's mark has its number of shingles, and whether an even or odd number of them fall to each bit, which bounds how far two differ in the same way. Shingles are sent only for the pairs that are left.
Paragraphs in band lists of any length are compared by ``setjoin``. A band list of more than LIGHT windows isn't paired: two sets of PARAGRAPH shingles reach the threshold exactly if they agree in all but
two. So its classes are listed by pairs of six buckets of their shingles, of which similar ones share a pair, and what is in a long list again, under each of its subsets without two shingles: any two classes
with one subset in common are linked. Components of links are groups of repeats; each keeps its first occurrence, by (key, position), and the spans of the others are removed.

Defined cases: a null, blank or short text (under 24 words) has no unit; a text or line of any length is read whole; rows without key take no part; rows with equal key count as one document; a group within one
document is no repeat; ties follow (key, position); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import setjoin
from .common import Words, bit_map, gathered, hits, mix, release_memory, scratch, table, written
from .components import connected_components
from .setjoin import distinct, set_classes, short

#: Words in a shingle, shingles in a window and in a paragraph at least, shingles of which one begins a window, least Jaccard similarity, windows that are compared in pairs.
SHINGLE, PARAGRAPH, WINDOW, SIMILARITY, LIGHT = 5, 20, 28, 0.8, 24
BLOCK = 4_000_000
_PLACE = np.uint64((1 << 24) - 1)


def tuned(similarity: float, recall: float = 0.98, rows: int = 2) -> int:
    """Bands that find a pair of this similarity with this probability, at so many rows a band."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS, ROWS = tuned(SIMILARITY), 2
#: Shingles that two windows must share.
COMMON = math.ceil(2 * PARAGRAPH * SIMILARITY / (1 + SIMILARITY) - 1e-9)


def _factors(n: int) -> np.ndarray:
    """n odd multipliers from a rule."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def shingled(column: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of a block of texts, and the hash of the five words from each word on (over ends of texts too)."""
    w = Words(column)
    n = max(len(w) - SHINGLE + 1, 0)
    words, shingles = w.hashes(), np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        shingles = mix(shingles + words[k : k + n] + np.uint64(k))
    return w, shingles


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of the first word in it, words, first word in the block) of each line that is a paragraph."""
    line = np.searchsorted(np.flatnonzero(w.low[:-8] == 10), w.starts)
    cut = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(w.doc, prepend=-1) != 0))
    size = np.diff(np.append(cut, len(w)))
    cut, size = cut[size >= PARAGRAPH + SHINGLE - 1], size[size >= PARAGRAPH + SHINGLE - 1]
    return w.doc[cut], cut - w.first[w.doc[cut]], size, cut


def line_shingles(shingles: np.ndarray, cut: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of lines, one line after another; their number by line)"""
    count = size - SHINGLE + 1
    return shingles[np.repeat(cut - np.cumsum(count) + count, count) + np.arange(int(count.sum()))], count


def line_bands(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """BANDS keys of each line, from 32 bits of its shingles (repeats don't matter); none is a window's key."""
    out = np.empty((len(count), BANDS), dtype=np.uint64)
    if len(count):
        factors, begin = _factors(BANDS * ROWS), np.cumsum(count) - count
        for b in range(BANDS):
            key = np.full(len(count), BANDS + b + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = mix(key + np.minimum.reduceat(mix(values * factors[b * ROWS + r]), begin))
            out[:, b] = key
    return out


def paragraphs(w: Words, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of the first word, hashes of the PARAGRAPH shingles) of each window of a block of texts."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, PARAGRAPH), np.uint64)
    if len(shingles) < PARAGRAPH:
        return none
    starts = np.maximum(w.per_doc - (PARAGRAPH + SHINGLE - 2), 0)  # places in each text where a window fits
    keep = np.flatnonzero(starts)
    if not len(keep):
        return none
    # Least (hash, place) of windows, by doubling; places of one text are in a row, with windows cut at its last place.
    at = np.repeat(w.first[:-1][keep] - (np.cumsum(starts[keep]) - starts[keep]), starts[keep]) + np.arange(int(starts.sum()))
    if len(at) > int(_PLACE):
        raise ValueError("a block of texts has too many words")
    order = (shingles[at] & ~_PLACE) | np.arange(len(at), dtype=np.uint64)
    least, span = order, 1
    while span * 2 <= WINDOW:
        least = np.minimum(least, np.append(least[span:], least[-span:])[: len(least)])
        span *= 2
    shift = WINDOW - span
    least = np.minimum(least, np.append(least[shift:], least[-shift:] if shift else least[:0])[: len(least)])
    texts = np.repeat(keep, starts[keep])
    begins = np.cumsum(starts[keep]) - starts[keep]
    whole = np.zeros(len(at), dtype=bool)  # windows that end within their text
    inside = np.arange(len(at)) - np.repeat(begins, starts[keep])
    whole[inside + WINDOW <= np.repeat(starts[keep], starts[keep])] = True
    chosen = np.zeros(len(at), dtype=bool)
    chosen[(least[whole] & _PLACE).astype(np.int64)] = True
    short = starts[keep] < WINDOW
    if short.any():
        chosen[(np.minimum.reduceat(order, begins)[short] & _PLACE).astype(np.int64)] = True
    found = np.flatnonzero(chosen)
    return texts[found], at[found] - w.first[texts[found]], shingles[at[found][:, None] + np.arange(PARAGRAPH)]


def counted(sets: np.ndarray) -> np.ndarray:
    """Shingles, 32 bits of each, in rising order, the second of equal ones made different from the first, and so on: sets of the same size."""
    out = np.sort(sets >> np.uint64(32), axis=1)
    for _ in range(PARAGRAPH - 1):
        same = out[:, 1:] == out[:, :-1]
        if not same.any():
            break
        out[:, 1:][same] = mix(out[:, 1:][same] + np.uint64(1)) >> np.uint64(32)
        out.sort(axis=1)
    return out


def band_keys(sets: np.ndarray) -> np.ndarray:
    """BANDS keys of each set, by ROWS MinHash values each."""
    out = np.empty((len(sets), BANDS), dtype=np.uint64)
    factors = _factors(BANDS * ROWS)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key + mix(sets * factors[b * ROWS + r]).min(axis=1))
        out[:, b] = key
    return out


def marks(sets: np.ndarray) -> np.ndarray:
    """64 bits for each window, one (maybe the same) for each of its shingles."""
    return np.bitwise_or.reduce(np.uint64(1) << (mix(sets) & np.uint64(63)), axis=1)


def near_marks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which windows can share COMMON shingles: each one that is in one of them only is a bit at most."""
    return np.bitwise_count(a ^ b) <= 2 * (PARAGRAPH - COMMON)


def line_marks(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64 bits for each paragraph: its number of different shingles (16 bits, the highest number for more), and of 48 bits those to which an odd number of them fall."""
    odd = np.append(np.uint64(0), np.bitwise_xor.accumulate(np.uint64(1) << (np.uint64(16) + mix(sets.astype(np.uint64)) % np.uint64(48))))
    ends = np.cumsum(count)
    return (odd[ends] ^ odd[ends - count]) | np.minimum(count, 0xFFFF).astype(np.uint64)


def near_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which paragraphs can be similar: by their numbers of shingles, and as each shingle that is in one of them only changes one bit."""
    m, n = ((x & np.uint64(0xFFFF)).astype(np.int64) for x in (a, b))
    most = np.where(np.maximum(m, n) < 0xFFFF, (1 - SIMILARITY) / (1 + SIMILARITY) * (m + n) + 1e-6, 48)
    return (np.minimum(m, n) >= SIMILARITY * np.maximum(m, n) - 1e-6) & (np.bitwise_count((a ^ b) >> np.uint64(16)) <= most)


def _in_text(bands: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The band keys of units, each mixed with the text that has it."""
    return mix(bands.ravel() + mix(np.repeat(doc, BANDS).astype(np.uint64) + np.uint64(1)))


def joined_by(hit: np.ndarray, bands: np.ndarray, doc: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which units are hit, or may be similar to one of their own text that is, directly or by others: those that share a band key there and are ``near`` (numbers of units; in lists of over LIGHT all count as near)."""
    out = hit.copy()
    if out.all() or not out.any():
        return out
    keys = _in_text(bands, doc)
    order = np.argsort(keys, kind="stable")
    begin = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    size = np.diff(np.append(begin, len(order)))
    unit, first = order // BANDS, np.repeat(begin, size)
    left = first + np.repeat(size, size) - np.arange(len(order))  # units of a list from each one on
    many = np.repeat(size > LIGHT, size)
    links = [(unit[many], unit[first[many]])]
    left[many] = 0
    for d in range(1, int(left.max(initial=1))):
        at = np.flatnonzero(left > d)
        a, b = unit[at], unit[at + d]
        some = ~(hit[a] & hit[b]) & (a != b)
        a, b = a[some], b[some]
        some = near(a, b)
        links.append((a[some], b[some]))
    a, b = (np.concatenate(x) for x in zip(*links))
    while len(a):
        apart = out[a] != out[b]
        if not apart.any():
            break
        out[a[apart]] = out[b[apart]] = True
        a, b = a[~apart], b[~apart]
    return out


def _units(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable, Callable]]:
    """For windows, then for paragraphs: (text, first word, words, band keys, what gives classes, 32-bit sets, their sizes and marks of some of them, what tells which two can be similar)."""
    w, shingles = shingled(t.column("text"))
    doc, begin, sets = paragraphs(w, shingles)
    sets = counted(sets)

    def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        classes = np.zeros(len(at), dtype=np.uint64)
        for k in range(PARAGRAPH):
            classes = mix(classes + sets[at, k])
        return (classes & ~np.uint64(1)).view(np.int64), sets[at].astype(np.uint32).ravel(), np.full(len(at), PARAGRAPH), marks(sets[at]).view(np.int64)

    yield doc, begin, np.full(len(doc), PARAGRAPH + SHINGLE - 1), band_keys(sets), windows, lambda a, b: near_marks(marks(sets[a]), marks(sets[b]))
    doc, begin, size, cut = lines(w)
    values, count = line_shingles(shingles, cut, size)

    def whole(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        some, n = distinct(*line_shingles(shingles, cut[at], size[at]))
        flat = short(some, n)
        return set_classes(some, n) | 1, flat, n, line_marks(flat, n).view(np.int64)

    yield doc, begin, size, line_bands(values >> np.uint64(32), count), whole, lambda a, b: np.ones(len(a), dtype=bool)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of a band key that the bit map holds."""
    return keys, keys >> np.uint64(32)


def _lists_of(values: np.ndarray, count: np.ndarray, null: np.ndarray) -> pa.ListArray:
    """Lists of so many values, one after another; those of null are null."""
    count = np.where(null, 0, count)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32(), mask=np.append(null, False)), pa.array(values))


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, begin, words, class, mark, posts, shingles) of all units with a band key that another document seems to have, and of those that such a unit can bring in within its text; classes of windows are even, of paragraphs odd. Mark, posts and shingles are null for most of equal ones.

    Posts are the band keys in which a unit can meet another one that is written: those that another document seems to have, or another unit of its block has."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, BLOCK):
            for doc, _, _, bands, _, _ in _units(t):
                once = np.unique(_in_text(bands, doc), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()[once].view(np.int64))], names=["key"])

    repeated = written(rows.select("text").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "bands")
    sent = df.sparkSession.sparkContext.broadcast(bit_map(repeated.select(F.explode(F.array("key", F.shiftrightunsigned("key", 32))).alias("key"))))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, BLOCK):
            for doc, begin, size, bands, of, near in _units(t):
                hit = np.logical_and(*(hits(sent.value, x) for x in _places(bands)))
                at = np.flatnonzero(joined_by(hit.any(axis=1), bands, doc, near))
                if len(at):
                    classes, flat, count, mark = of(at)
                    copy = np.ones(len(at), dtype=bool)  # of equal units of a block, one carries the shingles
                    copy[np.unique(classes, return_index=True)[1]] = False
                    bands, hit = bands[at], hit[at]
                    _, number, times = np.unique(bands, return_inverse=True, return_counts=True)
                    post = (hit | (times[number.reshape(bands.shape)] > 1)) & ~copy[:, None]
                    yield pa.RecordBatch.from_arrays(
                        [
                            t.column("key").combine_chunks().take(pa.array(doc[at])),
                            pa.array(begin[at].astype(np.int32)),
                            pa.array(size[at].astype(np.int32)),
                            pa.array(classes),
                            pa.array(mark, mask=copy),
                            _lists_of(bands[post].view(np.int64), post.sum(axis=1), copy),
                            _lists_of(flat[np.repeat(~copy, count)].view(np.int32), count, copy),
                        ],
                        names=["key", "begin", "words", "class", "mark", "posts", "shingles"],
                    )

    return rows.mapInArrow(found, "key long, begin int, words int, class long, mark long, posts array<long>, shingles array<int>")


def _met(rows: DataFrame, light: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """rows (class, mark, post), equal ones allowed -> (post, u, v): the pairs u < v of a list of at most ``light`` classes whose marks are ``near``, and (post, u, null) for each class of a longer list (some more than once).

    Lists come one after another, in order; only one that may go on in the next batch, and is short so far, is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["post", "class", "mark"]
        held = {k: np.zeros(0, np.int64) for k in names}
        longer = None  # the post of a longer list that may go on
        for batch in chain(batches, [None]):
            now = held if batch is None else {k: np.concatenate((held[k], batch.column(i).to_numpy())) for i, k in enumerate(names)}
            post, u = now["post"], now["class"]
            if not len(post):
                continue
            new = np.append(True, (post[1:] != post[:-1]) | (u[1:] != u[:-1]))
            post, u, mark = post[new], u[new], now["mark"][new]
            begin = np.flatnonzero(np.append(True, post[1:] != post[:-1]))
            size = np.diff(np.append(begin, len(post)))
            long_ = (size > light) | (post[begin] == longer if longer is not None else False)
            if batch is not None and not long_[-1]:
                held = {"post": post[begin[-1] :], "class": u[begin[-1] :], "mark": mark[begin[-1] :]}
                post, u, mark, begin, size, long_ = post[: begin[-1]], u[: begin[-1]], mark[: begin[-1]], begin[:-1], size[:-1], long_[:-1]
                longer = None
            else:
                held, longer = {k: np.zeros(0, np.int64) for k in names}, post[-1]
            left = np.repeat(np.where(long_, 0, begin + size), size) - np.arange(len(post))  # classes of a short list from each one on
            alone = np.flatnonzero(np.repeat(long_, size))
            yield pa.RecordBatch.from_arrays([pa.array(post[alone]), pa.array(u[alone]), pa.nulls(len(alone), pa.int64())], names=["post", "u", "v"])
            for d in range(1, int(size[~long_].max(initial=1))):
                at = np.flatnonzero(left > d)
                at = at[near(mark[at].view(np.uint64), mark[at + d].view(np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (post[at], u[at], u[at + d])], names=["post", "u", "v"])
        release_memory()

    return rows.select("post", "class", "mark").repartition("post").sortWithinPartitions("post", "class").mapInArrow(run, "post long, u long, v long")


def _stars(rows: DataFrame) -> DataFrame:
    """rows (class, post) -> (u, v): the least class of each list, and each other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = least = None  # post of the list that may go on, its least class
        for batch in batches:
            post, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(post):
                begin = np.flatnonzero(np.append(True, post[1:] != post[:-1]))
                first = v[begin]
                if post[0] == last:
                    first[0] = least
                last, least = post[-1], first[-1]
                u = np.repeat(first, np.diff(np.append(begin, len(post))))
                other = np.flatnonzero(u != v)
                yield pa.RecordBatch.from_arrays([pa.array(u[other]), pa.array(v[other])], names=["u", "v"])
        release_memory()

    return rows.select("post", "class").repartition("post").sortWithinPartitions("post", "class").mapInArrow(run, "u long, v long")


def _of(classes: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """(class, shingles) of ids (id), once each, and of a few other classes: what is not in a bit map of them isn't sent."""
    sent = classes.sparkSession.sparkContext.broadcast(bit_map(ids.select(F.shiftrightunsigned("id", 1).alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(sent.value, batch.column(0).to_numpy().view(np.uint64) >> np.uint64(1))))
        release_memory()

    return written(classes.select("class", "shingles").mapInArrow(run, "class long, shingles array<int>").dropDuplicates(["class"]), label)


def _posted(classes: DataFrame, keys) -> DataFrame:
    """A row (class, mark, post) for each of the keys (matrix of numbers) that ``keys`` makes of each class's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                sets = batch.column(1).flatten().to_numpy().view(np.uint32).astype(np.uint64).reshape(-1, PARAGRAPH)
                posts = keys(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), posts.shape[1]))), pa.array(np.repeat(marks(sets).view(np.int64), posts.shape[1])), pa.array(posts.ravel().view(np.int64))], names=["class", "mark", "post"])
        release_memory()

    return classes.select("class", "shingles").mapInArrow(run, "class long, mark long, post long")


def bucket_keys(sets: np.ndarray) -> np.ndarray:
    """Shingles fall into buckets by their hash. Sets that differ in D shingles on each side differ in 2 D buckets at most; with two more buckets than that, they agree in two: a key for each pair of buckets."""
    n = 2 * (PARAGRAPH - COMMON) + 2
    mixed, bucket = mix(sets), sets % np.uint64(n)
    sums = np.stack([np.where(bucket == np.uint64(k), mixed, np.uint64(0)).sum(axis=1, dtype=np.uint64) for k in range(n)], axis=1)
    return np.stack([mix(mix(sums[:, a] + np.uint64(n * a + b)) + sums[:, b]) for a, b in combinations(range(n), 2)], axis=1)


def subset_keys(sets: np.ndarray) -> np.ndarray:
    """A key for each subset of COMMON shingles."""
    out = np.array(list(combinations(range(PARAGRAPH), PARAGRAPH - COMMON)), dtype=np.int64)
    mixed = mix(sets)
    return mixed.sum(axis=1, dtype=np.uint64)[:, None] - mixed[:, out].sum(axis=2, dtype=np.uint64)


def _ids(met: DataFrame) -> DataFrame:
    """Classes of a pair or of a longer list."""
    return met.select("u").unionAll(met.where("v is not null").select("v")).withColumnRenamed("u", "id").distinct()


def links(classes: DataFrame, light: int = LIGHT, posted: DataFrame | None = None) -> DataFrame:
    """classes (class, shingles), equal ones allowed -> (u, v), some more than once: classes of a Jaccard similarity of SIMILARITY or more, enough of them to connect what meets in a band. posted: (class, mark, post) by bands, if that is known.

    Classes of long band lists are listed again by pairs of buckets, which anything similar agrees in; those of lists that are still long, by subsets."""
    met = written(_met(_posted(classes, band_keys) if posted is None else posted, light, near_marks).select("u", "v").distinct(), "bands-met")
    sets = _of(classes, _ids(met), "sets")
    of = lambda met: sets.join(met.where("v is null").select(F.col("u").alias("class")), "class", "left_semi")
    again = written(_met(_posted(of(met), bucket_keys), light, near_marks).select("u", "v").distinct(), "buckets-met")
    pairs = met.unionAll(again).where("v is not null").distinct()
    both = pairs.join(sets.select(F.col("class").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("class").alias("v"), F.col("shingles").alias("b")), "v")
    near = both.where(F.size(F.array_intersect("a", "b")) >= COMMON).select("u", "v")
    return near.unionAll(_stars(_posted(of(again), subset_keys)))


def line_groups(classes: DataFrame, posted: DataFrame) -> DataFrame:
    """classes (class, shingles) of paragraphs, equal ones allowed, and posted (class, mark, post) by bands -> (node, component) of those that are connected by a similarity of SIMILARITY or more, among what meets in a band."""
    met = written(_met(posted, setjoin.LIGHT, near_lines).distinct(), "line-lists")
    heavy = met.where("v is null").select("post", F.col("u").alias("id"))
    heavy = written(heavy.join(heavy.groupBy("post").agg(F.count("*").alias("n")), "post"), "line-lists-long")
    sets = _of(classes, _ids(met), "line-sets")
    long_ = _of(sets, heavy.select("id").distinct(), "line-sets-long")
    return setjoin.linked(met.where("v is not null").select("u", "v").distinct(), heavy, sets.withColumnRenamed("class", "id"), SIMILARITY, long_.withColumnRenamed("class", "id"))


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each unit that other documents have too: key, begin and end (word numbers), component, first (does this occurrence stay)."""
    found = written(candidates(df, key, text), "units")
    windows, whole = (found.where(f"class & 1 = {k} AND mark is not null") for k in (0, 1))
    posted = lambda units: units.select("class", "mark", F.explode("posts").alias("post"))
    groups = connected_components(links(windows, posted=posted(windows))).unionAll(line_groups(whole, posted(whole))).withColumnRenamed("node", "class")
    named = found.select("key", "begin", "words", "class").join(groups, "class", "left").select("key", "begin", "words", F.coalesce("component", "class").alias("component"))
    named = written(named, "named")
    # A row for each component, written, so that the rows of a very common one can be dealt to many tasks in the join.
    kept = written(named.groupBy("component").agg(F.min(F.struct("key", "begin")).alias("_first"), F.max("key").alias("_last")).where("_first.key <> _last"), "firsts")
    out = named.join(kept, "component")
    return out.select(F.col("key").alias(key), "begin", (F.col("begin") + F.col("words")).alias("end"), "component", (F.struct("key", "begin") == F.col("_first")).alias("first"))


def merged(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """repeats() by document: key, n_paragraphs, spans and removed (word numbers from, to; overlapping ones joined), removed_words."""

    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])

    def joined(row: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> pa.ListArray:
        """Spans of n rows, overlapping ones joined (by row, in order)."""
        order = np.lexsort((begin, row))
        row, begin, end = row[order], begin[order], end[order]
        reach = np.maximum.accumulate(end + (row << 32)) if len(row) else row  # of a row's spans so far: those of earlier rows lie below
        new = np.append(True, begin[1:] + (row[1:] << 32) > reach[:-1])[: len(row)]
        at = np.flatnonzero(new)
        ends = (reach - (row << 32))[np.append(at[1:], len(row))[: len(at)] - 1]
        parts = pa.StructArray.from_arrays([pa.array(begin[at].astype(np.int32)), pa.array(ends.astype(np.int32))], fields=list(span))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(n + 1)), pa.int32()), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists, flat = batch.num_rows, batch.column(1), batch.column(1).flatten()
            row = np.repeat(np.arange(n, dtype=np.int64), lists.value_lengths().to_numpy())
            begin, end = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            gone = ~flat.field(2).to_numpy(zero_copy_only=False)
            removed = joined(row[gone], begin[gone], end[gone], n)
            words = np.bincount(np.repeat(np.arange(n), removed.value_lengths().to_numpy()), weights=pc.subtract(removed.flatten().field(1), removed.flatten().field(0)).to_numpy(), minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.value_lengths(), joined(row, begin, end, n), removed, pa.array(words.astype(np.int64))], names=[key, "n_paragraphs", "spans", "removed", "removed_words"])

    spans = "array<struct<begin:int,end:int>>"
    by_doc = df.groupBy(key).agg(F.collect_list(F.struct("begin", "end", "first")).alias("list"))
    return by_doc.mapInArrow(run, f"`{key}` long, n_paragraphs int, spans {spans}, removed {spans}, removed_words long")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as tables:
        return tables.kept(merged(repeats(table(spark, sf_dir, "documents"))), "substrings")
