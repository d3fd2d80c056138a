"""A hidden Markov language model that is learnt from, and scores, whole texts.

A text is a sequence of words and one end token. Hidden states emit word classes: each of the most frequent words (OWN at most) and the end token are classes of
their own, other words share a class with those that end alike. A word of a shared class then has its smoothed share of the class's training tokens, with room for
one unseen word; so the model is a distribution over texts, and the likelihood of a text is exact: scaled forward recursion over its classes, times the words' shares.

Learning: all training tokens are counted (in Arrow blocks first, then by shuffle). Start values come from a few rounds of Baum-Welch on the beginnings of some SAMPLE texts. Then the classes of all
training texts are written once, two bytes a token, and in each round expected counts of states and classes over all of them are taken in each task and added up over tasks, with over-relaxed steps, until a round raises the
log-likelihood by less than SETTLED of it. Counts of states and classes are some ten thousand rows at any size.

Scoring: counts of frequent words (LOOKUP at most) are sent to every task; they cover most tokens, and without them no word is frequent enough to be a hot key. The other words of each text are joined with
the table of counts, which may be of any size.

Defined cases: a null, empty or blank text is the end token alone; texts of any length are scored whole; rows without doc_id are scored, their fold is the one of an empty id (not held out); repeated rows are scored each; without
training rows every token has the base probability 1 and states are uniform; of words that are equally frequent all or none have a class of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, drop_written, gathered, held_out, mix, release_memory, scratch, table, text_buffer, written

#: Words with a class of their own, words whose counts every task gets, shared classes (a power of two), states, texts for the start values, characters of each, their rounds, least gain of a round over all training texts, rounds after which something is wrong.
OWN, LOOKUP, SHARED_BITS, STATES, SAMPLE, START_CHARS, START_ROUNDS, SETTLED, MOST_ROUNDS = 8192, 131_072, 10, 8, 600, 16_000, 12, 1e-4, 200
SHARED, HASH_BITS, END = 1 << SHARED_BITS, 63 - SHARED_BITS, -1
#: How much longer each step is than the one before, and a step's length at most.
STRETCH, MOST_STRETCH = 1.4, 6.0
#: Bytes of text that a task works on at once.
BLOCK = 8_000_000
#: Tokens that a task of a round holds as packed classes, and works on at once.
HELD, AT_ONCE = 16_000_000, 1_000_000


def word_ids(w: Words) -> np.ndarray:
    """63 bits for each word; the upper ones number the shared class, by the last three bytes."""
    size, at = w.ends - w.starts, w.ends
    last = w.low[at - 1].astype(np.uint64)
    for k in (2, 3):
        last |= np.where(size >= k, w.low[np.maximum(at - k, 0)], 0).astype(np.uint64) << np.uint64(8 * (k - 1))
    shared = mix(last + np.uint64(1)) >> np.uint64(64 - SHARED_BITS)
    return (shared << np.uint64(HASH_BITS) | w.hashes() >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def count_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(id, c) of all tokens, end tokens too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for t in gathered(batches, 2 * BLOCK, text):
            ids, counts = np.unique(word_ids(Words(t.column(text))), return_counts=True)
            ends += t.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["id", "c"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([ends], pa.int64())], names=["id", "c"])

    return texts.select(text).mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """ids, counts, classes: the frequent words, by id. classes 0..own-1 are words' own, then SHARED shared ones, then the end token's."""

    ids: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    own: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int

    @property
    def size(self) -> int:
        return self.own + SHARED + 1

    @property
    def number(self) -> np.dtype:
        """What holds the number of a class."""
        return np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    @property
    def base_total(self) -> float:
        return self.tokens + 0.5 * (self.words + 1)

    def class_total(self) -> np.ndarray:
        return self.class_tokens + 0.5 * (self.class_words + 1)

    def look(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, class, is it frequent) for each word id."""
        if not len(self.ids):
            return np.zeros(len(ids), np.int64), self.own + (ids >> HASH_BITS), np.zeros(len(ids), bool)
        at = np.searchsorted(self.ids, ids)
        at[at == len(self.ids)] = 0
        hit = self.ids[at] == ids
        return np.where(hit, self.counts[at], 0), np.where(hit, self.classes[at], self.own + (ids >> HASH_BITS)), hit


def _weight(c: str):
    """Counts in steps of a sixteenth power of two: a thousand of them at most."""
    return F.floor(F.log2(F.col(c).cast("double")) * 16).cast("int")


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The frequent words, and the weight from which on words are frequent. Brings LOOKUP rows to the driver at most."""
    by_weight = sorted(((r["w"], r["n"]) for r in counts.where(F.col("id") != END).groupBy(_weight("c").alias("w")).agg(F.count("*").alias("n")).collect()), reverse=True)
    limits = {}
    for name, most in (("own", OWN), ("lookup", LOOKUP)):
        total, limits[name] = 0, 1 << 20
        for w, n in by_weight:
            total += n
            if total > most:
                break
            limits[name] = w
    frequent = counts.where((F.col("id") != END) & (_weight("c") >= limits["lookup"])).select("id", "c", (_weight("c") >= limits["own"]).alias("own")).toArrow().sort_by("id")
    ids, c, own = (frequent.column(k).to_numpy() for k in ("id", "c", "own"))
    classes = np.where(own, np.cumsum(own) - 1, own.sum() + (ids >> HASH_BITS))
    shared = counts.where((F.col("id") != END) & (_weight("c") < limits["own"])).groupBy(F.shiftright("id", HASH_BITS).alias("class")).agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).collect()
    tokens, words = np.zeros(SHARED), np.zeros(SHARED)
    for r in shared:
        tokens[r["class"]], words[r["class"]] = r["tokens"], r["words"]
    whole = counts.agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).first()
    return Vocabulary(ids.astype(np.int64), c.astype(np.int64), classes.astype(np.int64), int(own.sum()), tokens, words, int(whole["tokens"] or 0), int(whole["words"])), limits["lookup"]


@dataclass
class Model:
    start: np.ndarray  # by state
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # by class, state


def sequences(classes: np.ndarray, per_doc: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts, an end after each, laid out by position: (classes, first index of each position, rank of each text, text of each rank).

    Texts are ranked by length, longest first; position t of the text of rank r is at first[t] + r."""
    length = per_doc + 1
    order = np.argsort(-length, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    alive = np.bincount(length - 1)[::-1].cumsum()[::-1]  # texts that have position t
    first = np.concatenate(([0], np.cumsum(alive)))
    out = np.empty(int(length.sum()), dtype=np.int64)
    position = np.arange(len(classes)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    out[first[position] + np.repeat(rank, per_doc)] = classes
    out[first[per_doc] + rank] = end
    return out, first, rank, order


def _relative(m: Model, kind: type) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean emission of each class over the states, emissions relative to it, positions from one scaling to the next).

    A position changes a sum of relative forward probabilities by a factor from the least relative emission up to the number of states; scaling is as seldom as ``kind`` holds the product of such factors."""
    level = m.emit.mean(axis=1)
    ratio = m.emit / level[:, None]
    most = max(np.log10(len(m.start)), -np.log10(max(float(ratio.min(initial=1.0)), 1e-300)), 1e-9)
    return level, ratio.astype(kind), max(1, min(64, int((20 if kind == np.float32 else 200) / most)))


def _ends(first: np.ndarray) -> np.ndarray:
    """Index of the last position of each rank."""
    alive = np.diff(first)
    length = np.searchsorted(-alive, -np.arange(1, alive[0] + 1), side="right") if len(alive) else np.zeros(0, np.int64)
    return first[length - 1] + np.arange(len(length))


def forward(m: Model, laid: np.ndarray, first: np.ndarray, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """(natural log-likelihood by rank, scaled forward probabilities by index, what each position was multiplied by). Probabilities are relative to the classes' mean emissions until the end."""
    level, ratio, every = _relative(m, kind)
    a, move, ones = np.take(ratio, laid, axis=0), m.move.astype(kind), np.ones(len(m.start), dtype=kind)
    at = first.tolist()
    log, scales = np.zeros(at[1] if len(at) > 1 else 0), [None] * max(len(at) - 1, 0)
    a[: len(log)] *= m.start.astype(kind)
    for t in range(1, len(at) - 1):
        i, j = at[t], at[t + 1]
        here = a[i:j]
        here *= a[at[t - 1] : at[t - 1] + j - i] @ move
        if t % every == 0:
            s = here @ ones
            scales[t] = (1 / s)[:, None]
            here *= scales[t]
            log[: j - i] += np.log(s)
    if len(log):
        place = np.arange(len(laid)) - np.repeat(first[:-1], np.diff(first))  # ranks
        log += np.log((a[_ends(first)] @ ones).astype(np.float64)) + np.bincount(place, np.log(level)[laid], len(log))
    return log, a, scales


def expected(m: Model, laid: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of Baum-Welch over the texts: starts, moves, and emissions by class and state; the log-likelihood of the texts."""
    states = len(m.start)
    if not len(laid):
        return np.zeros(states), np.zeros((states, states)), np.zeros((len(m.emit), states)), 0.0
    log, a, scales = forward(m, laid, first, np.float32)
    back, x, at = np.ascontiguousarray(m.move.T.astype(np.float32)), np.take(_relative(m, np.float32)[1], laid, axis=0), first.tolist()
    b, ends = np.empty_like(a), _ends(first)
    b[ends] = 1 / a[ends].sum(axis=1, keepdims=True)  # so that forward times backward is a distribution at each index
    for t in range(len(at) - 3, -1, -1):
        j, k = at[t + 1], at[t + 2]
        there = x[j:k]
        there *= b[j:k]
        if scales[t + 1] is not None:
            there *= scales[t + 1]
        np.matmul(there, back, out=b[at[t] : at[t] + k - j])
    moves, alive = np.zeros((states, states)), np.diff(first)
    before = np.arange(at[1], len(laid)) - np.repeat(alive[:-1], alive[1:])
    for i in range(0, len(before), 1 << 16):
        some = before[i : i + (1 << 16)]
        moves += np.take(a, some, axis=0).T @ x[at[1] + i : at[1] + i + len(some)]
    a *= b
    by_state = np.ascontiguousarray(a.T)
    emissions = np.stack([np.bincount(laid, row, len(m.emit)) for row in by_state], axis=1)
    return a[: at[1]].sum(axis=0, dtype=np.float64), moves * m.move, emissions, float(log.sum())


def maximised(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, share: np.ndarray) -> Model:
    """share: of the classes in all training tokens; every state has some of it, so that no class is impossible."""
    emit = emissions + 50.0 * share[:, None]
    moves = moves + 1.0
    return Model((starts + 1) / (starts + 1).sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def start_model(share: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = share[:, None] * rng.gamma(2.0, 0.5, (len(share), states))
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def class_shares(v: Vocabulary, texts: int) -> np.ndarray:
    tokens = np.zeros(v.size)
    own = v.classes < v.own
    tokens[v.classes[own]] = v.counts[own]
    tokens[v.own : v.own + SHARED] = v.class_tokens
    tokens[-1] = texts
    return (tokens + 0.5) / (tokens + 0.5).sum()


def _laid(t: pa.Table, v: Vocabulary, text: str) -> tuple:
    w = Words(t.column(text))
    ids = word_ids(w)
    count, classes, hit = v.look(ids)
    return w, ids, count, classes, hit, sequences(classes, w.per_doc, v.size - 1)


def packed(texts: DataFrame, v: Vocabulary, text: str = "text") -> DataFrame:
    """(classes binary): the classes of each text's words, without its end, as little-endian numbers of two bytes (four if there are so many classes). What the rounds read, so that none tokenises again."""
    sent = texts.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for t in gathered(batches, BLOCK, text):
            w = Words(t.column(text))
            raw = v.look(word_ids(w))[1].astype(v.number)
            ends = pa.array(w.first * v.number.itemsize, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.LargeBinaryArray.from_buffers(pa.large_binary(), t.num_rows, [None, ends.buffers()[1], pa.py_buffer(raw)]).cast(pa.binary())], names=["classes"])

    return texts.select(text).mapInArrow(run, "classes binary")


def like_lengths(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, tokens by text) of about AT_ONCE tokens from packed rows, texts of like length together: long texts don't make every block have many positions."""
    width = v.number.itemsize
    for t in gathered(batches, HELD * width, "classes"):
        flat, offsets = text_buffer(t.column("classes"))
        flat, offsets = flat.view(v.number), offsets // width
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        filled = np.cumsum(size[order] + 1)
        begin = 0
        while begin < len(order):
            stop = max(begin + 1, int(np.searchsorted(filled, (filled[begin - 1] if begin else 0) + AT_ONCE, side="right")))
            some = order[begin:stop]
            n = size[some]
            yield flat[np.repeat(offsets[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].astype(np.int64), n
            begin = stop


def baum_welch(sequences_of: DataFrame, v: Vocabulary, m: Model, share: np.ndarray) -> tuple[Model, float]:
    """One round over all packed texts: the next model, and the log-likelihood under m. Expected counts are added up in each task, then over tasks."""
    spark, states = sequences_of.sparkSession, len(m.start)
    sent = spark.sparkContext.broadcast((v, m))
    names = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = sent.value
        total = None
        for classes, per_doc in like_lengths(batches, v):
            found = expected(m, *sequences(classes, per_doc, v.size - 1)[:2])
            total = found if total is None else tuple(a + b for a, b in zip(total, found, strict=True))
        release_memory()
        if total is not None:
            starts, moves, emissions, log = total
            used = np.flatnonzero(emissions.any(axis=1))
            index = np.concatenate((used, [-1], -2 - np.arange(states), [-2 - states]))
            values = np.vstack((emissions[used], starts, moves, np.full(states, log)))
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), *(pa.array(values[:, k]) for k in range(states))], names=["index", *names])

    sums = sequences_of.mapInArrow(run, "index long, " + ", ".join(f"{n} double" for n in names)).groupBy("index").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    sent.unpersist()
    index = sums.column("index").to_numpy()
    values = np.stack([sums.column(n).to_numpy() for n in names], axis=1) if len(index) else np.zeros((0, states))
    starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((v.size, states))
    emissions[index[index >= 0]] = values[index >= 0]
    starts += values[index == -1].sum(axis=0)
    inner = (index < -1) & (index >= -1 - states)
    moves[-2 - index[inner]] = values[inner]
    return maximised(starts, moves, emissions, share), float(values[index == -2 - states].sum() / states)


def stretched(m: Model, estimate: Model, step: float) -> Model:
    """The model ``step`` times as far from m as the estimate, in logarithms."""

    def part(old: np.ndarray, new: np.ndarray, axis: int) -> np.ndarray:
        log = np.log(old) + step * (np.log(new) - np.log(old))
        x = np.exp(log - log.max(axis=axis, keepdims=True))
        return x / x.sum(axis=axis, keepdims=True)

    return Model(part(m.start, estimate.start, 0), part(m.move, estimate.move, 1), part(m.emit, estimate.emit, 0))


def settled(sequences_of: DataFrame, v: Vocabulary, m: Model, share: np.ndarray) -> tuple[Model, list[float]]:
    """Rounds over all packed texts until the log-likelihood settles: (model, log-likelihood before each round).

    Steps are over-relaxed: while the likelihood rises, the next model is ever further on the way from the last one to the round's estimate; a step that loses likelihood is taken back to the plain estimate."""
    logs: list[float] = []
    best, plain, step = -np.inf, m, 1.0
    while len(logs) < MOST_ROUNDS:
        estimate, log = baum_welch(sequences_of, v, m, share)
        logs.append(log)
        if log < best and step > 1.0:
            m, step = plain, 1.0
            continue
        if log - best <= SETTLED * abs(log):
            return estimate, logs
        best, plain = log, estimate
        m = estimate if len(logs) == 1 else stretched(m, estimate, step)
        step = min(step * STRETCH, MOST_STRETCH)
    raise RuntimeError("the likelihood did not settle")


def train(texts: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Vocabulary, DataFrame, int, Model]:
    """(frequent words, table of counts, weight from which words are frequent, model)"""
    counts = written(count_words(texts, text), "counts")
    v, weight = vocabulary(counts)
    n = counts.where(F.col("id") == END).agg(F.sum("c")).first()[0] or 0
    share = class_shares(v, n)
    rows = texts.where((F.shiftrightunsigned(F.xxhash64(key, F.lit("start")), 1) / float(1 << 63)) < (1.0 if n <= SAMPLE else (SAMPLE - 4 * SAMPLE**0.5) / n)).select(key, F.substring(text, 1, START_CHARS).alias(text)).limit(2 * SAMPLE).toArrow().sort_by(key)
    m = start_model(share)
    if rows.num_rows:
        laid, first, _, _ = _laid(rows, v, text)[-1]
        for _ in range(START_ROUNDS):
            m = maximised(*expected(m, laid, first)[:3], share)
    rows = written(packed(texts, v, text), "sequences")
    m, _ = settled(rows, v, m, share)
    drop_written(rows)
    return v, counts, weight, m


def score(texts: DataFrame, v: Vocabulary, counts: DataFrame, weight: int, m: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) for each row; scores are log10 probabilities."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((v, m))
    ends = int(counts.where(F.col("id") == END).agg(F.sum("c")).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = sent.value
        base, within = np.log10(v.base_total), np.log10(v.class_total())
        row = TaskContext.get().partitionId() << 40
        for t in gathered(batches, BLOCK, text):
            w, ids, count, classes, hit, (laid, first, rank, order) = _laid(t, v, text)
            n = t.num_rows
            by_rank = forward(m, laid, first)[0] / np.log(10)
            log = np.log10(count[hit] + 0.5)
            base_sum = np.bincount(w.doc[hit], log - base, n) + np.log10(ends + 0.5) - base
            shared = hit & (classes >= v.own)
            share_sum = np.bincount(w.doc[shared], np.log10(count[shared] + 0.5) - within[classes[shared] - v.own], n)
            known = np.bincount(w.doc[hit], minlength=n) + (ends > 0)
            rare = np.flatnonzero(~hit)
            rare = rare[np.lexsort((ids[rare], w.doc[rare]))]
            new = np.ones(len(rare), dtype=bool)
            new[1:] = (ids[rare[1:]] != ids[rare[:-1]]) | (w.doc[rare[1:]] != w.doc[rare[:-1]])
            times = np.diff(np.append(np.flatnonzero(new), len(rare)))
            rare = rare[new]
            rows = row + np.arange(n)
            told = pa.StructArray.from_arrays([t.column(key).combine_chunks().cast(pa.int64()), pa.array(w.per_doc + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base_sum), pa.array(by_rank[rank] + share_sum)], names=["key", "n", "known", "base", "score"])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(-2 - rows), pa.array(np.zeros(n, np.int32)), told], names=["row", "id", "times", "told"])
            if len(rare):
                yield pa.RecordBatch.from_arrays([pa.array(rows[w.doc[rare]]), pa.array(ids[rare]), pa.array(times.astype(np.int32)), pa.nulls(len(rare), told.type)], names=["row", "id", "times", "told"])
            row += n

    parts = texts.select(key, text).mapInArrow(run, "row long, id long, times int, told struct<key: long, n: long, known: long, base: double, score: double>")
    rare = counts.where((F.col("id") != END) & (_weight("c") < weight))
    c = F.coalesce(F.col("c"), F.lit(0))
    total = F.array(*(F.lit(float(x)) for x in v.class_total()))
    word = F.col("told").isNull()
    joined = parts.join(rare, "id", "left").select(
        "row", F.col("told.key").alias("key"), F.coalesce("told.n", F.lit(0)).alias("n"), F.when(word, F.when(c > 0, F.col("times")).otherwise(0)).otherwise(F.col("told.known")).alias("known"),
        F.when(word, F.col("times") * F.log10((c + 0.5) / F.lit(v.base_total))).otherwise(F.col("told.base")).alias("base"),
        F.when(word, F.col("times") * F.log10((c + 0.5) / F.get(total, F.shiftright("id", HASH_BITS).cast("int")))).otherwise(F.col("told.score")).alias("score"),
    )
    sums = joined.groupBy("row").agg(F.max("key").alias(key), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return sums.drop("row")


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.coalesce(held_out(F.col("doc_id"), 5), F.lit(False))
    with scratch(spark) as tables:
        v, counts, weight, m = train(documents.where(~fold))
        out = score(documents, v, counts, weight, m)
        return tables.kept(out.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score"), "scores")
