"""Phrase collocations, counted in suffix automata.

Each shard of texts becomes one generalised suffix automaton over words, bounded in depth: a state is a class of phrases that end at the same positions, its count is the number
of these positions, its suffix link leads to the longest phrase that ends in more places. All states of a depth arise at once, by sorting positions on the words that
end there, so building takes a few sorts and no step for each word. Phrases and counts are enumerated from the states and added up over the shards by Spark.

Depths of three words and more come in later passes: a phrase can only be frequent if the phrase that its suffix link leads to and the one without its last word are,
so a bit map of frequent shorter phrases (of bounded size; a needless hit costs time only) keeps others out of the automaton.

Defined cases: a null or empty text has no words; a null language is ``und``, together with rows that say so; repeated rows count each; a text is one stretch however long it is, and
phrases don't cross separators; a part of a phrase occurs at least as often as the phrase, so all parts of candidates are frequent; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, bit_map, gathered, hits, mix, scratch, span_hashes, table, text_buffer

#: Bytes that part pieces, and bytes that part words within a piece.
SEPARATORS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_SEPARATES, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SEPARATES[list(SEPARATORS)] = True
_BLANK[list(BLANKS)] = True
#: Bytes of text in one shard, at most (one longer text is a shard of its own).
SHARD = 2 << 20
#: Parts that frequent words and the best rows of a language are dealt to.
SALTS = 32
#: A part is hot if it is one in so many of all words, or more.
HOT = 1000


class Shard:
    """Words of a shard in order. word[i]: number of the i-th word, words of two languages are two words; piece[i]: number of its piece; names: the word of each number; lang: its language."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        flat, offsets = text_buffer(texts)
        low = _LOWER[flat]
        parts = _SEPARATES[low]
        ink = ~(parts | _BLANK[low])
        begins = np.zeros(len(low) + 1, dtype=bool)
        begins[offsets] = True
        before = np.concatenate(([False], ink[:-1]))
        starts = np.flatnonzero(ink & (begins[:-1] | ~before))
        # A word is as long as the ink from its start to the next one's.
        sizes = np.add.reduceat(ink, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[ink])))
        text = np.searchsorted(offsets, starts, side="right") - 1
        # A step for each separator and each text: equal numbers mean the same piece.
        self.piece = np.cumsum(parts)[starts] + text if len(starts) else np.zeros(0, np.int64)
        coded, spoken = column.dictionary_encode(), pc.fill_null(langs, "und").dictionary_encode()
        lang = np.asarray(spoken.indices)[text].astype(np.int64)
        pairs, word = np.unique(np.asarray(coded.indices).astype(np.int64) * max(len(spoken.dictionary), 1) + lang, return_inverse=True)
        self.word = word.astype(np.int64)
        self.names = coded.dictionary.take(pa.array(pairs // max(len(spoken.dictionary), 1)))
        self.lang = spoken.dictionary.take(pa.array(pairs % max(len(spoken.dictionary), 1)))

    def keys(self) -> np.ndarray:
        """64 bits for each word number, from its letters and its language."""
        return mix(_hashes(self.names) ^ mix(_hashes(self.lang) + np.uint64(1)))


def _hashes(strings: pa.Array) -> np.ndarray:
    flat, ends = text_buffer(strings)
    return span_hashes(np.concatenate((flat, np.zeros(8, np.uint8))), ends[:-1], ends[1:])


def extended(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase from the key of all its words but the last, and that of the last."""
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + word)


class SuffixAutomaton:
    """The states of a shard's phrases of at most ``depth`` words. open_[d] (from depth 3 on): does this position end a phrase of d words that the automaton takes in?

    longest, shortest: words of a state's longest and shortest phrase; count: positions that it ends at; end: one of them; link: the state of the phrase without the first word of its shortest
    one, -1 at the root."""

    def __init__(self, word: np.ndarray, piece: np.ndarray, depth: int, open_: dict[int, np.ndarray] | None = None):
        n = len(word)
        levels = []  # (number of the phrase ending at each position or -1, counts, an end, parent's number)
        phrase, last = word, None
        here = np.arange(n)
        for d in range(1, depth + 1):
            if d > 1:
                here = here[here >= d - 1]
                here = here[piece[here - (d - 1)] == piece[here]]
                if open_ and d in open_:
                    here = here[open_[d][here]]
                values = last[here] * (int(word.max(initial=0)) + 1) + word[here - (d - 1)]
            else:
                values = phrase
            found, at, number, count = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
            end = here[at]
            parent = last[end] if d > 1 else np.full(len(found), -1)
            last = np.full(n, -1, dtype=np.int64)
            last[here] = number
            levels.append((count, end, parent))
        self._states(levels)

    def _states(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Phrases that end at the same positions are one state: a phrase joins its only extension to the left if that is as frequent."""
        base = np.concatenate(([0], np.cumsum([len(c) for c, _, _ in levels])))
        count, end = np.concatenate([c for c, _, _ in levels]), np.concatenate([e for _, e, _ in levels])
        length = np.repeat(np.arange(1, len(levels) + 1), np.diff(base))
        parent = np.concatenate([np.where(p >= 0, p + base[max(d - 1, 0)], -1) for d, (_, _, p) in enumerate(levels)])
        joins = np.full(len(count), -1)
        same = np.flatnonzero((parent >= 0) & (count == count[np.maximum(parent, 0)]))
        joins[parent[same]] = same
        state = np.arange(len(count))
        for d in range(len(levels) - 2, -1, -1):
            nodes = np.arange(base[d], base[d + 1])
            nodes = nodes[joins[nodes] >= 0]
            state[nodes] = state[joins[nodes]]
        longest = np.flatnonzero(state == np.arange(len(count)))
        number = np.full(len(count), -1)
        number[longest] = np.arange(len(longest))
        top = np.full(len(count), len(levels) + 1)
        np.minimum.at(top, state, length)
        self.longest, self.count, self.end, self.shortest = length[longest], count[longest], end[longest], top[longest]
        up = np.full(len(count), -1)
        heads = np.flatnonzero(length == top[state])
        up[state[heads]] = np.where(parent[heads] >= 0, number[state[np.maximum(parent[heads], 0)]], -1)
        self.link = up[longest]

    def phrases(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(a position that it ends at, count) of all phrases of so many words."""
        at = np.flatnonzero((self.shortest <= words) & (words <= self.longest))
        return self.end[at], self.count[at]


def _rows(shard: Shard, end: np.ndarray, count: np.ndarray, words: int) -> pa.RecordBatch:
    place = [pa.array(shard.word[end - k]) for k in range(words - 1, -1, -1)]
    phrase = shard.names.take(place[0])
    for p in place[1:]:
        phrase = pc.binary_join_element_wise(phrase, shard.names.take(p), pa.scalar(" ", shard.names.type))
    return pa.RecordBatch.from_arrays([shard.lang.take(place[0]).cast(pa.string()), phrase.cast(pa.string()), pa.array(count, pa.int64())], names=["lang", "phrase", "f"])


def _counted(docs: DataFrame, words: int, frequent: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f) by shard: phrases of one and two words, and the words of each language as the phrase ''; or phrases of ``words`` words whose two shorter parts are in ``frequent``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, SHARD):
            shard = Shard(rows.column("text").combine_chunks(), rows.column("lang").combine_chunks())
            if not len(shard.word):
                continue
            if shared is None:
                automaton = SuffixAutomaton(shard.word, shard.piece, 2)
                for k in (1, 2):
                    yield _rows(shard, *automaton.phrases(k), k)
                spoken, per = np.unique(np.asarray(shard.lang.dictionary_encode().indices)[shard.word], return_counts=True)
                yield pa.RecordBatch.from_arrays([shard.lang.dictionary_encode().dictionary.take(pa.array(spoken)).cast(pa.string()), pa.array([""] * len(spoken), pa.string()), pa.array(per, pa.int64())], names=["lang", "phrase", "f"])
                continue
            # Positions at which a frequent phrase of one word less ends, and did one word before.
            key = shard.keys()[shard.word]
            phrase = key
            for _ in range(2, words):
                phrase = extended(np.concatenate((phrase[:1], phrase[:-1])), key)
            fits = hits(shared.value, phrase)
            open_ = fits & np.concatenate(([False], fits[:-1]))
            automaton = SuffixAutomaton(shard.word, shard.piece, words, {words: open_})
            end, count = automaton.phrases(words)
            if len(end):
                yield _rows(shard, end, count, words)

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return texts.mapInArrow(run, "lang string, phrase string, f long")


def _keys(phrases: DataFrame) -> DataFrame:
    """key (long) of each (lang, phrase), as shards compute it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_lang = mix(_hashes(batch.column(0)) + np.uint64(1))
            words = [p.split(" ") for p in batch.column(1).to_pylist()]
            per = np.array([len(w) for w in words], dtype=np.int64)
            key = mix(_hashes(pa.array([x for w in words for x in w], pa.string())) ^ np.repeat(of_lang, per))
            first = np.cumsum(per) - per
            out = key[first] if len(per) else key
            for k in range(1, int(per.max(initial=0))):
                more = np.flatnonzero(per > k)
                out[more] = extended(out[more], key[first[more] + k])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["key"])

    return phrases.select("lang", "phrase").mapInArrow(run, "key long")


def _n_words(phrase: Column) -> Column:
    return F.char_length(phrase) - F.char_length(F.replace(phrase, F.lit(" "))) + 1


@dataclass(frozen=True)
class Collocations:
    """most_words: words of the longest phrase; least: occurrences of a candidate, at least; top: rows of a language; covered: percent of a phrase's occurrences in one longer candidate that drop it."""

    most_words: int = 3
    least: int = 10
    top: int = 2000
    covered: int = 50

    def mine(self, docs: DataFrame) -> DataFrame:
        """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
        spark = docs.sparkSession
        with scratch(spark) as s:
            frequent = self._frequent(docs, s)
            return s.kept(self._ranked(frequent), "collocations")

    def _frequent(self, docs: DataFrame, s) -> DataFrame:
        """(lang, phrase, f, words) of all phrases that occur often enough; phrase '' (0 words) has the words of its language."""
        from .common import written

        total = lambda df: df.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= self.least) | (F.col("phrase") == ""))
        tables = [written(total(_counted(docs, 2, None)).withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(_n_words(F.col("phrase")))), "phrases")]
        for words in range(3, self.most_words + 1):
            map_ = bit_map(_keys(tables[-1].where(F.col("words") == words - 1)))
            tables.append(written(total(_counted(docs, words, map_)).withColumn("words", F.lit(words)), "phrases"))
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _ranked(self, frequent: DataFrame) -> DataFrame:
        spoken = frequent.where("words = 0").select("lang", F.col("f").alias("n"))
        found = frequent.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), "words")
        kept = found.where(f"words = {self.most_words}") if self.most_words < 3 else self._uncovered(found)
        parts = F.split("phrase", " ")
        cuts = kept.select("lang", "phrase", "a", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), " ").alias("head"), F.array_join(F.slice(parts, k + 1, F.col("words") - k), " ").alias("tail")))).alias("k", "cut"))
        cuts = cuts.select("lang", "phrase", "a", "k", "cut.head", "cut.tail")
        # One word can begin a third of all candidates: parts that are a thousandth of all words or more (a thousand of each length at most) are dealt to SALTS places on both sides.
        total = spoken.agg(F.sum("n")).first()[0] or 0
        part = frequent.where(f"words between 1 and {self.most_words - 1}").select("lang", F.col("phrase").alias("part"), "f", (F.col("f") * HOT >= total).alias("hot"))
        hot = part.where("hot").select("lang", "part")
        dealt = part.select("lang", "part", "f", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
        for side, count in (("head", "l"), ("tail", "r")):
            known = F.broadcast(hot.select("lang", F.col("part").alias(side), F.lit(True).alias("hot")))
            salt = F.when(F.col("hot"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt")
            cuts = cuts.join(known, ["lang", side], "left").select(*cuts.columns, salt)
            cuts = cuts.join(dealt.select("lang", F.col("part").alias(side), F.col("f").alias(count), "salt"), ["lang", side, "salt"]).drop("salt")
        wide = lambda c: f"cast({c} as decimal(15, 0))"
        scored = cuts.withColumn("score", F.expr(f"({wide('a')} * {wide('a')} * cast(1000000 as decimal(7, 0))) div ({wide('l')} * {wide('r')})"))
        least = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"), "cut.score", "cut.l", "cut.r")
        best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        some = least.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= self.top)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= self.top)
        return ranked.join(spoken, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

    def _uncovered(self, found: DataFrame) -> DataFrame:
        """Candidates that no longer candidate covers. Every phrase within a phrase is reached by leaving out its first word (its suffix link) or its last, again and again, and covers pass
        down with the counts of the longer one."""
        covers = None
        for words in range(self.most_words, 2, -1):
            own = found.where(F.col("words") == words).select("lang", "phrase", F.col("a").alias("longer"))
            above = own if covers is None else own.unionByName(covers.where(F.col("words") == words).select("lang", "phrase", "longer"))
            link = F.expr("substring(phrase, position(' ', phrase) + 1)")
            head = F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)")
            down = above.select("lang", F.explode(F.array(link, head)).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer")).withColumn("words", F.lit(words - 1))
            covers = down if covers is None else covers.unionByName(down)
        return found.join(covers.select("lang", "phrase", "longer"), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < self.covered * F.col("a"))).drop("longer")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collocations().mine(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = """
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
        UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
    o AS (SELECT lang, phrase, max(a) AS longer FROM (
            SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
    kept AS (SELECT c.* FROM c LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
    cut AS (SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM kept UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE k = 3),
    s AS (SELECT cut.lang, cut.phrase, a, cut.k, x.f AS l, y.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
        FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.head JOIN f y ON y.lang = cut.lang AND y.phrase = cut.tail),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM s),
    t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM b WHERE pick = 1)
    SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""
