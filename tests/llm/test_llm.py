"""Operators against brute force, round trips and odd inputs."""

import collections
import hashlib
import itertools
import math
import pathlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sheetwise.llm import bpe, components, hmm, linededup, mixing, neartext, quality, rules, setjoin, simhash, substrings, vectors, warc
from sheetwise.llm.common import Words, fresh_path, let, word_array

WORD = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "x " * 3000, "é ß 漢字 a", "A\n\nB", "one two three four five six seven eight nine ten"]


def texts(n=60, seed=1, words=(0, 80)):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(*words))) for _ in range(n)]
    return out + ODD


def frame(spark, rows, more=0):
    data = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(rows)]
    return spark.createDataFrame(data + data[:more], DOCS).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame([(i, int("$" not in (t or "")), 0) for i, t in enumerate(rows) if i % 4], "doc_id long, quality int, toxic int")


def words_of(t):
    return WORD.findall((t or "").translate(LOW))


def test_words_and_let(spark):
    column = pa.array(texts())
    w = Words(column)
    raw = w.low.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.starts, w.ends)] == [x for t in texts() for x in words_of(t)]
    by_word = collections.defaultdict(set)
    for h, a, b in zip(w.hashes().tolist(), w.starts, w.ends):
        by_word[raw[a:b]].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)
    got = frame(spark, texts()).select("doc_id", word_array(F.col("text")).alias("w")).collect()
    assert {r["doc_id"]: r["w"] for r in got} == {i: WORD.findall(t or "") for i, t in enumerate(texts())}
    assert spark.range(1).select(let(F.lit(2), lambda x: x * x)).first()[0] == 4


def test_bpe_equals_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    c = bpe.codec(bpe.rank_file_path())
    known = tiktoken.Encoding("known", pat_str=tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(5)
    some = ["".join(rng.choice("ab 's't're'll''d\n\t 　é12٣½!?-\U0001f600漢\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 900, "<|endoftext|>", " " * 500] + [t or "" for t in texts()]
    ids = c.encode(some)
    assert ids == [" ".join(map(str, known.encode_ordinary(t))) for t in some]
    assert [c.decode(x) for x in ids] == [t.encode() for t in some]
    assert "".join("ab c's\n  d"[a:b] for a, b in itertools.pairwise([a for a, _ in c.offsets(["x", "ab c's\n  d"])[1]] + [10])) == "ab c's\n  d"
    small = bpe.Codec(c.ranks, cache_pieces=10)
    assert [[i for _, x in pieces for i in x] for pieces in small.offsets(some)] == [known.encode_ordinary(t) for t in some] and not small.cache
    df = bpe.encode_decode_digests(frame(spark, texts(), more=3), bpe.rank_file_path())
    for r in df.collect():
        t = texts()[r["doc_id"]] or ""
        x = known.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_decode_digests(frame(spark, texts()).limit(0), bpe.rank_file_path()).count() == 0
    round_trip = bpe.decode(bpe.encode(frame(spark, texts()).withColumn("ids", F.lit("clash")), bpe.rank_file_path()), bpe.rank_file_path()).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in round_trip)


def test_mixing(spark):
    rows = [(i, "w " * (i % 37), "x", ["b", "a", "ü", None, "tiny"][0 if i < 150 else i % 5], 0) for i in range(300)] + [(900, "one two", "x", "tiny2", 0), (901, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = [r.asDict() for r in mixing.mix(df).collect()]
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, [r.asDict() for r in mixing.mix(df.repartition(5)).collect()]))
    size = {r["doc_id"]: r["size"] for r in got}
    assert all(size[i] == len(WORD.findall(t or "")) for i, t, *_ in rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = [sum(size[r[0]] for r in rows if r[3] == s) for s in names]
    target = mixing.water_fill(sizes, [1 + k % 3 for k in range(len(names))], sum(sizes))
    for s, t in zip(names, target):
        own = [r for r in got if r["source"] == s]
        assert math.isclose(own[0]["target"], t) and abs(sum(r["taken"] for r in own) - t) <= max(2, 0.02 * t)
    assert mixing.water_fill([10, 0, 100], [1, 2, 3], 110) == [27.5, 0.0, 82.5] and mixing.water_fill([5, 0, 100], [1, 2, 3], 105) == [15.0, 0.0, 90.0]
    slots = mixing.schedule(spark, mixing.plan(spark.createDataFrame([("a", 500), ("b", 100)], "source string, size long"))).collect()
    for n in {r["n"] for r in slots}:
        assert sorted(r["rank"] for r in slots if r["n"] == n) == list(range(sum(r["n"] == n for r in slots)))
    assert mixing.mix(df.limit(0)).count() == 0
    times = collections.Counter(r["doc_id"] for r in mixing.repeated(df).collect())
    assert all(abs(times[r["doc_id"]] - r["taken"] / max(1, r["size"])) <= 0.5 for r in got)


def brute_units(t):
    """(begin, end, kind, set of shingles) of the windows and paragraphs of a text; only the hash that chooses windows is the operator's own."""
    w = words_of(t)
    out = []
    places = len(w) - 23
    if places > 0:
        hashes = substrings.shingled(pa.array([" ".join(w)]))[1]
        mask = ~substrings._PLACE
        for a in range(max(1, places - substrings.WINDOW + 1)):
            stretch = range(a, min(a + substrings.WINDOW, places))
            out.append(min(stretch, key=lambda k: (int(hashes[k] & mask), k)))
        out = [(k, k + 24, "w", frozenset(tuple(w[j : j + 5]) for j in range(k, k + 20))) for k in sorted(set(out))]
    at = 0
    for line in (t or "").split("\n"):
        n = len(words_of(line))
        if n >= 24:
            out.append((at, at + n, "p", frozenset(tuple(w[j : j + 5]) for j in range(at, at + n - 4))))
        at += n
    return out


def test_substrings_equal_brute_force(spark):
    """All rows of repeats(): whole lines with changed words, exact lines of 30 words, passages within lines, ties, repeats within one document only."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    line = lambda n: [word() for _ in range(n)]
    rows = [[line(rng.randint(5, 90)) for _ in range(rng.randint(1, 4))] for _ in range(30)]
    shared, exact, passage, own = line(60), line(30), line(55), line(40)
    for i in range(0, 10):
        rows[i].insert(rng.randint(0, 1), [word() if k == 10 + i else x for k, x in enumerate(shared)])
        rows[i + 10].append(exact)
        x = rows[i + 15][0]
        rows[i + 15][0] = x[:4] + passage + x[4:]
    rows[29] += [own, own]
    texts_ = ["\n".join(" ".join(x) for x in t) for t in rows] + ODD
    units = [(i, *u) for i, t in enumerate(texts_) for u in brute_units(t)]
    label = list(range(len(units)))
    similar = [(a, b) for a, b in itertools.combinations(range(len(units)), 2) if units[a][3] == units[b][3] and len(units[a][4] & units[b][4]) >= 0.8 * len(units[a][4] | units[b][4])]
    while any(label[a] != label[b] for a, b in similar):
        for a, b in similar:
            label[a] = label[b] = min(label[a], label[b])
    groups = collections.defaultdict(list)
    for u, g in zip(units, label):
        groups[g].append(u[:3])
    want = {(*u, u[:2] == min(g)[:2]) for g in groups.values() if len({u[0] for u in g}) > 1 for u in g}
    got = [(r["doc_id"], r["begin"], r["end"], r["first"]) for r in substrings.repeats(frame(spark, texts_)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    lengths = {e - b for _, b, e, _ in want}
    assert {60, 30, 24} <= lengths


def shuffled_mb(spark, run):
    """MB that run() writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def test_lists_are_sent_without_shingles(spark):
    """Unlike windows that meet in a band are told apart by marks: a post costs some 30 bytes of a shuffle, not 100 and more with the shingles."""
    rng = np.random.default_rng(3)
    sets = np.sort(rng.integers(0, 400, (6000, 20)) + np.arange(20) * 400, axis=1)  # few of a place's 400 shingles: bands meet by chance
    df = spark.createDataFrame([(2 * i, [int(x) for x in s]) for i, s in enumerate(sets)], "class long, shingles array<int>")
    meets = df.select("class", "shingles")
    meets.write.parquet(path := fresh_path(spark, "test-classes"))
    classes = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size
    try:
        assert 0.1 < shuffled_mb(spark, lambda: substrings.links(classes).count()) < 6000 * substrings.BANDS * 50 / 1e6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_met_equals_brute_force(spark):
    """Lists of one class to hundreds, with equal rows, over batches of seven rows: all near pairs of short lists, all classes of longer ones; stars connect each list."""
    rng = random.Random(8)
    rows = [(c, c % 64, p) for p, n in enumerate([1, 2, 5, 24, 25, 26, 60, 300, 3, 7, 24]) for c in rng.sample(range(1000), n) for _ in range(rng.choice([1, 1, 3]))]
    lists = collections.defaultdict(set)
    for c, m, p in rows:
        lists[p].add(c)
    rng.shuffle(rows)
    near = lambda a, b: np.abs(a.astype(np.int64) - b.astype(np.int64)) < 9
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "class long, mark long, post long")
        got = [tuple(r) for r in substrings._met(df, 24, near).collect()]
        stars = [tuple(r) for r in substrings._stars(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = [x for x in got if x[2] is not None]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(p, a, b) for p, x in lists.items() if len(x) <= 24 for a, b in itertools.combinations(sorted(x), 2) if abs(a % 64 - b % 64) < 9}
    assert {x[:2] for x in got if x[2] is None} == {(p, c) for p, x in lists.items() if len(x) > 24 for c in x}
    assert set(stars) == {(min(x), c) for x in lists.values() for c in x if c != min(x)}


def test_marks_lose_no_similar_pair():
    """Pairs at the threshold and just above, windows and paragraphs: none is ruled out; unlike ones mostly are."""
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 32, (4000, 20)).astype(np.uint64)
    b = a.copy()
    b[:, :2] = rng.integers(0, 1 << 32, (4000, 2))
    assert substrings.near_marks(substrings.marks(a), substrings.marks(b)).all()
    assert substrings.near_marks(substrings.marks(a), substrings.marks(a[::-1])).mean() < 0.01
    for n, m, common in ((20, 20, 18), (40, 36, 34), (60, 75, 60), (100, 100, 89), (70_000, 70_000, 63_000), (60_000, 70_000, 60_000)):
        assert common >= 0.8 * (n + m - common)
        for _ in range(3):
            x = rng.choice(1 << 32, n + m - common, replace=False).astype(np.uint32) if n < 1000 else np.arange(n + m - common, dtype=np.uint32)
            u, v = x[:n], x[n - common :]
            assert substrings.near_lines(*(substrings.line_marks(y, np.array([len(y)])) for y in (u, v))).all()


def test_substrings_of_one_text_that_others_bring_in(spark):
    """Lines of one text that drift word by word from a line that another text has: the last ones share no band key with that text, but belong to the group as brute force has it."""
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    line = [word() for _ in range(70)]
    drift = [line]
    for k in range(16):
        drift.append([word() if j == 2 + 4 * k else x for j, x in enumerate(drift[-1])])
    rows = ["\n".join(" ".join(x) for x in [line, [word() for _ in range(40)]]), "\n".join(" ".join(x) for x in drift[1:]), " ".join(word() for _ in range(90))]
    got = {(r["doc_id"], r["begin"], r["end"]): r["component"] for r in substrings.repeats(frame(spark, rows)).collect()}
    whole = [(0, 0, 70)] + [(1, 70 * k, 70 * k + 70) for k in range(16)]
    assert len({got.get(x) for x in whole}) == 1 and None not in {got.get(x) for x in whole}


def test_a_small_source_has_small_blocks(spark):
    """Three words beside a million: the schedule stays small, and what is taken equals a walk over the slots."""
    df = spark.createDataFrame([(0, "a b c", "x", "tiny", 0)] + [(i, "w " * 4000, "x", "big", 0) for i in range(1, 251)], DOCS)
    plan = mixing.plan(spark.createDataFrame([("big", 1_000_000), ("tiny", 3)], "source string, size long"))
    assert sum(p["slots"] for p in plan) < 4 * mixing.LEAST_SLOTS + 10 and plan[1]["slots"] == 9
    taken = {r["doc_id"]: (r["taken"], r["target"]) for r in mixing.mix(df).collect()}
    assert taken[0] == (9, 9.0) and sum(t for i, (t, _) in taken.items() if i) == plan[0]["slots"] * 1_000_000 // plan[0]["blocks"] and taken[1][1] == 999_994.0
    for q, r, blocks in ((4, 3, 7), (1, 0, 9), (5, 6, 7)):
        edges = [b * q + min(b, r) for b in range(blocks + 1)]
        rows = spark.range(edges[-1]).select("id", F.lit(q).alias("q"), F.lit(r).alias("r")).select("id", mixing.block_of(F.col("id")).alias("b"))
        assert all(edges[x["b"]] <= x["id"] < edges[x["b"] + 1] for x in rows.collect())


def test_taken_equals_a_walk_over_the_slots(spark):
    rng = random.Random(14)
    rows = [(i, "w " * rng.randint(0, 300), "x", rng.choice(["a", "b", None, "c"]), 0) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    sized = mixing.mix(df, with_order=True).collect()
    plan = mixing.plan(spark.createDataFrame([(r["source"], r["size"]) for r in sized], "source string, size long"))
    total = sum(p["slots"] for p in plan)
    bits = max(1, (total - 1).bit_length())
    owners = []
    for slot in range(1 << bits):
        point = int(f"{slot:0{bits}b}"[::-1], 2)
        if point < total:
            owners.append(next(p["n"] for p in plan if p["slots"] and p["first"] <= point < p["first"] + p["slots"]))
    uses = collections.Counter()
    rank = collections.Counter()
    for n in owners:
        uses[n, rank[n] % plan[n]["blocks"]] += 1
        rank[n] += 1
    for p in plan:
        own = sorted((r for r in sized if r["source"] == p["source"]), key=lambda r: (r["_order"], r["doc_id"], r["size"]))  # one span
        q, rest = divmod(p["size"], p["blocks"]) if p["blocks"] else (0, 0)
        block = [b for b in range(p["blocks"]) for _ in range(q + (b < rest))]
        at = 0
        for r in own:
            assert r["taken"] == sum(uses[p["n"], b] for b in block[at : at + r["size"]])
            at += r["size"]


def test_substrings(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    passage = [word() for _ in range(51)]
    rows = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(40)]
    for i in range(0, 12):
        w = rows[i].split()
        at = rng.randint(0, len(w))
        rows[i] = " ".join(w[:at] + passage + w[at:])
    for light in (1, 24):
        found = substrings.repeats(frame(spark, rows + ODD))
        hit = {r["doc_id"] for r in found.collect()}
        assert hit == set(range(12))  # rows are one line each, and no line is like another
        classes = [(i, sorted(rng.sample(range(1, 60), 20))) for i in range(30)]
        classes += [(100 + k, sorted({*s[:-1], 100 + k})) for k, (_, s) in enumerate(classes)]
        df = spark.createDataFrame(classes, "class long, shingles array<int>")
        label = {}
        for r in components.connected_components(substrings.links(df, light)).collect():
            label[r["node"]] = r["component"]
        for k in range(30):
            assert label.get(100 + k) == label.get(k) is not None
    assert substrings.tuned(0.8) == 4 and 1 - (1 - 0.8**2) ** 4 > 0.98
    merged = {r["doc_id"]: r for r in substrings.merged(substrings.repeats(frame(spark, rows))).collect()}
    assert merged[0]["removed"] == [] and all(merged[i]["removed_words"] >= 24 for i in range(1, 12))
    assert substrings.repeats(frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for a, b in edges + [(b, a) for a, b in edges] if a != b}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hmm(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LOOKUP", 40)
    monkeypatch.setattr(hmm, "OWN", 20)
    rows = texts()
    df = frame(spark, rows, more=2)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter(w for i, t in [*enumerate(rows), *enumerate(rows[:2])] if not fold(i) for w in [*words_of(t), "\0"])
    train = df.where(~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1))
    v, counts, weight, m = hmm.train(train)
    n, types = sum(count.values()), len(count)
    assert (v.tokens, v.words) == (n, types)
    out = hmm.score(df, v, counts, weight, m).collect()
    assert len(out) == len(rows) + 2
    total = v.class_total()
    for r in out:
        tokens = [*words_of(rows[r["doc_id"]]), "\0"]
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(count[t] > 0 for t in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((count[t] + 0.5) / (n + 0.5 * (types + 1))) for t in tokens), rel_tol=1e-9)
        ids = hmm.word_ids(Words(pa.array([" ".join(tokens[:-1])])))
        _, classes, _ = v.look(ids)
        state, log = m.start, 0.0
        for k, c in enumerate([*classes.tolist(), v.size - 1]):
            state = (state if k == 0 else state @ m.move) * m.emit[c]
            log += math.log10(state.sum())
            state = state / state.sum()
            if v.own <= c < v.size - 1:
                log += math.log10((count[tokens[k]] + 0.5) / total[c - v.own])
        assert math.isclose(r["score"], log, rel_tol=1e-6)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)


def test_expected_counts_by_all_paths():
    rng = np.random.default_rng(1)
    norm = lambda x, a: x / x.sum(axis=a, keepdims=True)
    m = hmm.Model(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((4, 2)), 0))
    rows = [[0, 2], [1], [], [2, 0, 1]]
    laid, first, rank, _ = hmm.sequences(np.array([c for r in rows for c in r]), np.array([len(r) for r in rows]), 3)
    starts, moves, emissions = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for r in ([*x, 3] for x in rows):
        paths = list(itertools.product(range(2), repeat=len(r)))
        p = [m.start[s[0]] * math.prod(m.move[a, b] for a, b in itertools.pairwise(s)) * math.prod(m.emit[c, k] for c, k in zip(r, s)) for s in paths]
        for s, q in zip(paths, np.array(p) / sum(p)):
            starts[s[0]] += q
            for a, b in itertools.pairwise(s):
                moves[a, b] += q
            for c, k in zip(r, s):
                emissions[c, k] += q
    got = hmm.expected(m, laid, first)
    assert np.allclose(got[0], starts, atol=1e-5) and np.allclose(got[1], moves, atol=1e-5) and np.allclose(got[2], emissions, atol=1e-5)


def test_hmm_settles_over_all_texts(spark, monkeypatch):
    """A start sample of few texts: another round over all texts must not gain any more."""
    monkeypatch.setattr(hmm, "SAMPLE", 20)
    rows = texts(200, 12, (20, 60)) + [" ".join(["red", "blue"] * 20 + ["one", "two", "three"] * 15)] * 60
    v, counts, weight, m = hmm.train(frame(spark, rows))
    laid, first, _, _ = hmm._laid(pa.table({"text": rows}), v, "text")[-1]
    log = lambda m: float(hmm.forward(m, laid, first)[0].sum())
    after = hmm.maximised(*hmm.expected(m, laid, first)[:3], hmm.class_shares(v, len(rows)))
    assert log(after) - log(m) <= 2e-4 * abs(log(m))


def junky(n=400):
    rng = random.Random(9)
    return [" ".join(w + rng.choice(["$$$", "%%%", "###"]) * (i % 3 == 0) for w in t.split()) for i, t in enumerate(texts(n, 3, (30, 80))[:n])]


def test_rules(spark):
    rows = junky() + ODD + ["a b c d e f g h " * 20]
    df = frame(spark, rows, more=1)
    found = rules.fit(df.select("doc_id", "text"), labels(spark, rows))
    assert found and all(c.name in rules.statistics() for r in found for c in r)
    out = rules.measured(df).select("*", rules.base_failed().alias("failed"), rules.verdict(found).alias("kept")).collect()
    for r in out:
        t = rows[r["doc_id"]] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = collections.Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        if not r["failed"] and r["doc_id"] < 400:
            assert r["kept"] == ("$" not in t and "%" not in t and "#" not in t)
    assert rules.fit(df.select("doc_id", "text"), labels(spark, rows).limit(0)) == []


def test_quality(spark):
    rows = junky() + ODD
    df = frame(spark, rows)
    machine = quality.fit(df, labels(spark, rows))
    out = {r["doc_id"]: r["quality_score"] for r in quality.scored(df.withColumn("quality_score", F.lit("clash")), machine).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    right = [(out[i] >= 0.5) == ("$" not in rows[i] and "%" not in rows[i] and "#" not in rows[i]) for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(right) / len(right) > 0.95
    row, column, value, dense = quality.features(pa.table({"text": rows[:5], "n_chars": [1, None, 3, 4, 5]}))
    d = machine.standard(dense)
    for i in range(5):
        x = np.zeros(quality.BUCKETS + quality.DENSE)
        x[column[row == i]] += value[row == i]
        x[quality.BUCKETS :] = d[i]
        at = np.flatnonzero(x)
        pairs = sum(machine.vectors[a] @ machine.vectors[b] * x[a] * x[b] for a, b in itertools.combinations(at, 2))
        assert math.isclose(machine.bias + machine.linear @ x + pairs, machine.margin(row, column, value, dense)[i], rel_tol=1e-6, abs_tol=1e-8)
    empty = quality.fit(df, labels(spark, rows).limit(0))
    assert all(r["quality_score"] == 0.5 for r in quality.scored(df, empty).collect())


def test_quality_learns_without_python_numbers(spark, monkeypatch):
    """The driver holds the examples as numbers of an array: 2,000 texts of 150 words each take a few MB."""
    rng = random.Random(9)
    rows = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) + " $" * (i % 2) for i in range(4000)]
    told = {}
    monkeypatch.setattr(quality, "train", lambda *x: told.update(zip(("labels", "row", "column", "value", "dense"), x, strict=True)))
    tracemalloc.start()
    try:
        quality.fit(frame(spark, rows), labels(spark, rows))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    chosen = [i for i in range(4000) if i % 4 and zlib.crc32(str(i).encode()) % 3 != 1]
    row, column, value, dense = quality.features(pa.table({"text": [rows[i] for i in chosen], "n_chars": [len(rows[i]) for i in chosen]}))
    assert told["labels"].tolist() == [i % 2 == 0 for i in chosen] and np.array_equal(told["row"], row) and np.array_equal(told["column"], column)
    assert np.array_equal(told["value"], value.astype(np.float32)) and np.array_equal(told["dense"], dense)
    assert len(row) > 250_000 and peak < 24 * len(row)


def test_broadcasts_go_with_the_block(spark):
    held = lambda: sum(x.is_file() for x in pathlib.Path(spark.sparkContext._temp_dir).iterdir())
    before = held()
    kept = neartext.deduplicated(frame(spark, texts(40, 8, (60, 90))))
    assert held() == before and kept.count() > 30


def test_line_dedup(spark):
    rng = random.Random(6)
    rows = ["\n".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9))) for _ in range(80)] + ["x\n\n\n\n\n\ny", None, "", "a\nb", "p\nq\nr\np\nq\nr", "p\nq\nr"]
    seen, gone = set(), collections.defaultdict(set)
    for i, t in enumerate(rows):
        lines = (t or "").split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip():
                if w in seen:
                    gone[i].update((k, k + 1, k + 2))
                seen.add(w)
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in enumerate(rows)}
    df = frame(spark, rows).withColumn("place", F.lit(1)).withColumn("h1", F.lit(2))
    got = linededup.without_repeats(df)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want and got.columns[:7] == df.columns
    assert linededup.without_repeats(df.limit(0)).count() == 0


def test_simhash(spark):
    rows = texts() + texts()[:9] + [t + " more" for t in texts(20, words=(40, 80))[:20]]
    prints = {}
    for i, t in enumerate(rows):
        w = words_of(t)
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = {i: i for i in prints}
    for _ in prints:
        before = dict(label)
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    for light in (1, 24):
        got = simhash.near_duplicates(frame(spark, rows), light=light).collect()
        assert {r["doc_id"]: r["fingerprint"] & (1 << 64) - 1 for r in got} == prints
        assert {r["doc_id"]: r["component_id"] for r in got} == label
    cluster = [(5 ^ (1 << a) ^ (1 << b),) for a in range(40) for b in range(a)]
    links = simhash.links(spark.createDataFrame(cluster, "fingerprint long").distinct()).collect()
    assert all((r["u"] ^ r["v"]).bit_count() <= 2 for r in links)
    joined = components.connected_components(spark.createDataFrame([(r["u"], r["v"]) for r in links], "u long, v long")).select("component").distinct().count()
    assert joined == 1
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_texts(spark):
    base = [t for t in texts(40, 8, (60, 90))[:40]]
    close = [" ".join(w if k != 30 else "changed" for k, w in enumerate(t.split())) for t in base[:15]]
    group = [" ".join(w if k not in (j % 50, 55) else f"v{j}" for k, w in enumerate(base[0].split())) for j in range(60)]
    rows = base + close + group + ODD
    got = {r["doc_id"]: r["keeper"] for r in neartext.keepers(frame(spark, rows)).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for t in rows]
    label = {i: i for i in got}
    for _ in range(8):
        for a, b in itertools.combinations(got, 2):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    kept = neartext.deduplicated(frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i] == i}


def near_labels(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for t in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = list(range(len(rows)))
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return dict(enumerate(label)), pairs


@pytest.mark.parametrize("light, chunk, few", [(10, 512, 16), (4, 16, 1), (4, 16, 1000)])
def test_near_texts_of_stars_and_chains(spark, monkeypatch, light, chunk, few):
    """Copies that are similar to their original only, and texts that are similar to the next one only."""
    monkeypatch.setattr(setjoin, "LIGHT", light)
    monkeypatch.setattr(setjoin, "CHUNK", chunk)
    monkeypatch.setattr(setjoin, "FEW", few)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    original = [word() for _ in range(100)]
    places = [(a, b) for a in range(5, 45) for b in range(55, 95)]
    star = [" ".join(word() if k in at else w for k, w in enumerate(original)) for at in rng.sample(places, 60)]
    long = [word() for _ in range(500)]
    chain = [" ".join(long[k : k + 100]) for k in range(0, 400, 9)]
    rng.shuffle(chain)
    rows = star[:30] + [" ".join(original)] + star[30:] + chain
    want, pairs = near_labels(rows)
    assert len(set(want.values())) == 2 and sum(a < 61 and b < 61 and 30 not in (a, b) for a, b in pairs) < 300
    assert {r["doc_id"]: r["keeper"] for r in neartext.keepers(frame(spark, rows)).collect()} == want


def test_near_texts_at_the_threshold(spark):
    """Every pair counts at a similarity just over 0.8, and a sentence that one text repeats counts once."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [[word() for _ in range(100)] for _ in range(150)]
    close = [" ".join(word() if k in (20, 70) else w for k, w in enumerate(b)) for b in base]
    rows = [" ".join(b) for b in base] + close + [" ".join(b[:-30] + b[-30:] * 40) for b in base[:10]]
    want, _ = near_labels(rows)
    assert all(want[150 + k] == k for k in range(150)) and all(want[300 + k] == k for k in range(10))
    assert {r["doc_id"]: r["keeper"] for r in neartext.keepers(frame(spark, rows)).collect()} == want


def test_warc(spark):
    pages = [(9, "u", "a" * 50_000), (9, "u", "b" * 50_000), (8, "u", "b" * 50_000), (1, "u", None), (2, None, ""), (3, "a\r\nb", "x" * 200_000), (4, "q", "x" * 200_000), (4, "q", "x" * 200_000), (None, "n", "x" * 200_000), (5, "z", "é" * 50_000), (6, "z", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    path = fresh_path(spark, "test")
    warc.write_archives(df, path)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    d = lambda t: (len(t.encode()), warc.digest(t.encode()))
    x = d("x" * 200_000)
    assert got == collections.Counter([(9, *d("a" * 50_000), "response", None), (9, *d("b" * 50_000), "response", None), (8, *d("b" * 50_000), "revisit", 9), (1, *d(""), "revisit", 2), (2, *d(""), "response", None), (3, *x, "revisit", 4), (4, *x, "response", None), (4, *x, "revisit", 4), (None, *x, "response", None), (5, *d("é" * 50_000), "response", None), (6, *d(pages[-1][2]), "response", None)])
    assert all(warc.unframed(warc.framed(b)) == b for b in (b"", b"a", b"\r\n" * 9000))
    with pytest.raises(ValueError):
        warc.unframed(warc.framed(b"abc")[:5])
    empty = fresh_path(spark, "empty")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, None, "ab"), (1, None, "ab"), (2, None, "ab"), (3, None, "c" * 40_000), (3, None, "c" * 40_000)], "page_id long, url string, html string")
    path = fresh_path(spark, "small")
    warc.write_archives(df, path, least=5)
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["record_id"]) for r in warc.read_archives(spark, path).collect()]
    assert sorted(map(str, (g[:3] for g in got))) == sorted(map(str, [(1, "response", None)] * 2 + [(2, "response", None), (3, "response", None), (3, "revisit", 3)])) and len({g[3] for g in got}) == 5


def test_top_k_tiles(spark, monkeypatch):
    """Bounds of few queries and rows at once, few products at once: the same rows."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows_of = lambda **k: sorted(map(tuple, vectors.top_k(df, "vec_id % 2 = 0", **k).collect()))
    want = rows_of()
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    scores = x @ x.T
    for q in range(0, 400, 2):
        best = sorted((-int(scores[q, j]), j) for j in range(400) if j != q)[:5]
        assert [r for r in want if r[0] == q] == [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    monkeypatch.setattr(vectors, "TILE", 700)
    monkeypatch.setattr(vectors, "PAIRS", 13)
    monkeypatch.setattr(vectors, "STEPS", (1, 2))
    assert rows_of(cells=4, block=64) == want


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 6 if i % 9 else 4).tolist()) for i in range(230)] + [(300, None), (350, [1.0, None]), (400, [float("nan")]), (500, [1e30, -1e30]), (550, []), (None, [1.0]), (7, [0.5] * 6), (100, [0.25] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cells", F.lit(0))
    valid = [(i, [int(min(max(math.floor(256 * float(np.float32(x))), -vectors.MOST), vectors.MOST)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for block in (8192, 3):
        got = collections.defaultdict(list)
        for r in vectors.top_k(df, "vec_id % 50 = 0", block=block, cells=16).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        for q, e in {i: e for i, e in valid if i % 50 == 0 and i != 100}.items():
            want = sorted(((-sum(a * b for a, b in zip(e, f)), j) for j, f in valid if j != q))[:5]
            assert got[q] == [(j, -s) for s, j in want]
    assert vectors.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


CLASH = ("key", "size", "shingles", "component", "post", "id", "taken", "target", "fingerprint", "row", "n", "block", "score", "class", "begin", "end", "label", "_label", "words", "list", "place")


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f " * 9, None, None, None), (None, None, None, None, None), (1, "word " * 120_000 + "\n" + "x" * 300_000, "en", "s", 1), (1, "word " * 120_000 + "\n" + "x" * 300_000, "en", "s", 1), (2, "", "en", None, 0), (3, "a b c d e f " * 9, "en", "s", None)]])
def test_odd_tables(spark, rows):
    """Empty tables, null in any column, very long texts, equal rows, and columns whose names the operators use within: every row comes back, or nothing."""
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASH})
    n, none = len(rows), spark.createDataFrame([], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    assert bpe.encode_decode_digests(df, bpe.rank_file_path()).count() == n
    mixed = mixing.mix(df).collect()
    assert len(mixed) == n and sum(r["taken"] for r in mixed) <= 3 * sum(r["size"] for r in mixed)
    assert mixing.repeated(df).columns == df.columns and mixing.repeated(df).count() <= 3 * n
    found = substrings.merged(substrings.repeats(df)).collect()
    assert {r["doc_id"] for r in found} <= {1, 3} and not any(r["removed_words"] for r in found)
    v, counts, weight, m = hmm.train(df)
    scores = hmm.score(df, v, counts, weight, m).collect()
    assert len(scores) == n and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in scores)
    assert rules.measured(df).select("*", rules.verdict(rules.fit(df, none)).alias("kept")).count() == n
    assert all(r["quality_score"] == 0.5 for r in quality.scored(df, quality.fit(df, none)).collect())
    lines = linededup.without_repeats(df)
    assert lines.count() == n and lines.columns[:-2] == df.columns
    near = simhash.near_duplicates(df).collect()
    assert len(near) == n and all(r["component_id"] == r["doc_id"] for r in near if r["doc_id"] in (1, 2))
    kept = neartext.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == n


def brute_lines(docs):
    """{doc_id: text} after line dedup; documents of which nothing is left are gone."""
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(" \t\n\x0b\x0c\r"):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        if t is None or len(gone) < len(lines):
            out[i] = t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_pipeline(spark, tmp_path):
    """The whole equals its stages by brute force, given the learned scores and the mix's counts."""
    import corpus_pipeline

    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    rows = junky(160)
    rows = ["\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)) for w in (t.split(" ") for t in rows)] + ODD
    rows += [rows[1], rows[2] + " more", rows[4] + "\nlast line", "\n".join(rows[5].split("\n")[:4] + rows[7].split("\n")), rows[8].replace(" ", "  ")]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, rows).write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == corpus_pipeline.COLUMNS, name
    machine = quality.fit(docs, labels(spark, rows))
    kept = {r["doc_id"]: r["text"] for r in quality.scored(docs, machine).where("quality_score >= 0.5").collect()}
    assert 60 < len(kept) < len(rows)
    kept = brute_lines(kept)
    ids = sorted(kept)
    label, _ = near_labels([kept[i] for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if label[k] == k}
    assert len(kept) < len(ids)
    after = spark.createDataFrame([(i, t, "en", f"src{i % 3}" if i % 5 else None, 0) for i, t in kept.items()], DOCS)
    times = {r["doc_id"]: math.floor(r["taken"] / max(1, r["size"]) + 0.5) for r in mixing.mix(after).collect()}
    known = tiktoken.Encoding("known", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.codec(bpe.rank_file_path()).ranks, special_tokens={})
    want = collections.Counter()
    for i, t in kept.items():
        x = known.encode_ordinary(t or "")
        want[i, len(x), np.array(x, dtype="<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()] += times[i]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["text_sha256"]) for r in out) == +want
    assert all(r["text_sha256"] == r["decoded_sha256"] for r in out)
