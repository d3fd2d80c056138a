"""The token automaton, fill-in-middle and phrase mining against libraries, brute force and odd inputs."""

import collections
import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import bpe, collocations, infill, tokendfa

DOCS = "doc_id long, text string, lang string, source string"
ODD = [None, "", " \n\t ", "a", "x " * 3000, "é ß 漢字 a", "A\n\nB", "a<P>b c d", "<|endoftext|>x <|endoftext|>", "\U0001f600\U0001f600 b "]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.rank_file_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def strange(n, seed):
    rng = random.Random(seed)
    some = ["".join(rng.choice("ab 's't're'll''d\n\t 　é12٣½!?-\U0001f600漢\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(n)]
    some += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return some + ["a" * 900, "-" * 700, " " * 5000, "the" * 300, "é" * 400, "x<|endoftext|> <|endoftext|><|endoftext|>  y", *(t or "" for t in ODD)]


def test_token_automaton_equals_library():
    known, c = library(), tokendfa.codec(bpe.rank_file_path("byte_bpe_50k.json"))
    some = strange(1500, 4)
    want = [e.ids for e in known.encode_batch(some, add_special_tokens=False)]
    assert c.encode(some) == [",".join(map(str, w)) for w in want]
    assert [c.decode(",".join(map(str, w))) for w in want] == [known.decode(w, skip_special_tokens=False) for w in want]
    rng = random.Random(9)
    for ids in ([rng.randrange(50257) for _ in range(6)] for _ in range(500)):  # bytes that aren't UTF-8
        assert c.decode(",".join(map(str, ids))) == known.decode(ids, skip_special_tokens=False)


def merged_by_rule(word, merges):
    """Merges in order, each from the left, over the whole word."""
    ids = list(word)
    for u, v, w in merges:
        k = 0
        while k + 1 < len(ids):
            if (ids[k], ids[k + 1]) == (u, v):
                ids[k : k + 2] = [w]
            k += 1
    return ids


def test_automaton_of_random_merges():
    """Pairs of equal tokens, merges that never apply, and split classes, on an alphabet of three bytes: every word is encoded as the merges say, by both paths."""
    for seed in range(30):
        rng = random.Random(seed)
        labels, merges = [bytes([b]) for b in range(256)], []
        while len(merges) < 25:
            u, v = (rng.choice([97, 98, 99, *range(256, len(labels))]) for _ in range(2))
            if labels[u] + labels[v] not in labels:
                merges.append((u, v, len(labels)))
                labels.append(labels[u] + labels[v])
        a = tokendfa.Automaton(labels, merges)
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(200)]
        want = [",".join(map(str, merged_by_rule(w, merges))) for w in words]
        assert a.encode(words) == want and [a._encode_long(w) for w in words] == want and [a.emit(x) for x in want] == words
    with pytest.raises(ValueError):
        tokendfa.Automaton([b"a", b"b", b"ab", b"aab"], [(0, 2, 3), (0, 1, 2)])


def test_token_frames(spark, tmp_path):
    known, path = library(), bpe.rank_file_path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(ODD)] + [(3, "a", "en", "s"), (None, "b", None, None)], DOCS).repartition(3)
    got = tokendfa.digests(df, path).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        t = (ODD[r["doc_id"]] if r["doc_id"] is not None else "b") or ""
        ids = known.encode(t, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = tokendfa.decode(tokendfa.encode(df.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)), path), path).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert tokendfa.digests(df.limit(0), path).count() == 0
    bad = json.load(open(path)) | {"normalizer": {"type": "Lowercase"}}
    with pytest.raises(ValueError):
        tokendfa.Codec(bad)
    small = tokendfa.Codec(json.load(open(path)), cache_words=3)
    assert small.encode(["one two three four five"] * 2) == [",".join(map(str, known.encode("one two three four five").ids))] * 2 and not small.cache


TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
UNITS = {"token": TOKEN, "run": re.compile("[\x20\x09-\x0d]+|[^\x20\x09-\x0d]+"), "line": re.compile("[^\n]*\n|[^\n]+"), "character": re.compile("(?s).")}


def filled(doc_id, t, units=TOKEN, rate=50, spm=80, seed=42):
    u = units.findall(t)
    d = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm_ = h[3] % 100 < spm
    return len(u), "spm" if spm_ else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm_ else f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark):
    rng = random.Random(3)
    rows = ODD + ["".join(rng.choice("ab<P>SM \t\n\x0bé漢\U0001f600\x00") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(rows)] + [(5, rows[5], "x", "y")], DOCS).repartition(3)
    clash = df.withColumn("output", F.lit(1)).withColumn("n", F.lit("n")).withColumn("_infill_text", F.lit(2)).withColumn("a.b", F.lit(3))
    for grammar, units in UNITS.items():
        for rate, spm in ((50, 80), (100, 0)):
            job = infill.Infill(rate=rate, spm=spm, grammar=grammar)
            got = job.transform(clash)
            got = got.withColumn("restored", job.restore(F.col("output"), F.col("form"))).collect()
            assert len(got) == len(rows) + 1
            for r in got:
                t = rows[r["doc_id"]] or ""
                assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == filled(r["doc_id"], t, units, rate, spm) and r["restored"] == t and r["_infill_text"] == 2
    assert infill.Infill().transform(df.limit(0)).count() == 0
    assert infill.Infill(rate=100).transform(spark.createDataFrame([(None, "a b", None, None)], DOCS)).first()["output"] == filled("", "a b", rate=100)[4]
    with pytest.raises(ValueError):
        infill.Infill(sentinels=("<P>", "<P>", "<M>"))


def brute_automaton(words, pieces, depth):
    """Right-equivalence by sets of end positions."""
    ends = collections.defaultdict(set)
    for i in range(len(words)):
        for d in range(1, depth + 1):
            if i - d + 1 >= 0 and pieces[i - d + 1] == pieces[i]:
                ends[tuple(words[i - d + 1 : i + 1])].add(i)
    classes = collections.defaultdict(list)
    for phrase, at in ends.items():
        classes[frozenset(at)].append(phrase)
    return ends, classes


def test_suffix_automaton_states():
    for seed in range(25):
        rng = random.Random(seed)
        n = rng.randint(1, 60)
        words = np.array([rng.randrange(rng.choice([2, 4, 9])) for _ in range(n)])
        pieces = np.cumsum([rng.random() < 0.15 for _ in range(n)])
        for depth in (1, 2, 3, 4):
            a = collocations.SuffixAutomaton(words, pieces, depth)
            ends, classes = brute_automaton(words.tolist(), pieces.tolist(), depth)
            assert len(a.longest) == len(classes)
            phrase = lambda s, d: tuple(words[a.end[s] - d + 1 : a.end[s] + 1].tolist())  # noqa: E731, B023
            for s in range(len(a.longest)):
                own = classes[frozenset(ends[phrase(s, a.longest[s])])]
                assert sorted(map(len, own)) == list(range(a.shortest[s], a.longest[s] + 1)) and a.count[s] == len(ends[own[0]])
                up = phrase(s, a.shortest[s])[1:]
                assert (a.link[s] == -1) == (not up)
                if up:
                    assert phrase(a.link[s], len(up)) == up and a.longest[a.link[s]] == len(up)
            for d in range(1, depth + 1):
                at, count = a.phrases(d)
                assert {tuple(words[e - d + 1 : e + 1].tolist()): c for e, c in zip(at, count)} == {p: len(x) for p, x in ends.items() if len(p) == d}


def brute_phrases(rows, most=3, least=10, top=2000, covered=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for d in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        drop = {p[i:j] for p, b in some.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * b >= covered * some[p[i:j]]}
        found = []
        for p, a in some.items():
            if p not in drop:
                score, _, left, right = min(((10**6 * a * a) // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("most,least,top,covered", [(3, 10, 2000, 50), (3, 3, 7, 80), (2, 5, 2000, 50), (4, 4, 2000, 60)])
def test_collocations_equal_brute_force(spark, monkeypatch, most, least, top, covered):
    rng = random.Random(7)
    vocabulary = ["the", "of", "New", "york", "é", "漢字", "x-1", "a b", "zz"]
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)]
    for i in range(200):
        t = "".join(rng.choice(vocabulary[: rng.randint(2, 9)]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((100 + i, t, rng.choice(["en", "en", "de", None, "und"]), None))
    rows += rows[50:60]
    monkeypatch.setattr(collocations, "SHARD", 2000)
    monkeypatch.setattr(collocations, "HOT", 10)
    df = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("clash")).repartition(5)
    got = collocations.Collocations(most, least, top, covered).mine(df).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, most, least, top, covered) and got
    assert collocations.Collocations().mine(df.limit(0)).count() == 0


def test_shard_words():
    texts = [t or "" for t in ODD] + ["One,two  three\tFOUR.\nfive", "six"]
    s = collocations.Shard(pa.array(texts), pa.array(["en"] * (len(texts) - 1) + ["de"]))
    want = [(w, k, i) for i, t in enumerate(texts) for k, p in enumerate(re.split("[.,;:!?\x0a-\x0d]", t.translate(LOW))) for w in re.findall("[^\x20\x09]+", p)]
    names = s.names.to_pylist()
    assert [names[k] for k in s.word] == [w for w, _, _ in want]
    assert [a == b for a, b in zip(s.piece, s.piece[1:])] == [a[1:] == b[1:] for a, b in zip(want, want[1:])]
    assert s.lang.to_pylist()[s.word[-1]] == "de" and len(collocations.Shard(pa.array(["", "."]), pa.array(["a", None])).word) == 0
