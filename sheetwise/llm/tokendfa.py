"""BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary are compiled into a deterministic automaton over tokens that accepts exactly the token sequences the merges produce. It starts
as one state that reads any byte token; each merge (u, v) -> w, in order, is a gadget put into it: the state after u is split off and loses its arc v, and an arc w
is drawn from every state with an arc u to the state after v. A state after a token depends on the token only, so an arc's target is a column of the
table, and an arc's presence is one bit of (state class, token class); classes are split when a merge tells their members apart.

A pre-split word is encoded by table look-ups alone: each prefix of a word has one accepted token sequence, so each byte position has one state. A suffix automaton of
the labels names the tokens that can end at a position (longest first), and the one whose arc leaves the state at its beginning is taken. Many words go side by
side; long ones alone, in time linear in their length. Decoding emits the labels of the arcs.

Defined cases: a null text is the empty text (no ids, the digest of no bytes); added tokens of the file are cut out of a text first, the leftmost and longest of them, and are ids of
their own; merges of equal pairs go from the left; white space, texts of any length and repeated rows are encoded as they are; an empty table gives an empty result; columns beside the
key and the text pass ``encode`` unread, and one named like an output column is replaced by it. Bytes that aren't UTF-8 decode to U+FFFD, as the library has it.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _chunks, piece_starts, rank_file_path
from .common import release_memory, table

#: Words of more bytes than this are encoded alone.
SIDE_BY_SIDE = 48
#: Words that are encoded side by side at once.
AT_ONCE = 100_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable Latin-1 characters stand for themselves, other bytes for U+0100 and on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Automaton:
    """labels: the bytes of each token; merges: (u, v, w) in order. Tokens that no merge makes are single bytes."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self._compile(merges)
        self._index()

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        made = {t for t, label in enumerate(self.labels) if len(label) == 1}
        n = len(self.labels)
        arcs = np.zeros((256, 32), dtype=np.uint8)  # a bit for each token class
        state, kind = np.zeros(n, dtype=np.int32), np.full(n, -1, dtype=np.int32)  # -1: no state reads the token
        kind[sorted(made)] = 0
        arcs[0, 0] = 1
        in_state, in_kind = [len(made) + 1], [len(made)]  # the start counts as a token of state 0
        for u, v, w in merges:
            if u not in made or v not in made or w in made or self.labels[u] + self.labels[v] != self.labels[w]:
                raise ValueError("each merge must join two tokens made before it into a token that no other merge makes")
            made.add(w)
            a, b = int(state[u]), int(kind[v])
            state[w] = state[v]
            in_state[state[v]] += 1
            if kind[u] < 0 or b < 0 or not arcs[a, b >> 3] >> (b & 7) & 1:
                continue  # u is never before v
            if len(in_state) == len(arcs):
                arcs = np.concatenate((arcs, np.zeros_like(arcs)))
            if len(in_kind) == 8 * arcs.shape[1]:
                arcs = np.concatenate((arcs, np.zeros_like(arcs)), axis=1)
            if in_state[a] > 1:
                arcs[len(in_state)] = arcs[a]
                state[u] = len(in_state)
                in_state[a] -= 1
                in_state.append(1)
            if in_kind[b] > 1:
                new = len(in_kind)
                arcs[: len(in_state), new >> 3] |= (arcs[: len(in_state), b >> 3] >> (b & 7) & 1) << (new & 7)
                kind[v] = new
                in_kind[b] -= 1
                in_kind.append(1)
            arcs[state[u], kind[v] >> 3] &= 255 - (1 << (int(kind[v]) & 7))
            kind[w] = kind[u]
            in_kind[kind[u]] += 1
        kind[kind < 0] = len(in_kind)  # a class that no state has an arc for
        self.state, self.label_class, self.arcs = state, kind, np.ascontiguousarray(arcs[: len(in_state), : (len(in_kind) >> 3) + 1])
        if self.arcs.shape[1] <= len(in_kind) >> 3:
            self.arcs = np.pad(self.arcs, ((0, 0), (0, 1)))

    def _index(self) -> None:
        """The tokens that end at a position: a table from (node, byte) to node over all label prefixes, the longest token at each node, the next shorter one of each token."""
        child: dict[int, int] = {}
        depth, parent, by = [0], [0], [0]
        at_token = np.zeros(len(self.labels), dtype=np.int64)
        for t, label in enumerate(self.labels):
            node = 0
            for b in label:
                key = node << 8 | b
                down = child.get(key)
                if down is None:
                    down = child[key] = len(depth)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    by.append(b)
                node = down
            at_token[t] = node
        depth, parent, by = np.array(depth), np.array(parent), np.array(by)
        go = np.zeros((len(depth), 256), dtype=np.int32)
        fail, longest = np.zeros(len(depth), dtype=np.int32), np.full(len(depth), -1, dtype=np.int32)
        longest[at_token] = np.arange(len(self.labels))
        order = np.argsort(depth, kind="stable")
        first = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for d in range(1, depth.max() + 1):
            nodes = order[first[d] : first[d + 1]]
            if d > 1:
                fail[nodes] = go[fail[parent[nodes]], by[nodes]]
            go[parent[nodes], by[nodes]] = nodes
            none = nodes[longest[nodes] < 0]
            longest[none] = longest[fail[none]]
            go[nodes] = go[fail[nodes]]
        self.go, self.longest = go.ravel(), longest
        self.shorter = longest[fail[at_token]]
        self.size = np.array([len(x) for x in self.labels], dtype=np.int32)
        self.text_of = {str(t): label for t, label in enumerate(self.labels)}

    def reads(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        kind = self.label_class[token]
        return (self.arcs[state, kind >> 3] >> (kind & 7).astype(np.uint8)) & 1 > 0

    def encode(self, words: list[bytes]) -> list[str]:
        """The ids of each word in decimal, joined by commas."""
        out = [""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= SIDE_BY_SIDE]
        for k, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE:
                out[k] = self._encode_long(w)
        for a in range(0, len(short), AT_ONCE):
            some = sorted(short[a : a + AT_ONCE], key=lambda k: -len(words[k]))
            for k, ids in zip(some, self._encode_many([words[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def _encode_many(self, words: list[bytes]) -> list[str]:
        """Words from the longest to the shortest, so that those which reach a position are the first ones."""
        size = np.array([len(w) for w in words])
        most, n = int(size[0]) if len(size) else 0, len(words)
        letters = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), dtype=np.uint8).reshape(n, most).T
        reached = [int(np.searchsorted(-size, -j, side="right")) for j in range(most + 1)]
        node = np.zeros(n, dtype=np.int64)
        state, last = np.zeros((most + 1, n), dtype=np.int32), np.zeros((most + 1, n), dtype=np.int32)
        for j in range(1, most + 1):
            m = reached[j]
            node[:m] = self.go[node[:m] << 8 | letters[j - 1, :m]]
            word, token = np.arange(m), self.longest[node[:m]]
            while len(word):
                fits = self.reads(state[j - self.size[token], word], token)
                taken = token[fits]
                last[j, word[fits]] = taken
                state[j, word[fits]] = self.state[taken]
                word, token = word[~fits], self.shorter[token[~fits]]
        ids: list[list[str]] = [[] for _ in words]
        at, word = size.copy(), np.flatnonzero(size)
        while len(word):
            token = last[at[word], word]
            for k, t in zip(word.tolist(), token.tolist(), strict=True):
                ids[k].append(str(t))
            at[word] -= self.size[token]
            word = word[at[word] > 0]
        return [",".join(x[::-1]) for x in ids]

    def _encode_long(self, word: bytes) -> str:
        go, longest, shorter, size = map(memoryview, (self.go, self.longest, self.shorter, self.size))
        state, label_class, arcs, wide = memoryview(self.state), memoryview(self.label_class), memoryview(self.arcs.ravel()), self.arcs.shape[1]
        states, last = array("i", bytes(4 * len(word) + 4)), array("i", bytes(4 * len(word) + 4))
        node = 0
        for j, letter in enumerate(word, 1):
            node = go[node << 8 | letter]
            token = longest[node]
            kind = label_class[token]
            while not arcs[states[j - size[token]] * wide + (kind >> 3)] >> (kind & 7) & 1:
                token = shorter[token]
                kind = label_class[token]
            last[j], states[j] = token, state[token]
        ids, at = [], len(word)
        while at:
            ids.append(str(last[at]))
            at -= size[last[at]]
        return ",".join(ids[::-1])

    def emit(self, ids: str) -> bytes:
        """The labels of a row of arcs."""
        return b"".join(map(self.text_of.__getitem__, ids.split(","))) if ids else b""


class Codec:
    """Encoder and decoder for one tokenizer file. cache_words bounds the memory of the word cache; older words are encoded again when met."""

    def __init__(self, tokenizer: dict, cache_words: int = 200_000):
        self.added = self._checked(tokenizer)
        bytes_of = byte_alphabet()
        vocabulary = tokenizer["model"]["vocab"]
        label = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            label[i] = bytes(map(bytes_of.__getitem__, token))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in tokenizer["model"]["merges"]]
        self.automaton = Automaton(label, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        for content, i in self.added.items():
            self.automaton.text_of[str(i)] = content.encode()
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache: dict[str, str] = {}
        self.most = cache_words

    @staticmethod
    def _checked(tokenizer: dict) -> dict[str, int]:
        """Added tokens by content. Files that ask for more than byte-level BPE are refused."""
        model, split = tokenizer["model"], tokenizer["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or tokenizer.get("normalizer") or not split or split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level BPE without normalizer and prefix space is known")
        if tokenizer.get("post_processor") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokenizer["added_tokens"]):
            raise ValueError("added tokens must be plain, and there must be no post-processor")
        return {t["content"]: t["id"] for t in tokenizer["added_tokens"]}

    def _segments(self, texts: list[str]) -> tuple[list[str], list[int], dict[int, str]]:
        """Stretches between added tokens, the number of stretches before each text, and for the stretches that an added token follows that token's id."""
        out, first, follows = [], [0], {}
        for text in texts:
            at = 0
            for found in self.cut.finditer(text) if self.cut else ():
                out.append(text[at : found.start()])
                follows[len(out) - 1] = str(self.added[found.group()])
                at = found.end()
            out.append(text[at:])
            first.append(len(out))
        return out, first, follows

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text in decimal, joined by commas."""
        stretches, begins, follows = self._segments(texts)
        joined = "".join(stretches)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in stretches], dtype=np.int64)))
        starts = piece_starts(codes, np.unique(bounds[:-1][np.diff(bounds) > 0]))
        cuts = [*starts.tolist(), len(joined)]
        words = [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        new = list({*words}.difference(self.cache))
        self.cache.update(zip(new, self.automaton.encode([w.encode() for w in new]), strict=True))
        ids = list(map(self.cache.__getitem__, words))
        if len(self.cache) > self.most:
            self.cache.clear()
        first = np.searchsorted(starts, bounds).tolist()
        if not follows:
            return [",".join(ids[first[a] : first[b]]) for a, b in zip(begins, begins[1:], strict=False)]
        out = []
        for a, b in zip(begins, begins[1:], strict=False):
            parts = []
            for k in range(a, b):
                parts += ids[first[k] : first[k + 1]]
                if k in follows:
                    parts.append(follows[k])
            out.append(",".join(parts))
        return out

    def decode(self, ids: str) -> str:
        return self.automaton.emit(ids).decode("utf-8", "replace")


@cache
def codec(tokenizer_file: str) -> Codec:
    """Compiled once for each Python worker: the file is read where tokenizer files are installed on each machine."""
    with open(tokenizer_file, encoding="utf-8") as source:
        return Codec(json.load(source))


def _fields(df: DataFrame, kept: list[str]) -> str:
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema if f.name in kept)


def encode(df: DataFrame, tokenizer_file: str, text: str = "text") -> DataFrame:
    """df with ``ids`` (array of int) of each row's text."""
    kept = [c for c in df.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids = [[int(i) for i in x.split(",")] if x else [] for a, b in _chunks(texts) for x in c.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in kept), pa.array(ids, pa.list_(pa.int32()))], names=[*kept, "ids"])

    return df.mapInArrow(run, f"{_fields(df, kept)}ids array<int>")


def decode(df: DataFrame, tokenizer_file: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded`` (string): the text of each row's ids."""
    kept = [c for c in df.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_file)
        for batch in batches:
            out = [c.decode(",".join(map(str, x or []))) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in kept), pa.array(out, pa.string())], names=[*kept, "decoded"])

    return df.mapInArrow(run, f"{_fields(df, kept)}decoded string")


def digests(df: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass over the rows: key, n_tokens, ids_sha256 (ids joined by commas), decoded_sha256. Narrow: no row leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, of_ids, of_text = [], [], []
            for a, b in _chunks(texts):
                for ids in c.encode(texts[a:b]):
                    counts.append(ids.count(",") + 1 if ids else 0)
                    of_ids.append(hashlib.sha256(ids.encode("ascii")).hexdigest())
                    of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        release_memory()

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{_fields(df, [key])}n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_token_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), rank_file_path("byte_bpe_50k.json"))
