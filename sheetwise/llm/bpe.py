"""Byte-level BPE encoding and decoding.

Pre-tokenisation looks at whole batches at once. Every code point gets a symbol (letter, number, space, other, and what the next
code points make of it), every symbol is a function from eight states to eight states, and function composition is associative: the
functions of fixed blocks are composed side by side, the blocks' results are chained by pointer doubling, and a second sweep replays each
block from its known entry state. A piece starts wherever the replayed step says so. No regex runs over the text.

Pieces then go through a bounded cache in front of the pair merging; offsets of pieces are kept, so that any id range can be decoded and
traced to its place in the text.

Defined cases: a null text is the empty text (no ids, the digest of no bytes); pairs of equal rank merge from the left; white space only, texts of any length and repeated rows
are encoded as they are; an empty table gives an empty result; columns beside the key and the text pass ``encode`` unread, and one named like an output column is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols 0-2 are the classes; then an apostrophe before a one-letter and before a two-letter ending, and four kinds of space.
APOS1, APOS2, MID, BLANK, LAST, TAIL = range(3, 9)
#: States: nothing open, a letter, number or other run, a space run, one blank that waits for a run, an ending with two or one letters to come.
IDLE, IN_L, IN_N, IN_O, IN_S, WAIT, TWO, ONE = range(8)
N_SYMBOLS, N_STATES, BLOCK = 9, 8, 64
#: Rank of a pair that never merges.
NEVER = 1 << 60
#: Endings that stand alone after an apostrophe (fixed values of the pattern).
ENDINGS1, ENDINGS2 = "stmd", ("re", "ve", "ll")
#: Code points with the White_Space property.
WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Letters and numbers that Unicode 16 added; this Python's tables can be older than those of the tokenizer libraries (fixed values: first, last).
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@cache
def code_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[WHITE] = SPACE
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece start here) by symbol and state; symbol + N_SYMBOLS is the same symbol at the start of a text."""
    step = np.zeros((2 * N_SYMBOLS, N_STATES), dtype=np.uint8)
    begin = np.ones((2 * N_SYMBOLS, N_STATES), dtype=bool)
    for symbol, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        step[symbol] = run
        begin[symbol, [run, WAIT]] = False
    step[LETTER, TWO], step[LETTER, ONE] = ONE, IDLE
    begin[LETTER, [TWO, ONE]] = False
    for symbol, state in ((APOS1, ONE), (APOS2, TWO)):
        step[symbol] = state
        step[symbol, [IN_O, WAIT]] = IN_O
        begin[symbol, [IN_O, WAIT]] = False
    for symbol in (MID, TAIL, LAST):
        step[symbol] = IN_S
    begin[MID, IN_S] = begin[TAIL, IN_S] = False
    step[BLANK] = WAIT
    step[N_SYMBOLS:] = step[:N_SYMBOLS, IDLE : IDLE + 1]
    return step, begin


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that rows of symbols can compose to, numbered, the identity first: (of the symbols, products, images of the states)."""
    step, _ = automaton()
    number = {tuple(range(N_STATES)): 0}
    queue = list(number)
    for f in queue:
        for row in step:
            g = tuple(int(row[x]) for x in f)
            if g not in number:
                number[g] = len(number)
                queue.append(g)
    images = np.array(queue, dtype=np.uint8)
    product = np.array([[number[tuple(g[x] for x in f)] for g in queue] for f in queue], dtype=np.uint16)
    return np.array([number[tuple(map(int, row))] for row in step], dtype=np.uint16), product, images


def symbols(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One symbol for each code point; starts: where each non-empty text begins."""
    n = len(codes)
    out = code_classes()[codes]
    last = np.append(starts[1:], n) - 1
    space = np.flatnonzero(out == SPACE)
    follows = out[np.minimum(space + 1, n - 1)] == SPACE
    made = np.where(follows, MID, np.where(codes[space] == 32, BLANK, LAST)).astype(np.uint8)
    ended = np.zeros(n + 1, dtype=bool)
    ended[last] = True
    made[ended[space]] = TAIL
    out[space] = made
    apostrophes = np.flatnonzero((codes == 39) & ~ended[:n])
    if len(apostrophes):
        first, second = codes[apostrophes + 1], codes[np.minimum(apostrophes + 2, n - 1)]
        two = np.zeros(len(apostrophes), dtype=bool)
        for a, b in ENDINGS2:
            two |= (first == ord(a)) & (second == ord(b)) & ~ended[apostrophes + 1]
        one = np.isin(first, [ord(c) for c in ENDINGS1])
        out[apostrophes[one]] = APOS1
        out[apostrophes[two]] = APOS2
    out[starts] += N_SYMBOLS
    return out


def piece_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where pieces begin, in a row of texts of which each non-empty one begins at one of starts."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    step, begin = automaton()
    of_symbol, product, images = monoid()
    padded = np.zeros(-(-n // BLOCK) * BLOCK, dtype=np.uint8)
    padded[:n] = symbols(codes, starts)
    columns = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
    after = product[:, of_symbol].ravel()  # by function, then symbol
    composed = np.zeros(columns.shape[1], dtype=np.uint16)
    for symbol in columns:
        composed = after[composed * len(of_symbol) + symbol]
    # Each block's function after those of all blocks before it, by doubling.
    reach = 1
    while reach < len(composed):
        composed[reach:] = product[composed[:-reach], composed[reach:]]
        reach *= 2
    state = np.concatenate((images[:1, IDLE], images[composed[:-1], IDLE]))
    found = np.zeros(columns.shape, dtype=bool)
    next_state, flat_begin = step.ravel(), begin.ravel()
    for k, symbol in enumerate(columns):
        at = symbol * np.uint8(N_STATES) + state
        found[k] = flat_begin[at]
        state = next_state[at]
    return np.flatnonzero(found.T.ravel()[:n])


class Codec:
    """Encoder and decoder for one rank file. cache_pieces bounds the memory of the piece cache; older pieces are merged again when met."""

    def __init__(self, ranks: dict[bytes, int], cache_pieces: int = 200_000):
        self.ranks = ranks
        self.text_of = {str(i): token for token, i in ranks.items()}
        self.cache = Pieces(ranks, cache_pieces)

    def split(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """(all texts in a row, starts of pieces, for each text the number of its first piece, and the number of pieces at last)"""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        begins = np.unique(bounds[:-1][np.diff(bounds) > 0])
        starts = piece_starts(codes, begins)
        return joined, starts, np.searchsorted(starts, bounds)

    def merged(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(ids of each piece in decimal, the code point at which it starts in all texts in a row, for each text the number of its first piece and the number of pieces at last)"""
        joined, starts, first = self.split(texts)
        cuts = [*starts.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.cache.learn({*pieces}.difference(self.cache))
        out = list(map(self.cache.__getitem__, pieces))
        self.cache.trim()
        return out, starts, first

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text in decimal, joined by one space."""
        merged, _, first = self.merged(texts)
        return [" ".join(merged[a:b]) for a, b in zip(first, first[1:], strict=False)]

    def offsets(self, texts: list[str]) -> list[list[tuple[int, list[int]]]]:
        """For each text (code point at which a piece starts in it, its ids) of each piece."""
        merged, starts, first = self.merged(texts)
        begin = np.cumsum([0, *map(len, texts)])
        return [[(int(starts[k] - at), [int(i) for i in merged[k].split(" ")]) for k in range(a, b)] for a, b, at in zip(first, first[1:], begin, strict=False)]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids.split(" "))) if ids else b""


class Pieces(dict):
    """Piece to ids in decimal; merges what is missing."""

    def __init__(self, ranks: dict[bytes, int], most: int):
        super().__init__()
        self.ranks, self.most = ranks, most
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        joins = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pairs, self.joined = np.array([*(p for p, _ in joins), 1 << 62], dtype=np.int64), np.array([*(r for _, r in joins), NEVER], dtype=np.int64)

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()

    def learn(self, pieces: set[str]) -> None:
        """Merge many short pieces side by side; a long one is merged when it is asked for."""
        raw = {p: p.encode("utf-8", "replace") for p in pieces if len(p) <= 40}
        self.update((p, str(self.ranks[r])) for p, r in raw.items() if r in self.ranks)
        todo = [p for p, r in raw.items() if r not in self.ranks]
        for a in range(0, len(todo), 50_000):
            some = todo[a : a + 50_000]
            self.update(zip(some, self._merge_all([raw[p] for p in some]), strict=True))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], NEVER)

    def _merge_all(self, raw: list[bytes]) -> list[str]:
        out = [""] * len(raw)
        size = np.array([len(r) for r in raw])
        ids, piece = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.repeat(np.arange(len(raw)), size)
        rank = np.full(len(ids), NEVER)
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        while len(ids):
            head = np.flatnonzero(np.diff(piece, prepend=-1))
            least = np.minimum.reduceat(rank, head)
            count = np.diff(np.append(head, len(ids)))
            done = least == NEVER
            if done.any():
                gone = np.repeat(done, count)
                flat, at = [str(i) for i in ids[gone].tolist()], 0
                for p, k in zip(piece[head[done]].tolist(), count[done].tolist(), strict=True):
                    out[p] = " ".join(flat[at : at + k])
                    at += k
                ids, piece, rank = ids[~gone], piece[~gone], rank[~gone]
                least, count = least[~done], count[~done]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            hit = hit[np.flatnonzero(np.diff(piece[hit], prepend=-1))]  # the first of each piece
            ids[hit] = least
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))
            ids, piece, rank = ids[keep], piece[keep], rank[keep]
            for at in (hit, hit[hit > 0] - 1):
                inside = np.zeros(len(at), dtype=bool)
                ok = at + 1 < len(ids)
                inside[ok] = piece[at[ok]] == piece[at[ok] + 1]
                rank[at[~inside]] = NEVER
                rank[at[inside]] = self._rank(ids[at[inside]], ids[at[inside] + 1])
        return out

    def __missing__(self, piece: str) -> str:
        raw = piece.encode("utf-8", "replace")
        rank = self.ranks.get(raw)
        out = str(rank) if rank is not None else " ".join(map(str, merge(raw, self.ranks)))
        if len(piece) <= 64:
            self[piece] = out
        return out


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank until none is left. A long piece keeps its pairs in a heap, so time stays n log n."""
    if len(raw) > 200:
        return _merge_long(raw, ranks)
    parts = [raw[i : i + 1] for i in range(len(raw))]
    get = ranks.get
    pairs = [get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == 1 << 60:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    import heapq

    n = len(raw)
    part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i]
        if part[i] is None or j >= n or ranks.get(part[i] + part[j]) != rank:
            continue
        part[i], part[j] = part[i] + part[j], None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(part[i] + part[right[i]])) is not None:
                heapq.heappush(heap, (r, i))
        if left[i] >= 0 and (r := ranks.get(part[left[i]] + part[i])) is not None:
            heapq.heappush(heap, (r, left[i]))
    return [ranks[p] for p in part if p is not None]


@cache
def codec(rank_file: str) -> Codec:
    """Once for each Python worker: the rank file is read where tokenizer files are installed on each machine."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return Codec(ranks)


def _chunks(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(df: DataFrame, rank_file: str, text: str = "text") -> DataFrame:
    """df with ``ids`` (array of int) and ``piece_starts`` (code point offset of each piece, array of int) for each row's text."""
    kept = [c for c in df.columns if c not in ("ids", "piece_starts")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids, places = [], []
            for a, b in _chunks(texts):
                for pieces in c.offsets(texts[a:b]):
                    ids.append([i for _, x in pieces for i in x])
                    places.append([p for p, _ in pieces])
            columns = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))], names=[*kept, "ids", "piece_starts"])

    return df.mapInArrow(run, f"{fields}, ids array<int>, piece_starts array<int>")


def decode(df: DataFrame, rank_file: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded`` (binary): the bytes of each row's ids."""
    kept = [c for c in df.columns if c != "decoded"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for batch in batches:
            raw = [c.decode(" ".join(map(str, x or []))) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in kept), pa.array(raw, pa.binary())], names=[*kept, "decoded"])

    return df.mapInArrow(run, f"{fields}, decoded binary")


def encode_decode_digests(df: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass over the rows: key, n_tokens, ids_sha256, decoded_sha256. Narrow: no row leaves its task."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, ids_digest, text_digest = [], [], []
            for a, b in _chunks(texts):
                for ids in c.encode(texts[a:b]):
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_digest.append(hashlib.sha256(ids.encode("ascii")).hexdigest())
                    text_digest.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def rank_file_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(table(spark, sf_dir, "documents"), rank_file_path())
