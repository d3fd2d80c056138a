"""What the operators of this package share: tables, the shared folder, and word scanning over Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words; everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session that names none (tests) gets a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sheetwise-"))
    return context.getCheckpointDir()


#: Tables and broadcasts of the scratch blocks that are open, the innermost last.
_scratch: list[list[str | Broadcast]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/sheetwise-{label}-{uuid.uuid4().hex[:12]}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs nothing that is written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_out(spark: SparkSession, value: object) -> Broadcast:
    """value as a broadcast, which the scratch block that is open takes back at its end."""
    out = spark.sparkContext.broadcast(value)
    if _scratch:
        _scratch[-1].append(out)
    release_memory()
    return out


class Scratch:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def path(self, label: str) -> str:
        return fresh_path(self.spark, label)

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        """df as a table that outlives the block (it is the enclosing block's, if there is one)."""
        mine = _scratch.pop()
        try:
            return written(df, label)
        finally:
            _scratch.append(mine)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Everything that is written or sent_out within the block is deleted at its end, but for kept() results: a query leaves its result in the shared folder, not its intermediate tables. A result that is not kept() must not read either."""
    _scratch.append([])
    try:
        yield Scratch(spark)
    finally:
        for made in _scratch.pop():
            if isinstance(made, str):
                drop_written(made, spark)
            else:
                made.destroy()


def word_array(text: Column) -> Column:
    """The words of a text (null: none), in order, as DataFrame expressions only."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def held_out(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column and n+1 offsets into them; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


class Words:
    """Words of a batch of texts. low: the bytes with A-Z lowered and eight zeros after them; word i is low[starts[i]:ends[i]] and belongs to text doc[i]."""

    def __init__(self, column: pa.Array, lower: bool = True):
        flat, offsets = text_buffer(column)
        n = len(flat)
        self.low = np.zeros(n + 8, dtype=np.uint8)
        self.low[:n] = _LOWER[flat] if lower else flat
        ink = np.zeros(n + 1, dtype=bool)
        ink[:n] = ~_IS_SPACE[flat]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = ink[:-1]
        self.starts = np.flatnonzero(ink & (cut | ~before))
        self.ends = np.flatnonzero(before & (cut | ~ink))
        self.offsets = offsets
        self.per_doc = np.diff(np.searchsorted(self.starts, offsets))
        self.first = np.concatenate(([0], np.cumsum(self.per_doc)))
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.per_doc)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same on every machine."""
        return span_hashes(self.low, self.starts, self.ends)


def span_hashes(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash byte spans eight bytes at a time; padded ends with eight spare bytes."""
    lanes = np.ndarray((max(len(padded) - 7, 0),), dtype="<u8", buffer=padded, strides=(1,))
    length = (ends - starts).astype(np.uint64)
    h = length * np.uint64(0x9E3779B97F4A7C15)
    left, at, rows = (ends - starts).astype(np.int64), starts, None
    while len(left):
        lane = lanes[at]
        short = left < 8
        if short.any():
            keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 7).astype(np.uint64)))
            lane = np.where(short, np.where(left > 0, lane & keep, 0), lane)
        if rows is None:
            h = mix(h ^ lane)
        else:
            h[rows] = mix(h[rows] ^ lane)
        go = np.flatnonzero(left > 8)
        rows = go if rows is None else rows[go]
        left, at = left[go] - 8, at[go] + 8
    return h


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and fold, twice."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def release_memory() -> None:
    """Give freed memory back to the machine: Python workers live on, and what one query held counts against the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], about: int, column: str = "text") -> Iterator[pa.Table]:
    """The rows in tables of about so many bytes of text (one long text may be more): long arrays for vectorised work, in bounded memory."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, ends = text_buffer(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + about - size, side="right")) - 1)
            stop = min(stop, batch.num_rows)
            held.append(batch.slice(begin, stop - begin))
            size += int(ends[stop] - ends[begin])
            begin = stop
            if size >= about or begin < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                release_memory()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        held = []
    release_memory()


def drop_written(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a table that written() made, once nothing reads it any more."""
    if isinstance(df_or_path, str):
        paths = [df_or_path]
    else:
        spark = df_or_path.sparkSession
        paths = sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    for path in paths:
        if "sheetwise-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of a bit map at most.
MOST_BITS = 1 << 27


def bit_map(keys: DataFrame) -> np.ndarray:
    """A bit map of bounded size (16 MB at most, 64 bits a key before that) that has a bit for each key (long)."""
    bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, (64 * keys.count()).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((key & {bits - 1}) & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint8)


def hits(map_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit."""
    place = keys & np.uint64(8 * len(map_) - 1)
    return (map_[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def let(value: Column, body) -> Column:
    """body(v) with v bound to value, so that lambdas inside body don't compute value again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def labelled_sample(labels: DataFrame, label: str, bound: int, where: Column | None = None, key: str = "doc_id") -> DataFrame:
    """(key, label) of labelled rows, at most about ``bound`` (less by 4 standard deviations): those of least hash. The same rows each time; a repeated key counts once."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    rows = (rows.where(where) if where is not None else rows).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    n = rows.count()
    if n > bound:
        rows = rows.where((F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 1) / float(1 << 63)) < (bound - 4 * bound**0.5) / n)
    return rows
