"""Small helpers that several operators share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local run without one gets a temporary folder, a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_CUT: list[str] = []  # tables of this session that are still there


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that cut has written; for callers that have written the results that read them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _CUT:
        path = jvm.org.apache.hadoop.fs.Path(_CUT.pop())
        path.getFileSystem(conf).delete(path, True)


def words(text: str | None) -> list[bytes]:
    """Words of `[^\\x20\\x09-\\x0D]+`: bytes.split() parts at exactly those six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_one(x: int) -> int:
    return int(mix(np.array([x & M64], np.uint64))[0])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [M64], np.uint64)  # masks of the first 0 to 8 bytes
LONG_WORD = 256  # longer words are hashed one by one
GOLD = np.uint64(0x9E3779B97F4A7C15)
UNGOLD = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts of one Arrow column, as arrays.

    data: the UTF-8 bytes; start, end: each word's place in them; first: the number of the first
    word of each text (one entry more than texts); row: the text of each word.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray) -> None:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, places, raw = texts.buffers()
        at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if places else np.zeros(len(texts) + 1, np.int64)
        n = int(at[-1] - at[0])
        self.data = np.zeros(n + 8, np.uint8)  # eight bytes can be read from any place
        if n:
            self.data[:n] = np.frombuffer(raw, np.uint8)[at[0] : at[-1]]
        bounds = at - at[0]
        ink = ~_SPACE[self.data[:n]]
        begins, ends = ink.copy(), ink.copy()
        begins[1:] &= ~ink[:-1]
        ends[:-1] &= ~ink[1:]
        edge = bounds[:-1][bounds[:-1] < n]
        begins[edge] = ink[edge]
        edge = bounds[1:][bounds[1:] > 0] - 1
        ends[edge] = ink[edge]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, eight bytes at a time; words of up to eight bytes never collide with each other."""
        chunks = np.ndarray((len(self.data) - 7,), "<u8", self.data.data, 0, (1,))
        size = self.end - self.start
        h = mix(chunks[self.start] & _LOW_BYTES[np.minimum(size, 8)]) if len(size) else np.zeros(0, np.uint64)
        live, k = np.flatnonzero(size > 8), 8
        while len(live) and k < LONG_WORD:
            h[live] = mix(h[live] * GOLD + (chunks[self.start[live] + k] & _LOW_BYTES[np.minimum(size[live] - k, 8)]))
            k += 8
            live = live[size[live] > k]
        for i in live.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return h


PORTION = 1 << 20  # bytes of text that are looked at together


def portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in smaller ones of about PORTION bytes in a column, so that arrays over words stay small."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION, "right")))
            yield b.slice(at, end - at)
            at = end


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of all k-word shingles (empty if there are fewer words)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * GOLD + h[i : i + n]
    return mix(out)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct `row`, so that their names cannot clash with working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs from `row`, with new values for those that docs has, in their own types."""
    own = [new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f"row.`{f.name}`") for f in docs.schema.fields]
    return rows.select(*own)


def sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most `rows` rows by the smallest hash of a key; only rows under a hash threshold are carried."""
    total = df.count()
    order = F.xxhash64(F.col(key), F.lit(seed))
    if total > rows:
        # a quarter more than wanted pass the threshold, so that the limit is nearly always filled
        share = min(1.0, (1.25 * rows + 100) / total)
        df = df.where(order <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    return df.withColumn("_order", order).orderBy("_order").limit(rows).drop("_order")


FEW = 100_000  # most rows of the hot side of a skewed join


def skewed_join(rows: DataFrame, small: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows inner-joined with small (one row per key; n: how many of rows have the key), without the column n.

    Keys with more than 1 / FEW of all rows (and HOT_ROWS at least) are fewer than FEW: their side
    is broadcast, so that such a key stays spread over all tasks. The other keys are shuffled.
    """
    limit = max(HOT_ROWS, rows.count() // FEW)
    hot = small.where(F.col(n) > limit).drop(n)
    plain = small.where(F.col(n) <= limit).drop(n)
    if hot.isEmpty():
        return rows.join(plain, keys)
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(plain, keys))


def skewed_split(rows: DataFrame, small: DataFrame, keys: list[str], n: str) -> tuple[DataFrame, DataFrame]:
    """rows with a key of small, and the other rows; small may be of any length, and n counts the rows of a key, as for skewed_join."""
    limit = max(HOT_ROWS, rows.count() // FEW)
    hot, plain = F.broadcast(small.where(F.col(n) > limit).select(*keys)), small.where(F.col(n) <= limit).select(*keys)
    rest = rows.join(hot, keys, "left_anti")  # no key of these is hot
    return rows.join(hot, keys, "left_semi").unionByName(rest.join(plain, keys, "left_semi")), rest.join(plain, keys, "left_anti")


HOT_ROWS = 5_000
