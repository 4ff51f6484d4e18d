"""Shared plumbing of the training-data operators: shared scratch tables, bounded Arrow
blocks, word splitting and 64-bit word hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ODD = re.compile("[\u0085\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")
_SPLIT = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words as UTF-8: runs of letters and digits; ASCII and general punctuation separates."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = _ODD.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, one of our own in local mode and an error elsewhere."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="tradewire-")
    return _own


_own: str | None = None


def scratch(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared scratch folder and return the reread table.

    This cuts lineage, survives lost executors, and fixes values such as generated row ids.
    The table goes when it is discarded, or else when the driver's interpreter exits.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_root(spark)}/tradewire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def _drop(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if spark.sparkContext._jsc is None or jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Let Arrow batches hold at most ``most`` rows in this session; never raises the setting.

    A batch of 10,000 documents takes over 100 MB outside the heap of each task; texts are what is
    sent here, so the default suits none of the operators.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))


def crc_mod(column: str, n: int):
    """crc32 of the column's decimal text, modulo ``n`` (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def blocks(batches: Iterable[pa.RecordBatch], text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``text`` column (texts, bytes, lists of numbers, or sizes) holds about ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(_lengths(column))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    if pa.types.is_integer(column.type):
        size = column
    else:
        size = pc.multiply(pc.list_value_length(column), 8) if pa.types.is_list(column.type) else pc.binary_length(column)
    return pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's strings; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound (then forgotten and filled anew)."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: list[bytes], memory: WordHashes) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; a shorter text is one shingle, an empty one none."""
    if not hashes.size:
        return hashes
    n = min(n, hashes.size)
    size = hashes.size - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = mix64(out + STEP + hashes[k : k + size])
    return distinct(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values. Sorting beats numpy's hashing unique several times over here."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if x.size else x


def with_fields(schema: T.StructType, *more: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *more])


class Bitmap:
    """Marks of 64-bit hashes in 2**bits places: never misses one that was put in.

    There are about 16 places a hash, so few others pass; above 2**28 places (32 MB, what is sent to each
    executor at most) more others pass, which costs work and changes no result.
    """

    def __init__(self, rows: DataFrame, column: str, most_bits: int = 28):
        n = rows.count()
        self.bits = min(most_bits, max(16, (16 * n).bit_length()))
        shift = 64 - self.bits
        mask = F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({column}, {shift}) & 63 AS int)))")
        # At most 2**(bits - 6) rows of 16 bytes, which come as Arrow batches.
        found = rows.groupBy(F.shiftrightunsigned(F.shiftrightunsigned(column, shift), 6).alias("word")).agg(mask.alias("mask")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash (uint64) is marked."""
        at = h >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def parted(rows: DataFrame, hash_column: str, marks: Bitmap, size_of: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash is marked, and the others: a join with what was marked need not move these."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(marks)  # 32 MB at most

    def chosen(want: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, size_of):
                yield block.filter(pa.array(shared.value.holds(block.column(hash_column).to_numpy().view(np.uint64)) == want))

        return run

    return rows.mapInArrow(chosen(True), rows.schema), rows.mapInArrow(chosen(False), rows.schema)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``scratch`` that nothing reads any more; others go when the driver's interpreter exits."""
    for df in tables:
        path = _paths.pop(id(df), None)
        if path is not None:
            _drop(df.sparkSession, path)


_paths: dict[int, str] = {}
