"""Shared pieces of the training-data operators.

Every operator takes DataFrames and returns DataFrames. Intermediate tables
that must outlive an executor are written below the folder that the session
names in ``spark.checkpoint.dir``. Operators that return lazy frames expect
their caller to run them with Arrow batches of some megabytes (BATCHES).
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Raw bytes that one numpy block holds at most (a longer text is a block of its own).
BLOCK_BYTES = 1 << 19


#: Batches of some megabytes: texts are long, and a reader or worker holds a batch several times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "128"}


@contextmanager
def bounded_batches(spark: SparkSession):
    """The session with BATCHES while a table is written, then with its own values again."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def bound_batches(spark: SparkSession) -> None:
    """Sets BATCHES for the session: for applications, whose lazy results are run by others."""
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a registered query. Queries hand lazy frames to their caller, so the session gets BATCHES for good here."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI of the file system that Spark itself would use for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


class Tables:
    """The intermediate tables made while it is open, for a caller that knows when they have served."""

    open_: ClassVar[list[Tables]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self):
        Tables.open_.append(self)
        return self

    def __exit__(self, *_):
        Tables.open_.remove(self)

    def release(self, keep: DataFrame | None = None) -> None:
        """Deletes them, but for those that ``keep`` reads."""
        files = keep.inputFiles() if keep is not None else []
        for path in list(self.paths):
            if not any(path.rpartition("/")[2] in f for f in files):
                remove_path(self.spark, path)
                self.paths.remove(path)


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    Without ``spark.checkpoint.dir`` only a local session, whose executors are
    the driver itself, gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="gridmorph-")
        base = _LOCAL["dir"]
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for t in Tables.open_:
        t.paths.append(path)
    return path


_LOCAL: dict[str, str] = {}


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a durable cut of the lineage."""
    path = shared_dir(df.sparkSession)
    with bounded_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_for(spark: SparkSession, least: int = 256) -> int:
    """Number of hash buckets of a packed exchange; follows the session's shuffle width."""
    return max(least, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with ``rank`` 0, 1, ... in the given order.

    Ranges are dealt to partitions, sorted and numbered there; only the
    partitions' row counts meet in one window, so no task sees all rows.
    """
    flat = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    flat = flat.withColumn("part_", F.shiftright("at_", 33))
    sizes = flat.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    starts = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("start_"))
    # a row for each partition
    return flat.join(F.broadcast(starts), "part_").withColumn("rank", F.col("start_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))).drop("part_", "at_", "start_")


def _held() -> dict:
    module = sys.modules.setdefault("gridmorph_worker_cache", types.ModuleType("gridmorph_worker_cache"))
    return module.__dict__.setdefault("held", {})


def worker_cache(key: str, make):
    """make() once for each Python worker process and key: tasks of one worker share compiled models and memos.

    A worker keeps one of them at a time, besides tables of powers.
    """
    held = _held()
    if key not in held:
        if key != POWERS:
            forget_models()
        held[key] = make()
    return held[key]


POWERS = "powers"


def forget_models() -> None:
    """Gives back what earlier tasks left in this worker process: other operators' models, and memory that the allocators hold."""
    held = _held()
    for key in set(held) - {POWERS}:
        del held[key]
    pa.set_memory_pool(pa.system_memory_pool())  # whose freed memory can be given back
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: its allocator decides
        pass


# --- Arrow and numpy ------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets from 0; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def text_in(column: pa.Array) -> pa.Array:
    """A column of texts, or the field ``text`` of a column of rows."""
    return pc.struct_field(column, "text") if pa.types.is_struct(column.type) else column


def sliced(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES):
    """The batch in runs of rows whose text column holds about ``most`` bytes each, at least one row."""
    _, offsets = utf8(text_in(batch.column(column)))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield batch.slice(row, end - row)
        row = end


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and the document of each.

    Words are runs of bytes outside 0x20 and 0x09-0x0D; they never cross documents.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~is_space(data)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begin[firsts] = inside[firsts]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    finish[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept by the worker."""
    held = worker_cache(POWERS, dict)
    got = held.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        got[0] = 1
        held[base] = np.cumprod(got, out=got)
    return got[:n]


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _powers(base, n), out=self.prefix[1:])
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)

    def spans(self, starts, ends) -> np.ndarray:
        return mix64((self.prefix[ends] - self.prefix[starts]) * self.back[starts])

    def windows(self, width: int) -> np.ndarray:
        """Of every window of ``width`` symbols."""
        n = len(self.prefix) - width
        return mix64((self.prefix[width:] - self.prefix[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: A 64-bit symbol for each byte value, in two independent alphabets.
BYTE_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
OTHER_SYMBOLS = mix64(BYTE_SYMBOLS ^ np.uint64(0xA0761D6478BD642F))


#: Words up to this many bytes are hashed by two rolling hashes at once; they cannot hold the long patterns on which such hashes agree.
SHORT_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent 64-bit symbols of each word, as rows: rolling hashes over two alphabets for short words, XXH3-128 for others."""
    out = np.empty((len(starts), 2), np.uint64)
    for k in (0, 1):
        out[:, k] = Rolling(BYTE_SYMBOLS[data] if k == 0 else OTHER_SYMBOLS[data], BASES[k]).spans(starts, ends)
    long = np.flatnonzero(ends - starts > SHORT_WORD)
    if len(long):
        view = memoryview(data)
        out[long] = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return out


def covered_by(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks of the positions 0..n-1 inside spans that do not overlap."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def covered(n: int, starts: np.ndarray, width) -> np.ndarray:
    """Marks of the positions 0..n-1 that spans [start, start + width) cover."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1]
    edge -= np.bincount(np.minimum(starts + width, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0
