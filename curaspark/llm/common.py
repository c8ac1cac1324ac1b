"""What the operators share: table access, batch splitting, word hashing on byte arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one slice of an Arrow batch may hold before it is worked on; a longer text is a slice by itself.
SLICE_CHARS = 400_000
#: Rows of text in an Arrow batch: keeps a batch to some MB for usual documents.
BATCH_ROWS = "500"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the one set on the context. Where none is named, a
    local session, which is one machine, gets a temporary one; on a cluster that is an error, as a folder of one machine
    would lose its files with the machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: What this process has written to shared folders and not removed yet.
_written: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder and survives lost executors. Shuffle files of what led to it
    go as soon as it is written."""
    spark = df.sparkSession
    shared_folder(spark)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        out = df.select("*").checkpoint()
    _written.add(_checkpoint_file(out))
    return out


def _checkpoint_file(df: DataFrame) -> str:
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: smaller than a checkpoint where there are texts, and
    read by columns."""
    folder = new_folder(df.sparkSession, name)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside, given back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.discard(folder)


def drop(*frames: DataFrame) -> None:
    """Remove checkpoints that nothing needs any more."""
    for df in frames:
        remove(df.sparkSession, _checkpoint_file(df))


def files(*frames: DataFrame) -> set[str]:
    return {_checkpoint_file(df) for df in frames}


def written() -> set[str]:
    return set(_written)


def clean(spark: SparkSession, but: set[str] = frozenset()) -> None:
    """Remove what operators have left in the shared folder, but for some. A result that was not written elsewhere yet is
    read from there, so this is for callers that have written theirs."""
    for folder in _written - set(but):
        remove(spark, folder)


def local_path(uri: str) -> str | None:
    """The path of a file on a local mount, None for other stores."""
    kind, mark, rest = uri.partition(":")
    if not mark or "/" in kind:
        return uri
    return "/" + rest.lstrip("/") if kind == "file" else None


def _store(uri: str):
    from pyarrow import fs

    at = local_path(uri)
    return (fs.LocalFileSystem(), at) if at is not None else fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Written beside and moved, so that a task that is run again or twice leaves a whole file."""
    store, path = _store(uri)
    aside = f"{path}.{uuid.uuid4().hex}"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(aside) as f:
        f.write(data)
    store.move(aside, path)


def read_file(uri: str):
    """The bytes of a file, None if there is none."""
    store, path = _store(uri)
    try:
        with store.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def list_files(uri: str) -> list[str]:
    """Names of the files of a folder, but for those that are being written."""
    from pyarrow import fs

    store, path = _store(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and "." not in f.base_name)


def map_file(uri: str):
    """A file of a local mount as mapped memory, None if there is none."""
    try:
        return pa.memory_map(local_path(uri)).read_buffer()
    except FileNotFoundError:
        return None


#: Bits of a prefilter, in words of 64: a million rows of two longs at most are broadcast, whatever the number of values.
BITS = 1 << 26


def _bit(c: Column) -> Column:
    return F.pmod(c, F.lit(BITS)).cast("int")


def mark(df: DataFrame, key: Column, values: DataFrame, column: str, name: str) -> DataFrame:
    """df with a boolean column: false only where key (a hash) is none of the values. It only spares rows a shuffle: what
    it lets through is joined exactly afterwards, and with very many values it lets everything through."""
    bit = _bit(F.col(column))
    words = values.select((bit / 64).cast("int").alias("__word"), F.expr("shiftleft(1L, " + f"cast(pmod(`{column}`, {BITS}) as int) % 64)").alias("__b")).groupBy("__word").agg(F.bit_or("__b").alias("__bits"))
    at = F.coalesce(_bit(key), F.lit(-1))
    keyed = df.withColumns({"__at": at, "__word": (at / 64).cast("int")}).join(F.broadcast(words), "__word", "left")
    hit = F.coalesce((F.col("__at") >= 0) & (F.expr("shiftrightunsigned(__bits, __at % 64)").bitwiseAND(F.lit(1)) == 1), F.lit(False))
    return keyed.withColumn(name, hit).drop("__at", "__word", "__bits")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession):
    """For actions inside: text columns need fewer rows in a batch than Arrow's default of 10,000."""
    return setting(spark, _BATCH, BATCH_ROWS)


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same for what is made of df and run later: df in a session of its own, a copy of the caller's but for the size
    of batches. The caller's session keeps its settings, whatever is built or run in it meanwhile."""
    spark = df.sparkSession
    own = spark._jsparkSession.cloneSession()
    own.conf().set(_BATCH, BATCH_ROWS)
    classic = spark._jvm.org.apache.spark.sql.classic
    there = classic.Dataset.ofRows(own, df._jdf.queryExecution().analyzed())
    session = SparkSession(spark.sparkContext, own)
    classic.SparkSession.setActiveSession(spark._jsparkSession)  # the line above has made the copy the active one
    return DataFrame(there, session)


def trim() -> None:
    """Hand back what freed batches and arrays left in the allocators of this worker; a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def leanly(batches: Iterator) -> Iterator:
    """The batches of a task. What they leave in the allocators goes back after each, and does not stay with the worker when the task ends."""
    try:
        for batch in batches:
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
    finally:
        trim()


def replace_columns(df: DataFrame, new: dict) -> DataFrame:
    """Add columns; those of the same name (whatever the case) give way."""
    taken = {k.lower() for k in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in new.items()])


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` characters together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Numbers(dict):
    """Numbers strings in the order of their first use."""

    def __init__(self):
        self.names: list[str] = []

    def __missing__(self, string: str) -> int:
        n = self[string] = len(self.names)
        self.names.append(string)
        return n


class Rows:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.all, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> int:
        """Where x begins."""
        at, self.n = self.n, self.n + len(x)
        if self.n > len(self.all):
            self.all = np.concatenate([self.all[:at], np.zeros(max(self.n, len(self.all) // 2), self.all.dtype)])
        self.all[at : self.n] = x
        return at


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = sizes.astype(np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE = 0x5851F42D4C957F2D
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * SLICE_CHARS)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            t = np.full(size, np.uint64(base))
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    return _powers["up"], _powers["down"]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, on one UTF-8 byte array (texts joined by a newline).

    start, end: byte ranges; doc: row of the slice; hash: 64-bit hash of the word's bytes.
    bounds[i]:bounds[i+1] are the words of row i, byte_bounds[i]:byte_bounds[i+1]-1 its bytes.
    """

    def __init__(self, texts: list[str], lower: bool = False, hashes: bool = True):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(coded) + b"\n"
        if lower:
            data = data.lower()  # bytes.lower() folds A-Z alone
        self.bytes = b = np.frombuffer(data, np.uint8)
        self.byte_bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)])
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.bounds = np.searchsorted(self.start, self.byte_bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        if hashes:
            up, down = _power_tables(len(b) + 1)
            total = np.cumsum(_BYTE_VALUES[b] * up[: len(b)], dtype=np.uint64)
            before = np.where(self.start > 0, total[self.start - 1], np.uint64(0)) if len(self.start) else total[:0]
            self.hash = mix64((total[self.end - 1] - before) * down[self.start] + (self.end - self.start).astype(np.uint64) * _GOLDEN)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside a text, and the index of each run's first word."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(self.hash) - n + 1
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = (h + self.hash[k : k + m]) * np.uint64(_BASE)
            h ^= h >> np.uint64(29)
        first = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix64(h[first]), first
