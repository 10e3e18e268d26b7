"""Helpers that the corpus operators share: staging, byte-level tokenising, hashing, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles (a longer document is one step of its own).
CHUNK_BYTES = 1 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_RNG = np.random.default_rng(20240117)
#: A random 64-bit value for each byte, and an odd multiplier of polynomial hashes modulo 2^64.
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 2)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one serves in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/statelens-{uuid.uuid4().hex}"


#: Options of staged() for rows of megabytes: row groups of 8 MB, their size looked at after each row and not after a hundred. Readers decode a row group's rows at once.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.row.count.limit": 2}


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Jobs that run meanwhile send Python this many rows at once, not ten thousand: for rows of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def staged(df: DataFrame, partition_by: str | None = None, options: dict | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there."""
    path, w = shared_dir(df.sparkSession), df.write.options(**options or {})
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aside(columns, taken) -> dict[str, str]:
    """New names for the columns whose names are taken; they clash with no other column."""
    prefix = "_"
    while any(f"{prefix}{c}" in columns for c in taken if c in columns):
        prefix += "_"
    return {c: f"{prefix}{c}" for c in columns if c in taken}


def discard(*frames: DataFrame) -> None:
    """Deletes what staged() wrote for these frames; nothing may read them any more."""
    for df in frames:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Makes checkpoint() usable, in the folder of spark.checkpoint.dir where it is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark).rpartition("/")[0])


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base=MULTIPLIER) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_chunks(column, limit: int = CHUNK_BYTES):
    """Yields (first row, UTF-8 bytes, offsets) for runs of rows of an Arrow string column; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, data[offs[lo] : offs[hi]], (offs[lo : hi + 1] - offs[lo])
        lo = hi


def pieces(buf: np.ndarray, not_word: np.ndarray, limit: int = CHUNK_BYTES):
    """Yields buf in runs of about ``limit`` bytes that end between words (a longer word stays whole)."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = lo + limit
        while hi < n:
            free = np.flatnonzero(not_word[buf[hi : hi + 4096]])
            if len(free):
                hi += int(free[0])
                break
            hi += 4096
        yield buf[lo : min(hi, n)]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, not_word: np.ndarray):
    """Starts and ends of the maximal runs of word bytes, none across rows, and how many words each row has."""
    w = ~not_word[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = offs[:-1][offs[:-1] < len(buf)]
    first[cut] = w[cut]
    starts = np.flatnonzero(first)
    last = w.copy()
    last[:-1] &= ~w[1:]
    cut = offs[1:] - 1
    cut = cut[(cut >= 0)]
    last[cut] = w[cut]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    v = BYTE_HASH[buf[np.repeat(starts, lens) + at]] * powers(int(lens.max()))[at]
    return mix(np.add.reduceat(v, np.cumsum(lens) - lens) + lens.astype(np.uint64))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the undirected edges (u, v): component is the least node it reaches.

    Alternates large-star and small-star steps until the edges stop changing: each step is one shuffle
    over at most as many edges as before, so chains shorten exponentially and no list of a node's
    neighbours is ever gathered. Nodes without an edge are not returned; no edges give no rows.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = e.checkpoint()
    seen = None
    # the least is given the node's name as an aggregate of its own, so that the join deals both sides out anew and
    # a node with very many neighbours can be split over tasks
    least_of = lambda d, m: d.groupBy("u").agg(F.min("u").alias("w"), F.min("v").alias("v")).select(F.col("w").alias("u"), m.alias("m"))
    for step in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(both, F.least("w", "v"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = least_of(large, F.col("v"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        e = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        if step % 4 == 3:
            release(spark)
    else:
        raise RuntimeError("the components did not settle")
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.union(e.select("v", F.col("v").alias("component")).distinct())
