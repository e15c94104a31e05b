"""What several training-data operators share: shared storage, byte arrays of texts, hashed n-grams."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and \t..\r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Java / RE2 class of the same characters, and of what is not one.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor reach: spark.checkpoint.dir, or a local one where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='newsloom-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what `written` wrote, once nothing reads it any more: rounds of a loop need not pile up until the session ends."""
    path = df.__dict__.get("_written_at")
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows than Spark's default, unless the session chose a size itself: whole long texts stay within a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Gives back what a Python worker holds without need: it lives on, idle, beside the JVM's next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    freed = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if freed is not None:
        freed(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def free_prefix(df: DataFrame, wanted: str = "_n_") -> str:
    """A beginning that no column name of df has."""
    while any(c.lower().startswith(wanted.lower()) for c in df.columns):
        wanted = "_" + wanted
    return wanted


#: Words of 64 bits that a key filter has at most (16 MB broadcast).
FILTER_WORDS = 1 << 20


def flagged(rows: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """rows with the boolean column `flag`: false only if `key` is no value of `keys` (one column, long).

    A filter of one bit for each hashed key, 16 bits for each key up to FILTER_WORDS words, is broadcast: rows that
    cannot have a partner need not be shuffled to learn it. Beyond that size more rows are flagged in vain, no row is missed.
    """
    hashed, m = keys.select(F.xxhash64(F.col(keys.columns[0])).alias("h")), 64
    n = hashed.count()
    while m < 64 * FILTER_WORDS and m < 16 * n:
        m *= 2
    place = lambda h: h.bitwiseAND(F.lit(m - 1))
    p = free_prefix(rows)
    bit = lambda c: f"shiftleft(1L, int({c} & 63))"
    words = hashed.select(place(F.col("h")).alias("at")).groupBy(F.expr("at div 64").alias(f"{p}word")).agg(F.expr(f"bit_or({bit('at')})").alias(f"{p}bits"))
    words = written(words, "filter")
    asked = rows.withColumn(f"{p}at", place(F.xxhash64(key))).withColumn(f"{p}of", F.expr(f"`{p}at` div 64"))
    met = asked.join(F.broadcast(words), F.col(f"{p}of") == F.col(f"{p}word"), "left")
    return met.withColumn(flag, F.coalesce(F.expr(f"(`{p}bits` & {bit(f'`{p}at`')}) <> 0"), F.lit(False))).drop(f"{p}at", f"{p}of", f"{p}word", f"{p}bits")


def without(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """rows whose number `name` is not in `gone` (one column); only rows that the filter flags are shuffled."""
    flag = free_name(rows, "flag")
    asked = flagged(rows, F.col(name), gone, flag)
    stay = asked.where(~F.col(flag)).drop(flag)
    return stay.unionByName(asked.where(flag).drop(flag).join(gone.select(F.col(gone.columns[0]).alias(name)).hint("shuffle_hash"), name, "left_anti").select(*rows.columns))


def numbered(documents: DataFrame, name: str) -> DataFrame:
    """documents with a number for each row that stays the same in every later read.

    doc_id where it is unique and never null; else a row number in a copy written to shared storage (numbers by
    partition would change if the files were split otherwise, as after executors came or went).
    """
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return documents.withColumn(name, F.col("doc_id").cast("long"))
    return written(documents.withColumn(name, F.monotonically_increasing_id()), "numbered")


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each with a space before it and one after the last; and where each begins (at its space)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.full(1, 32, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    return np.insert(raw, at, 32), at[:-1] + np.arange(len(texts))


def word_array(b: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """Where each word of the byte array (of `flat_bytes`) begins, and the words."""
    gap = SPACE[b]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return starts, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b[~gap])])


def slices(texts: pa.Array, most: int = 1 << 20):
    """Runs of consecutive texts of about `most` bytes each, a longer text alone: (first, end)."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts.to_pylist()), np.int64, len(texts)) if not len(texts) else lengths(texts)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, nulls zero."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)


_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_held: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if _held.get("n", 0) < n:
        _held.update(n=n, p=_powers(_P, n), q=_powers(_PI, n))
    return _held["p"][:n], _held["q"][:n]


def ngrams(b: np.ndarray, ns: tuple[int, ...], bits: int):
    """For each n: the bucket of the n bytes from each position, and whether they count (no white space but at their ends)."""
    gap = SPACE[b]
    wide = b.astype(np.uint32)
    h = wide.copy()
    inner = np.ones(len(b), bool)
    for n in range(2, max(ns) + 1):
        m = len(b) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) + wide[n - 1 :]
        inner = inner[:m] & ~gap[n - 2 : n - 2 + m] if n > 2 else inner[:m]
        if n in ns:
            x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            yield n, x >> np.uint32(32 - bits), inner


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the byte array begins, and 64 bits of hash."""
    gap = SPACE[b]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    p, q = powers(len(b) + 1)
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:-1], out=s[1:])
    h = (s[ends] - s[starts]) * q[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return starts, h


def words(b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the byte array begins, and its bucket."""
    starts, h = word_hashes(b)
    return starts, (h >> np.uint64(64 - bits)).astype(np.uint32)
