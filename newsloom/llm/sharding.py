"""Sharding by extendible hashing.

Rows hash to 64 bits. A shard is a bucket of all rows whose hash begins with the same bits; only buckets over the
byte limit split, on one more bit, until every shard fits. The directory is indexed by hash-prefix bits: a level of
it has one entry for each cell, a prefix of as many bits as make a cell an eighth to a quarter of a shard on average; each cell adds
its bytes to the buckets of all its prefixes, and its entry names the shortest prefix that fits. Cells that are
themselves over the limit, if any, are split on in another level, of eight bits more.

Levels are a few entries for each shard, so they are broadcast to the rows (up to ENTRIES entries; a larger level,
of a corpus of more than about a hundred thousand shards, is left to the planner), and no text is shuffled to learn its shard.

Where bits cannot split a bucket (all rows have one hash: repeated rows) it gets overflow pages: its rows are
dealt into runs that fit, by a window over a salted part of the bucket each. A single row over the limit is a
shard of its own, or of rows as large, marked `over_limit`.

Cases: null text counts no bytes; rows with null or repeated doc_id are placed like any other; an empty table has
no shards; columns of the same names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Entries of a level that are broadcast.
ENTRIES = 2_000_000


def _prefix(h: Column, bits: int) -> Column:
    """The first bits of a hash, as a number."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def _named(prefix: Column, bits: int) -> Column:
    """A prefix as a string of 0 and 1."""
    return F.lpad(F.bin(prefix), bits, "0") if bits else F.lit("")


def _level(hashes: DataFrame, at: int, bits: int, limit: int) -> DataFrame:
    """cell (the first `bits` bits), bytes, rows, shard (its shortest prefix of `at` bits or more that fits; null if the cell does not fit).

    hashes: h, n_bytes, rows.
    """
    cells = hashes.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.sum("rows").alias("rows"))
    cells = C.written(cells, "cells")
    depths = F.sequence(F.lit(at), F.lit(bits))
    each = cells.select("cell", "bytes", F.explode(depths).alias("depth")).withColumn("bucket", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
    # each cell is in one bucket of each depth
    fits = each.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit).select("depth", "bucket")
    # of the buckets of a cell that fit the shortest is its shard; fitting ones of a cell are all its prefixes from that depth on
    least = each.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    shard = F.expr(f"if(depth = 0, '', lpad(bin(shiftrightunsigned(cell, {bits} - depth)), depth, '0'))")
    return cells.join(least, "cell", "left").select("cell", "bytes", "rows", F.when(F.col("depth").isNotNull(), shard).alias("shard"))


def assign(documents: DataFrame, limit: int = 256 << 20, key: str = "doc_id", fine: int = 2) -> DataFrame:
    """Each row with n_bytes, shard_id (hash prefix, then /page for an overflow page), shard_bytes, shard_rows and over_limit."""
    added = ("n_bytes", "shard_id", "shard_bytes", "shard_rows", "over_limit")
    base = documents.drop(*added)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    p = C.free_prefix(base)
    h = f"{p}h"
    # null as a value of its own: xxhash64 passes over nulls
    base = base.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn(h, F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0")), F.xxhash64(text)))
    hashes = C.written(base.groupBy(F.col(h).alias("h")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("rows")), "hashes")
    total = hashes.agg(F.sum("n_bytes")).first()[0] or 0
    at, bits = 0, min(64, max(1, math.ceil(math.log2(max(1, total / max(1, limit)) + 1)) + fine))
    levels, left = [], hashes
    while True:
        level = C.written(_level(left, at, bits, limit), "directory")
        levels.append((bits, level))
        over = level.where("shard is null").select("cell")
        if bits == 64 or over.isEmpty():
            break
        left = C.written(left.join(over, _prefix(F.col("h"), bits) == F.col("cell"), "left_semi"), "oversized")
        at, bits = bits + 1, min(64, bits + 8)
    entries = [_entries(level, bits, limit) for bits, level in levels]
    sums = entries[0]
    for e in entries[1:]:
        sums = sums.unionByName(e)
    sums = C.written(sums.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max("pages").alias("pages")), "shards")
    placed = base
    for i, (bits, level) in enumerate(levels):
        e = _entries(level, bits, limit).join(sums.select("shard", F.col("bytes").alias("b"), F.col("rows").alias("r")), "shard")
        e = C.written(e.select(F.col("cell").alias(f"{p}cell{i}"), F.struct("shard", F.col("b").alias("bytes"), F.col("r").alias("rows"), "pages").alias(f"{p}at{i}")), "entries")
        placed = placed.join(F.broadcast(e) if e.count() <= ENTRIES else e, _prefix(F.col(h), bits) == F.col(f"{p}cell{i}"), "left").drop(f"{p}cell{i}")
    found = F.coalesce(*[F.col(f"{p}at{i}") for i in range(len(levels))])
    placed = placed.withColumn(f"{p}at", found).drop(*[f"{p}at{i}" for i in range(len(levels))])
    get = lambda name: F.col(f"{p}at").getField(name)
    plain = placed.where(get("pages") == 1)
    rows = plain.select(*documents.drop(*added).columns, "n_bytes", get("shard").alias("shard_id"), get("bytes").alias("shard_bytes"), get("rows").alias("shard_rows"))
    if not sums.where("pages > 1").isEmpty():
        paged = placed.where(get("pages") > 1).withColumn("shard_id", F.concat(get("shard"), F.lit("/"), F.pmod(F.monotonically_increasing_id(), get("pages")).cast("string")))
        # written, as a row's page depends on where the row is read
        paged = C.written(_repage(paged.drop(h, f"{p}at"), limit, f"{p}run"), "pages")
        rows = rows.unionByName(paged.join(paged.groupBy("shard_id").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows")), "shard_id"))
    return rows.withColumn("over_limit", F.col("shard_bytes") > limit)


def _entries(level: DataFrame, bits: int, limit: int) -> DataFrame:
    """cell, shard, bytes, rows, pages of the cells of a level that have a shard; at 64 bits all have one, oversized ones in pages (rows of one hash are alike)."""
    one = F.lit(1).cast("long")
    each = F.greatest(one, F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("bytes") / F.col("rows"))))
    e = level.withColumn("pages", F.when(F.col("shard").isNull(), F.ceil(F.col("rows") / each)).otherwise(one))
    return e.withColumn("shard", F.coalesce("shard", _named(F.col("cell"), 64))) if bits == 64 else e.where("shard is not null")


def _repage(paged: DataFrame, limit: int, run: str) -> DataFrame:
    """Pages by the salt may be uneven; each is cut again into runs within the limit (rows of a page are of one size)."""
    w = Window.partitionBy("shard_id").orderBy("n_bytes")
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("n_bytes"))))
    d = paged.withColumn(run, F.floor((F.row_number().over(w) - 1) / per).cast("string"))
    return d.withColumn("shard_id", F.concat("shard_id", F.lit("."), F.col(run))).drop(run)
