"""Exact dedup by distributed most-significant-digit radix partitioning.

A document is the byte string of its text, each run of white space replaced by one space, with its length before
it. Groups of documents are split by successive bytes: first by length and the first `stride` bytes, then, in
each round, by the next run of bytes, four times as long as the one before. A group of one is finished; so is a
group whose bytes have ended: its texts are equal, byte for byte, and no digest was asked. Only the others go on,
so that a document's bytes move about as far as another document agrees with it: the first round aggregates a few bytes
of each document where it is read, and only documents that a broadcast filter of the groups of two or more flags are
shuffled with their texts.

A round is an aggregate by (group, next bytes), partial on the reading side, and a join of the remaining documents
with its groups of two or more. A group's name is the smallest row number in it. Remaining documents are written
to shared storage after each round, whole; rounds grow with the logarithm of the longest text.

Cases: null counts as the empty text; of rows with the same doc_id and text one stays; a null doc_id stays only
if all of its group are null; empty tables give no rows; other columns are ignored here and kept by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), C.GAP, " ")


def _bytes(data: Column, start: Column | int, n: int) -> Column:
    return F.substring(data, F.lit(start) if isinstance(start, int) else start, F.lit(n))


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows (rid, doc_id, sha, ...): each group's name, size and the row that stays; nulls sort last."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("name"), best, F.min("sha").alias("sha"))


def _alone(groups: DataFrame) -> DataFrame:
    """Groups of one row, as results."""
    return groups.where("n = 1").select(F.col("best.rid").alias("rid"), F.col("best.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")


def classes(documents: DataFrame, stride: int = 64, row: str | None = None) -> DataFrame:
    """rid (a number for each row, the column `row` if given), doc_id, keep_id, group_size, kept and sha (SHA-256 of the normalised text, binary) of each row."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = documents.select(number.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).cast("binary").alias("data"))
    rows = rows.select("rid", "doc_id", F.octet_length("data").alias("size"), _bytes(F.col("data"), 1, stride).alias("digits"), F.unhex(F.sha2("data", 256)).alias("sha"), "data")
    first = C.written(_groups(rows.drop("data"), "size", "digits"), "radix-groups")
    out = _alone(first)
    shared = first.where("n > 1").select("size", "digits", "name")
    asked = C.flagged(rows, F.xxhash64("size", "digits"), shared.select(F.xxhash64("size", "digits").alias("k")), "flag").where("flag").drop("flag")
    left = C.written(asked.join(shared, ["size", "digits"]).select("name", "rid", "doc_id", "size", "sha", _bytes(F.col("data"), stride + 1, 2**30).alias("data")), "radix-rows")
    done = stride
    while True:
        ended = left.where(F.col("size") <= done).drop("data")
        full = _groups(ended.withColumnRenamed("name", "of"), "of").select(F.col("of").alias("name"), "n", "best")
        out = out.unionByName(ended.join(full, "name").select("rid", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("best.rid")).alias("kept"), "sha"))
        going = left.where(F.col("size") > done)
        stride *= 4
        if going.isEmpty():
            return out
        going = going.withColumnRenamed("name", "of").withColumn("digits", _bytes(F.col("data"), 1, stride))
        groups = C.written(_groups(going.drop("data"), "of", "digits"), "radix-groups")
        out = out.unionByName(_alone(groups))
        shared = groups.where("n > 1").select("of", "digits", "name")
        left = C.written(going.join(shared, ["of", "digits"]).select("name", "rid", "doc_id", "size", "sha", _bytes(F.col("data"), stride + 1, 2**30).alias("data")), "radix-rows")
        done += stride


def deduplicate(documents: DataFrame, stride: int = 64) -> DataFrame:
    """The rows of documents that stay, with all their columns."""
    name = C.free_name(documents, "rid")
    rows = C.numbered(documents, name)
    gone = C.written(classes(rows, stride, name).where("not kept").select("rid"), "copies")
    return C.without(rows, name, gone).select(*documents.columns)
