"""Quality rules kept in a bitmask ledger.

Each rule is evaluated once for each document. The ledger holds the measurements and one long whose bit i says
that rule i failed. Policies are versioned masks over those bits: applying another version, or asking what a
policy would keep without one of its rules, reads the ledger and never a text again.

All of it is DataFrame expressions. Repeated windows of words are found by the sorted hashes of a document's
windows (64 bits over 64-bit hashes of the words: two unequal windows of one document fall together about once in
10**10 documents of 50,000 words); positions are looked at only where some hash occurs twice.

Cases: null and empty texts and texts of white space have no words and fail `few_words`; a text of one very long
word is measured whole; repeated rows are measured each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rule of each bit: failed if the condition over the measurements holds.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > word_chars"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
]
#: Names of the rules of each version; a version never changes, a new one is added.
POLICIES: dict[str, list[str]] = {
    "v1": ["few_words", "repeated_words"],
    "v2": ["few_words", "repeated_words", "symbols", "repeated_lines"],
    "v3": ["few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "short_words", "long_words"],
}


def bit(rule: str) -> int:
    return 1 << [n for n, _ in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and the measurements of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(F.split(text, C.GAP), lambda w: w != "").alias("words"), lines.alias("lines"),
                         (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"), (F.size(F.split(text, r"\p{Lu}")) - 1).cast("long").alias("n_capitals"))
    d = d.select("doc_id", "n_symbols", "n_capitals", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.expr("aggregate(words, 0L, (a, w) -> a + length(w))").alias("word_chars"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    d = d.withColumn("windows", F.expr("if(n_words >= 5, transform(sequence(0, int(n_words) - 5), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2], hashes[i + 3], hashes[i + 4])), array())"))
    d = d.drop("hashes").withColumn("twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    # of texts with some window twice: windows by hash, then the places of those beside their equal
    d = d.withColumn("sorted", F.expr("if(twice, sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))), null)")).drop("windows")
    d = d.withColumn("places", F.expr("sort_array(transform(filter(sorted, (x, k) -> (k > 0 and sorted[greatest(k - 1, 0)].h = x.h) or (k < size(sorted) - 1 and sorted[least(k + 1, size(sorted) - 1)].h = x.h)), x -> x.i))"))
    covered = "aggregate(places, named_struct('n', 0, 'last', -5), (a, i) -> named_struct('n', a.n + least(5, i - a.last), 'last', i), a -> bigint(a.n))"
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(F.expr(covered), F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines", "n_capitals")


def ledger(documents: DataFrame) -> DataFrame:
    """The measurements and `failed`, the bits of the rules that failed."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(documents).withColumn("failed", total)


def passes(policy: str, failed: Column | None = None) -> Column:
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail nothing else, and rows kept with and without it.

    Rows are first summed by their failure bits, of which there are at most 2**rules.
    """
    own = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sums = book.select(own.alias("failed")).groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    s = sums.select("failed", "n", one.alias("r")).select("failed", "n", "r.rule", "r.bit")
    return s.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("failed") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
