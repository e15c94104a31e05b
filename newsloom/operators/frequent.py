"""The most frequent n-grams of two corpora, exactly, without a shuffle of all distinct ones.

First pass: words are counted as they are, longer runs only by the cell of their hash, so that a task sends at most its
distinct words and `cells` numbers. A cell's sum bounds the count of each run in it, and the count of the word in place
`features` bounds from below what a term of the result must reach. Second pass: runs are counted only in cells that reach
this bound; no other run can be among the first. If there are fewer words than features the bound is 0 and all runs are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import shared

#: Runs of signs that count as words.
WORD = r"\b[a-z][a-z0-9]+\b"


def words(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def prepared(column: Column) -> Column:
    """Text for n-grams: tags to spaces, then the search form (accents folded, camel case split, signs to spaces), of which
    the tokens stay that are words as a whole; one with a letter beyond a to z is not cut in pieces, it goes."""
    return F.array_join(prepared_words(column), " ")


def prepared_words(column: Column) -> Column:
    """The words of the prepared text, cut out of the search form by one pattern."""
    form = text.normalize(F.regexp_replace(F.coalesce(column, F.lit("")), r"<[^>]+>", " "))
    return F.regexp_extract_all(form, F.lit(r"(?<![^ ])[a-z][a-z0-9]+(?![^ ])"), F.lit(0))


def _sums(by: str) -> list[Column]:
    return [F.count_if(F.col(by) == who).alias(who) for who in ("internal", "competitor")]


def _longer(w: Column, n_max: int) -> Column:
    return F.concat(*[text.ngrams(w, n) for n in range(2, n_max + 1)])


def top_ngrams(docs: DataFrame, column: str, n_max: int = 3, features: int = 10_000, by: str = "corpus", cells: int = 1 << 20) -> DataFrame:
    """ngram, internal, competitor: occurrences of runs of 1..n_max words within documents, the most frequent `features`, ties by name.

    cells: numbers that the first pass keeps of longer runs; more cells let fewer runs into the second. The result does
    not depend on it. Null texts have no words. Written to shared storage: at most `features` rows, read as often as wanted.
    column: texts, or arrays of words that were cut before; these are written, as both passes read them.
    """
    if docs.schema[column].dataType.typeName() == "array":
        d = shared.written(docs.select(by, F.col(column).alias("w")), "ngram-words")
    else:
        d = docs.select(by, words(F.col(column)).alias("w"))
    cell = lambda g: F.pmod(F.xxhash64(g), F.lit(cells)).cast("int")
    total = F.col("internal") + F.col("competitor")
    none = F.lit(None)
    single = F.transform("w", lambda x: F.struct(x.alias("word"), none.cast("int").alias("cell")))
    if n_max > 1:
        hashed = F.transform(_longer(F.col("w"), n_max), lambda g: F.struct(none.cast("string").alias("word"), cell(g).alias("cell")))
        single = F.concat(single, hashed)
    first = shared.written(d.select(by, F.inline(single)).groupBy("word", "cell").agg(*_sums(by)), "ngram-cells")
    counts = first.where("word is not null").select(F.col("word").alias("ngram"), "internal", "competitor")
    if n_max > 1:
        least = counts.select(total.alias("n")).orderBy(F.col("n").desc()).limit(features).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).first()
        bound = least.n if least.k == features else 0
        runs = d.select(by, F.explode(_longer(F.col("w"), n_max)).alias("ngram"))
        if bound > 0:
            likely = F.broadcast(first.where((total >= bound) & F.col("cell").isNotNull()).select("cell"))  # at most `cells` numbers
            runs = runs.withColumn("cell", cell(F.col("ngram"))).join(likely, "cell", "left_semi")
        counts = counts.unionByName(runs.groupBy("ngram").agg(*_sums(by)))
    return shared.written(counts.orderBy(total.desc(), "ngram").limit(features), "ngrams")
