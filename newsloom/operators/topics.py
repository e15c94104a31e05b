"""Topic clusters of a window: TF-IDF over words and word pairs, truncated SVD, k-means with a knee search, labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import written
from . import svd

#: A topic has this many articles on average, at least; below twice as many articles there is one topic.
LEAST_SIZE = 5


def grams(docs: DataFrame, column: str, key: str) -> DataFrame:
    """key and `grams`: words of two signs or more that are no stop words, and pairs of neighbours among these. Texts of at most 10 signs go."""
    stop = StopWordsRemover.loadDefaultStopWords("english")
    words = F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    d = docs.where(F.length(column) > 10).select(key, F.filter(words, lambda w: ~w.isin(stop)).alias("words"))
    return d.select(key, F.concat("words", text.ngrams(F.col("words"), 2)).alias("grams"))


def vocabulary(found: DataFrame, most: int = 20_000, min_df: int = 2, cells: int = 1 << 20) -> DataFrame:
    """term, df and place (from 0 by term): of the terms in `min_df` texts or more the `most` that occur most often.

    Words are counted by name. Pairs, most of which are rare, are counted first by the cell of their hash only, and by name in cells
    that reach what the word in the last place has: no other pair can be among the first. With fewer words all pairs are counted.
    """
    pair = lambda g: F.contains(g, F.lit(" "))
    cell = lambda g: F.pmod(F.xxhash64(g), F.lit(cells)).cast("int")
    each = lambda g: F.concat(
        F.transform(g, lambda x: F.struct(x.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct(g), lambda x: F.struct(x.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))),
    )
    totals = lambda d: d.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(F.col("df") >= min_df)
    words = written(totals(found.select(F.inline(each(F.filter("grams", lambda g: ~pair(g)))))), "topic-words")
    least = words.orderBy(F.col("tf").desc()).limit(most).agg(F.count(F.lit(1)).alias("k"), F.min("tf").alias("tf")).first()
    pairs = F.filter("grams", pair)
    counted = found.select(F.inline(each(pairs)))
    if least.k == most:
        full = found.select(F.explode(F.transform(pairs, cell)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least.tf)
        counted = counted.withColumn("cell", cell(F.col("term"))).join(F.broadcast(written(full.select("cell"), "topic-cells")), "cell", "left_semi")
    top = words.unionByName(totals(counted)).orderBy(F.col("tf").desc(), "term").limit(most)
    return top.select("term", "df", (F.row_number().over(Window.orderBy("term")) - 1).alias("place"))


def vectors(found: DataFrame, words: list[tuple[str, int]], n: int, key: str) -> DataFrame:
    """key, idx and val: each text's TF-IDF of unit length, smoothed as ln((1 + n) / (1 + df)) + 1. words: (term, df) by place, a bounded list."""
    terms = pa.array([t for t, _ in words], pa.string())
    weight = np.log((1 + n) / (1 + np.array([d for _, d in words], float))) + 1

    def run(batches):
        for batch in batches:
            g = batch.column(1)
            place = pc.index_in(g.flatten(), value_set=terms)
            row = np.repeat(np.arange(len(g)), g.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[place.is_valid().to_numpy(zero_copy_only=False)]
            cell, tf = np.unique(row * len(terms) + place.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            row, idx = np.divmod(cell, len(terms))
            val = tf * weight[idx]
            val /= np.sqrt(np.bincount(row, val * val, len(g)))[row]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(g)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (idx.astype(np.int32), val)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [key, "idx", "val"])

    kind = found.schema[key].dataType.simpleString()
    return found.select(F.col(key).alias("key"), "grams").mapInArrow(run, f"key {kind}, idx array<int>, val array<double>").withColumnRenamed("key", key)


def best_k(inertias: list[tuple[int, float]]) -> int:
    """The k of the largest second difference of the inertias (a handful of numbers)."""
    if len(inertias) < 3:
        return inertias[0][0]
    bends = [(a - 2 * b + c, -k) for (_, a), (k, b), (_, c) in zip(inertias, inertias[1:], inertias[2:])]
    return -max(bends)[1]


def labels(vectors_: DataFrame, assigned: DataFrame, words: list[tuple[str, int]], key: str, n: int = 3) -> DataFrame:
    """cluster, label: the `n` terms of the greatest mean TF-IDF over the cluster's texts."""
    spark = vectors_.sparkSession
    names = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(words)], "idx int, term string")
    cells = vectors_.join(assigned, key).select("cluster", F.inline(F.arrays_zip("idx", "val")))
    weight = cells.groupBy("cluster", "idx").agg(F.sum("val").alias("w")).join(F.broadcast(names), "idx")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("w", 9).desc(), "term"))
    top = weight.withColumn("place", place).where(F.col("place") <= n)
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), ", ").alias("label"))


def _fitted(reduced: DataFrame, k: int, starts: int, seed: int):
    """Of k-means models from several starts the one of the least cost: one start alone may end in a poor optimum."""
    models = [KMeans(k=k, seed=seed + i, predictionCol="cluster", maxIter=50).fit(reduced) for i in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def cluster(docs: DataFrame, column: str, key: str = "article_id", k: int | None = None, least: int = 8, most: int = 25, rank: int = 100, terms: int = 20_000, starts: int = 5, seed: int = 42):
    """docs of more than 10 signs with `cluster`, and a table cluster, label. key: a unique column.

    k, if not given, is searched from `least` to `most`, with LEAST_SIZE articles for each topic. Fewer than twice as
    many articles, or a vocabulary of fewer than three terms, make one topic, "general".
    """
    spark = docs.sparkSession
    found = written(grams(docs, column, key), "topic-grams")
    n = found.count()
    words = [(r.term, r.df) for r in vocabulary(found, terms).orderBy("place").collect()] if n >= 2 * LEAST_SIZE else []
    rank = min(rank, len(words) - 1, n - 1)
    if rank < 2:
        return docs.where(F.length(column) > 10).withColumn("cluster", F.lit(0)), spark.createDataFrame([(0, "general")], "cluster int, label string")
    x = written(vectors(found, words, n, key), "topic-vectors")
    v, _ = svd.fit(x, len(words), rank, seed=seed)
    reduced = written(svd.project(x, v, key).select(key, array_to_vector("reduced").alias("features")), "topic-reduced").persist()
    if k is None:
        tried = range(least, min(most, n // LEAST_SIZE) + 1)
        k = best_k([(i, _fitted(reduced, i, starts, seed).summary.trainingCost) for i in tried]) if tried else least
    assigned = written(_fitted(reduced, min(k, n), starts, seed).transform(reduced).select(key, "cluster"), "topic-clusters")
    reduced.unpersist()
    return docs.join(assigned, key), labels(x, assigned, words, key)


def global_notes(articles: DataFrame, places: list[str]) -> DataFrame:
    """note, internal, competitor: weekend share in percent, and the share of articles that mention each place."""
    low = F.lower(F.concat_ws(" ", "title", "summary"))
    measures = [("weekend", F.col("is_weekend"))] + [(f"place:{p}", F.contains(low, F.lit(p))) for p in places]
    e = articles.select("is_internal", F.explode(F.array(*[F.struct(F.lit(n).alias("note"), c.alias("hit")) for n, c in measures])).alias("m"))
    share = lambda who: F.round(F.coalesce(F.try_divide(F.count_if(who & F.col("m.hit")) * 100.0, F.count_if(who)), F.lit(0.0)), 6)
    return e.groupBy(F.col("m.note").alias("note")).agg(share(F.col("is_internal")).alias("internal"), share(~F.col("is_internal")).alias("competitor"))


def region_edges(notes: DataFrame, least: float = 1.3, n: int = 5) -> DataFrame:
    d = notes.where("note like 'place:%' and competitor > 0").withColumn("ratio", F.round(F.col("internal") / F.col("competitor"), 6)).where(F.col("ratio") >= least)
    return d.withColumn("_r", F.row_number().over(Window.orderBy(F.col("ratio").desc(), "note"))).where(F.col("_r") <= n).drop("_r")
