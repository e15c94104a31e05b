"""Topics: TF-IDF, distributed SVD and clusters against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from newsloom.operators import svd, topics


def plain_tfidf(texts, most=20_000, min_df=2):
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    found = []
    for t in texts:
        w = [x for x in re.findall(r"\w{2,}", t.lower()) if x not in stop]
        found.append(w + [" ".join(p) for p in zip(w, w[1:])])
    tf, df = Counter(g for f in found for g in f), Counter(g for f in found for g in set(f))
    terms = sorted(sorted((t for t in df if df[t] >= min_df), key=lambda t: (-tf[t], t))[:most])
    x = np.array([[f.count(t) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in terms] for f in found])
    return terms, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix(rows, width):
    out = {}
    for r in rows:
        out[r[0]] = np.zeros(width)
        out[r[0]][r.idx] = r.val
    return np.array([out[i] for i in sorted(out)])


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    themes = [[f"{w}{i}" for i in range(12)] for w in ("ship", "court", "vaccine")]
    return [" ".join(draw.choice(themes[i % 3] if draw.random() < 0.9 else ["the", "of", "common", "news"]) for _ in range(20)) for i in range(90)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(list(enumerate(corpus)), "doc_id long, content string").repartition(5)


@pytest.mark.parametrize("most", [20_000, 25])
def test_tfidf_equals_a_plain_one(spark, docs, corpus, most):
    terms, want = plain_tfidf(corpus, most)
    found = topics.grams(docs, "content", "doc_id")
    words = [(r.term, r.df) for r in topics.vocabulary(found, most).orderBy("place").collect()]
    assert [t for t, _ in words] == terms
    assert np.allclose(matrix(topics.vectors(found, words, len(corpus), "doc_id").collect(), len(terms)), want)


@pytest.mark.parametrize("rank, passes", [(5, 30), (40, 2)])
def test_subspace_equals_the_dense_one(spark, rank, passes):
    """With fewer directions than the matrix has, after enough passes; with all of them at once."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 45)) * (rng.random((60, 45)) < 0.2)
    x[7] = 0
    rows = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "doc_id long, idx array<int>, val array<double>").repartition(4)
    v, s = svd.fit(d, 45, rank, passes=passes)
    u0, s0, v0 = np.linalg.svd(x)
    assert np.allclose(s, s0[:rank], rtol=1e-6)
    assert np.allclose(v @ v.T, v0[:rank].T @ v0[:rank], atol=1e-4) and np.allclose(v.T @ v, np.eye(rank), atol=1e-9)
    got = {r.doc_id: r.reduced for r in svd.project(d, v, "doc_id").collect()}
    assert np.allclose(np.array([got[i] for i in range(60)]), x @ v)


def test_blocks_of_rows_change_nothing(spark, docs, corpus, monkeypatch):
    found = topics.grams(docs, "content", "doc_id")
    words = [(r.term, r.df) for r in topics.vocabulary(found).orderBy("place").collect()]
    x = topics.vectors(found, words, len(corpus), "doc_id")
    q = np.random.default_rng(0).standard_normal((len(words), 7))
    _, dense = plain_tfidf(corpus)
    assert np.allclose(svd.gram_times(x, q), dense.T @ (dense @ q))
    import pyarrow as pa

    monkeypatch.setattr(svd, "ENTRIES", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([[0, 2], [], None, [1], [0, 1, 2, 3]], pa.list_(pa.int32())), pa.array([[1.0, 2.0], [], None, [3.0], [1.0, 1.0, 1.0, 1.0]])], ["idx", "val"])
    rows = np.concatenate([svd._times(*b, np.eye(4)) for b in svd._row_blocks(batch)])
    assert rows.tolist() == [[1, 0, 2, 0], [0] * 4, [0] * 4, [0, 3, 0, 0], [1, 1, 1, 1]]


def test_clusters_are_the_themes_and_labels_their_heaviest_terms(spark, docs, corpus):
    got, names = topics.cluster(docs, "content", key="doc_id", k=3)
    of = {r.doc_id: r.cluster for r in got.collect()}
    assert len(of) == 90 and len({of[i] for i in range(3)}) == 3 and all(of[i] == of[i % 3] for i in range(90))
    terms, x = plain_tfidf(corpus)
    for r in names.collect():
        mean = x[[i for i in range(90) if of[i] == r.cluster]].mean(axis=0)
        assert r.label == ", ".join(sorted(terms, key=lambda t: (-round(mean[terms.index(t)] * sum(c == r.cluster for c in of.values()), 9), t))[:3])
    assert names.count() == 3


def test_k_is_searched_up_to_a_fifth_of_the_articles(spark, docs):
    got, names = topics.cluster(docs, "content", key="doc_id", rank=10, starts=1)
    n = got.select("cluster").distinct().count()
    assert 8 <= n <= 18 and names.count() == n


def test_few_articles_are_one_topic(spark, docs):
    got, names = topics.cluster(docs.limit(9), "content", key="doc_id")
    assert got.count() == 9 and [tuple(r) for r in names.collect()] == [(0, "general")]
    got, names = topics.cluster(docs.limit(0), "content", key="doc_id")
    assert got.count() == 0 and names.count() == 1
    short = docs.withColumn("content", F.lit("x"))
    assert topics.cluster(short, "content", key="doc_id")[0].count() == 0
    alike = docs.withColumn("content", F.concat(F.lit("unique words "), F.col("doc_id").cast("string"), F.lit(" "), F.sha2("content", 256)))
    got, names = topics.cluster(alike, "content", key="doc_id")  # no word stands in two texts but two
    assert got.count() == 90
