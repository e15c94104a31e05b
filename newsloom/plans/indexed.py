"""Queries over a stored search index; each has the SQL of the search that scans texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import stored_index
from ..sources import shared
from .catalogue import _INDEX, ORACLES, _tok, _word, corpus_view, query

_OPEN: dict[tuple[str, str], stored_index.Index] = {}


def _index(spark, sf: str) -> stored_index.Index:
    """The index over all documents, written once for each application: two segments, of which the second holds a part of the first anew."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _OPEN:
        folder = f"{shared.folder(spark)}/newsloom/{key[0]}/index-{uuid.uuid4().hex[:12]}"
        d = corpus_view(spark, sf).withColumn("published_date", F.col("published").cast("string"))
        stored_index.add(d.where("published < '2024-03-01'"), folder)
        _OPEN[key] = stored_index.add(d.where("published >= '2024-02-15'"), folder)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return _OPEN[key]


@query(ORACLES["search_and"])
def index_and(spark, sf):
    return stored_index.search(_index(spark, sf), "tion and BLEING").select("article_id")


@query(ORACLES["search_or"])
def index_or(spark, sf):
    return stored_index.search(_index(spark, sf), "tion OR bleing or nble").select("article_id")


@query(ORACLES["search_mixed_case"])
def index_mixed_case(spark, sf):
    return stored_index.search(_index(spark, sf), "bleiNG").select("article_id")


@query(ORACLES["search_phrase"])
def index_phrase(spark, sf):
    return stored_index.search(_index(spark, sf), '"of the"').select("article_id")


@query(_INDEX + f" SELECT article_id, source, title FROM n WHERE contains(s, 'n the re') OR {_word('nble')}")
def index_phrase_or(spark, sf):
    """A phrase may begin and end within words."""
    return stored_index.search(_index(spark, sf), '"n the re" OR nble').select("article_id", "source", "title")


@query(ORACLES["search_mixed"])
def index_mixed(spark, sf):
    return stored_index.search(_index(spark, sf), 'or tion that "in the"').select("article_id")


@query(_INDEX + f" SELECT article_id FROM n WHERE {_tok('ing')} AND source = 'src3'")
def index_short_token(spark, sf):
    return stored_index.search(_index(spark, sf), "ing", sources=["src3"]).select("article_id")


@query(ORACLES["keyword_counts"])
def index_keyword_counts(spark, sf):
    return stored_index.keyword_counts(_index(spark, sf), ["tion", "of the", "nble", "zzzz"])


@query(ORACLES["postings"])
def index_tokens(spark, sf):
    """Document frequencies after a merge, in which replaced articles no longer count."""
    merged = stored_index.merge(spark, _index(spark, sf).folder)
    return merged.tokens().groupBy("token").agg(F.sum("df").cast("long").alias("df"))
