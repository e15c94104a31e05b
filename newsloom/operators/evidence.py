"""Evidence for gaps: articles by title, by part of a title, by keyword, by class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons, text
from ..sources.shared import dealt, written
from . import automaton


#: Bytes of strings whose runs are few enough to be sent to all tasks: a run of three begins at each byte, 24 bytes of numbers for each.
FEW_BYTES = 1 << 20


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def by_title(gaps: DataFrame, articles: DataFrame) -> DataFrame:
    """Equal titles; of articles with one title the last (by id) counts. gaps: gap_id, evidence (a title)."""
    w = Window.partitionBy("_t").orderBy(F.col("article_id").desc())
    a = articles.withColumn("_t", _key(F.col("title"))).where("_t <> ''").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    g = gaps.withColumn("_t", _key(F.col("evidence")))
    return g.join(a, "_t").select("gap_id", "article_id", F.lit("exact").alias("match_method"))


def _runs(strings: DataFrame, shorter: bool) -> DataFrame:
    """id, n, run: the distinct runs of three bytes of each string (id, s), as numbers, and how many it has. shorter: runs of one and two bytes too; else these only of strings so short."""

    def parts(batch):  # a row at least, about a megabyte at most
        upto, first = automaton.texts(batch.column(1))[1], 0
        while first < len(batch):
            end = max(first + 1, int(np.searchsorted(upto, upto[first] + (1 << 20), "right")) - 1)
            yield batch.slice(first, end - first)
            first = end

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            data, offsets = automaton.texts(batch.column(1))
            size = np.diff(offsets)
            data, of = data[offsets[0] : offsets[-1]].astype(np.int64), np.repeat(np.arange(len(size)), size)
            left = np.repeat(offsets[1:] - offsets[0], size) - np.arange(len(data))  # bytes from here to the string's end
            found, code = [], np.zeros(len(data), np.int64)
            for n in (1, 2, 3):
                code = (code << 8)[: len(data) - n + 1] | data[n - 1 :]
                ok = left[: len(code)] >= n
                if n < 3 and not shorter:
                    ok &= size[of[: len(code)]] == n
                found.append(of[: len(code)][ok] << 32 | n << 24 | code[ok])
            both = np.unique(np.concatenate(found))
            of, code = both >> 32, both & 0xFFFFFFFF
            n = np.bincount(of, minlength=len(size))[of]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(n), pa.array(code)], ["id", "n", "run"])

    return strings.select("id", "s").mapInArrow(run, "id long, n long, run long")


def contained(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """needle, hay: the strings `s` of needles that stand within strings `s` of hay. Both: distinct strings, none empty.

    A string within another has its runs of three bytes there (shorter strings: the whole string). Strings of hay are
    posted under their runs; of a needle's runs the one with the fewest postings fetches candidates in an equi join, and a
    needle with a run that is posted nowhere goes at once. Candidates fetch their strings, and `contains` decides.

    Runs are many times what the strings take, so a side is broadcast only if its strings are counted and few (FEW_BYTES);
    of few needles the runs choose what is posted at all, before anything is dealt out.
    """
    needles, hay = (written(d.select(F.monotonically_increasing_id().alias("id"), "s"), "strings") for d in (needles, hay))
    few = {side: d.agg(F.coalesce(F.sum(F.octet_length("s")), F.lit(0)).alias("n")).first().n <= FEW_BYTES for side, d in (("needles", needles), ("hay", hay))}
    sent = lambda side, d: F.broadcast(d) if few[side] else dealt(d)
    posted = _runs(hay, shorter=True).select(F.col("id").alias("in"), "run")
    asked = _runs(needles, shorter=False)
    if few["needles"]:
        posted = posted.join(F.broadcast(asked.select("run").distinct()), "run", "left_semi")
    often = posted.groupBy("run").agg(F.count(F.lit(1)).alias("df"))
    often = F.broadcast(often) if True in few.values() else dealt(often)
    found = asked.join(often, "run").groupBy("id", "n").agg(F.count(F.lit(1)).alias("posted"), F.min(F.struct("df", "run")).alias("least"))
    rarest = found.where("posted = n").select("id", F.col("least.run").alias("run"))
    met = rarest.join(sent("hay", posted), "run") if not few["needles"] else posted.join(F.broadcast(rarest), "run")
    met = met.select("id", "in").join(sent("needles", needles.select("id", F.col("s").alias("needle"))), "id").join(sent("hay", hay.select(F.col("id").alias("in"), F.col("s").alias("hay"))), "in")
    return met.where(F.contains("hay", F.col("needle"))).select("needle", "hay")


def by_part(gaps: DataFrame, articles: DataFrame) -> DataFrame:
    """One title within the other, the smallest id of several; titles meet through postings of their runs of three bytes, in both directions."""
    a = written(articles.select("article_id", _key(F.col("title")).alias("t")).where("t <> ''").groupBy("t").agg(F.min("article_id").alias("article_id")), "titles")
    g = written(gaps.select("gap_id", _key(F.col("evidence")).alias("e")).where("e <> ''"), "gaps")
    titles, parts = a.select(F.col("t").alias("s")), g.select(F.col("e").alias("s")).distinct()
    met = contained(parts, titles).select(F.col("needle").alias("e"), F.col("hay").alias("t")).unionByName(contained(titles, parts).select(F.col("hay").alias("e"), F.col("needle").alias("t")))
    best = met.join(dealt(a), "t").groupBy("e").agg(F.min("article_id").alias("article_id"))
    return g.join(best, "e").groupBy("gap_id").agg(F.min("article_id").alias("article_id")).withColumn("match_method", F.lit("partial"))


def by_keyword(gaps: DataFrame, articles: DataFrame, n: int = 5) -> DataFrame:
    """Articles with a word of the gap, the first `n` by id. gaps: gap_id, keywords (array of single words).

    Words of the gaps meet words of the articles in an equi join.
    """
    g = gaps.select("gap_id", F.explode("keywords").alias("w")).withColumn("w", F.lower("w")).distinct()
    a = articles.select("article_id", F.explode(F.array_distinct(text.tokens(text.normalize(text.join_fields(F.col("title"), F.col("summary")))))).alias("w"))
    hit = a.join(g, "w").select("gap_id", "article_id").distinct()
    r = F.row_number().over(Window.partitionBy("gap_id").orderBy("article_id"))
    return hit.withColumn("_r", r).where(F.col("_r") <= n).select("gap_id", "article_id", F.lit("keyword").alias("match_method"))


def meets(topic: str, low: Column) -> Column:
    """Whether a lower-case text is evidence for a class; any text is for the general one."""
    out = F.lit(True)
    for ks in lexicons.EVIDENCE.get(topic, []):
        out = out & text.contains_any(low, ks)
    return out


def class_text(title: str = "title", summary: str = "summary", content: str = "content", most: int = 500) -> Column:
    return F.lower(F.concat_ws(" ", title, summary, F.substring(content, 1, most)))


def classes_of(articles: DataFrame) -> DataFrame:
    """article_id, class: each class that the article is evidence for."""
    low = class_text()
    hit = F.array_compact(F.array(*[F.when(meets(c, low), F.lit(c)) for c in lexicons.EVIDENCE]))
    return articles.select("article_id", F.explode(hit).alias("class"))


def gap_class(title: Column, description: Column) -> Column:
    return text.first_class(F.concat_ws(" ", title, description), lexicons.GAP_CLASSES)


def by_class(gaps: DataFrame, articles: DataFrame, n: int = 5) -> DataFrame:
    """The first `n` articles by id that are evidence for the gap's class; any is for the general one. gaps: gap_id, title, description."""
    every = classes_of(articles).unionByName(articles.select("article_id", F.lit("general").alias("class")))
    first = every.withColumn("_r", F.row_number().over(Window.partitionBy("class").orderBy("article_id"))).where(F.col("_r") <= n)
    g = gaps.select("gap_id", gap_class(F.col("title"), F.col("description")).alias("class"))
    return g.join(first, "class").select("gap_id", "article_id", F.lit("class").alias("match_method"))


def enrich(gaps: DataFrame, articles: DataFrame, n: int = 5) -> DataFrame:
    """gap_id, article_id, match_method: titles first, then keywords, then the gap's class; at most `n` for a gap.

    gaps: gap_id, evidence, keywords, and title and description for the class; gaps without these two have no class.
    """
    exact = by_title(gaps, articles)
    left = gaps.join(exact.select("gap_id").distinct(), "gap_id", "left_anti")
    part = by_part(left, articles)
    none = left.join(part.select("gap_id").distinct(), "gap_id", "left_anti")
    word = by_keyword(none, articles, n)
    every = exact.unionByName(part).unionByName(word)
    if {"title", "description"} <= set(gaps.columns):
        every = every.unionByName(by_class(none.join(word.select("gap_id").distinct(), "gap_id", "left_anti"), articles, n))
    order = F.row_number().over(Window.partitionBy("gap_id").orderBy("match_method", "article_id"))
    return every.withColumn("_r", order).where(F.col("_r") <= n).drop("_r")
