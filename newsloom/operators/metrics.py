"""Two corpora compared: coverage, shares, gaps, strengths, log odds, cadence, indices.

Every comparison is one aggregate with a conditional count for each corpus, never two tables joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import frequent


def entity_counts(articles: DataFrame, entities: str = "entities", corpus: str = "corpus") -> DataFrame:
    """entity, internal, competitor: articles of each corpus with the entity (each once)."""
    e = articles.select(corpus, F.explode(F.array_distinct(entities)).alias("entity"))
    return e.groupBy("entity").agg(F.count_if(F.col(corpus) == "internal").alias("internal"), F.count_if(F.col(corpus) == "competitor").alias("competitor"))


def totals(articles: DataFrame, corpus: str = "corpus") -> DataFrame:
    """One row: articles of each corpus, with or without entities."""
    return articles.agg(F.count_if(F.col(corpus) == "internal").alias("n_internal"), F.count_if(F.col(corpus) == "competitor").alias("n_competitor"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def coverage(articles: DataFrame, entities: str = "entities") -> DataFrame:
    """entity, counts and percentages of both corpora. The joined side is one row."""
    c = entity_counts(articles, entities).crossJoin(F.broadcast(totals(articles)))
    return c.withColumn("internal_pct", percent(F.col("internal"), F.col("n_internal"))).withColumn("competitor_pct", percent(F.col("competitor"), F.col("n_competitor")))


def top_entities(articles: DataFrame, n: int = 15, limit_internal: int | None = 20) -> DataFrame:
    """The competitor's top n with both percentages; ours is 0 outside our own top `limit_internal`."""
    c = coverage(articles).where("competitor > 0 or internal > 0")
    if limit_internal:
        ours = c.orderBy(F.col("internal").desc(), "entity").limit(limit_internal).where("internal > 0").select(F.col("entity").alias("_own"))
        c = c.join(ours, F.col("entity") == F.col("_own"), "left").withColumn("internal_pct", F.when(F.col("_own").isNotNull(), F.col("internal_pct")).otherwise(F.lit(0.0))).drop("_own")
    return c.where("competitor > 0").orderBy(F.col("competitor").desc(), "entity").limit(n).select("entity", "competitor_pct", "internal_pct")


def gap_priority(gap: Column, competitor_pct: Column) -> Column:
    return F.when((gap >= 5) & (competitor_pct >= 5), F.lit("High")).when(gap >= 3, F.lit("Medium")).otherwise(F.lit("Low"))


def gaps(compared: DataFrame) -> DataFrame:
    """Entities that they cover more, with priority."""
    g = compared.withColumn("gap", F.round(F.col("competitor_pct") - F.col("internal_pct"), 2)).where("gap > 0")
    return g.withColumn("priority", gap_priority(F.col("gap"), F.col("competitor_pct"))).orderBy(F.col("gap").desc(), "entity")


def strengths(compared: DataFrame, n: int = 5) -> DataFrame:
    """Entities that we cover more, the largest lead first."""
    s = compared.withColumn("lead", F.round(F.col("internal_pct") - F.col("competitor_pct"), 2))
    return s.where("internal_pct > 0 and lead > 0").orderBy(F.col("lead").desc(), "entity").limit(n)


def mentions(articles: DataFrame, entities: str, most: int = 30, least: int = 2) -> DataFrame:
    e = articles.select(F.explode(entities).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return e.orderBy(F.col("n").desc(), "entity").limit(most).where(F.col("n") >= least)


def only_theirs(counts: DataFrame) -> DataFrame:
    return counts.where("competitor > 0 and internal = 0").select("entity", "competitor")


def affiliate_difference(articles: DataFrame, flag: str, entities: str, n: int = 15, least: int = 5) -> DataFrame:
    """Share of each entity among flagged rows against the others, largest difference first; both sides need more than `least` rows."""
    e = articles.select(flag, F.explode(F.array_distinct(entities)).alias("entity"))
    c = e.groupBy("entity").agg(F.count_if(F.col(flag)).alias("a"), F.count_if(~F.col(flag)).alias("b"))
    t = articles.agg(F.count_if(F.col(flag)).alias("na"), F.count_if(~F.col(flag)).alias("nb"))
    d = c.crossJoin(F.broadcast(t)).where(f"na > {least} and nb > {least}")
    d = d.withColumn("affiliate_pct", percent(F.col("a"), F.col("na"))).withColumn("other_pct", percent(F.col("b"), F.col("nb"))).withColumn("diff", F.round(F.col("affiliate_pct") - F.col("other_pct"), 2))
    return d.orderBy(F.col("diff").desc(), "entity").limit(n).select("entity", "affiliate_pct", "other_pct", "diff")


def ngram_counts(docs: DataFrame, column: str, n_max: int = 3, features: int = 10_000, by: str = "corpus") -> DataFrame:
    """ngram, internal, competitor: occurrences of runs of 1..n_max words within documents, the most frequent `features`."""
    return frequent.top_ngrams(docs, column, n_max, features, by)


def log_odds_terms(counts: DataFrame, stopwords: list[str], least: int = 3, n: int = 20) -> DataFrame:
    """Terms of ours by log odds against theirs. Totals are sums over the table of counts (one row)."""
    t = counts.agg(F.sum("internal").alias("ti"), F.sum("competitor").alias("tc"))
    s = counts.where(F.col("internal") + F.col("competitor") >= least).where(text.meaningful(F.col("ngram"), stopwords)).crossJoin(F.broadcast(t))
    s = s.withColumn("score", F.round(text.log_odds(F.col("internal"), F.col("ti"), F.col("competitor"), F.col("tc")), 6))
    return s.where("score > 0").orderBy(F.col("score").desc(), "ngram").limit(n).select("ngram", "internal", "competitor", "score")


def smoothed_ratio(a: Column, b: Column, plus: float) -> Column:
    return (a + plus) / (b + plus)


def occurrence_edges(docs: DataFrame, column: str, lexicon: dict[str, list[str]], per: str = "article", plus: float = 0.01, least: float = 1.2, n: int = 10) -> DataFrame:
    """label, rates of both corpora and their ratio: how often a label's keywords occur, for each article."""
    low = F.lower(F.col(column))
    total = {label: reduce(lambda a, b: a + b, [text.occurrences(low, k) for k in ks]) for label, ks in lexicon.items()}
    pairs = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), c.alias("k")) for label, c in total.items()])).alias("p")
    c = docs.select("corpus", pairs).groupBy(F.col("p.label").alias("label")).agg(
        F.sum(F.when(F.col("corpus") == "internal", F.col("p.k")).otherwise(0)).alias("internal"), F.sum(F.when(F.col("corpus") == "competitor", F.col("p.k")).otherwise(0)).alias("competitor"),
        F.count_if(F.col("corpus") == "internal").alias("ni"), F.count_if(F.col("corpus") == "competitor").alias("nc"))
    rate = lambda k, m: F.coalesce(F.try_divide(k, m), F.lit(0.0))
    c = c.withColumn("internal_rate", F.round(rate(F.col("internal"), F.col("ni")), 6)).withColumn("competitor_rate", F.round(rate(F.col("competitor"), F.col("nc")), 6))
    c = c.withColumn("ratio", F.round(smoothed_ratio(F.col("internal_rate"), F.col("competitor_rate"), plus), 6))
    return c.where(F.col("ratio") > least).orderBy(F.col("ratio").desc(), "label").limit(n).select("label", "internal", "competitor", "internal_rate", "competitor_rate", "ratio")


def format_shares(docs: DataFrame, formats: dict[str, list[str]]) -> DataFrame:
    """format, shares of both corpora in percent and their ratio; formats without articles too."""
    c = docs.groupBy("article_format").agg(F.count_if(F.col("corpus") == "internal").alias("i"), F.count_if(F.col("corpus") == "competitor").alias("c"))
    names = docs.sparkSession.createDataFrame([(f,) for f in formats], "format string")
    d = names.join(c, F.col("format") == F.col("article_format"), "left").crossJoin(F.broadcast(totals(docs)))
    share = lambda k, m: F.coalesce(F.try_divide(F.col(k) * 100.0, F.col(m)), F.lit(0.0))
    d = d.withColumn("internal_pct", F.round(share("i", "n_internal"), 6)).withColumn("competitor_pct", F.round(share("c", "n_competitor"), 6))
    return d.withColumn("ratio", F.round(smoothed_ratio(F.col("internal_pct"), F.col("competitor_pct"), 0.1), 6)).select("format", "internal_pct", "competitor_pct", "ratio")


def cadence(docs: DataFrame, ts: str, days: int) -> DataFrame:
    """One row for each corpus: articles, daily rate, weekend share in percent, median hour."""
    return docs.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / days, 2).alias("per_day"),
        F.round(F.count_if(F.weekday(ts) >= 5) * 100.0 / F.count(F.lit(1)), 1).alias("weekend_pct"), F.median(F.hour(ts)).alias("median_hour"))


def keyword_rates(docs: DataFrame, column: str, stopwords: list[str], n: int = 100) -> DataFrame:
    """Words of three letters or more: mentions and mentions for 100 articles of both corpora."""
    w = F.filter(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), lambda x: ~x.isin(stopwords))
    c = docs.select("corpus", F.explode(w).alias("keyword")).groupBy("keyword").agg(F.count_if(F.col("corpus") == "internal").alias("internal"), F.count_if(F.col("corpus") == "competitor").alias("competitor"))
    c = c.orderBy((F.col("internal") + F.col("competitor")).desc(), "keyword").limit(n).crossJoin(F.broadcast(totals(docs)))
    return c.withColumn("internal_rate", percent(F.col("internal"), F.col("n_internal"), 6)).withColumn("competitor_rate", percent(F.col("competitor"), F.col("n_competitor"), 6))


def trending(rates: DataFrame, industry: list[str], n: int = 15) -> DataFrame:
    """Words whose larger rate is 1 or more, with trend (2 points either way), industry words first, then the widest gap."""
    gap = F.round(F.col("internal_rate") - F.col("competitor_rate"), 6)
    d = rates.withColumn("gap", gap).withColumn("trend", F.when(gap >= 2, F.lit("strength")).when(gap <= -2, F.lit("gap")).otherwise(F.lit("parity")))
    d = d.where(F.greatest("internal_rate", "competitor_rate") >= 1).withColumn("is_industry", F.col("keyword").isin(industry))
    return d.orderBy(F.col("is_industry").desc(), F.abs("gap").desc(), "keyword").limit(n).select("keyword", "internal_rate", "competitor_rate", "gap", "trend", "is_industry")


def topic_indices(articles: DataFrame, cluster: str = "cluster", valued: list[str] | None = None) -> DataFrame:
    """Ownership, exclusivity, timeliness, depth, format edge and score of each cluster.

    articles: cluster, is_internal, is_weekend, publish_hour, word_count, article_format. One aggregate by cluster;
    shares of formats come from a second one by cluster and format.
    """
    mine, other = F.col("is_internal"), ~F.col("is_internal")
    half = lambda c, who: F.when(who, F.col(c))
    t = articles.groupBy(cluster).agg(
        F.count_if(mine).alias("internal_count"), F.count_if(other).alias("competitor_count"),
        F.avg(half("is_weekend", mine).cast("int")).alias("wi"), F.avg(half("is_weekend", other).cast("int")).alias("wc"),
        F.median(half("publish_hour", mine)).alias("hi"), F.median(half("publish_hour", other)).alias("hc"),
        F.median(half("word_count", mine)).alias("mi"), F.median(half("word_count", other)).alias("mc"), F.stddev_samp(half("word_count", other)).alias("sd"),
    )
    i, c = F.col("internal_count"), F.col("competitor_count")
    own = F.coalesce(F.try_divide(i, i + c), F.lit(0.0))
    excl = F.when(i == 0, 0.0).when(c == 0, 1.0).otherwise(F.least(F.lit(1.0), own * 1.5))
    weekend = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("wi") - F.col("wc"), F.col("wi"), F.lit(0.0))) * 3)
    hours = F.when(c == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("hc") - F.col("hi")) / 6)))
    time = F.when(i == 0, 0.0).otherwise(0.6 * weekend + 0.4 * hours)
    z = (F.col("mi") - F.col("mc")) / F.coalesce(F.nullif(F.col("sd"), F.lit(0.0)), F.lit(100.0))
    depth = F.when(i == 0, 0.0).when(c == 0, 0.5).otherwise((F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z)) + 2) / 4)
    f = articles.groupBy(cluster, "article_format").agg(F.count_if(mine).alias("fi"), F.count_if(other).alias("fc"))
    w = Window.partitionBy(cluster)
    f = f.withColumn("si", F.try_divide(F.col("fi"), F.sum("fi").over(w))).withColumn("sc", F.coalesce(F.try_divide(F.col("fc"), F.sum("fc").over(w)), F.lit(0.0)))
    f = f.where(F.col("article_format").isin(valued or [])).groupBy(F.col(cluster).alias("_c")).agg(F.count_if((F.col("fi") > 0) & (F.col("si") >= 1.5 * F.col("sc"))).alias("over"), F.count_if(F.col("fi") > 0).alias("used"))
    t = t.join(f, t[cluster] == F.col("_c"), "left").drop("_c")
    edge = F.when(i == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.col("over"), F.col("used")), F.lit(0.0)))
    t = t.withColumns({"ownership": own, "exclusivity": excl, "timeliness": time, "depth": depth, "format_edge": edge})
    score = 0.35 * F.col("ownership") + 0.25 * F.col("exclusivity") + 0.15 * F.col("timeliness") + 0.15 * F.col("depth") + 0.10 * F.col("format_edge")
    return t.withColumn("score", score).select(cluster, "internal_count", "competitor_count", *[F.round(x, 6).alias(x) for x in ("ownership", "exclusivity", "timeliness", "depth", "format_edge", "score")])


def ranked_topics(indices: DataFrame, cluster: str = "cluster", n: int = 12, own: float = 0.6, exclusive: float = 0.4) -> DataFrame:
    """Topics of five articles and three of ours that are owned or exclusive enough, the best scores first."""
    keep = (F.col("internal_count") + F.col("competitor_count") >= 5) & (F.col("internal_count") >= 3) & ~((F.col("ownership") < own) & (F.col("exclusivity") < exclusive))
    return indices.where(keep).orderBy(F.col("score").desc(), cluster).limit(n)


def knee(inertias: DataFrame) -> DataFrame:
    """k, inertia -> the k of the largest second difference (the smallest of equals)."""
    w = Window.orderBy("k")
    d = inertias.withColumn("bend", F.lag("inertia", 2).over(w) - 2 * F.lag("inertia", 1).over(w) + F.col("inertia")).withColumn("at", F.lag("k", 1).over(w))
    return d.where("bend is not null").orderBy(F.col("bend").desc(), "at").limit(1).select(F.col("at").alias("k"))
