"""What our corpus covers better: detectors, cards, topic scorecards, wins and levers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons, text
from . import followups, title_pairs


def _counts(hits: DataFrame, hit: Column) -> DataFrame:
    return hits.agg(F.count_if(hit & (F.col("corpus") == "internal")).alias("our"), F.count_if(hit & (F.col("corpus") == "competitor")).alias("their"))


def _share(our: Column, their: Column) -> Column:
    return F.coalesce(F.try_divide(our, our + their), F.lit(0.0))


def _low(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def explainer(articles: DataFrame, signals: list[str] | None = None) -> DataFrame:
    """advantage_key, our, their, score: one row, none below two of ours."""
    c = _counts(articles, text.contains_any(_low("title", "summary"), signals or lexicons.EXPLAINER_SIGNALS))
    score = F.col("our") + F.when(_share(F.col("our"), F.col("their")) > 0.5, 2).otherwise(0) + F.when(F.col("our") >= 4, 1).otherwise(0)
    return c.where("our >= 2").select(F.lit("explainer").alias("advantage_key"), "our", "their", score.cast("long").alias("score"))


def events(articles: DataFrame, signals: list[str] | None = None) -> DataFrame:
    c = _counts(articles, text.contains_any(_low("title", "summary", "link"), signals or lexicons.EVENT_SIGNALS))
    score = F.col("our") + F.when(_share(F.col("our"), F.col("their")) > 0.6, 2).otherwise(0) + F.when(F.col("our") >= 5, 1).otherwise(0)
    return c.where("our >= 2").select(F.lit("event").alias("advantage_key"), "our", "their", score.cast("long").alias("score"))


def franchise(articles: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """A title counts for the first pattern it matches; several kinds of series score more."""
    kind = F.lit(None).cast("string")
    for p in reversed(patterns or lexicons.FRANCHISE_PATTERNS):
        kind = F.when(F.lower("title").rlike(p), F.lit(p)).otherwise(kind)
    d = articles.withColumn("_k", kind).where("_k is not null")
    c = d.agg(F.count_if(F.col("corpus") == "internal").alias("our"), F.count_if(F.col("corpus") == "competitor").alias("their"), F.count_distinct(F.when(F.col("corpus") == "internal", F.col("_k"))).alias("kinds"))
    score = F.col("our") + F.when(F.col("kinds") >= 2, 2).otherwise(0) + F.when(F.col("our") > F.col("their"), 1).otherwise(0)
    return c.where("our >= 2").select(F.lit("franchise").alias("advantage_key"), "our", "their", score.cast("long").alias("score"))


def geographies(articles: DataFrame, places: list[str] | None = None) -> DataFrame:
    """article_id, corpus, place: articles by the places they mention."""
    low = _low("title", "summary")
    hit = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in places or lexicons.GEOGRAPHIES]))
    return articles.select("article_id", "corpus", F.explode(hit).alias("place"))


def geography(articles: DataFrame, places: list[str] | None = None) -> DataFrame:
    """Places where we have two articles or more and more than they; articles are counted once over all such places."""
    e = geographies(articles, places)
    per = e.groupBy("place").agg(F.count_distinct(F.when(F.col("corpus") == "internal", F.col("article_id"))).alias("o"), F.count_distinct(F.when(F.col("corpus") == "competitor", F.col("article_id"))).alias("t")).where("o >= 2 and o > t")
    own = e.join(per.select("place"), "place", "left_semi")
    c = own.agg(F.count_distinct(F.when(F.col("corpus") == "internal", F.col("article_id"))).alias("our"), F.count_distinct(F.when(F.col("corpus") == "competitor", F.col("article_id"))).alias("their"), F.count_distinct("place").alias("places"))
    score = F.col("our") + F.when(F.col("places") >= 2, 2).otherwise(0) + F.when(F.col("our") > 2 * F.col("their"), 2).otherwise(0)
    return c.where("our >= 2").select(F.lit("geography").alias("advantage_key"), "our", "their", score.cast("long").alias("score"))


def followed_pairs(articles: DataFrame, least: int = 2) -> DataFrame:
    """corpus, a, b, cluster: pairs of articles of a corpus whose titles share `least` words of four letters or more."""
    return title_pairs.pairs(followups.titles(articles), least)


def followthrough(articles: DataFrame) -> DataFrame:
    """Stories followed up: unique articles with a partner, and whether they form three clusters by the first three shared words; no pairs are listed."""
    c = followups.counted(articles, upto=3)
    score = F.col("our") + F.when(F.col("clusters") >= 3, 2).otherwise(0) + F.when(F.col("our") > F.col("their"), 1).otherwise(0)
    return c.where("our >= 2").select(F.lit("followthrough").alias("advantage_key"), "our", "their", score.cast("long").alias("score"))


def cards(articles: DataFrame, detectors: list | None = None, n: int = 5) -> DataFrame:
    """The detectors' rows as shares of each corpus, kept where ours is the larger, by how much larger."""
    every = None
    for d in detectors or (explainer, franchise, geography, events, followthrough):
        found = d(articles)
        every = found if every is None else every.unionByName(found)
    t = articles.agg(F.count_if(F.col("corpus") == "internal").alias("no"), F.count_if(F.col("corpus") == "competitor").alias("nt"))
    d = every.crossJoin(F.broadcast(t)).withColumn("our", F.least("our", "no")).withColumn("their", F.least("their", "nt"))
    pct = lambda k, m: F.coalesce(F.try_divide(F.col(k) * 100.0, F.col(m)), F.lit(0.0))
    d = d.withColumn("our_pct", F.round(pct("our", "no"), 6)).withColumn("their_pct", F.round(pct("their", "nt"), 6))
    d = d.withColumn("concentration_ratio", F.round(F.when(F.col("their_pct") > 0, F.col("our_pct") / F.col("their_pct")).otherwise(99.0), 6))
    return d.where("our_pct > their_pct").orderBy(F.col("concentration_ratio").desc(), "advantage_key").limit(n).select("advantage_key", "our", "their", "our_pct", "their_pct", "concentration_ratio", "score")


def merge_cards(cards_: DataFrame, texts: DataFrame, fallback: str) -> DataFrame:
    """Generated texts by key, else a template."""
    t = texts.groupBy("advantage_key").agg(F.min("text").alias("_t"))
    return cards_.join(t, "advantage_key", "left").withColumn("text", F.coalesce("_t", F.format_string(fallback, F.col("advantage_key"), F.col("our")))).drop("_t")


def candidates(articles: DataFrame, column: str, n_max: int = 2, stopwords: list[str] | None = None, addresses: bool = False) -> DataFrame:
    """article_id, corpus, published, topic: each article's word runs of 3 to 30 letters, hyphens and spaces without stopwords or dashes at their ends.

    addresses: web and mail addresses and handles are taken for the words that they hold; else they are left out, and their neighbours meet.
    """
    stop = stopwords or lexicons.COMMON_WORDS
    # each step a column of its own: an expression under a lambda would be computed for each element
    a = articles.select("article_id", "corpus", "published", F.filter(F.split(text.clean(F.col(column), addresses), " "), lambda w: w != "").alias("_words"))
    words = F.col("_words")
    edge = lambda w: w.isin(stop) | w.startswith("-") | w.endswith("-")
    grams = F.array_distinct(F.concat(*[text.ngrams(words, n) for n in range(1, n_max + 1)]))
    ok = F.filter(grams, lambda g: F.length(g).between(3, 30) & g.rlike(r"^[\p{L} \-]+$") & ~edge(F.substring_index(g, " ", 1)) & ~edge(F.substring_index(g, " ", -1)))
    return a.select("article_id", "corpus", "published", F.explode(ok).alias("topic"))


def topic_counts(found: DataFrame, recent: Column) -> DataFrame:
    """topic, our, their, share, our_7d, their_7d."""
    ours = F.col("corpus") == "internal"
    c = found.groupBy("topic").agg(F.count_if(ours).alias("our"), F.count_if(~ours).alias("their"), F.count_if(ours & recent).alias("our_7d"), F.count_if(~ours & recent).alias("their_7d"))
    # hundredths are rounded as numbers, as SQL does; F.round(x, 2) takes the shortest decimals instead, by which 23 of 40 are 0.58
    return c.withColumn("share", F.round(_share(F.col("our"), F.col("their")) * 100) / 100)


def scored_topics(counts: DataFrame, totals: DataFrame, min_total: int = 3, min_our: int = 2, n: int = 10) -> DataFrame:
    """Ownership, edge and momentum of topics, summed into a score with the difference of shares. totals: n_internal, n_competitor."""
    c = counts.where((F.col("our") + F.col("their") >= min_total) & (F.col("our") >= min_our)).crossJoin(F.broadcast(totals))
    diff = F.coalesce(F.try_divide(F.col("our"), F.col("n_internal")), F.lit(0.0)) - F.coalesce(F.try_divide(F.col("their"), F.col("n_competitor")), F.lit(0.0))
    own = (F.col("their") == 0) & (F.col("our") >= 2)
    edge = (F.col("share") >= 0.6) & (F.col("our") + F.col("their") >= 4)
    momentum = (F.col("our_7d") >= 2) & (F.col("their_7d") == 0)
    d = c.withColumns({"share_diff": F.round(diff, 6), "ownership": own, "edge": edge, "momentum": momentum})
    score = 2.0 * F.col("ownership").cast("int") + 1.5 * F.col("edge").cast("int") + 1.0 * F.col("momentum").cast("int") + F.col("share_diff")
    d = d.withColumn("score", F.round(score, 3))
    return d.where("ownership or edge or momentum").orderBy(F.col("score").desc(), "topic").limit(n).select("topic", "our", "their", "share", "share_diff", "ownership", "edge", "momentum", "score")


def near_advantages(counts: DataFrame, totals: DataFrame, n: int = 5) -> DataFrame:
    c = counts.where("our >= 1").crossJoin(F.broadcast(totals))
    diff = F.coalesce(F.try_divide(F.col("our"), F.col("n_internal")), F.lit(0.0)) - F.coalesce(F.try_divide(F.col("their"), F.col("n_competitor")), F.lit(0.0))
    return c.withColumn("share_diff", F.round(diff, 6)).where("share_diff > 0").orderBy(F.col("share_diff").desc(), "topic").limit(n).select("topic", "our", "their", "share", "share_diff")


def reader_topics(counts: DataFrame, n: int = 5) -> DataFrame:
    """Topics where we lead by two of three, or by half again of five."""
    d = counts.withColumn("lead", F.col("our") - F.col("their"))
    ok = ((F.col("our") >= 3) & (F.col("lead") >= 2)) | ((F.col("our") >= 5) & (F.col("our") / F.greatest("their", F.lit(1)) >= 1.5))
    return d.where(ok).orderBy(F.col("lead").desc(), F.col("our").desc(), "topic").limit(n).select("topic", "our", "their", "lead")


def reader_wins(counts: DataFrame, n: int = 7) -> DataFrame:
    """Wins (three of ours, twice theirs or at most one of theirs); near wins only if there is no win."""
    d = counts.withColumn("advantage", F.col("our") - F.col("their"))
    win = (F.col("our") >= 3) & ((F.col("our") >= 2 * F.col("their")) | (F.col("their") <= 1))
    near = (F.col("our") >= 2) & (F.col("advantage") >= 1)
    d = d.withColumn("is_win", win).where(win | near).withColumn("any_win", F.max("is_win").over(Window.partitionBy()))
    return d.where(F.col("is_win") | ~F.col("any_win")).orderBy(F.col("advantage").desc(), F.col("our").desc(), "topic").limit(n).select("topic", "our", "their", "advantage", (~F.col("is_win")).alias("near_win"))


def toi(i: Column, c: Column) -> Column:
    return _share(i, c)


def editorial_wins(topics: DataFrame) -> DataFrame:
    """Topics of three of ours and five in all that are ours alone or to seven tenths."""
    i, c = F.col("internal_count"), F.col("competitor_count")
    d = topics.withColumn("is_exclusive", c == 0).withColumn("toi", F.round(toi(i, c), 6))
    return d.where((i >= 3) & (i + c >= 5) & (F.col("is_exclusive") | (F.col("toi") >= 0.7))).orderBy(F.col("is_exclusive").desc(), F.col("toi").desc(), "cluster").select("cluster", "internal_count", "competitor_count", "is_exclusive", "toi")


def owned(topics: DataFrame) -> DataFrame:
    i, c = F.col("internal_count"), F.col("competitor_count")
    d = topics.withColumn("is_exclusive", c == 0).withColumn("ownership_ratio", F.round(toi(i, c), 6))
    return d.where((i >= 3) & (F.col("is_exclusive") | (F.col("ownership_ratio") >= 0.7))).orderBy(F.col("is_exclusive").desc(), F.col("internal_count").desc(), "cluster")


def by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in order of priority: of rows with the same key the earliest part's stays."""
    every = None
    for k, p in enumerate(parts):
        p = p.withColumn("_priority", F.lit(k))
        every = p if every is None else every.unionByName(p)
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_priority"))).where("_r = 1").drop("_r", "_priority")


def levers(topics: DataFrame, weekend_edge: bool, speakers: DataFrame, n: int = 5) -> DataFrame:
    """lever, name, potential: our topics as sponsorship, by count (a fifth more with a weekend edge), and the first speakers."""
    t = topics.where("internal_count >= 3").select(F.lit("topic").alias("lever"), F.col("cluster").cast("string").alias("name"), F.round(F.col("internal_count") * (1.2 if weekend_edge else 1.0), 6).alias("potential"))
    s = speakers.orderBy("place").limit(n).select(F.lit("speaker").alias("lever"), "name", F.lit(1.0).alias("potential"))
    return t.unionByName(s).orderBy(F.when(F.col("lever") == "topic", 0).otherwise(1), F.col("potential").desc(), "name")
