"""Compositions: articles tagged through all steps, differentiators of two corpora, topics with what to do, briefs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons, text, urls
from . import advantages, metrics, reports, tagging, topics


# ---- articles ------------------------------------------------------------------------------------------------------


def tagged(
    articles: DataFrame, topics_: dict[str, list[str]] | None = None, companies: dict[str, list[str]] | None = None, places: dict[str, list[str]] | None = None,
    fallbacks: dict[str, list[str]] | None = None, own_sources: list[str] | None = None, own_domains: list[str] | None = None, verbs: list[str] | None = None,
) -> DataFrame:
    """articles with category (ours by source or host), topics_list, companies_list and regions_list.

    One pass: topics and places by keyword, regions of phrases as well; companies are capitalised
    runs of the title that are no generic term, role, headline fragment or platform, under their canonical names,
    and those of the dictionary that the text mentions.
    """
    whole = F.concat_ws(" ", "title", "summary")
    aliases = companies if companies is not None else lexicons.COMPANIES
    ours = urls.internal(F.col("source"), F.col("link"), own_sources or [""], own_domains or [])
    d = articles.withColumn("category", F.when(ours, F.lit("internal")).otherwise(F.col("category")))
    d = d.withColumn("topics_list", text.labels(F.lower(whole), topics_ or lexicons.TOPICS))
    runs = F.array_distinct(F.regexp_extract_all("title", F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0)))
    named = F.filter(runs, lambda e: ~text.ignored_entity(e, lexicons.IGNORED_ENTITIES, lexicons.ROLES) & ~text.headline_fragment(e, verbs or []))
    canonical = F.create_map(*[F.lit(x) for name, alias in aliases.items() for k in dict.fromkeys([name.lower(), *alias]) for x in (k, name)]) if aliases else None
    if canonical is not None:
        named = F.transform(named, lambda e: F.coalesce(F.try_element_at(canonical, F.lower(e)), e))
    mentioned = text.labels(F.lower(whole), {name: [name.lower(), *alias] for name, alias in aliases.items()}) if aliases else F.array().cast("array<string>")
    d = d.withColumn("companies_list", F.when(urls.platform(urls.domain(F.col("link"))), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(named, mentioned)))))
    found = text.labels(F.lower(whole), places if places is not None else lexicons.REGIONS)
    more = text.regions(whole, fallbacks if fallbacks is not None else lexicons.REGION_PHRASES)
    return d.withColumn("regions_list", F.array_distinct(F.concat(found, more)))


def counters(articles: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """kind, name, n: the most frequent regions, companies and topics, without blank and unknown ones."""
    every = None
    for kind, n in (most or {"regions": 10, "companies": 15, "topics": 20}).items():
        e = articles.select(F.explode(f"{kind}_list").alias("name")).where("name is not null and trim(name) <> '' and name <> 'Unknown'")
        top = e.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(n).select(F.lit(kind).alias("kind"), "name", "n")
        every = top if every is None else every.unionByName(top)
    return every


def cardinalities(terms: DataFrame) -> DataFrame:
    """label, n: keywords of each label of a dictionary table (keyword, label)."""
    return terms.groupBy("label").agg(F.count_distinct("keyword").alias("n"))


def examples(articles: DataFrame, group: str, n: int = 3) -> DataFrame:
    """group, examples: the newest `n` articles of each group, each id once."""
    one = articles.dropDuplicates([group, "article_id"])
    top = tagging.top_per_group(one, group, [F.col("published").desc(), F.col("article_id").asc()], n)
    e = F.struct("published", "article_id", "title", "link")
    newest = F.reverse(F.array_sort(F.collect_list(e)))
    return top.groupBy(group).agg(newest.alias("examples"))


def largest(sizes: DataFrame, key: str = "cluster", n: str = "n") -> DataFrame:
    """The largest group, of equals the first by key."""
    return sizes.orderBy(F.col(n).desc(), key).limit(1)


# ---- comparison ----------------------------------------------------------------------------------------------------


def seo(rates: DataFrame, industry: list[str], n: int = 10) -> DataFrame:
    """section, place, keyword, gap, priority: gaps (widest first), strengths, and what to write about."""
    t = metrics.trending(rates, industry, 1_000_000).withColumn("priority", F.when(F.abs("gap") >= 10, F.lit("high")).when(F.abs("gap") >= 5, F.lit("medium")).otherwise(F.lit("low")))
    part = lambda trend, name, m: t.where(F.col("trend") == trend).withColumn("section", F.lit(name)).withColumn("_m", F.lit(m))
    every = part("gap", "gaps", n).unionByName(part("strength", "strengths", n)).unionByName(part("gap", "recommendations", 3))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.abs("gap").desc(), "keyword"))
    return every.withColumn("place", place).where("place <= _m").select("section", "place", "keyword", "gap", "priority")


def differentiators(articles: DataFrame, stopwords: list[str], companies: dict[str, list[str]], regions: dict[str, list[str]], formats: dict[str, list[str]], days: int, features: int = 10_000, n: int = 20) -> DataFrame:
    """section, place, name, internal, competitor, score: language, companies, regions, formats, cadence and the corpora's sizes.

    articles: corpus, published, title, summary, content. Whole texts are compared.
    """
    d = articles.withColumn("whole", text.join_fields(F.col("title"), F.col("summary"), F.col("content")))
    d = d.withColumn("article_format", text.best_format(F.concat_ws(" ", "title", "summary"), formats))
    number = lambda c: F.col(c).cast("double")

    def section(name: str, rows: DataFrame, key: str, a: Column, b: Column, score: Column) -> DataFrame:
        r = rows.select(F.col(key).alias("name"), a.alias("internal"), b.alias("competitor"), F.round(score, 6).alias("score"))
        return r.withColumn("section", F.lit(name)).withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "name"))).select("section", "place", "name", "internal", "competitor", "score")

    terms = metrics.log_odds_terms(metrics.ngram_counts(d, "whole", 3, features), stopwords, n=n)
    by_company = metrics.occurrence_edges(d, "whole", companies, n=10)
    by_region = metrics.occurrence_edges(d, "whole", regions, n=len(regions))
    by_format = metrics.format_shares(d, formats)
    pace = metrics.cadence(d, "published", days)
    one = lambda who, c: F.max(F.when(F.col("corpus") == who, number(c)))
    pace = pace.agg(*[one(w, c).alias(f"{c}_{w}") for c in ("n", "per_day", "weekend_pct", "median_hour") for w in ("internal", "competitor")])
    measures = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(f"{c}_internal", F.lit(0.0)).alias("a"), F.coalesce(f"{c}_competitor", F.lit(0.0)).alias("b")) for c in ("n", "per_day", "weekend_pct", "median_hour")]))
    pace = pace.select(measures.alias("m")).select("m.name", "m.a", "m.b")
    parts = [
        section("language", terms, "ngram", number("internal"), number("competitor"), F.col("score")),
        section("company", by_company, "label", F.col("internal_rate"), F.col("competitor_rate"), F.col("ratio")),
        section("region", by_region, "label", F.col("internal_rate"), F.col("competitor_rate"), F.col("ratio")),
        section("format", by_format, "format", F.col("internal_pct"), F.col("competitor_pct"), F.col("ratio")),
        section("cadence", pace, "name", F.col("a"), F.col("b"), metrics.smoothed_ratio(F.col("a"), F.col("b"), 0.1)),
    ]
    return reduce(DataFrame.unionByName, parts)


def topic_formats(articles: DataFrame, cluster: str = "cluster", n: int = 2) -> DataFrame:
    """cluster, formats: the `n` formats that most of our articles of a cluster have, the most frequent first."""
    c = articles.where("is_internal").groupBy(cluster, "article_format").agg(F.count(F.lit(1)).alias("k"))
    top = tagging.top_per_group(c, cluster, [F.col("k").desc(), F.col("article_format").asc()], n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "article_format"))), lambda x: x["article_format"])
    return top.groupBy(cluster).agg(ordered.alias("formats"))


def topic_actions(indices: DataFrame, formats: DataFrame, cluster: str = "cluster") -> DataFrame:
    """indices with `actions` (three, by thresholds on the indices, in order) and `risk`. formats: of `topic_formats`."""
    j = indices.join(formats.withColumnRenamed(cluster, "_c"), F.col(cluster) == F.col("_c"), "left").drop("_c")
    own, excl, pace, deep, form = (F.col(c) for c in ("ownership", "exclusivity", "timeliness", "depth", "format_edge"))
    names = F.array_join(F.coalesce("formats", F.array(F.lit("our"))), " and ")
    chosen = [
        F.when(form >= 0.5, F.concat(F.lit("Keep to the formats that win here: "), names, F.lit("."))).when(form < 0.3, F.lit("Add an explainer or a story told with data.")),
        F.when((pace >= 0.5) & (own < 0.7), F.lit("Publish first: speed is an edge that can still win ground.")).when(pace < 0.3, F.lit("Publish more evenly, weekends included.")),
        F.when(excl >= 0.5, F.lit("Make a series of what only we cover.")).when((excl < 0.3) & (own >= 0.5), F.lit("Find an angle that the others lack.")),
        F.when(deep < 0.4, F.lit("Go deeper: sources, figures, analysis.")).when(deep >= 0.6, F.lit("Promote these pieces as works of reference.")),
        F.lit("Publish two pieces a week on this."), F.lit("Gather all coverage on one page."), F.lit("Give this a place in the newsletter."),
    ]
    risk = F.when(excl >= 0.7, F.lit("low: others need a month or more to catch up")).when(excl >= 0.4, F.lit("medium: others need two or three weeks"))
    risk = risk.when(F.col("competitor_count") > 0, F.lit("high: others are here already")).otherwise(F.lit("low: nobody else is here yet"))
    return j.withColumn("actions", F.slice(F.array_compact(F.array(*chosen)), 1, 3)).withColumn("risk", risk).drop("formats")


def topic_report(articles: DataFrame, valued: list[str], least: int = 10, cluster: str = "cluster", n: int = 12, **ranks) -> DataFrame:
    """cluster, score, risk, actions, n_window, error: the window's best topics, or one row with an error where it holds fewer than `least` articles.

    articles: of a window, with their cluster (of `topics.cluster`, or given) and the columns of articles.window_frame.
    """
    total = articles.agg(F.count(F.lit(1)).alias("n_window"))
    best = metrics.ranked_topics(metrics.topic_indices(articles, cluster, valued), cluster, n, **ranks)
    rows = topic_actions(best, topic_formats(articles, cluster), cluster).select(F.col(cluster).cast("string").alias("cluster"), "score", "risk", "actions")
    found = rows.crossJoin(F.broadcast(total)).where(F.col("n_window") >= least).withColumn("error", F.lit(None).cast("string"))
    none = total.where(F.col("n_window") < least).select(F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("risk"),
                                                         F.array().cast("array<string>").alias("actions"), "n_window", F.lit("too few articles in the window").alias("error"))
    return found.unionByName(none)


def edges(articles: DataFrame, places: list[str], least: float = 1.3) -> DataFrame:
    """metric, our_value, comp_value, delta: where we differ by weekend, format and region. articles: is_internal, is_weekend, article_format, title, summary."""
    d = articles.withColumn("corpus", F.when(F.col("is_internal"), F.lit("internal")).otherwise(F.lit("competitor")))
    notes = topics.global_notes(d, places)
    weekend = notes.where("note = 'weekend'").select(F.lit("weekend").alias("metric"), F.col("internal").alias("our_value"), F.col("competitor").alias("comp_value"), F.round(F.col("internal") - F.col("competitor"), 6).alias("delta"))
    share = d.groupBy("article_format").agg(F.count_if("is_internal").alias("i"), F.count_if(~F.col("is_internal")).alias("c")).crossJoin(F.broadcast(metrics.totals(d)))
    a, b = metrics.percent(F.col("i"), F.col("n_internal"), 6), metrics.percent(F.col("c"), F.col("n_competitor"), 6)
    formats = share.select(F.concat(F.lit("format:"), F.col("article_format")).alias("metric"), a.alias("our_value"), b.alias("comp_value")).where("our_value > comp_value").withColumn("delta", F.round(F.col("our_value") - F.col("comp_value"), 6))
    regions = topics.region_edges(notes, least).select(F.concat(F.lit("region:"), F.substring("note", 7, 100)).alias("metric"), F.col("internal").alias("our_value"), F.col("competitor").alias("comp_value"), F.col("ratio").alias("delta"))
    return weekend.unionByName(formats).unionByName(regions)


def rendered(topics_: DataFrame, edge: DataFrame, speakers: DataFrame) -> dict[str, DataFrame]:
    """The tables of the differentiators page: wins, edges, levers, and a summary of one row."""
    wins = advantages.editorial_wins(topics_)
    positive = edge.agg(F.coalesce(F.bool_or((F.col("metric") == "weekend") & (F.col("delta") > 0)), F.lit(False)).alias("weekend_positive"),
                        F.count_if(F.col("metric").startswith("format:")).alias("format_edges"), F.count_if(F.col("metric").startswith("region:")).alias("region_edges"))
    summary = wins.agg(F.count(F.lit(1)).alias("owned_topics"), F.count_if("is_exclusive").alias("exclusive_topics"), F.coalesce(F.median("toi"), F.lit(0.0)).alias("median_toi")).crossJoin(F.broadcast(positive))
    weekend = bool(positive.first().weekend_positive)
    return {"editorial_wins": wins, "audience_edge": edge, "commercial_levers": advantages.levers(topics_.join(wins.select("cluster"), "cluster", "left_semi"), weekend, speakers), "summary": summary}


def owned_cards(topics_: DataFrame) -> DataFrame:
    """Cards of owned topics: the share, what to do, and how exposed the lead is."""
    d = advantages.owned(topics_)
    i, c = F.col("internal_count"), F.col("competitor_count")
    kpi = F.format_string("%d of %d articles", i, i + c)
    return d.select("cluster", "is_exclusive", "ownership_ratio", reports.action_text(i, c).alias("action"), kpi.alias("kpi"), F.when(F.col("is_exclusive"), F.lit("only ours")).otherwise(F.lit("ours first")).alias("state"))


def scorecard(found: DataFrame, recent: Column, totals: DataFrame, brands: list[str], not_topics: list[str], common: list[str], n: int = 10, n_examples: int = 3, **gates) -> DataFrame:
    """Topics scored, brands and non-topics dropped after counting, each with its newest examples of ours. found: article_id, corpus, published, topic, title, link."""
    counts = advantages.topic_counts(found, recent).where(text.valid_topic(F.col("topic"), brands, not_topics, common))
    best = advantages.scored_topics(counts, totals, n=n, **gates)
    mine = found.where("corpus = 'internal'").join(F.broadcast(best.select("topic")), "topic", "left_semi")  # n rows
    return best.join(examples(mine, "topic", n_examples), "topic", "left")


# ---- results without a language model ------------------------------------------------------------------------------


def topic_insight(rows: DataFrame) -> DataFrame:
    """text: the first gap of a topic table (entity, competitor_pct, internal_pct; its order is by the others' share), '' without a gap."""
    top = rows.where("competitor_pct > internal_pct").orderBy(F.col("competitor_pct").desc(), "entity").limit(1)
    said = F.format_string("Widest topic gap: %s (%.0f%% elsewhere, %.0f%% here)", "entity", "competitor_pct", "internal_pct")
    return top.agg(F.max(said).alias("t")).select(F.coalesce("t", F.lit("")).alias("text"))


def affiliate_insight(rows: DataFrame) -> DataFrame:
    """text: what affiliates write more about (entity, affiliate_pct, other_pct, diff), '' if nothing."""
    top = rows.where("diff > 0").orderBy(F.col("diff").desc(), "entity").limit(1)
    said = F.format_string("Affiliates focus on %s (%.0f%% against %.0f%%)", "entity", "affiliate_pct", "other_pct")
    return top.agg(F.max(said).alias("t")).select(F.coalesce("t", F.lit("")).alias("text"))


def _top(rows: DataFrame, column: str, n: int) -> Column:
    """The first n of a column by place, as an array: for agg over rows with place."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= n, F.struct("place", column)))), lambda x: x[column])


def seo_fallback(gaps: DataFrame, strengths: DataFrame) -> DataFrame:
    """quick_wins, topic, target_keywords, competitor_keywords, is_fallback: one row. gaps, strengths: place (from 1), keyword."""
    g = gaps.agg(_top(gaps, "keyword", 5).alias("g"))
    s = strengths.agg(_top(strengths, "keyword", 1).alias("s"))
    first = lambda c, some, none: F.when(F.size(c) > 0, F.concat(F.lit(some), F.try_element_at(F.col(c), F.lit(1)))).otherwise(F.lit(none))
    wins = F.array(first("g", "Write about: ", "Go over what is published for its keywords"), first("s", "Strengthen: ", "Link related articles"), F.lit("Renew the descriptions of the best pages"))
    return g.crossJoin(F.broadcast(s)).select(wins.alias("quick_wins"), F.coalesce(F.try_element_at(F.col("g"), F.lit(1)), F.lit("Trends")).alias("topic"), F.slice("g", 1, 2).alias("target_keywords"), F.col("g").alias("competitor_keywords"), F.lit(True).alias("is_fallback"))


def keyword_fallback(theirs: DataFrame, gap_topics: DataFrame) -> DataFrame:
    """place, keyword, content_type, rationale: five keywords of the others, then three gap topics. Both: place (from 1), keyword."""
    a = theirs.where("place <= 5").select(F.col("place").alias("place"), "keyword", F.lit("article").alias("content_type"), F.lit("others focus on it").alias("rationale"))
    b = gap_topics.where("place <= 3 and keyword <> ''").select((F.col("place") + 5).alias("place"), "keyword", F.lit("guide").alias("content_type"), F.lit("a gap of ours").alias("rationale"))
    return a.unionByName(b)


def filled(result: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the arrays of a result, empty or missing ones from a fallback of the same columns."""
    f = fallback.select(*[F.col(k).alias(f"_f_{k}") for k in keys])
    pick = lambda k: F.when(F.coalesce(F.size(k), F.lit(0)) > 0, F.col(k)).otherwise(F.col(f"_f_{k}"))
    return result.crossJoin(F.broadcast(f)).select(*[pick(k).alias(k) if k in keys else F.col(k) for k in result.columns])


def batched(parts: DataFrame, n: int = 5) -> DataFrame:
    """section, place, name, text: the first `n` themes, gaps and wins over all batches, each name once, blank texts replaced. parts: batch, place, section, name, text."""
    first = F.row_number().over(Window.partitionBy("section", F.lower(F.trim("name"))).orderBy("batch", "place"))
    d = parts.where("trim(name) <> ''").withColumn("_f", first).where("_f = 1")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("section").orderBy("batch", "place", "name"))).where(F.col("_r") <= n)
    return d.select("section", F.col("_r").alias("place"), "name", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("No detail given.")).alias("text"))


def segment_votes(contexts: DataFrame, key: str, column: str, segments: dict[str, list[str]] | None = None) -> DataFrame:
    """key, label, votes, confidence: as tagging.vote, surer by the votes: 0.3 and 0.1 for each, 0.9 at most; 0 without any."""
    v = tagging.vote(contexts, key, column, segments or lexicons.SEGMENTS)
    sure = F.when(F.col("votes") > 0, F.least(F.lit(0.9), 0.3 + 0.1 * F.col("votes"))).otherwise(0.0)
    return v.withColumn("confidence", F.round(sure, 6))
