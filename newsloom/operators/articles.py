"""The article relation: canonical columns, corpora, windows, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls

#: What counts as the other corpus: rule -> (ours, theirs) over the lower-case category.
CORPUS_RULES = {
    "with_affiliates": (["internal"], ["competitor", "affiliate"]),
    "named": (["internal", "us", "our"], ["competitor", "them", "external", "comp"]),
    "rest": (["internal"], None),
}
#: Column -> accepted other names, the first present counts.
ALIASES = {"content": ["content", "body"], "summary": ["summary", "description"], "category": ["source_type", "category"]}
COLUMNS = ["article_id", "source", "title", "link", "published_date", "summary", "category", "is_affiliate", "run_timestamp", "scrape_timestamp", "content"]


def canonical(df: DataFrame) -> DataFrame:
    """The canonical columns, absent ones null, aliases resolved; other columns follow."""
    have = set(df.columns)
    cols = []
    for c in COLUMNS:
        names = [x for x in ALIASES.get(c, [c]) if x in have]
        cols.append((F.coalesce(*[F.col(x) for x in names]) if names else F.lit(None).cast("boolean" if c == "is_affiliate" else "string")).alias(c))
    used = {x for c in COLUMNS for x in ALIASES.get(c, [c])}
    return df.select(*cols, *[c for c in df.columns if c not in used])


def corpus(category: Column, rule: str = "with_affiliates") -> Column:
    """'internal', 'competitor' or null by a rule."""
    ours, theirs = CORPUS_RULES[rule]
    c = F.lower(F.trim(category))
    other = F.when(c.isNotNull(), F.lit("competitor")) if theirs is None else F.when(c.isin(theirs), F.lit("competitor"))
    return F.when(c.isin(ours), F.lit("internal")).otherwise(other)


def tidy(df: DataFrame) -> DataFrame:
    """For display: no row without both title and link, dates read, undated rows out, one row for each title and source."""
    d = df.dropna(how="all", subset=["title", "link"]).withColumn("published", dates.parse(F.col("published_date"))).where("published is not null")
    return keep_first(d, ["title", "source"], [F.col("published").asc(), F.col("article_id").asc()])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by an order (which should be total)."""
    name = "_rank"
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def latest_by_id(df: DataFrame, seq: str = "seq") -> DataFrame:
    return keep_first(df, ["article_id"], [F.col("published_date").desc(), F.col(seq).asc()])


def earliest_by_id_and_link(df: DataFrame, seq: str = "seq") -> DataFrame:
    by = [F.col("published_date").asc_nulls_last(), F.col(seq).asc()]
    d = keep_first(df, ["article_id"], by).withColumn("_link", F.lower(F.trim("link")))
    blank = F.coalesce(F.col("_link"), F.lit("")) == ""
    linked = keep_first(d.where(~blank), ["_link"], by)
    return linked.unionByName(d.where(blank)).drop("_link")


def backfill_dates(df: DataFrame) -> DataFrame:
    """Blank publication dates become the scrape's, else the run's."""
    blank = F.nullif(F.trim("published_date"), F.lit(""))
    return df.withColumn("published_date", F.coalesce(blank, F.nullif(F.trim("scrape_timestamp"), F.lit("")), dates.standardize(F.col("run_timestamp"))))


def upsert(history: DataFrame, new: DataFrame, scraped: str) -> DataFrame:
    """History with new articles: columns aligned, dates filled, the earliest row of each id and link kept. Doing it twice changes nothing."""
    stamped = new.withColumn("scrape_timestamp", F.lit(scraped))
    both = history.withColumn("_new", F.lit(0)).unionByName(stamped.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    # of rows of one id and date the first by all that is shown stays, whatever order they arrive in
    both = backfill_dates(both).withColumn("_seq", F.to_json(F.struct("_new", *[c for c in ("article_id", "title", "link", "summary", "content", "source") if c in both.columns])))
    return earliest_by_id_and_link(both, "_seq").drop("_new", "_seq")


def backfill(history: DataFrame, found: DataFrame, start: str) -> DataFrame:
    """Found articles since a date whose id the history lacks, appended, newest first."""
    fresh = found.join(history.select("article_id"), "article_id", "left_anti").where(F.col("published_date") >= start)
    every = history.unionByName(fresh, allowMissingColumns=True)
    return keep_first(every, ["article_id"], [F.col("published_date").desc(), F.col("title").asc()]).orderBy(F.col("published_date").desc(), "article_id")


def url_groups(df: DataFrame) -> DataFrame:
    """Links that several rows share, with their ids in order."""
    return df.groupBy(F.lower(F.trim("link")).alias("link")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("article_id")).alias("ids")).where("n > 1")


def recategorise(df: DataFrame, by_source: DataFrame) -> DataFrame:
    """category and is_affiliate from a table by source; unknown sources are competitors."""
    d = by_source.select(F.col("source").alias("_s"), F.col("category").alias("_c"), F.col("is_affiliate").alias("_a"))
    j = df.join(d, urls.norm_source(F.col("source")) == urls.norm_source(F.col("_s")), "left")
    return j.withColumn("category", F.coalesce("_c", F.lit("competitor"))).withColumn("is_affiliate", F.coalesce("_a", F.lit(False))).drop("_s", "_c", "_a")


def window_frame(df: DataFrame, ts: str, as_of: str, days: int, formats: dict, rule: str = "rest") -> DataFrame:
    """Rows of a half-open window with the derived columns of the topic indices."""
    d = df.where(dates.half_open(F.col(ts), as_of, days))
    whole = text.join_fields(F.col("title"), F.col("summary"), F.col("content"))
    return d.withColumns({
        "combined_text": whole, "word_count": text.count_words(whole), "article_format": text.best_format(text.join_fields(F.col("title"), F.col("summary")), formats),
        "is_internal": corpus(F.col("category"), rule) == "internal", "publish_hour": F.hour(ts), "publish_dow": F.weekday(ts), "is_weekend": F.weekday(ts) >= 5,
    })


def batches(df: DataFrame, size: int = 60, most: int = 500) -> DataFrame:
    """Rows in order of id with batch, place and the content cut; numbers come from counts by id prefix, not from one sort.

    The prefix table has 16**3 rows at most; a row's number is the rows of smaller prefixes and its place in its own.
    """
    d = df.withColumn("_p", F.substring("article_id", 1, 3))
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    d = d.join(before, "_p").withColumn("row", F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy("article_id")) - 1)
    cut = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.coalesce("content", F.lit("")))
    return d.withColumn("batch", F.floor(F.col("row") / size).cast("long")).withColumn("content", cut).drop("_p", "_b")


def page(df: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
