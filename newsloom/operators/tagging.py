"""Dictionary tagging of articles, alias and metadata lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons, text


def dimension(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    """keyword, label."""
    return spark.createDataFrame(lexicons.rows(lexicon), "keyword string, label string")


def tag(articles: DataFrame, column: Column, lexicon: dict[str, list[str]], name: str) -> DataFrame:
    """An array column of the labels of which a keyword occurs as a substring: no shuffle, one pass."""
    return articles.withColumn(name, text.labels(F.lower(F.coalesce(column, F.lit(""))), lexicon))


def tag_by_table(articles: DataFrame, column: str, terms: DataFrame, key: str = "article_id") -> DataFrame:
    """key, label: as `tag`, for a dictionary that is a table (keyword, label) of any size.

    Keywords of one to three words meet the articles' own word runs in an equi join, so that a large dictionary
    is never compared with each article.
    """
    words = articles.select(key, text.tokens(text.normalize(F.col(column))).alias("_w"))
    runs = words.select(key, F.explode(F.array_distinct(F.concat(*[text.ngrams(F.col("_w"), n) for n in (1, 2, 3)]))).alias("keyword"))
    return runs.join(terms.select(text.normalize(F.col("keyword")).alias("keyword"), "label"), "keyword").select(key, "label").distinct()


def canonical_names(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Canonical name by lower-case alias, else the name as it is. aliases: keyword, label."""
    a = aliases.groupBy(F.lower(F.trim("keyword")).alias("_k")).agg(F.min("label").alias("_l"))
    return df.join(a, F.lower(F.trim(column)) == F.col("_k"), "left").withColumn("canonical", F.coalesce("_l", F.trim(column))).drop("_k", "_l")


def regions_of(df: DataFrame, column: str, regions: DataFrame) -> DataFrame:
    """Rows whose place is in the table, with its region."""
    r = regions.groupBy(F.lower(F.trim("keyword")).alias("_k")).agg(F.min("label").alias("region"))
    return df.join(r, F.lower(F.trim(column)) == F.col("_k")).drop("_k")


def with_metadata(df: DataFrame, column: str, metadata: DataFrame) -> DataFrame:
    """type and segment of a company by exact name, else by name in any case, else unknown. metadata: name, type, primary_segment."""
    exact = metadata.groupBy(F.col("name").alias("_n")).agg(F.min("type").alias("_t1"), F.min("primary_segment").alias("_s1"))
    loose = metadata.groupBy(F.lower("name").alias("_l")).agg(F.min("type").alias("_t2"), F.min("primary_segment").alias("_s2"))
    j = df.join(exact, F.col(column) == F.col("_n"), "left").join(loose, F.lower(column) == F.col("_l"), "left")
    return j.withColumn("type", F.coalesce("_t1", "_t2", F.lit("unknown"))).withColumn("segment", F.coalesce("_s1", "_s2", F.lit("unknown"))).drop("_n", "_l", "_t1", "_t2", "_s1", "_s2")


def company_entities(articles: DataFrame, column: str, aliases: DataFrame, verbs: list[str], most: int = 5) -> DataFrame:
    """article_id, company: capitalised runs of words that are no generic term, role, fragment or platform, under their canonical names."""
    runs = F.slice(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0))), 1, most)
    e = articles.select("article_id", F.explode(runs).alias("name"))
    e = e.where(~text.ignored_entity(F.col("name"), lexicons.IGNORED_ENTITIES, lexicons.ROLES) & ~text.headline_fragment(F.col("name"), verbs))
    return canonical_names(e, "name", aliases).select("article_id", F.col("canonical").alias("company")).distinct()


def radar(counts: DataFrame, metadata: DataFrame, sponsors: DataFrame, types: list[str] | None = None, n: int = 15) -> DataFrame:
    """entity, n, type, segment, is_sponsor: the most mentioned companies of the wanted types."""
    d = with_metadata(counts, "entity", metadata)
    if types:
        d = d.where(F.col("type").isin(types))
    s = sponsors.select(F.lower(F.trim("name")).alias("_s")).distinct()
    d = d.join(s, F.lower("entity") == F.col("_s"), "left").withColumn("is_sponsor", F.col("_s").isNotNull()).drop("_s")
    return d.orderBy(F.col("n").desc(), "entity").limit(n)


def vote(contexts: DataFrame, key: str, column: str, classes: dict[str, list[str]]) -> DataFrame:
    """key, label, votes, confidence: each context votes once for each class it mentions; the first class of equals."""
    low = F.lower(F.col(column))
    sums = contexts.groupBy(key).agg(*[F.count_if(text.contains_any(low, ks)).alias(f"v{i}") for i, ks in enumerate(classes.values())])
    best = F.array_max(F.array(*[F.struct(F.col(f"v{i}").alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)]))
    d = sums.withColumn("_b", best)
    votes = F.col("_b.n")
    return d.select(key, F.when(votes > 0, F.col("_b.c")).otherwise("unknown").alias("label"), votes.alias("votes"), F.round(F.when(votes > 0, F.least(F.lit(0.9), 0.5 + 0.1 * votes)).otherwise(0.3), 6).alias("confidence"))


def enriched(metadata: DataFrame, votes: DataFrame, least: float = 0.5) -> DataFrame:
    """Types that are unknown take the vote's if it is sure enough."""
    v = votes.select(F.col("name").alias("_n"), F.col("label").alias("_l"), F.col("confidence").alias("_c"))
    j = metadata.join(v, F.col("name") == F.col("_n"), "left")
    better = (F.coalesce("type", F.lit("unknown")) == "unknown") & (F.col("_c") > least) & (F.col("_l") != "unknown")
    return j.withColumn("type", F.when(better, F.col("_l")).otherwise(F.coalesce("type", F.lit("unknown")))).drop("_n", "_l", "_c")


def contexts(articles: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """company, context: lower-case title and summary of each article that lists the company ("['a', 'b']")."""
    from ..functions import dates

    d = articles.where(dates.half_open(F.col("published"), as_of, days))
    names = F.split(F.regexp_replace(F.col("companies_list"), r"^\[|\]$|'", ""), r",\s*")
    return d.select(F.explode(names).alias("company"), F.lower(F.concat_ws(" ", "title", "summary")).alias("context")).where("trim(company) <> ''")


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
