"""Readers and writers of files: history, registries, documents, reports."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates

HISTORY = "article_id string, source string, title string, link string, published_date string, summary string, category string, is_affiliate boolean, run_timestamp string, scrape_timestamp string, content string"


def history_csv(spark: SparkSession, path: str, drop_undated: bool = True) -> DataFrame:
    """The article history with `published`, its date read; rows without a date go."""
    d = spark.read.schema(HISTORY).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    d = d.withColumn("published", dates.parse(F.col("published_date")))
    return d.where("published is not null") if drop_undated else d


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and what makes a path of it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def replaced(spark: SparkSession, path: str, write) -> None:
    """Writes beside a folder, then puts the new one in its place: a failure on the way loses neither."""
    fs, make = _folder(spark, path)
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    fs.delete(make(new), True)
    write(new)
    fs.delete(make(old), True)
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    fs.rename(make(new), make(path))
    fs.delete(make(old), True)


def write_history(df: DataFrame, path: str) -> None:
    """The history in place of the one that was there (which df may read)."""
    replaced(df.sparkSession, path, lambda at: df.write.option("header", True).option("escape", '"').csv(at))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """name, url, category, is_affiliate, mode of a nested JSON configuration (feeds read directly, and by proxy)."""
    feed = "array<struct<name:string,url:string,domain:string,category:string,is_affiliate:boolean>>"
    d = spark.read.schema(f"direct_rss struct<sources:{feed}>, google_news_proxy struct<sources:{feed}>").json(path, multiLine=True)
    direct = d.select(F.inline("direct_rss.sources")).withColumn("mode", F.lit("rss"))
    proxy = d.select(F.inline("google_news_proxy.sources")).withColumn("mode", F.lit("proxy")).withColumn("url", F.concat(F.lit("https://news.google.com/rss/search?q=site:"), F.col("domain")))
    return direct.unionByName(proxy).select("name", "url", "category", F.coalesce("is_affiliate", F.lit(False)).alias("is_affiliate"), "mode")


def documents_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.json(path, multiLine=True)


def markdown_text(spark: SparkSession, path: str) -> DataFrame:
    """value: the whole text of each file."""
    return spark.read.text(path, wholetext=True)


@dataclass(frozen=True)
class Thresholds:
    """Gates, weights and limits of the topic scorecard."""

    min_total: int = 3
    min_our: int = 2
    edge_threshold: float = 0.6
    top_n: int = 10
    near_n: int = 5
    examples: int = 3
    momentum_days: int = 7
    brands: tuple[str, ...] = field(default_factory=tuple)


def thresholds(settings: dict) -> Thresholds:
    """From nested settings, as a YAML or JSON file has them; absent ones keep their defaults."""
    t, limits = settings.get("thresholds", {}), settings.get("limits", {})
    brands = [b for k in ("portfolio_brands", "our_domains", "boilerplate", "web_artifacts") for b in settings.get(k, [])]
    return Thresholds(
        t.get("min_total", 3), t.get("min_our", 2), settings.get("share", {}).get("edge_threshold", 0.6), limits.get("top_n", 10), limits.get("near_advantages_n", 5),
        limits.get("examples_per_topic", 3), settings.get("momentum", {}).get("window_days", 7), tuple(sorted({b.lower() for b in brands})),
    )


def load_settings(path: str) -> dict:
    """A JSON or YAML settings file, read on the driver; {} if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            body = f.read()
    except OSError:
        return {}
    if path.endswith(".json"):
        return json.loads(body)
    import yaml

    return yaml.safe_load(body) or {}


def write_snapshot(df: DataFrame, path: str) -> None:
    replaced(df.sparkSession, path, df.write.json)


def write_tables(tables: dict[str, DataFrame], folder: str, stamp: str) -> dict[str, str]:
    """Each table as a dated CSV and as the latest one; tables without rows are left out. Returns the latest paths."""
    paths = {}
    for name, df in tables.items():
        if not df.isEmpty():
            write_csv(df, f"{folder}/{name}_{stamp}.csv")
            paths[name] = f"{folder}/{name}_latest.csv"
            write_csv(df, paths[name])
    return paths


def remove_dated(spark: SparkSession, folder: str) -> list[str]:
    """Deletes the dated CSVs of a folder (name_YYYYMMDD_HHMMSS.csv) and returns their names; the latest ones stay."""
    fs, make = _folder(spark, folder)
    if not fs.exists(make(folder)):
        return []
    gone = sorted(s.getPath() for s in fs.listStatus(make(folder)) if re.search(r"_\d{8}_\d{6}\.csv$", s.getPath().getName()))
    for path in gone:
        fs.delete(path, True)
    return [path.getName() for path in gone]


def empty_window(articles: DataFrame, days: int, at: str) -> DataFrame:
    """json: what is written in place of an analysis where a window holds no article; no row where it holds one. articles: the window's."""
    t = F.struct(F.lit(True).alias("empty_window"), F.lit(at).alias("timestamp"), F.lit(0).alias("competitor_count"), F.lit(0).alias("internal_count"), F.lit(days).alias("analysis_period_days"))
    return articles.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.to_json(t).alias("json"))


def briefing(analysis: DataFrame, window: DataFrame, run: DataFrame, days: int, at: str) -> DataFrame:
    """json: the analysis (one row) with its run's id and time and with the window's counts; all articles of the window count as analysed.

    window: articles with corpus; run: run_id, generated_at of the latest run, or no row.
    """
    count = lambda c: F.count_if(F.col("corpus") == c)
    stats = window.agg(F.count(F.lit(1)).alias("n"), count("competitor").alias("c"), count("internal").alias("i"))
    meta = F.struct(
        F.col("n").alias("total_window_articles"), F.col("c").alias("total_window_competitor"), F.col("i").alias("total_window_internal"), F.col("n").alias("articles_analyzed"),
        F.date_format(F.lit(at).cast("timestamp_ntz"), "yyyy-MM-dd").alias("analysis_date"), F.lit(days).alias("analysis_period_days"),
    )
    latest = run.agg(F.max(F.struct("generated_at", "run_id")).alias("r"))  # a row also without a run
    d = analysis.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(latest))
    whole = F.struct(*[F.col(c) for c in analysis.columns], F.col("r.run_id").alias("run_id"), F.col("r.generated_at").cast("string").alias("generated_at"), F.lit(days).alias("analysis_period_days"), meta.alias("metadata"))
    return d.select(F.to_json(whole).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV folder, arrays joined by ' | ', a header also without rows."""
    arrays = [c for c, t in df.dtypes if t.startswith("array")]
    df.withColumns({c: F.array_join(c, " | ") for c in arrays}).write.mode("overwrite").option("header", True).csv(path) if arrays else df.write.mode("overwrite").option("header", True).csv(path)


def run_info(df: DataFrame, at: str) -> DataFrame:
    """run_id, generated_at, article_count: one row."""
    t = F.lit(at).cast("timestamp_ntz")
    return df.agg(F.count(F.lit(1)).alias("article_count")).select(F.date_format(t, "yyyyMMddHHmmss").alias("run_id"), t.alias("generated_at"), "article_count")
