"""A data source for RSS and Atom feeds: spark.read.format("feed").

Options: path (a file or address, or several joined by commas), source, category, is_affiliate, limit (entries of
a feed, 50), feeds (JSON: [path, source, category, is_affiliate, mode] of each, instead), mode ("rss" or "proxy": links are redirects that carry their target). A feed is one partition; what
cannot be fetched or parsed gives no rows.
"""

from __future__ import annotations

import html
import json
import re
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import dates, text, urls

SCHEMA = "source string, title string, link string, published string, summary string, category string, is_affiliate boolean"


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def entries(data: bytes, limit: int = 50) -> Iterator[dict]:
    """title, link, published and summary of a feed's first entries with a title and a link."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return
    items = [e for e in root.iter() if _plain(e.tag) in ("item", "entry")][:limit]
    for item in items:
        found = {"title": "", "link": "", "published": "", "summary": ""}
        for e in item:
            name, value = _plain(e.tag), (e.text or "").strip()
            if name == "link":
                found["link"] = found["link"] or e.get("href") or value
            elif name in ("pubdate", "published", "updated", "date"):
                found["published"] = found["published"] or value
            elif name in ("description", "summary"):
                found["summary"] = found["summary"] or value
            elif name == "title":
                found["title"] = value
        if found["title"] and found["link"]:
            yield found


def target(link: str) -> str:
    """What a redirect's address carries."""
    asked = urllib.parse.parse_qs(urllib.parse.urlsplit(link).query)
    for k in ("url", "q", "link"):
        for v in asked.get(k, []):
            if v.startswith(("http://", "https://")):
                return v
    return link


class _Feed(InputPartition):
    def __init__(self, path: str, source: str, category: str, is_affiliate: bool, mode: str):
        self.path, self.source, self.category, self.is_affiliate, self.mode = path, source, category, is_affiliate, mode


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        o = self.options
        one = lambda p: _Feed(p, o.get("source", p), o.get("category", "competitor"), o.get("is_affiliate", "false").lower() == "true", o.get("mode", "rss"))
        return [_Feed(*f) for f in json.loads(o.get("feeds", "[]"))] + [one(p.strip()) for p in o.get("path", "").split(",") if p.strip()]

    def read(self, partition):
        o = self.options
        try:
            if re.match("https?://", partition.path):
                with urllib.request.urlopen(partition.path, timeout=float(o.get("timeout", "10"))) as f:
                    data = f.read()
            else:
                with open(partition.path.removeprefix("file://"), "rb") as f:
                    data = f.read()
        except OSError:
            return
        for e in entries(data, int(o.get("limit", "50"))):
            link = target(e["link"]) if partition.mode == "proxy" else e["link"]
            yield (partition.source, html.unescape(e["title"]), link, e["published"], e["summary"], partition.category, partition.is_affiliate)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options)


def read(spark: SparkSession, registry: DataFrame, blocked_sources: list[str] | None = None, blocked_domains: list[str] | None = None) -> DataFrame:
    """Articles of a source registry (name, url, category, is_affiliate, mode), canonical links and ids, blocked ones out, one row for each id.

    The registry is a configuration of a few dozen rows, read on the driver.
    """
    spark.dataSource.register(FeedSource)
    feeds = [[r["url"], r["name"], r["category"], bool(r["is_affiliate"]), r["mode"] or "rss"] for r in registry.collect()]
    found = spark.read.format("feed").option("feeds", json.dumps(feeds)).load()  # one scan, a partition for each feed
    d = found.withColumn("link", urls.normalize(F.col("link"))).withColumn("published_date", dates.standardize(F.col("published"))).withColumn("summary", text.strip_html(F.col("summary"), 300)).drop("published")
    d = d.withColumn("article_id", urls.article_id(F.col("source"), F.col("link"))).where(~urls.blocked(F.col("source"), F.col("link"), blocked_sources or [""], blocked_domains or []))
    from ..operators.articles import keep_first

    return keep_first(d, ["article_id"], [F.col("published_date").desc(), F.col("title").asc()])
