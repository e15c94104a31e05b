"""Documents made of results: summaries, briefs, exports, fallbacks without a language model, JSON repair, result cache."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def export_strings(df: DataFrame, lists: dict[str, str]) -> DataFrame:
    """Array columns as joined strings; lists: column -> separator."""
    return df.withColumns({c: F.array_join(c, sep) for c, sep in lists.items()})


def json_rows(df: DataFrame, columns: list[str], n: int, ts: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """json: the first n rows, by an order (by all columns if none is given), as objects, a timestamp as a date."""
    d = df.select(*columns).orderBy(*(order or columns)).limit(n)
    if ts in columns:
        d = d.withColumn(ts, F.date_format(ts, "yyyy-MM-dd"))
    return d.select(F.to_json(F.struct(*columns)).alias("json"))


def repair_json(value: str | None):
    """An object or array cut short: the longest beginning that closes. None if nothing can be read.

    Fences and text around are dropped, commas before a closing bracket too; then brackets open at each possible
    end (after a value), from the last back, are closed.
    """
    if not value:
        return None
    s = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", value)
    start = min((i for i in (s.find("{"), s.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    s = re.sub(r",(\s*[}\]])", r"\1", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s[start:]))
    try:
        return json.JSONDecoder().raw_decode(s)[0]
    except ValueError:
        pass
    ends, stack, text = [], [], False
    i = 0
    while i < len(s):
        c = s[i]
        if text:
            if c == "\\":
                i += 1
            elif c == '"':
                text = False
                ends.append((i + 1, list(stack)))
        elif c == '"':
            text = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            ends.append((i + 1, list(stack)))
        elif c in "}]" and stack:
            stack.pop()
            ends.append((i + 1, list(stack)))
        elif c == ",":
            ends.append((i, list(stack)))
        i += 1
    for end, open_ in reversed(ends):
        try:
            return json.loads(s[:end].rstrip().rstrip(",") + "".join(reversed(open_)))
        except ValueError:
            continue
    return None


def repaired(df: DataFrame, column: str) -> DataFrame:
    """df with `repaired`, the column's JSON made readable: what Spark can parse as it is stays, the rest goes to Python in batches."""
    @F.pandas_udf("string")
    def fix(values: pd.Series) -> pd.Series:
        found = values.map(repair_json)
        return found.map(lambda x: None if x is None else json.dumps(x))

    plain = F.when(F.try_parse_json(column).isNotNull(), F.to_json(F.try_parse_json(column)))
    return df.withColumn("repaired", F.coalesce(plain, F.when(F.try_parse_json(column).isNull(), fix(F.col(column)))))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32)


def cache_stats(cache: DataFrame, as_of: str) -> DataFrame:
    """total, valid and expired entries of a table ts, ttl_hours."""
    alive = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("ttl_hours")) > F.lit(as_of).cast("timestamp_ntz")
    return cache.agg(F.count(F.lit(1)).alias("total"), F.count_if(alive).alias("valid"), F.count_if(~alive).alias("expired"))


def cache_get(cache: DataFrame, key: str, as_of: str) -> DataFrame:
    alive = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("ttl_hours")) > F.lit(as_of).cast("timestamp_ntz")
    return cache.where((F.col("key") == key) & alive).orderBy(F.col("ts").desc()).limit(1)


def speakers(briefings: DataFrame, section: str = "Potential Speakers", by: str | None = None) -> DataFrame:
    """place, name, expertise: list items of a markdown section. briefings: value, the whole text of one; by: the key of many.

    place: the item's line. A section ends at the next heading; null texts have no lines. Each text is read by itself, without a shuffle.
    """
    key = [] if by is None else [by]
    line = lambda l: F.trim(F.regexp_replace(l, "^#+ ", ""))

    def items(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda l, i: F.when(l.rlike("^#+ "), i)), lambda i: i.isNotNull())
        of = lambda i: F.array_max(F.filter(heads, lambda h: h <= i))
        ours = lambda i: F.coalesce(line(F.get(lines, of(i))) == section, F.lit(False))
        kept = F.transform(lines, lambda l, i: F.when(l.rlike(r"^\s*[-*] "), F.when(ours(i), F.struct(i.alias("place"), l.alias("line")))))
        return F.array_compact(kept)

    d = briefings.select(*key, F.inline(text.once(F.split("value", "\n"), items)))
    item = F.regexp_replace(F.regexp_replace("line", r"^\s*[-*] ", ""), r"\*\*", "")
    return d.select(*key, "place", F.trim(F.substring_index(item, ":", 1)).alias("name"), F.trim(F.regexp_extract(item, ":(.*)$", 1)).alias("expertise"))


def weekend_numbers(note: Column) -> tuple[Column, Column]:
    """The two percentages of 'a% ... vs ... b%'."""
    p = r"(\d+\.?\d*)%.*vs.*?(\d+\.?\d*)%"
    return F.regexp_extract(note, p, 1).try_cast("double"), F.regexp_extract(note, p, 2).try_cast("double")


def evidence_html(links: Column) -> Column:
    """Links (array of title, link) joined by a middle dot."""
    return F.array_join(F.transform(links, lambda x: F.concat(F.lit('<a href="'), x["link"], F.lit('">'), x["title"], F.lit("</a>"))), " · ")


def action_text(i: Column, c: Column) -> Column:
    """What to do about a topic, by how far we own it."""
    share = F.coalesce(F.try_divide(i, i + c), F.lit(0.0))
    return F.when(c == 0, F.lit("Only we cover this: turn it into a series.")).when(share >= 0.7, F.lit("We lead here: publish a reference piece and keep the pace.")).when(share >= 0.5, F.lit("Close race: add depth that others lack.")).otherwise(F.lit("Others lead: pick one angle of our own."))


def insight(kind: str, rows: DataFrame) -> DataFrame:
    """text: the sentence shown where no language model is at hand.

    gap (entity, competitor_pct, internal_pct): the widest; companies (name, n): the first three; region (region, n): the largest.
    """
    if kind == "gap":
        d = rows.withColumn("d", F.col("competitor_pct") - F.col("internal_pct")).orderBy(F.col("d").desc(), "entity").limit(1)
        return d.select(F.format_string("%s is the widest gap: they are %.1f points ahead.", "entity", "d").alias("text"))
    if kind == "companies":
        d = rows.orderBy(F.col("n").desc(), "name").limit(3)
        return d.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "name"))).alias("x")).select(F.concat(F.lit("Most mentioned: "), F.array_join(F.transform("x", lambda v: v["name"]), ", "), F.lit(".")).alias("text"))
    return rows.orderBy(F.col("n").desc(), "region").limit(1).select(F.format_string("%s leads with %d articles.", "region", "n").alias("text"))


def prospects(articles: DataFrame, n: int = 5, titles: int = 20) -> DataFrame:
    """name: capitalised words of more than three letters in the newest titles, in order of appearance, each once."""
    t = articles.orderBy(F.col("published").desc(), "article_id").limit(titles)
    w = t.withColumn("_t", F.row_number().over(Window.orderBy(F.col("published").desc(), "article_id"))).select("_t", F.posexplode(F.regexp_extract_all("title", F.lit(r"\b[A-Z]\w{3,}\b"), F.lit(0))).alias("_p", "name"))
    return w.groupBy("name").agg(F.min(F.struct("_t", "_p")).alias("first")).orderBy("first").limit(n).select("name")


def rollup_batches(batch_companies: DataFrame) -> DataFrame:
    """name, n, context: companies of batch results with their longest context, the most frequent ten."""
    d = batch_companies.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.length("context").alias("l"), "context")).alias("m"))
    return d.orderBy(F.col("n").desc(), F.lower("name")).limit(10).select("name", "n", F.col("m.context").alias("context"))


def markdown(title: str, sections: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """at, line: a report of tables, a heading for each and a list item for each row, in the order of the columns. Rows stay where they are."""
    spark = next(iter(sections.values())).sparkSession
    every = spark.createDataFrame([(0, "", f"# {title}")], "section int, key string, line string")
    for i, (name, df) in enumerate(sections.items(), 1):
        head = spark.createDataFrame([(2 * i - 1, "", f"## {name}")], every.schema)
        item = F.concat(F.lit("- "), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[name]]), ": "))
        every = every.unionByName(head).unionByName(df.select(F.lit(2 * i).alias("section"), item.alias("key"), item.alias("line")))
    return every.orderBy("section", "key").select("section", "line")


def content_brief(topic: DataFrame) -> DataFrame:
    """brief: headline, angle and checks for a topic row (cluster, label, internal_count, competitor_count, score)."""
    i, c = F.col("internal_count"), F.col("competitor_count")
    return topic.select("cluster", F.struct(F.concat(F.lit("Brief: "), F.col("label")).alias("headline"), action_text(i, c).alias("angle"), F.round("score", 2).alias("score"), F.when(c == 0, F.lit("low")).when(c < i, F.lit("medium")).otherwise(F.lit("high")).alias("risk")).alias("brief"))
