"""More registered queries: entities, roll-ups, exports, briefs and fallbacks, and the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons, text
from ..operators import advantages, articles, metrics, reports, tagging
from .catalogue import AS_OF, ART, FORMATS, TAGGED, COVER, _format_sql, corpus_view, query, table, tagged, window

_ASCII = r"regexp_replace(title, '[^\x00-\x7F]', ' ', 'g')"
VERBS = ["was", "is", "are", "launches", "wins"]


def ascii_titles(d):
    return d.withColumn("title", F.regexp_replace("title", r"[^\x00-\x7F]", " "))


def strings(xs) -> str:
    return "(" + ", ".join("'" + x.lower() + "'" for x in xs) + ")"


@query(f"""WITH {ART}, l AS (SELECT doc_id, lower(concat_ws(' ', title, summary)) AS context, unnest(['c' || CAST(doc_id % 5 AS VARCHAR), 'c' || CAST(doc_id % 3 AS VARCHAR)]) AS company FROM art WHERE published >= TIMESTAMP '2024-03-11')
  SELECT company, count(*) AS n, CAST(sum(length(context)) AS BIGINT) AS chars FROM l GROUP BY company""")
def company_contexts(spark, sf):
    d = corpus_view(spark, sf).withColumn("companies_list", F.format_string("['c%d', 'c%d']", F.col("doc_id") % 5, F.col("doc_id") % 3))
    c = tagging.contexts(d, AS_OF, 20)
    return c.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("context")).alias("chars"))


@query("SELECT event_type AS name, count(*) AS n, max((length(props), props))[2] AS context FROM events GROUP BY event_type ORDER BY n DESC, lower(event_type) LIMIT 10")
def batch_rollup(spark, sf):
    return reports.rollup_batches(table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("props").alias("context")))


@query(f"WITH {ART} SELECT doc_id, replace(array_to_string(string_split(source, 'c'), ' | '), 's', 'S') AS parts FROM art")
def export_rows(spark, sf):
    d = corpus_view(spark, sf).select("doc_id", F.split("source", "c").alias("parts"))
    return reports.export_strings(d, {"parts": " | "}).withColumn("parts", F.replace("parts", F.lit("s"), F.lit("S")))


@query(f"""WITH {ART}, t AS (SELECT doc_id, title, substr(title, 1, 110) AS cut, regexp_extract(substr(title, 1, 110), '^(.*)\\s\\S*$', 1) AS word FROM art)
  SELECT doc_id, CASE WHEN length(title) <= 110 THEN title WHEN length(word) >= 66 THEN rtrim(word) || '…' ELSE rtrim(cut) || '…' END AS short FROM t""")
def title_truncation(spark, sf):
    return corpus_view(spark, sf).select("doc_id", text.truncate_title(F.col("title")).alias("short"))


@query("""WITH k AS (SELECT item_id, list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'), regexp_extract_all(text, '"([^"]+)"', 1)), list_concat(list_concat(regexp_extract_all(text, '\\b[A-Z]{2,6}\\b'), regexp_extract_all(text, '[$€£]\\s?[0-9][0-9,.]*\\s?(?:million|billion|m|bn)?')),
    regexp_extract_all(text, '\\b(?:19|20)[0-9]{2}\\b'))), lambda x: lower(trim(x)))) AS ks FROM (SELECT event_id AS item_id, upper(event_type) || ' in ' || CAST(2000 + user_id % 30 AS VARCHAR) || ' UK: Big Deal "' || event_type || ' ' || CAST(user_id % 7 AS VARCHAR) || '" of $' || CAST(user_id % 50 AS VARCHAR) || ' million by Ann Bee' AS text FROM events))
  SELECT item_id, len(ks) AS n, array_to_string(list_sort(ks), ',') AS keywords FROM k""")
def gap_keywords(spark, sf):
    n = lambda k: (F.col("user_id") % k).cast("string")
    t = F.concat(F.upper("event_type"), F.lit(" in "), (2000 + F.col("user_id") % 30).cast("string"), F.lit(' UK: Big Deal "'), F.col("event_type"), F.lit(" "), n(7), F.lit('" of $'), n(50), F.lit(" million by Ann Bee"))
    k = text.gap_keywords(t)
    return table(spark, sf, "events").select(F.col("event_id").alias("item_id"), k.alias("k")).select("item_id", F.size("k").cast("long").alias("n"), F.array_join(F.array_sort("k"), ",").alias("keywords"))


@query("""SELECT doc_id, 2 AS place, coalesce(source, 'x') || ' ' || doc_id AS name, coalesce(lang, '') AS expertise FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 3, 'Bo', 'tax: all' FROM documents WHERE lang = 'en'""")
def briefing_speakers(spark, sf):
    """Of a briefing for each document; only those of English ones have the section."""
    head = F.when(F.col("lang") == "en", F.lit("# Day\n### Potential Speakers\n")).otherwise(F.lit("# Potential Speakers\n## Panels\n"))
    name = F.concat(F.coalesce("source", F.lit("x")), F.lit(" "), F.col("doc_id").cast("string"))
    value = F.concat(head, F.lit("- **"), name, F.lit("**: "), F.coalesce("lang", F.lit("")), F.lit("\n* **Bo**: tax: all\nno item\n## Next\n- x: y"))
    return reports.speakers(table(spark, sf, "documents").select("doc_id", value.alias("value")), by="doc_id")


@query(f"WITH {ART}, s AS (SELECT source, 1 AS p, count(*) AS n FROM art WHERE source < 'src3' GROUP BY source UNION ALL SELECT source, 2, count(*) + 1000 FROM art WHERE source > 'src2' GROUP BY source) SELECT source, n FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY p) = 1")
def edge_priority(spark, sf):
    d = corpus_view(spark, sf)
    n = lambda w, plus: d.where(w).groupBy("source").agg((F.count(F.lit(1)) + plus).alias("n"))
    return advantages.by_priority([n("source < 'src3'", 0), n("source > 'src2'", 1000)], "source")


@query(TAGGED + ", c AS (SELECT entity AS advantage_key, count(*) FILTER (corpus = 'internal') AS our FROM tags GROUP BY entity) SELECT advantage_key, our, CASE WHEN advantage_key = 'T1' THEN 'written' ELSE advantage_key || ': ' || our || ' articles' END AS text FROM c")
def card_texts(spark, sf):
    c = metrics.entity_counts(tagged(spark, sf)).select(F.col("entity").alias("advantage_key"), F.col("internal").alias("our"))
    return advantages.merge_cards(c, spark.createDataFrame([("T1", "written")], "advantage_key string, text string"), "%s: %d articles")


@query(f"""WITH {ART}, f AS (SELECT *, {_format_sql('lower(summary)', FORMATS)} AS article_format, isodow(published) >= 6 AS we FROM win), t AS (SELECT count(*) FILTER (corpus = 'internal') AS ni, count(*) FILTER (corpus = 'competitor') AS nc FROM f),
  x AS (SELECT 'weekend' AS edge, round(count(*) FILTER (corpus = 'internal' AND we) * 100.0 / max(ni), 6) AS internal_pct, round(count(*) FILTER (corpus = 'competitor' AND we) * 100.0 / max(nc), 6) AS competitor_pct FROM f, t
        UNION ALL SELECT 'format:' || article_format, round(count(*) FILTER (corpus = 'internal') * 100.0 / max(ni), 6), round(count(*) FILTER (corpus = 'competitor') * 100.0 / max(nc), 6) FROM f, t GROUP BY article_format) SELECT * FROM x WHERE internal_pct > competitor_pct""")
def audience_edge(spark, sf):
    d = window(spark, sf).withColumn("article_format", text.best_format(F.col("summary"), FORMATS)).withColumn("we", F.weekday("published") >= 5)
    e = d.select("corpus", F.explode(F.array_compact(F.array(F.when(F.col("we"), F.lit("weekend")), F.concat(F.lit("format:"), F.col("article_format"))))).alias("edge"))
    c = e.groupBy("edge").agg(F.count_if(F.col("corpus") == "internal").alias("i"), F.count_if(F.col("corpus") == "competitor").alias("c")).crossJoin(F.broadcast(metrics.totals(d)))
    return c.select("edge", metrics.percent(F.col("i"), F.col("n_internal"), 6).alias("internal_pct"), metrics.percent(F.col("c"), F.col("n_competitor"), 6).alias("competitor_pct")).where("internal_pct > competitor_pct")


@query(f"""WITH {ART}, r AS (SELECT article_id, regexp_extract_all({_ASCII}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b') AS xs FROM win), q AS (SELECT article_id, unnest(xs) AS name, generate_subscripts(xs, 1) AS i FROM r),
  e AS (SELECT article_id, name FROM q GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY min(i)) <= 5), x AS (SELECT article_id, name, lower(trim(name)) AS e FROM e)
  SELECT DISTINCT article_id, CASE WHEN e = 'hand' THEN 'Hand Group' ELSE name END AS company FROM x WHERE length(e) >= 3 AND e NOT IN {strings([*lexicons.IGNORED_ENTITIES, *lexicons.ROLES])} AND NOT regexp_matches(e, '^chief .*officer$')
  AND e NOT IN {strings(VERBS)} AND NOT regexp_matches(e, '(^| )({'|'.join(VERBS)})( |$)') AND len(string_split_regex(e, '\\s+')) < 4 AND NOT (contains(lower(name), ' in ') AND len(string_split_regex(e, '\\s+')) >= 3)""")
def company_entities(spark, sf):
    aliases = spark.createDataFrame([("hand", "Hand Group")], "keyword string, label string")
    return tagging.company_entities(ascii_titles(window(spark, sf)), "title", aliases, VERBS)


@query(f"""WITH {ART}, t AS (SELECT article_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({_ASCII}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))) AS w FROM win)
  SELECT DISTINCT article_id, CASE WHEN w = 'hand' THEN 'A' WHEN w = 'that' THEN 'B' ELSE 'A' END AS label FROM t WHERE w IN ('hand', 'that', 'this')""")
def table_tags(spark, sf):
    d = window(spark, sf).withColumn("title", F.lower(F.regexp_replace("title", r"[^\x00-\x7F]", " ")))
    d = d.withColumn("title", F.regexp_replace("title", "[0-9]", " "))
    return tagging.tag_by_table(d, "title", tagging.dimension(spark, {"A": ["hand", "this"], "B": ["that"]}))


@query(COVER + ", g AS (SELECT entity, competitor_pct - internal_pct AS d FROM pct ORDER BY d DESC, entity LIMIT 1) SELECT entity || ' is the widest gap: they are ' || printf('%.1f', d) || ' points ahead.' AS text FROM g")
def gap_insight(spark, sf):
    return reports.insight("gap", metrics.coverage(tagged(spark, sf)))


@query("SELECT r_name || ' leads with ' || n || ' articles.' AS text FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name ORDER BY n DESC, r_name LIMIT 1)")
def region_insight(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.insight("region", c.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {ART} SELECT doc_id, CASE WHEN c = 0 THEN 'Only we cover this: turn it into a series.' WHEN i / (i + c) >= 0.7 THEN 'We lead here: publish a reference piece and keep the pace.'
  WHEN i / (i + c) >= 0.5 THEN 'Close race: add depth that others lack.' ELSE 'Others lead: pick one angle of our own.' END AS action FROM (SELECT doc_id, doc_id % 4 AS i, doc_id % 3 AS c FROM art)""")
def topic_actions(spark, sf):
    return corpus_view(spark, sf).select("doc_id", reports.action_text(F.col("doc_id") % 4, F.col("doc_id") % 3).alias("action"))


@query("SELECT c_mktsegment AS segment, CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' ELSE 'week' END AS part, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def order_cadence(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("segment"), F.when(F.weekday("o_orderdate") >= 5, F.lit("weekend")).otherwise(F.lit("week")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def line_rollup(spark, sf):
    return table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def labelled_semijoin(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality", "toxic")


@query("""WITH w AS (SELECT role, unnest(list_filter(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')), '\\b[a-z]{3,}\\b'), lambda x: x NOT IN ('the', 'and'))) AS keyword FROM conversations WHERE role IN ('user', 'assistant')),
  t AS (SELECT count(*) FILTER (role = 'user') AS ni, count(*) FILTER (role = 'assistant') AS nc FROM conversations), c AS (SELECT keyword, count(*) FILTER (role = 'user') AS internal, count(*) FILTER (role = 'assistant') AS competitor FROM w GROUP BY keyword ORDER BY internal + competitor DESC, keyword LIMIT 50)
  SELECT keyword, internal, competitor, round(internal * 100.0 / ni, 6) AS internal_rate, round(competitor * 100.0 / nc, 6) AS competitor_rate FROM c, t""")
def role_keywords(spark, sf):
    d = table(spark, sf, "conversations").where("role in ('user', 'assistant')").withColumn("corpus", F.when(F.col("role") == "user", F.lit("internal")).otherwise(F.lit("competitor"))).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    return metrics.keyword_rates(d, "text", ["the", "and"], 50).select("keyword", "internal", "competitor", "internal_rate", "competitor_rate")


@query(f"WITH {ART} SELECT strftime(TIMESTAMP '2024-03-31 01:02:03', '%Y%m%d%H%M%S') AS run_id, count(*) AS article_count FROM art")
def run_info(spark, sf):
    from ..sources import files

    return files.run_info(corpus_view(spark, sf), "2024-03-31 01:02:03").select("run_id", "article_count")


@query(f"WITH {ART} SELECT article_id, length(content) > 0 AS has_content, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS words, hour(published) AS hour, isodow(published) - 1 AS dow FROM win")
def derived_columns(spark, sf):
    d = articles.window_frame(corpus_view(spark, sf).where("published <= timestamp_ntz'2024-03-31 00:00:00'"), "published", AS_OF, 30, FORMATS)
    return d.select("article_id", text.has_content(F.col("content")).alias("has_content"), text.count_words(F.col("content")).cast("long").alias("words"), F.col("publish_hour").cast("long").alias("hour"), F.col("publish_dow").cast("long").alias("dow"))
