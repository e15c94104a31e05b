"""Operators on hand-made tables."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.operators import advantages, articles, evidence, metrics, reports, search, tagging, topics

ARTICLE = "article_id string, title string, summary string, content string, source string, link string, category string, published_date string"


def corpus(spark):
    rows = [
        ("a1", "Apple launch", "fruit", None, "S1", "l1", "internal", "2024-03-01 10:00"), ("a2", "Orange juice", "drink", "deep apple text", "S2", "l2", "competitor", "2024-03-02 10:00"),
        ("a3", "Banana", "AI said so", "", "S2", "l3", "competitor", "2024-03-03 10:00"), ("a4", "iGaming news", "the quick fox", None, "S3", "l4", "affiliate", None), (None, "apple", "", "", "S3", "l5", "internal", None),
    ]
    return spark.createDataFrame(rows, ARTICLE)


def found(spark, q, **k):
    return {r.article_id for r in search.search(corpus(spark), q, **k).collect()}


def test_search(spark):
    assert found(spark, "apple") == {"a1", "a2"}
    assert found(spark, "apple orange") == {"a2"}
    assert found(spark, "apple OR banana") == {"a1", "a2", "a3"}
    assert found(spark, '"quick fox"') == {"a4"}
    assert found(spark, "ai") == {"a3"}
    assert found(spark, "gaming") == {"a4"}
    assert found(spark, "xyzzytest") == set() and found(spark, "") == set()
    assert found(spark, "ppl") == set() and found(spark, "pple") == {"a1", "a2"}
    assert found(spark, "apple", sources=["S1"]) == {"a1"}
    assert found(spark, "OR apple banana") == {"a1", "a2", "a3"}


def test_parse_keeps_the_traps():
    assert [(s.op, s.value) for s in search.parse('a OR "p q"')] == [("PHRASE", "p q"), ("AND", "a")]
    assert [(s.op, s.value) for s in search.parse("OR a b")] == [("OR", "a"), ("AND", "b")]


def test_keyword_options(spark):
    rows = search.keyword_counts(corpus(spark), ["apple", "banana", "nonexistent123"]).select(search.option(F.col("keyword"), F.col("n")).alias("o")).collect()
    assert [r.o for r in rows] == ["apple (2 articles)", "banana (1 article)"]


def test_upsert_twice_changes_nothing(spark):
    h = articles.canonical(corpus(spark)).where("article_id is not null")
    once = articles.upsert(h, h.limit(2), "2024-04-01 00:00")
    again = articles.upsert(once, h, "2024-04-02 00:00")
    key = lambda d: sorted((r.article_id, r.link) for r in d.collect())
    assert key(once) == key(again) and len(key(once)) == 4


def test_canonical_aliases(spark):
    d = articles.canonical(spark.createDataFrame([("x", "body text", "Our")], "title string, body string, source_type string")).first()
    assert d.content == "body text" and d.category == "Our" and d.article_id is None


def test_corpus_rules(spark):
    d = spark.createDataFrame([("internal",), ("Affiliate",), ("external",), (None,)], "c string")
    get = lambda r: [x.v for x in d.select(articles.corpus(F.col("c"), r).alias("v")).collect()]
    assert get("with_affiliates") == ["internal", "competitor", None, None]
    assert get("named") == ["internal", None, "competitor", None]
    assert get("rest") == ["internal", "competitor", "competitor", None]


def test_batches_cover_all_once(spark):
    d = spark.range(295).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("article_id"), F.lit("x" * 600).alias("content"))
    r = articles.batches(d).orderBy("row").collect()
    assert [x.row for x in r] == list(range(295)) and [x.article_id for x in r] == sorted(x.article_id for x in r)
    assert max(x.batch for x in r) == 4 and len(r[0].content) == 503


def test_strengths_and_gaps(spark):
    d = spark.createDataFrame([("Mobile Gaming", 10.75, 5.0), ("Slots", 1.0, 9.0), ("Other", 0.0, 2.0)], "entity string, internal_pct double, competitor_pct double")
    s = metrics.strengths(d).collect()
    assert [(x.entity, x.lead) for x in s] == [("Mobile Gaming", 5.75)]
    assert [(x.entity, x.priority) for x in metrics.gaps(d).collect()] == [("Slots", "High"), ("Other", "Low")]


def test_indices_are_bounded(spark):
    rows = [(c, c < 2, h % 7 > 4, h % 24, 100 * h + 1, "guide" if h % 2 else "news") for c in range(4) for h in range(12)] + [(9, True, True, 3, 10, "guide")]
    d = spark.createDataFrame(rows, "cluster int, is_internal boolean, is_weekend boolean, publish_hour int, word_count int, article_format string")
    for r in metrics.topic_indices(d, valued=["guide"]).collect():
        assert all(0 <= r[x] <= 1 for x in ("ownership", "exclusivity", "timeliness", "depth", "format_edge", "score"))
        if r.cluster > 1 and r.cluster < 9:
            assert r.score == 0


def test_reader_wins_fall_back_to_near_wins(spark):
    near = spark.createDataFrame([("a", 2, 1)], "topic string, our long, their long")
    assert [(r.topic, r.near_win) for r in advantages.reader_wins(near).collect()] == [("a", True)]
    both = near.unionByName(spark.createDataFrame([("b", 4, 0)], near.schema))
    assert [(r.topic, r.near_win) for r in advantages.reader_wins(both).collect()] == [("b", False)]


def test_editorial_wins(spark):
    d = spark.createDataFrame([(1, 5, 0), (2, 7, 3), (3, 6, 4), (4, 2, 9)], "cluster int, internal_count long, competitor_count long")
    assert [(r.cluster, r.is_exclusive) for r in advantages.editorial_wins(d).collect()] == [(1, True), (2, False)]


def test_followed_pairs_of_frequent_words(spark):
    """More titles than any cap on a word, all with the same two words."""
    d = spark.range(1100).select(F.lit("internal").alias("corpus"), F.format_string("%04d", "id").alias("article_id"), F.lit("that with").alias("title"))
    d = d.unionByName(spark.createDataFrame([("internal", "x1", "that alone"), ("competitor", "x2", "that with")], "corpus string, article_id string, title string"))
    r = advantages.followed_pairs(d)
    assert r.count() == r.select("a", "b").distinct().count() == 1100 * 1099 // 2
    assert advantages.followed_pairs(d.where("article_id >= '1098'"), least=1).count() == 3


def test_cards_of_all_detectors_are_registered(spark):
    import __spark_entry__ as entry

    sql = entry.oracle_sql()["adv_cards_all"]
    assert all(f"'{k}' AS advantage_key" in sql for k in ("explainer", "event", "franchise", "geography", "followthrough"))
    assert "adv_cards_all" in entry.queries()


def test_gaps_match_by_part(spark):
    d = spark.createDataFrame([("a1", "Short one"), ("a2", "A longer title of more than five words"), ("a3", "unrelated")], "article_id string, title string")
    gaps = spark.createDataFrame([(1, "short"), (2, "onger title of more than five wor"), (3, "the short one here"), (4, "none")], "gap_id int, evidence string")
    want = {(1, "a1"), (2, "a2"), (3, "a1")}
    assert {(r.gap_id, r.article_id) for r in evidence.by_part(gaps, d).collect()} == want


def test_evidence_by_class(spark):
    d = spark.createDataFrame([(f"a{i}", "Firm unveils a platform" if i < 7 else "Quiet day", "", "") for i in range(9)], "article_id string, title string, summary string, content string")
    gaps = spark.createDataFrame([(1, "zzz", [], "Rollout", "of it"), (2, "zzz", [], "Odd", "thing"), (3, "zzz", ["quiet"], "Rollout", "")], "gap_id int, evidence string, keywords array<string>, title string, description string")
    got = {(r.gap_id, r.article_id, r.match_method) for r in evidence.enrich(gaps, d).collect()}
    assert got == {(g, f"a{i}", "class") for g in (1, 2) for i in range(5)} | {(3, f"a{i}", "keyword") for i in (7, 8)}


def test_evidence_tiers(spark):
    d = corpus(spark).where("article_id is not null")
    gaps = spark.createDataFrame([(1, "apple LAUNCH ", []), (2, "Orange juice of today", []), (3, "nothing like it", ["fox"]), (4, "zzz", [])], "gap_id int, evidence string, keywords array<string>")
    got = {(r.gap_id, r.article_id, r.match_method) for r in evidence.enrich(gaps, d).collect()}
    assert got == {(1, "a1", "exact"), (2, "a2", "partial"), (3, "a4", "keyword")}


def test_vote_and_enrich(spark):
    c = spark.createDataFrame([("k", "a sportsbook operator"), ("k", "supplier of odds"), ("k", "operator"), ("z", "none")], "name string, context string")
    v = tagging.vote(c, "name", "context", {"operator": ["operator"], "supplier": ["supplier"]})
    assert {(r.name, r.label, r.votes) for r in v.collect()} == {("k", "operator", 2), ("z", "unknown", 0)}
    m = spark.createDataFrame([("k", "unknown"), ("z", None)], "name string, type string")
    assert {(r.name, r.type) for r in tagging.enriched(m, v).collect()} == {("k", "operator"), ("z", "unknown")}


def test_table_tags(spark):
    d = spark.createDataFrame([("a", "Responsible Gaming in Malta"), ("b", "none")], "article_id string, t string")
    terms = tagging.dimension(spark, {"RG": ["responsible gaming"], "EU": ["malta"]})
    assert {(r.article_id, r.label) for r in tagging.tag_by_table(d, "t", terms).collect()} == {("a", "RG"), ("a", "EU")}


def test_json_repair(spark):
    assert reports.repair_json('{"a": [1, 2, {"b": "x"}, {"c": "unfin') == {"a": [1, 2, {"b": "x"}, {}]}
    assert reports.repair_json('```json\n{"a": 1,}\n```') == {"a": 1}
    assert reports.repair_json("nothing") is None and reports.repair_json(None) is None
    d = spark.createDataFrame([('{"a":1}',), ('{"a":[1,2',), (None,), ("x",)], "j string")
    assert [r.repaired for r in reports.repaired(d, "j").collect()][:2] == ['{"a":1}', '{"a": [1]}']  # a number at the cut may be half of one


def test_mixed_case_words_are_tried_again(spark):
    d = spark.createDataFrame([("a1", "Brazil opens", "", "", "S", "l", "c", None), ("a2", "b razil", "", "", "S", "l", "c", None)], ARTICLE)
    one = d.where("article_id = 'a1'")
    get = lambda x, q: {r.article_id for r in search.search(x, q).collect()}
    assert get(one, "bRazil") == get(one, "brazil") == {"a1"}
    assert get(d, "bRazil") == {"a2"}  # some article has the normal form
    assert get(one, "opens bRazil") == {"a1"} and get(one, "DraftKings") == set()


def test_normal_forms_agree(spark):
    """On the driver and in columns, for words of all kinds."""
    from newsloom.functions import text

    words = ["DraftKings", "bRazil", "ABCd", "a1b2C3", "AB1C", "aBCd", "x1Y", "É-tude", "i Gaming", "e-Sports", "esport", "e cricket", "U.S.A.", "São Paulo", "AAaAAa", "3D", "iGaming", "İstanbul", "ſ", "  ", "a_b"]
    d = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r.i: r.n for r in d.select("i", text.normalize(F.col("w")).alias("n")).collect()}
    plain = {i: search.normalize(w) for i, w in enumerate(words) if w not in ("İstanbul", "ſ")}
    assert {i: got[i] for i in plain} == plain
    assert got[0] == "draft kings" and got[2] == "ab cd" and got[3] == "a 1 b 2 c 3" and got[8] == "igaming gaming"


def test_search_normalises_once(spark):
    plan = search.search(corpus(spark), "apple banana orange")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 4  # a rough filter and the exact one, over three fields folded together


def test_index_cache(spark):
    cache, d = search.IndexCache(most=1), corpus(spark)
    one = cache.get(d)
    assert cache.get(corpus(spark)) is one and search.fingerprint(d) == search.fingerprint(d.orderBy(F.rand(1)))
    assert search.fingerprint(d.limit(0)) == "empty" != search.fingerprint(d.limit(2)) != search.fingerprint(d)
    cache.get(d, "title"), cache.get(d.limit(2))
    assert len(cache.held) == 1
    one.unpersist()


def test_suggestions_options_and_cache(spark):
    w = spark.createDataFrame([(1, "Apple pie"), (2, "banana"), (3, "apple")], "place int, suggestion string")
    assert [r.place for r in search.suggestions(w, " APPLE").collect()] == [1, 3] and [r.place for r in search.suggestions(w, "", 2).collect()] == [1, 2]
    c = spark.createDataFrame([("k", dt.datetime(2024, 1, 1), 24, "old"), ("k", dt.datetime(2024, 1, 2), 24, "new"), ("z", dt.datetime(2024, 1, 2), 1, "z")], "key string, ts timestamp_ntz, ttl_hours int, value string")
    assert [r.value for r in reports.cache_get(c, "k", "2024-01-02 12:00:00").collect()] == ["new"] and reports.cache_get(c, "z", "2024-01-02 12:00:00").isEmpty()
    key = spark.range(1).select(reports.cache_key(F.lit("f"), F.lit(1)).alias("k"), reports.cache_key(F.lit("f"), F.lit(2)).alias("l")).first()
    assert len(key.k) == 32 and key.k != key.l


def test_reports(spark):
    d = spark.createDataFrame([(2, "b", dt.datetime(2024, 1, 5)), (1, "a", None)], "n int, t string, published timestamp_ntz")
    assert [r.json for r in reports.json_rows(d, ["n", "published"], 1, "published", [F.col("n").desc()]).collect()] == ['{"n":2,"published":"2024-01-05"}']
    lines = [r.line for r in reports.markdown("Report", {"One": d, "Two": d.limit(0)}, {"One": ["t", "n"], "Two": ["t"]}).collect()]
    assert lines == ["# Report", "## One", "- a: 1", "- b: 2", "## Two"]
    links = spark.range(1).select(reports.evidence_html(F.array(F.struct(F.lit("T").alias("title"), F.lit("l").alias("link")), F.struct(F.lit("U").alias("title"), F.lit("m").alias("link")))).alias("h")).first().h
    assert links == '<a href="l">T</a> · <a href="m">U</a>'
    b = reports.content_brief(spark.createDataFrame([(1, "L", 3, 0, 0.512)], "cluster int, label string, internal_count long, competitor_count long, score double")).first().brief
    assert (b.headline, b.risk, b.score) == ("Brief: L", "low", 0.51)


def test_upsert_does_not_depend_on_order(spark):
    h = articles.canonical(corpus(spark)).where("article_id is not null")
    twins = h.where("article_id = 'a1'").withColumn("link", F.lit("other")).unionByName(h.where("article_id = 'a1'").withColumn("link", F.lit("again")))
    rows = lambda d: sorted(map(str, articles.upsert(h, d, "2024-04-01 00:00").collect()))
    assert rows(twins) == rows(twins.orderBy("link")) == rows(twins.orderBy(F.col("link").desc()))


def test_history_is_replaced_whole(spark, tmp_path):
    from newsloom.sources import files

    at, d = str(tmp_path / "h"), articles.canonical(corpus(spark))
    files.write_history(d, at)
    files.write_history(files.history_csv(spark, at, drop_undated=False).limit(2).drop("published"), at)  # reads what it replaces
    assert files.history_csv(spark, at, drop_undated=False).count() == 2 and {p.name for p in tmp_path.iterdir() if p.suffix != ".crc"} == {"h"}
    files.write_snapshot(d, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == d.count()


def test_tables_and_retention(spark, tmp_path):
    from newsloom.sources import files

    d = spark.createDataFrame([(1, ["a", "b"])], "n int, xs array<string>")
    paths = files.write_tables({"wins": d, "none": d.limit(0)}, str(tmp_path), "20240331_010203")
    assert set(paths) == {"wins"} and spark.read.option("header", True).csv(paths["wins"]).first().xs == "a | b"
    assert files.remove_dated(spark, str(tmp_path)) == ["wins_20240331_010203.csv"] and files.remove_dated(spark, str(tmp_path / "no")) == []
    assert (tmp_path / "wins_latest.csv").exists()


def test_sources_and_settings(spark, tmp_path):
    from newsloom.sources import files

    (tmp_path / "r.json").write_text('{"direct_rss": {"sources": [{"name": "A", "url": "https://a.com/f", "category": "internal"}]}, "google_news_proxy": {"sources": [{"name": "B", "domain": "b.com", "category": "competitor", "is_affiliate": true}]}}')
    assert {(r.name, r.mode, r.is_affiliate) for r in files.registry(spark, str(tmp_path / "r.json")).collect()} == {("A", "rss", False), ("B", "proxy", True)}
    (tmp_path / "m.md").write_text("# T\nx")
    assert files.markdown_text(spark, str(tmp_path / "m.md")).first().value == "# T\nx"
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.documents_json(spark, str(tmp_path / "d.json"), "a long").count() == 2
    (tmp_path / "s.json").write_text('{"thresholds": {"min_our": 5}, "portfolio_brands": ["ACME"], "momentum": {"window_days": 3}}')
    t = files.thresholds(files.load_settings(str(tmp_path / "s.json")))
    assert (t.min_total, t.min_our, t.momentum_days, t.brands) == (3, 5, 3, ("acme",)) and files.load_settings("none") == {}


def test_tidy_and_places(spark):
    from newsloom.functions import text, urls

    d = spark.createDataFrame([("a", "T", "S", "l", "2024-01-02"), ("b", "T", "S", "m", "2024-01-01"), ("c", None, "S", None, "2024-01-01"), ("d", "U", "S", "l", "?")], "article_id string, title string, source string, link string, published_date string")
    assert [r.article_id for r in articles.tidy(d).collect()] == ["b"]
    p = spark.createDataFrame([("www.google.com",), ("maps.google.com",), ("google.com.evil.org",)], "h string").select(urls.platform(F.col("h")).alias("p"))
    assert [r.p for r in p.collect()] == [True, True, False]
    r = spark.createDataFrame([("a tribal casino",), ("Tribal",), ("tribalism in brazil",), (None,)], "t string").select(text.regions(F.col("t"), {"North America": ["tribal casino"], "LatAm": ["brazil"]}).alias("r"))
    assert [x.r for x in r.collect()] == [["North America"], ["North America"], ["LatAm"], []]


def test_region_edges(spark):
    n = spark.createDataFrame([("place:x", 3.0, 1.0), ("place:y", 1.0, 1.0), ("place:z", 2.0, 0.0), ("weekend", 9.0, 1.0)], "note string, internal double, competitor double")
    assert [(r.note, r.ratio) for r in topics.region_edges(n).collect()] == [("place:x", 3.0)]


def test_clusters_release_what_they_cache(spark):
    d = spark.createDataFrame([(i, f"apple banana {'cherry' if i % 2 else 'plum'} tree number {i % 5}") for i in range(40)], "doc_id int, content string")
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    got, names = topics.cluster(d, "content", key="doc_id", k=2)
    assert got.select("doc_id").distinct().count() == 40 and names.count() == 2
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_empty_window(spark):
    from newsloom.sources import files

    d = spark.createDataFrame([("a", 1)], "article_id string, n int")
    assert files.empty_window(d, 7, "2024-01-01").collect() == []
    assert '"empty_window":true' in files.empty_window(d.limit(0), 7, "2024-01-01").first().json


def test_speakers_and_numbers(spark):
    d = spark.createDataFrame([("# T\n- no: one\n### Potential Speakers\n- **Ann B**: law\n- **Bo**: tax\n## Next\n- x: y",)], "value string")
    assert [(r.name, r.expertise) for r in reports.speakers(d).orderBy("place").collect()] == [("Ann B", "law"), ("Bo", "tax")]
    many = spark.createDataFrame([("b1", "## Potential Speakers\n* Cy\n"), ("b2", None), ("b3", "- x: y\n# Potential Speakers\n# Potential Speakers\n- D: e: f"), ("b4", "")], "briefing string, value string")
    assert sorted(tuple(r) for r in reports.speakers(many, by="briefing").collect()) == [("b1", 1, "Cy", ""), ("b3", 3, "D", "e: f")]
    a, b = reports.weekend_numbers(F.lit("We 12.5% vs them 3%"))
    assert tuple(spark.range(1).select(a, b).first()) == (12.5, 3.0)


def test_insights(spark):
    g = spark.createDataFrame([("A", 5.0, 1.0), ("B", 9.0, 1.0)], "entity string, competitor_pct double, internal_pct double")
    assert reports.insight("gap", g).first().text.startswith("B ")
    c = spark.createDataFrame([("x", 3), ("y", 5), ("z", 1), ("w", 2)], "name string, n long")
    assert reports.insight("companies", c).first().text == "Most mentioned: y, x, w."


def test_knee():
    assert topics.best_k([(8, 100.0), (12, 60.0), (16, 50.0), (20, 45.0)]) == 12


def test_feed(spark, tmp_path):
    from newsloom.sources import feeds

    f = tmp_path / "f.xml"
    f.write_text("<rss><channel><item><title>One</title><link>https://E.com/a?utm_source=x</link><pubDate>Tue, 02 Jan 2024 10:30:00 +0000</pubDate><description>&lt;p&gt;Hi&lt;/p&gt;</description></item><item><title>No link</title></item><item><title>Bad</title><link>https://bad.com/z</link></item></channel></rss>")
    reg = spark.createDataFrame([("Feed", str(f), "internal", False, "rss"), ("Gone", str(tmp_path / "none.xml"), "competitor", True, "rss")], "name string, url string, category string, is_affiliate boolean, mode string")
    r = feeds.read(spark, reg, blocked_domains=["bad.com"]).collect()
    assert [(x.title, x.link, x.summary, x.published_date) for x in r] == [("One", "https://e.com/a", "Hi", "2024-01-02 10:30")]


def test_history_round_trip(spark, tmp_path):
    from newsloom.sources import files

    d = articles.canonical(corpus(spark))
    files.write_history(d, str(tmp_path / "h"))
    back = files.history_csv(spark, str(tmp_path / "h"))
    assert back.count() == 3 and back.where("published is null").isEmpty()
    assert files.run_info(back, "2024-03-04 05:06:07").first().run_id == "20240304050607"


def test_stream_upsert_is_idempotent(spark, tmp_path):
    from newsloom.streaming import events

    src = str(tmp_path / "src")
    articles.canonical(corpus(spark)).where("article_id is not null").write.parquet(src)
    put = events.history_sink(str(tmp_path / "hist"), "2024-04-01 00:00")
    for n in (0, 1):
        put(spark.read.parquet(src), n)
    assert events.latest(spark, str(tmp_path / "hist")).count() == 4


def test_window_edges(spark):
    from newsloom.functions import dates

    d = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 31),), (dt.datetime(2024, 2, 5),)], "t timestamp_ntz")
    assert d.where(dates.closed(F.col("t"), "2024-01-31 00:00:00", 30)).count() == 2
    assert d.where(dates.half_open(F.col("t"), "2024-01-31 00:00:00", 30)).count() == 3
