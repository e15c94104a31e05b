"""The stored index against the search that scans texts."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import search as scan
from newsloom.operators import stored_index as stored

ARTICLE = "article_id string, title string, summary string, content string, source string, link string, category string, published_date string"
QUERIES = [
    "apple pie", "OR apple banana", '"le pi"', '"pple pie tart"', '"pp"', '"!!" apple', "", "xyzzytest", "ppl", "ai", "bRazil", "a-b", "iGaming", '"i gaming"', "ﬁnance", "paulo OR the tart", 'apple OR "e t" banana', "or or", "U.S.",
]


def made(spark, rows):
    return spark.createDataFrame([(i, t, s, c, src, f"l{i}", "internal", None) for i, t, s, c, src in rows], ARTICLE)


def random_rows(seed, ids):
    r = random.Random(seed)
    words = "apple pie tart the banana ai brazil b razil São-Paulo esports iGaming ﬁnance i gaming rapple piece AB c U.S. pineapple".split(" ")
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randint(0, n)))
    return [(i, text(3), r.choice([None, "", text(4)]), r.choice([None, text(6)]), r.choice(["S1", "S2"])) for i in ids]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/index"


def same(index, corpus, queries=QUERIES):
    shown = [*stored.SHOWN, "has_content"]
    for q in queries:
        want = sorted(map(str, scan.search(corpus, q).select(*shown).collect()))
        assert sorted(map(str, stored.search(index, q).select(*shown).collect())) == want, q


def test_equals_a_scan(spark, folder):
    corpus = made(spark, [*random_rows(1, [f"a{i}" for i in range(30)]), (None, "apple", "", "", "S1"), ("", "apple", "", "", "S1")])
    index = stored.add(corpus, folder, buckets=4)
    same(index, corpus)
    for q in ("pple", "bRazil", '"le pi" OR the'):
        assert {r.article_id for r in stored.search(index, q, substring=True).collect()} == {r.article_id for r in scan.search(corpus, q, substring=True).collect()}
    assert {r.article_id for r in stored.search(index, "apple", sources=["S2"], categories=["internal"]).collect()} == {r.article_id for r in scan.search(corpus, "apple", sources=["S2"]).collect()}
    words = ["apple", "apple pie", "zzzz", "pple", "", "or"]
    assert stored.keyword_counts(index, words).collect() == scan.keyword_counts(corpus, words).collect()
    assert stored.keyword_counts(index, [""]).collect() == []


def test_segments_replace_and_merge(spark, folder):
    first, second, third = random_rows(2, [f"a{i}" for i in range(12)]), random_rows(3, [f"a{i}" for i in range(8, 16)]), random_rows(4, ["a0", "a9", "a20"])
    one = stored.add(made(spark, first), folder, buckets=4)
    stored.add(made(spark, second), folder)
    three = stored.add(made(spark, third), folder, buckets=99)
    now = made(spark, list({r[0]: r for r in [*first, *second, *third]}.values()))
    some = [*QUERIES[:5], "bRazil", "razil"]
    assert three.segments == (1, 2, 3) and three.buckets == 4
    same(three, now, some)
    same(one, made(spark, first), some[:4])  # who opened the first version still sees it
    part = stored.merge(spark, folder, newest=2)
    assert part.segments == (1, 4)
    same(part, now, some[:3])
    whole = stored.merge(spark, folder)
    assert whole.segments == (5,) and stored.merge(spark, folder).segments == (5,)
    same(whole, now, some[1:4])
    df = {r.token: r.df for r in whole.tokens().collect()}
    assert df == {r.token: r.n for r in scan.postings(scan.indexed(now)).groupBy("token").agg(F.count("*").alias("n")).collect()}
    assert stored.opened(spark, folder).segments == (5,)
    assert stored.vacuum(spark, folder) == 4  # segments 1 to 4
    same(stored.opened(spark, folder), now, some[:2])


def test_reads_postings_only_and_few_buckets(spark, folder):
    index = stored.add(made(spark, random_rows(5, [f"a{i}" for i in range(20)])), folder, buckets=16)
    plan = stored._hits(index, [("token", ("apple",))])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(bucket#" in plan.split("PartitionFilters")[1] and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]
    files = stored.search(index, "apple pie").inputFiles()
    assert files and all("/docs/" in f or "/postings/" in f or "/gone/" in f for f in files)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_repeated_and_unfinished(spark, folder):
    assert stored.opened(spark, folder) is None and stored.merge(spark, folder) is None
    empty = stored.add(made(spark, []), folder, buckets=2)
    assert stored.search(empty, "apple").count() == 0 and stored.search(empty, '"!!"').count() == 0
    rows = [("a1", "apple pie", None, None, "S1"), ("a1", "apple pie", None, None, "S1"), ("a2", "apple", None, "x", "S1"), ("a2", "tart", None, "x", "S1"), ("a3", None, None, None, None)]
    index = stored.add(made(spark, rows), folder)
    assert index.docs().count() == 3 and [r.article_id for r in stored.search(index, '"apple pie"').collect()] == ["a1"]
    kept = {r.title for r in index.docs().where("article_id = 'a2'").collect()}
    assert len(kept) == 1 and (stored.search(index, "tart").count() == 1) == (kept == {"tart"})
    # a writer that stopped before its manifest changes nothing, and the next one writes over what it left
    stored._write(spark, folder, 3, index.postings(), index.docs().drop("segment"), index.docs().select("article_id"))
    assert stored.opened(spark, folder).segments == (1, 2)
    assert stored.add(made(spark, [("a9", "banana", "", "", "S1")]), folder).segments == (1, 2, 3)
    assert [r.article_id for r in stored.search(stored.opened(spark, folder), "banana").collect()] == ["a9"]


def test_replaced_articles_by_a_filter(spark, tmp_path, monkeypatch):
    """Only rows that the filter flags are dealt out; one word of bits flags too many, and the rows are the same."""
    rows = [(f"a{i}", f"title {i}", "alpha beta" if i % 2 else "gamma delta") for i in range(60)]
    make = lambda r: spark.createDataFrame(r, "article_id string, title string, content string").withColumns({"summary": F.lit(None).cast("string"), "source": F.lit("s")})
    for words in (1 << 20, 1):
        monkeypatch.setattr(stored, "FILTER_WORDS", words)
        folder = f"{tmp_path}/{words}"
        stored.add(make(rows), folder)
        index = stored.add(make([(a, t, "omega") for a, t, _ in rows[:20]] + [("b", "new", "omega")]), folder)
        assert {r.article_id for r in stored.search(index, "alpha").collect()} == {f"a{i}" for i in range(21, 60, 2)}
        assert stored.search(index, "omega").count() == 21 and index.docs().count() == 61
        rest, asked = index._flagged(index.postings(), index.segments)
        flagged = {r.article_id for r in asked.collect()}
        assert flagged >= {f"a{i}" for i in range(20)} and (words == 1 or len(flagged) < 40) and rest.where("segment = 2").count() == index.postings().where("segment = 2").count()
        merged = stored.merge(spark, folder)
        assert {r.token: r.df for r in merged.tokens().collect()}["alpha"] == 20


def test_only_repeated_articles_and_no_posting_are_shuffled(spark, folder, monkeypatch):
    """Whole rows are dealt out for articles of several rows only, a repeated row counts once, and segments are written as they are read."""
    rows = [*random_rows(6, [f"a{i}" for i in range(30)]), ("r1", "apple pie", None, "x", "S1"), ("r1", "apple pie", None, "x", "S1"), ("r2", "apple", None, "x", "S1"), ("r2", "tart", None, "x", "S1")]
    d = made(spark, rows)
    plan = stored._single(made(spark, rows[:30]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    for few in (100_000, 0):
        monkeypatch.setattr(stored, "FEW", few)
        one = {r.article_id: r for r in stored._single(d).collect()}
        assert len(one) == 32 == stored._single(d).count() and one["r2"].title in ("apple", "tart") and set(stored._single(d).columns) == set(d.columns)
    kept = made(spark, [(i, r.title, r.summary, r.content, r.source) for i, r in one.items()])
    monkeypatch.setattr(stored, "CHUNK", 40)
    index = stored.add(d, folder, buckets=4)
    assert {r.token: r.df for r in index.tokens().collect()} == {r.token: r.n for r in scan.postings(scan.indexed(kept)).groupBy("token").agg(F.count("*").alias("n")).collect()}
    want = {(t, i, tuple(at)) for i, s in scan.indexed(kept).select("article_id", "search_text").collect() for t in set(s.split()) for at in [[k for k, w in enumerate(s.split()) if w == t]]}
    assert {(r.token, r.article_id, tuple(r.positions)) for r in index.postings().collect()} == want
    written = []
    monkeypatch.setattr(stored, "_write", lambda spark, folder, number, postings, docs, gone: written.append(postings))
    monkeypatch.setattr(stored, "_commit", lambda *a: None)
    stored.add(made(spark, rows[:30]), folder)
    assert "Exchange" not in written[0]._jdf.queryExecution().executedPlan().toString()
