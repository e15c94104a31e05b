"""Queries against their SQL over small tables of odd texts, and what larger tables need: no unbounded broadcast, cheap character classes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.functions import text
from newsloom.operators import evidence

from .test_queries import shown


@pytest.fixture
def matches(spark, tmp_path):
    def check(name, texts, benchmark=()):
        """texts: of documents with numbers in the window (doc_id % 90 = 60 and on), sources by turns."""
        docs = [(60 + 90 * i, t, "en", f"src{i % 5}", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert want
        assert shown(df.select(*columns).collect()) == shown(want)

    return check


def test_keywords_begin_after_an_accent(matches):
    matches("evidence_keyword", ["la queletion oui", "la meletiones"], ["Ici èqueletion là", "meletionesé", "xmeletiones", "Ämeletiones!"])


def test_phrase_in_regions_as_written(matches):
    matches("search_in_regions", ["onth THE", "onth the end", "ouer tHe", "ouer breathe", "the", "onst the", "onst a"])


@pytest.mark.parametrize("name", ["topic_candidates", "topic_scorecard"])
def test_topics_beside_addresses(matches, name):
    matches(name, ["alpha beta see http://host.org/path gamma", "ask a.b@example.com now alpha beta", "@handle alpha beta #tag gamma"] * 6)


def test_topic_share_at_a_half(matches):
    """23 of 40 are ours."""
    texts = iter(["anque"] * 40)
    turns = [0, 1, 2] * 5 + [3, 4] * 4 + [0]  # sources by turns: of five three are ours
    matches("topic_candidates", [next(texts) if i % 5 < 3 and sum(1 for j in range(i) if j % 5 < 3) < 23 or i % 5 >= 3 and sum(1 for j in range(i) if j % 5 >= 3) < 17 else "nothing else" for i in range(len(turns) * 2)])


def test_marks_are_those_of_unicode(spark):
    import sys
    import unicodedata

    every = [(i, chr(i)) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    d = spark.createDataFrame(every, "i int, c string")
    gone = {r.i for r in d.where(F.regexp_replace("c", text.MARKS, "") == "").collect()}
    assert gone == {i for i, c in every if unicodedata.category(c) == "Mn"}


def test_ranges_of_marks_are_asked_last():
    """Of the ranges beyond the first block none is asked for a letter of Latin texts."""
    assert text.MARKS.startswith(r"[\x{300}-\x{36f}[\x{370}-\x{10ffff}&&[")


def _strings(seed, n):
    draw = random.Random(seed)
    return sorted({"".join(draw.choice("abcé ") for _ in range(draw.randint(1, 9))) for _ in range(n)})


@pytest.mark.parametrize("few", [0, 700, 1 << 20])
def test_contained_by_what_is_few(spark, monkeypatch, few):
    monkeypatch.setattr(evidence, "FEW_BYTES", few)
    small, large = _strings(1, 60), _strings(2, 400)
    for needles, hay in ((small, large), (large, small)):
        got = evidence.contained(*(spark.createDataFrame([(s,) for s in x], "s string") for x in (needles, hay)))
        assert {tuple(r) for r in got.collect()} == {(a, b) for a in needles for b in hay if a in b}
        if not few:  # neither runs nor strings go to all tasks, whatever Spark thinks of their size
            assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
