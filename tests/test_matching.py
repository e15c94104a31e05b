"""Substring tagging by automaton and containment by postings, against plain `in`."""

import random

import numpy as np
import pyarrow as pa
import pytest

from newsloom.operators import automaton, evidence


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_automaton_equals_in(monkeypatch, chunk):
    monkeypatch.setattr(automaton, "CHUNK", chunk)
    draw = random.Random(chunk)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randint(1, 5))) for _ in range(40)} | {"aaaa", "aa", "日本"})
    texts = [None, "", "a", "日本語"] + ["".join(draw.choice("abcé日本") for _ in range(draw.randint(0, 60))) for _ in range(120)]
    codes = [i % 7 for i in range(len(words))]
    a = automaton.Automaton([w.encode() for w in words], codes)
    got = set(zip(*(x.tolist() for x in a.find(*automaton.texts(pa.array(texts)))), strict=True))
    assert got == {(i, c) for i, t in enumerate(texts) for w, c in zip(words, codes, strict=True) if w in (t or "")}
    sliced = pa.array(texts).slice(50, 20)
    got = set(zip(*(x.tolist() for x in a.find(*automaton.texts(sliced))), strict=True))
    assert got == {(i, c) for i, t in enumerate(sliced.to_pylist()) for w, c in zip(words, codes, strict=True) if w in t}


def test_fifty_thousand_keywords_in_one_pass(spark):
    draw = random.Random(9)
    words = list({"".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(4, 9))) for _ in range(50_500)})[:50_000]
    texts = [" ".join(draw.choice(words) if draw.random() < 0.3 else "".join(draw.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(40)) for _ in range(60)]
    d = spark.createDataFrame([(i, t.upper()) for i, t in enumerate(texts)], "article_id long, t string").repartition(3)
    terms = spark.createDataFrame([(w, f"label{i % 1000}") for i, w in enumerate(words)], "keyword string, label string")
    label = {w: f"label{i % 1000}" for i, w in enumerate(words)}
    want = {(i, label[w]) for i, t in enumerate(texts) for w in words if w in t}
    for most in (automaton.MOST_BYTES, 150_000):  # one automaton, and three
        assert {tuple(r) for r in automaton.tag(d, d.t, terms, most_bytes=most).collect()} == want


def test_odd_dictionaries_and_tables(spark):
    d = spark.createDataFrame([(1, "The Cat"), (1, "the dog"), (2, None), (None, "cat")], "article_id long, t string")
    terms = spark.createDataFrame([("CAT", "animal"), ("dog", "animal"), ("the", "word"), ("", "none"), (None, "none"), ("cat", None)], "keyword string, label string")
    assert {tuple(r) for r in automaton.tag(d, d.t, terms).collect()} == {(1, "animal"), (1, "word"), (None, "animal")}
    assert automaton.tag(d, d.t, terms).count() == 3
    assert automaton.tag(d, d.t, terms.limit(0)).count() == automaton.tag(d.limit(0), d.t, terms).count() == 0


def test_contained_equals_in(spark):
    draw = random.Random(2)
    hay = list({"".join(draw.choice("abc é") for _ in range(draw.randint(1, 30))) for _ in range(150)})
    needles = list({h[i : i + draw.randint(1, 8)] for h in hay for i in (draw.randint(0, len(h)),)} - {""} | {"zz", "a", "ab", "😀"})
    n, h = (spark.createDataFrame([(x,) for x in xs], "s string") for xs in (needles, hay))
    assert {tuple(r) for r in evidence.contained(n, h).collect()} == {(x, y) for x in needles for y in hay if x in y}
    plan = evidence.contained(n, h)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parts_of_titles_at_any_number_of_gaps(spark):
    draw = random.Random(4)
    titles = [(f"a{i:03d}", " ".join(draw.choice(["news", "of", "the", "day", "x"]) for _ in range(draw.randint(1, 6))).title()) for i in range(80)] + [("b", None), ("c", "  ")]
    gaps = [(i, " ".join(draw.choice(["news", "of", "the", "day", "x"]) for _ in range(draw.randint(1, 9)))) for i in range(60)] + [(100, None), (101, " ")]
    d, g = spark.createDataFrame(titles, "article_id string, title string"), spark.createDataFrame(gaps, "gap_id int, evidence string")
    low = lambda x: (x or "").strip().lower()
    want = {(i, min(a for a, t in titles if low(t) and (low(e) in low(t) or low(t) in low(e)))) for i, e in gaps if low(e) and any(low(t) and (low(e) in low(t) or low(t) in low(e)) for _, t in titles)}
    got = evidence.by_part(g, d)
    assert {(r.gap_id, r.article_id) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert evidence.by_part(g.limit(0), d).count() == evidence.by_part(g, d.limit(0)).count() == 0


def test_states_are_bounded_by_the_bytes_of_the_keywords():
    words = [f"{i:07d}".encode() for i in range(20_000)]
    a = automaton.Automaton(words, list(range(20_000)))
    held = sum(x.nbytes for x in (a.fail, a.ends, a.size, a.first, a.codes, a.root, a.key, a.to))
    assert held <= 60 * sum(map(len, words)) + 10_000 and isinstance(a.key, np.ndarray)
