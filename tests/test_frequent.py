"""The most frequent n-grams against a plain count."""

import random
from collections import Counter

from pyspark.sql import functions as F

from newsloom.operators import frequent


def plain(rows, n_max, features):
    import re

    counts = {"internal": Counter(), "competitor": Counter(), "x": Counter()}
    for corpus, t in rows:
        w = re.findall(r"\b[a-z][a-z0-9]+\b", (t or "").lower(), re.ASCII)
        counts[corpus].update(" ".join(w[i : i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1))
    names = set().union(*counts.values())
    all_ = [(g, counts["internal"][g], counts["competitor"][g]) for g in names]
    return sorted(all_, key=lambda r: (-r[1] - r[2], r[0]))[:features]


def test_equals_plain_counts(spark):
    r = random.Random(7)
    vocabulary = [f"w{chr(97 + i % 26)}{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(r.choice(["internal", "competitor"]), " ".join(r.choices(vocabulary, weights, k=r.randint(0, 60)))) for _ in range(120)]
    rows += [("internal", None), ("competitor", ""), ("x", "wa0 wb1 only here"), ("internal", "Tie tie TIE a b2c"), ("internal", "une <b>été</b>")]
    d = spark.createDataFrame(rows, "corpus string, t string")
    for n_max, features, cells in ((3, 40, 1 << 20), (3, 40, 3), (2, 25, 64), (1, 10, 8), (3, 60, 1), (2, 100_000, 64)):
        got = [tuple(x) for x in frequent.top_ngrams(d, "t", n_max, features, cells=cells).orderBy((F.col("internal") + F.col("competitor")).desc(), "ngram").collect()]
        assert got == plain(rows, n_max, features), (n_max, features, cells)


def test_second_pass_counts_few_runs(spark):
    """Of very many runs that come once, hardly any reaches the second shuffle."""
    rows = [("internal", f"the cat sat x{i} y{i} z{i} the cat sat") for i in range(400)]
    d = spark.createDataFrame(rows, "corpus string, t string")
    w = d.select("corpus", frequent.words(F.col("t")).alias("w"))
    cells = w.select(F.explode(frequent._longer(F.col("w"), 3)).alias("g")).groupBy(F.pmod(F.xxhash64("g"), F.lit(1 << 20)).alias("c")).count()
    assert cells.count() > 3500 and cells.where("count >= 400").count() <= 10
    got = {r.ngram: r.internal for r in frequent.top_ngrams(d, "t", 3, 3).collect()}
    assert got == {"cat": 800, "cat sat": 800, "sat": 800}


def test_empty_and_prepared(spark):
    d = spark.createDataFrame([], "corpus string, t string")
    assert frequent.top_ngrams(d, "t", 3, 5).collect() == []
    one = spark.createDataFrame([("internal", "<p>DraftKings in <b>São</b> Paulo</p>"), ("internal", None), ("x", "Straße a_b été")], "corpus string, t string")
    assert [r.p for r in one.select(frequent.prepared(F.col("t")).alias("p")).collect()] == ["draft kings in sao paulo", "", "ete"]
