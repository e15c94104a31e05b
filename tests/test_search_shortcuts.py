"""What spares texts the search form: borders in two passes, cheap conditions that miss no match, sure ones that find no other."""

import random
import re

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import search

WORDS = "tion Tion ation tional TION tionA aTion Ation 9tion tion9 _tion tion_ tión étion tion-x x.tion iGaming i gaming e sport e sports esport sporting tioń ﬁsh ＡＢc İstanbul Kelvin a1B2 ABCd 12ab in the inthe".split()


def texts(n=400):
    r = random.Random(11)
    return ["", "tion", " tion ", "in\nthe", *["".join(r.choice(WORDS) + r.choice([" ", " ", "", "-", "\n"]) for _ in range(r.randint(1, 4))) for _ in range(n)]]


def test_borders_in_two_passes(spark):
    r = random.Random(5)
    rows = texts() + ["".join(r.choice("abAB09é _") for _ in range(r.randint(0, 9))) for _ in range(2000)]
    d = spark.createDataFrame([(t,) for t in rows], "t string")
    got = d.select("t", F.regexp_replace(F.regexp_replace("t", text.BORDER_BEFORE, " $0"), text.BORDER_AFTER, "$0 ").alias("g")).collect()
    assert all(x.g == re.sub(text.BORDERS, r"\1 ", x.t) for x in got)


def test_shortcuts_agree_with_the_search_form(spark):
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts())], "article_id string, title string").withColumns({"summary": F.lit(None).cast("string"), "content": F.lit(None).cast("string")})
    d = d.withColumn("s", search.search_text()).cache()
    for query in ("tion", "ation", "tion sport", "ion or the", '"in the"', '"n th" or esports', "the", '"e sp"', "esport OR gaming", "iGaming", "ab", "nowhere"):
        steps = search.parse(query)
        for substring in (False, True):
            by = search.rules(d, steps, substring)
            exact = search.predicate(steps, by, F.col("s"), substring)
            want = {x.article_id for x in d.where(exact).collect()}
            assert {x.article_id for x in d.where(search._matches(steps, by, substring)).collect()} == want, query
            assert {x.article_id for x in d.where(search._surely(steps, by, search._whole(()), substring)).collect()} <= want, query
    tokens = set(search.words_of(search.parse("tion ation sporting nowhere")))
    assert search.known_words(d, sorted(tokens)) == {w for w in tokens if d.where(F.array_contains(F.split("s", " "), w)).count()}


def test_sure_matches_need_no_search_form(spark):
    """Texts that hold the words as they are asked for are not normalised."""
    d = spark.createDataFrame([("a", "the tion in the house")], "article_id string, title string")
    sure = search._surely(search.parse('or tion that "in the"'), search.Rules({"that"}, set()), F.col("title"), False)
    assert d.select(sure.alias("x")).first().x is False and d.select(search._surely(search.parse('tion "in the"'), search.Rules({"tion"}, set()), F.col("title"), False).alias("x")).first().x
