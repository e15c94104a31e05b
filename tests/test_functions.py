"""Scalars: exact values."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, lexicons, text, urls


def value(spark, expr, **row):
    names = list(row) or ["x"]
    return spark.createDataFrame([tuple(row.values()) or (1,)], ", ".join(f"{n} string" for n in names)).select(expr.alias("v")).first().v


@pytest.mark.parametrize("given, want", [("HELLO WORLD", "hello world"), ("MiXeD CaSe", "mi xe d ca se"), ("São Paulo", "sao paulo"), (None, ""), ("bet365", "bet 365"), ("DraftKings", "draft kings"), ("i gaming", "igaming gaming"), ("e-sport now", "esports now"), ("  a \n b ", "a b")])
def test_normalize(spark, given, want):
    assert value(spark, text.normalize(F.col("x")), x=given) == want


@pytest.mark.parametrize("given, want", [("https://WWW.Example.com:8080/a", "example.com"), ("http://m.site.org/?x=1", "m.site.org"), ("no address", ""), (None, "")])
def test_domain(spark, given, want):
    assert value(spark, urls.domain(F.col("x")), x=given) == want


@pytest.mark.parametrize("given, want", [("HTTPS://Example.com/A/?utm_source=x&b=2&a=1#top", "https://example.com/A?a=1&b=2"), ("https://example.com/", "https://example.com/"), ("https://example.com/p?reference=1", "https://example.com/p"), ("https://example.com/p/", "https://example.com/p")])
def test_normalize_url(spark, given, want):
    assert value(spark, urls.normalize(F.col("x")), x=given) == want


def test_strip_tracking_keeps_order_and_lookalikes(spark):
    assert value(spark, urls.strip_tracking(F.col("x")), x="https://e.com/p?b=2&fbclid=z&reference=1&a=1#f") == "https://e.com/p?b=2&reference=1&a=1"


@pytest.mark.parametrize("link, want", [("https://bad.com/x", True), ("https://sub.bad.com/x", True), ("https://notbad.com", False), ("https://bad.com.evil.org", False)])
def test_blocked(spark, link, want):
    assert value(spark, urls.blocked(F.lit("fine"), F.col("x"), ["nope"], ["bad.com"]), x=link) is want


def test_redirect_target(spark):
    assert value(spark, urls.redirect_target(F.col("x")), x="https://r.com/?q=https%3A%2F%2Fa.b%2Fc") == "https://a.b/c"
    assert value(spark, urls.redirect_target(F.col("x")), x="https://r.com/plain") == "https://r.com/plain"


@pytest.mark.parametrize("given, want", [("Tue, 02 Jan 2024 10:30:00 +0200", "2024-01-02 08:30"), ("2024-01-02T10:30:00Z", "2024-01-02 10:30"), ("2024-01-02", "2024-01-02 00:00"), ("junk", ""), ("", "")])
def test_dates(spark, given, want):
    assert value(spark, dates.standardize(F.col("x")), x=given) == want


def test_article_id_is_stable(spark):
    a = value(spark, urls.article_id(F.col("x"), F.lit("https://e.com/a")), x=" The  Feed ")
    assert len(a) == 16 and a == value(spark, urls.article_id(F.col("x"), F.lit("https://e.com/a")), x="the feed")


def test_html(spark):
    assert value(spark, text.strip_html(F.col("x"), 20), x="<p>a &amp; b</p><script>x()</script> c") == "a & b c"


def test_formats_prefer_the_first_of_equals(spark):
    assert value(spark, text.best_format(F.col("x"), lexicons.FORMATS), x="Interview and guide") == "interview"
    assert value(spark, text.best_format(F.col("x"), lexicons.FORMATS), x="nothing") == "news"


def test_labels_are_substrings_and_sorted(spark):
    assert value(spark, text.labels(F.lower("x"), {"B": ["ai"], "A": ["ice"], "C": ["zz"]}), x="He said service") == ["A", "B"]


def test_topics_lexicon_sizes():
    assert [len(lexicons.rows(x)) for x in (lexicons.COMPANIES, lexicons.TOPICS)] == [64, 84]
    assert len({k for k, _ in lexicons.rows(lexicons.REGIONS)}) == 187


def test_gap_class_precedence(spark):
    for t, want in (("CEO appointed for merger", "executive"), ("Merger license", "partnership"), ("License for market", "regulation"), ("Market launch", "market"), ("Launch", "product"), ("zzz", "general")):
        assert value(spark, text.first_class(F.col("x"), lexicons.GAP_CLASSES), x=t) == want


def test_ngrams_and_counts(spark):
    assert value(spark, text.ngrams(F.split("x", " "), 2), x="a b c") == ["a b", "b c"]
    assert value(spark, text.ngrams(F.split("x", " "), 2), x="a") == []
    assert value(spark, text.occurrences(F.col("x"), "aa"), x="aaaa") == 2
    assert value(spark, text.count_words(F.col("x")), x=" a  b ") == 2


def test_truncate_title(spark):
    assert value(spark, text.truncate_title(F.col("x"), 10), x="short") == "short"
    assert value(spark, text.truncate_title(F.col("x"), 10), x="abcdefg hijklm") == "abcdefg…"
    assert value(spark, text.truncate_title(F.col("x"), 10), x="ab cdefghijklmnop") == "ab cdefghi…"


def test_log_odds_sign(spark):
    f = lambda a, b: value(spark, text.log_odds(F.lit(a), F.lit(100), F.lit(b), F.lit(100)), x="1")
    assert f(9, 1) > 0 > f(1, 9) and f(5, 5) == 0


def test_entities(spark):
    bad = ["ab", "123", "Casino", "ceo", "Chief Fun Officer"]
    assert [value(spark, text.ignored_entity(F.col("x"), lexicons.IGNORED_ENTITIES, lexicons.ROLES), x=x) for x in bad] == [True] * 5
    assert value(spark, text.ignored_entity(F.col("x"), lexicons.IGNORED_ENTITIES, lexicons.ROLES), x="Kambi") is False
    assert value(spark, text.headline_fragment(F.col("x"), ["wins"]), x="Kambi wins") is True
    assert value(spark, text.headline_fragment(F.col("x"), ["wins"]), x="Genius Sports") is False


def test_folding_equals_nfkd_over_the_basic_plane(spark):
    """Both sides of a search: texts on the JVM, query words in Python."""
    import unicodedata

    from newsloom.operators import search

    known = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    d = spark.createDataFrame([(c, f"x{c}y") for c in [*known, "😀", "𝐀"]], "c string, t string")
    plain = lambda t: "".join(k for k in unicodedata.normalize("NFKD", t) if unicodedata.category(k) != "Mn")
    assert [r.c for r in d.select("c", text.fold(F.col("t")).alias("f")).collect() if r.f != plain(f"x{r.c}y")] == []
    words = ["ﬁnance", "ｆｕｌｌ", "İstanbul", "Ⅷ", "½", "①", "ñandú", "Straße", "Ærø", "한국", "㎏"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.normalize(F.col("w")).alias("n")).collect()
    assert [r.n for r in got] == [search.normalize(w) for w in words] and [r.n for r in got][:3] == ["finance", "full", "istanbul"]
    assert spark.range(1).select(text.fold(F.lit(None).cast("string"))).first()[0] is None
