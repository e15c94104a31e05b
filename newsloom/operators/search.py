"""Boolean full-text search.

A query is parsed on the driver into steps; the steps fold into one boolean over the normalised text, which is
computed once for each article however many words ask for it. A word matches articles that have it as a token; only
where no article has, or if asked for, as a substring. Words of fewer than four letters match as tokens only. A word
that normalises to something that no article has ("bRazil": b razil) is tried again as it is, in lower case.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


@dataclass(frozen=True)
class Step:
    op: str  # AND, OR or PHRASE
    value: str


def parse(query: str) -> list[Step]:
    """Phrases in quotes come first, then words; 'or' makes the next word an alternative, 'and' says nothing."""
    steps = [Step("PHRASE", p.strip()) for p in re.findall(r'"([^"]+)"', query) if p.strip()]
    alternative = False
    for word in re.sub(r'"[^"]*"', " ", query).split():
        if word.lower() == "or":
            alternative = True
        elif word.lower() != "and":
            steps.append(Step("OR" if alternative else "AND", word))
            alternative = False
    return steps


def normalize(value: str) -> str:
    """As functions.text.normalize, for query words."""
    t = "".join(c for c in unicodedata.normalize("NFKD", value) if unicodedata.category(c) != "Mn")
    t = re.sub(r"[^\w]+", " ", re.sub(text.BORDERS, r"\1 ", t).lower()).strip()
    for pattern, to in text.COMPOUNDS:
        t = re.sub(pattern, to, t)
    return " ".join(t.split())


def _plain(value: str) -> str | None:
    """A word in lower case, where that is not its normal form."""
    return value.lower() if normalize(value) and value.lower() != normalize(value) else None


def indexed(articles: DataFrame, *fields: str) -> DataFrame:
    """Articles with search_text and has_content; rows without an id are left out."""
    return _with_id(articles).withColumn("search_text", search_text(*fields)).withColumn("has_content", text.has_content(F.col("content")))


def _with_id(articles: DataFrame) -> DataFrame:
    return articles.where(F.coalesce("article_id", F.lit("")) != "")


def search_text(*fields: str) -> Column:
    return text.normalize(text.join_fields(*[F.col(f) for f in fields or ("title", "summary", "content")]))


def postings(index: DataFrame) -> DataFrame:
    """token, article_id: one row for each distinct token of an article."""
    return index.select(F.explode(F.array_distinct(text.tokens(F.col("search_text")))).alias("token"), "article_id")


def _has_token(word: str, column: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), column, F.lit(" ")), F.lit(f" {word} "))


def words_of(steps: list[Step]) -> list[str]:
    """Tokens of four letters or more whose rule depends on whether some article has them."""
    values = [s.value for s in steps if s.op != "PHRASE"]
    words = [w for v in values for w in normalize(v).split()] + [p for v in values if (p := _plain(v))]
    return sorted({w for w in words if len(w) >= 4})


def _any(articles: DataFrame, tests: list, fields: tuple[str, ...]) -> list[bool]:
    """For each test of the normalised text, whether some article meets it: one aggregate."""
    held = text.once(search_text(*fields), lambda s: F.array(*[t(s) for t in tests]))
    hits = _with_id(articles).select(held.alias("hits"))
    row = hits.agg(*[F.coalesce(F.bool_or(F.col("hits")[i]), F.lit(False)).alias(f"h{i}") for i in range(len(tests))]).first()
    return list(row)


def _compound(word: str) -> bool:
    return any(part in word for part in text.COMPOUND_PARTS)


def _whole(fields: tuple[str, ...]) -> Column:
    return text.join_fields(*[F.col(f) for f in fields or ("title", "summary", "content")])


def _may(words: list[str], low: Column, folded_: Column, token) -> Column:
    """Whether all words occur as letters in a row (compounds aside, a part of a token of the normal form is such a run). A condition that costs little.

    token: word -> whether it must be a token, so that it has no small letter beside it."""
    out = F.lit(True)
    for w in words:
        if not _compound(w):
            out = out & _may_one(w, low, folded_, token(w))
    return out


def _may_one(w: str, low: Column, folded_: Column, token: bool) -> Column:
    """A token in small letters a to z begins after what is no letter a to z and no underscore, and ends before what is no small one; one with capitals may have borders within."""
    found = F.contains(low, F.lit(w))
    if not (token and re.fullmatch("[a-z]{2,}", w)):
        return found
    pattern = f"[{w[0]}{w[0].upper()}](?:{w[1:]}(?<=(?:^|[^A-Za-z_]){w})(?![a-z_])|(?i:{w[1:]})(?<!{w}))"
    return found & folded_.rlike(pattern)


def _roughly(fields: tuple[str, ...], test) -> Column:
    """test(text in lower case, text) of an article's folded text."""
    return text.once(text.fold(_whole(fields)), lambda t: text.once(F.lower(t), lambda low: test(low, t)))


def known_words(articles: DataFrame, words: list[str], fields: tuple[str, ...] = ()) -> set[str]:
    """Which of the words some article has as a token.

    A lower-case word between two spaces is one, whatever stands around it: one cheap aggregate settles frequent
    words. For the others, only articles that hold one of them as letters in a row are normalised.
    """
    plain = [w for w in words if not _compound(w)]
    known: set[str] = set()
    if plain:
        spaced = articles.select(F.concat(F.lit(" "), _whole(fields), F.lit(" ")).alias("t"), "article_id")
        row = _with_id(spaced).agg(*[F.coalesce(F.bool_or(F.contains("t", F.lit(f" {w} "))), F.lit(False)).alias(f"w{i}") for i, w in enumerate(plain)]).first()
        known = {w for i, w in enumerate(plain) if row[i]}
    rest = [w for w in words if w not in known]
    if not rest:
        return known
    if not any(_compound(w) for w in rest):
        articles = articles.where(_roughly(fields, lambda low, t: reduce(lambda a, b: a | b, [_may_one(w, low, t, True) for w in rest])))
    return known | {w for w, hit in zip(rest, _any(articles, [lambda s, w=w: _has_token(w, s) for w in rest], fields), strict=True) if hit}


def _as_token(w: str, known: set[str], substring: bool) -> bool:
    return len(w) < 4 or (w in known and not substring)


def _single(w: str, known: set[str], column: Column, substring: bool) -> Column:
    return _has_token(w, column) if _as_token(w, known, substring) else F.contains(column, F.lit(w))


def _normal(value: str, known: set[str], column: Column, substring: bool) -> Column:
    out = None
    for w in normalize(value).split():
        p = _single(w, known, column, substring)
        out = p if out is None else out & p
    return F.lit(False) if out is None else out


def found_nowhere(articles: DataFrame, steps: list[Step], known: set[str], substring: bool = False, fields: tuple[str, ...] = ()) -> set[str]:
    """Words whose normal form no article has, of those that are something else in plain lower case."""
    values = sorted({s.value for s in steps if s.op != "PHRASE" and _plain(s.value)})
    if not values:
        return set()
    hits = _any(articles, [lambda s, v=v: _normal(v, known, s, substring) for v in values], fields)
    return {v for v, hit in zip(values, hits, strict=True) if not hit}


@dataclass(frozen=True)
class Rules:
    """What the corpus decides about a query's words: known tokens, and words to be taken in plain lower case."""

    known: set[str]
    plain: set[str]


def rules(articles: DataFrame, steps: list[Step], substring: bool = False, fields: tuple[str, ...] = ()) -> Rules:
    known = set() if substring else known_words(articles, words_of(steps), fields)
    return Rules(known, found_nowhere(articles, steps, known, substring, fields))


def folded(steps: list[Step], test) -> Column:
    """The steps, from left to right: alternatives gather until the next AND; gathered ones are joined with what was
    found so far by OR, then the AND applies. An AND before anything was found starts the result. test: step -> condition."""
    result: Column | None = None
    gathered: Column | None = None
    for s in steps:
        p = test(s)
        if s.op == "OR":
            gathered = p if gathered is None else gathered | p
        elif result is None:
            result = p
        else:
            if gathered is not None:
                result, gathered = result | gathered, None
            result = result & p
    if gathered is not None:
        result = gathered if result is None else result | gathered
    return F.lit(False) if result is None else result


def predicate(steps: list[Step], by: Rules, column: Column, substring: bool = False, rough: Column | None = None) -> Column:
    """The folded steps over the normalised text.

    rough: the folded text as it is written; the condition is then a weaker one over column, the same in lower case, which every match meets."""

    def test(s: Step) -> Column:
        if rough is not None:
            token = lambda w: s.op != "PHRASE" and _as_token(w, by.known, substring)
            return _may([_plain(s.value)] if s.value in by.plain else normalize(s.value).split(), column, rough, token) if normalize(s.value) else F.lit(s.op == "PHRASE")
        if s.op == "PHRASE":
            return F.contains(column, F.lit(normalize(s.value)))
        return _single(_plain(s.value), by.known, column, substring) if s.value in by.plain else _normal(s.value, by.known, column, substring)

    return folded(steps, test)


def _surely(steps: list[Step], by: Rules, written: Column, substring: bool) -> Column:
    """A condition over the text as it is written, not even folded, that only matches meet: small letters a to z stay side by side
    in the search form, and between two spaces they are a token."""

    def test(s: Step) -> Column:
        words = [_plain(s.value)] if s.op != "PHRASE" and s.value in by.plain else normalize(s.value).split()
        if not words or not all(re.fullmatch("[a-z]+", w) and not _compound(w) for w in words):
            return F.lit(s.op == "PHRASE" and not words)
        if s.op == "PHRASE":
            joined = F.contains(written, F.lit(" ".join(words)))
            return joined if len(words) == 1 else joined & ~text.contains_any(F.lower(written), list(text.COMPOUND_PARTS))
        return reduce(lambda a, b: a & b, [F.contains(written, F.lit(f" {w} " if _as_token(w, by.known, substring) else w)) for w in words])

    return folded(steps, test)


def _matches(steps: list[Step], by: Rules, substring: bool, fields: tuple[str, ...] = ()) -> Column:
    """The folded steps over an article's search form, which only texts need that neither of two cheaper conditions settles."""
    exact = lambda t: text.once(text.spread(t), lambda s: predicate(steps, by, s, substring))
    rough = lambda t: text.once(F.lower(t), lambda low: predicate(steps, by, low, substring, rough=t))
    left = lambda w: text.once(text.fold(w), lambda t: rough(t) & exact(t))
    return text.once(_whole(fields), lambda w: _surely(steps, by, w, substring) | left(w))


def search(articles: DataFrame, query: str, substring: bool = False, sources: list[str] | None = None, categories: list[str] | None = None, regions: list[str] | None = None, known_in: DataFrame | None = None) -> DataFrame:
    """Matching articles with the seven display columns and has_content. known_in: the corpus that decides which words count as tokens.

    regions: only articles whose array `regions_list` has one of them.
    """
    steps = parse(query)
    by = rules(articles if known_in is None else known_in, steps, substring)
    found = _with_id(articles)
    if sources:
        found = found.where(F.col("source").isin(sources))
    if categories:
        found = found.where(F.col("category").isin(categories))
    if regions:
        found = found.where(F.arrays_overlap("regions_list", F.array(*[F.lit(r) for r in regions])))
    found = found.where(_matches(steps, by, substring))
    wanted = ["article_id", "title", "summary", "source", "link", "category", "published_date"]
    return found.select(*[c for c in wanted if c in found.columns], text.has_content(F.col("content")).alias("has_content"))


def keyword_index(articles: DataFrame, keywords: list[str]) -> DataFrame:
    """keyword, article_id: articles that a search for each keyword finds. All keywords are looked for in one scan."""
    steps = {k: parse(k) for k in keywords}
    by = rules(articles, [s for parsed in steps.values() for s in parsed])
    hits = text.once(search_text(), lambda t: F.array_compact(F.array(*[F.when(predicate(s, by, t), F.lit(k)) for k, s in steps.items()])))
    rough = _roughly((), lambda low, t: F.exists(F.array(*[predicate(s, by, low, rough=t) for s in steps.values()]), lambda x: x))
    return _with_id(articles).where(rough).select(F.explode(hits).alias("keyword"), "article_id").distinct()


def keyword_counts(articles: DataFrame, keywords: list[str]) -> DataFrame:
    """keyword, n: how many articles a search for each keyword finds, most first; keywords that find nothing are left out."""
    return keyword_index(articles, keywords).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "keyword")


def fingerprint(articles: DataFrame) -> str:
    """What tells one state of a corpus from another: rows, and a sum over ids, titles and texts that does not depend on their order."""
    of = F.xxhash64("article_id", "title", "summary", "content").cast("decimal(38,0)")
    row = articles.agg(F.count(F.lit(1)).alias("n"), F.sum(of).alias("h")).first()
    return f"rows:{row.n}_ids:{row.h or 0}" if row.n else "empty"


class IndexCache:
    """Search indexes by fields and fingerprint, kept between queries; when there are more than `most`, all go."""

    def __init__(self, most: int = 5):
        self.most, self.held = most, {}

    def get(self, articles: DataFrame, *fields: str) -> DataFrame:
        key = (fields, fingerprint(articles))
        if key not in self.held:
            if len(self.held) > self.most:
                for df in self.held.values():
                    df.unpersist()
                self.held.clear()
            self.held[key] = indexed(articles, *fields).persist()
        return self.held[key]


def find_in_list(articles: DataFrame, column: str, name: str) -> DataFrame:
    """Articles whose array `column` has the name; by keyword where there is no such column."""
    if column not in articles.columns:
        return find_by_keyword(articles, name)
    return _found(articles.where(F.array_contains(column, name)))


def find_by_keyword(articles: DataFrame, keyword: str) -> DataFrame:
    """Articles with the keyword, in any case, as a substring of title and summary."""
    low = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    return _found(articles.where(F.contains(low, F.lit(keyword.lower()))))


def _found(d: DataFrame) -> DataFrame:
    got = lambda c, otherwise: (F.coalesce(F.col(c).cast("string"), F.lit(otherwise)) if c in d.columns else F.lit(otherwise)).alias(c)
    return d.select(got("article_id", ""), got("source", "Unknown"), got("title", "No title"), got("link", ""), got("category", "unknown"), got("published_date", "No date"))


def find_smart(articles: DataFrame, term: str, topics: list[str], companies: list[str], regions: list[str]) -> DataFrame:
    """What the term is known as decides: a topic, a company, a region, else a keyword. search_type says which."""
    for kind, names, column in (("topic", topics, "topics_list"), ("company", companies, "companies_list"), ("region", regions, "regions_list")):
        if term in names:
            return find_in_list(articles, column, term).withColumn("search_type", F.lit(kind))
    return find_by_keyword(articles, term).withColumn("search_type", F.lit("keyword"))


def option(keyword: Column, n: Column) -> Column:
    return F.concat(keyword, F.lit(" ("), n.cast("string"), F.when(n == 1, F.lit(" article)")).otherwise(F.lit(" articles)")))


def option_keyword(label: Column) -> Column:
    return F.regexp_extract(label, r"^(.*) \([0-9]+ articles?\)$", 1)


def parity(left: DataFrame, right: DataFrame, key: str = "article_id") -> DataFrame:
    """Keys of either side with in_left and in_right; those of one side only are the difference."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def suggestions(words: DataFrame, query: str, n: int = 5) -> DataFrame:
    """Suggestions that contain the query, in any case; the first ones for an empty query."""
    d = words if not query.strip() else words.where(F.contains(F.lower("suggestion"), F.lit(query.strip().lower())))
    return d.orderBy("place").limit(n)
