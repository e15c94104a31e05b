"""Text scalars as column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _marks() -> str:
    """A class of all combining marks that Python knows; query words lose the same ones (the JVM's own class is of an older Unicode)."""
    at = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Mn"]
    first = [i for i, before in zip(at, [-2, *at]) if i != before + 1]
    last = [i for i, after in zip(at, [*at[1:], -2]) if after != i + 1]
    every = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(first, last, strict=True))
    # Java asks all ranges for each character that is in none: a cheap test stands before them, and the block that Latin letters decompose to before that
    return rf"[\x{{300}}-\x{{36f}}[\x{{370}}-\x{{10ffff}}&&[{every}]]]+"


MARKS = _marks()


def fold(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks: accents off, ligatures and wide letters as plain ones. ASCII texts pass as they are."""
    decomposed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.when(text.isNull() | (F.length(text) == F.octet_length(text)), text).otherwise(F.regexp_replace(decomposed, MARKS, ""))


#: A character with a border after it, within one run: camel case, capitals before a word, letters beside digits.
BORDERS = r"([a-z](?=[A-Z0-9])|[A-Z](?=[A-Z][a-z]|[0-9])|[0-9](?=[A-Za-z]))"
#: The same borders in two passes, each with a space before or after: both begin with a class that few characters are in, so that
#: Java passes over the others (the pattern above tries three alternatives at each letter).
BORDER_BEFORE = r"[A-Z0-9](?<=[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Z]|[A-Z][A-Z](?=[a-z]))"
BORDER_AFTER = r"[0-9](?=[a-z])"
#: Known compounds, in order, over words with single spaces between.
COMPOUNDS = ((r"\bi gaming\b", "igaming gaming"), (r"\be cricket\b", "ecricket cricket"), (r"\be sports?\b", "esports"), (r"\besport\b", "esports"))
#: No text without one of these has a compound.
COMPOUND_PARTS = ("gaming", "cricket", "sport")


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it: an expression that is pushed down is copied for each name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _compounds(t: Column) -> Column:
    joined = t
    for pattern, to in COMPOUNDS:
        joined = F.regexp_replace(joined, pattern, to)
    return F.when(contains_any(t, list(COMPOUND_PARTS)), joined).otherwise(t)


def normalize(text: Column) -> Column:
    """Search form: accents folded, camel case and letter-digit borders split, lower case, signs to spaces, known
    compounds joined, white space collapsed. Null becomes ''."""
    return spread(fold(F.coalesce(text, F.lit(""))))


def spread(folded: Column) -> Column:
    """The search form of a text that is folded already."""
    t = F.regexp_replace(folded, BORDER_BEFORE, " $0")
    t = F.regexp_replace(t, BORDER_AFTER, "$0 ")
    t = F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_]+", " "))
    return once(t, _compounds)


def join_fields(*fields: Column) -> Column:
    """Non-blank fields joined by a space."""
    return F.concat_ws(" ", *[F.nullif(F.trim(f), F.lit("")) for f in fields])


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def has_content(content: Column) -> Column:
    return F.coalesce(F.trim(content), F.lit("")) != ""


ADDRESSES = (r"(?:https?://|www\.)\S+", r"\S+@\S+\.\S+", r"[@#]\w+")


def clean(text: Column, addresses: bool = False) -> Column:
    """Lower case without addresses, handles and signs; hyphens and apostrophes stay. addresses: these stay too, as the words that they hold."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for p in (*(() if addresses else ADDRESSES), r"[^\p{L}\p{N}_\s'\-]"):
        t = F.regexp_replace(t, p, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip_html(html: Column, most: int | None = None) -> Column:
    """Text of markup: scripts, styles and comments away, tags to spaces, the common entities decoded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(to))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.substring(t, 1, most) if most else t


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword occurs as a substring (text in lower case)."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k))
    return out


def count_any(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur."""
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(text, F.lit(k)).cast("int")
    return total


def occurrences(text: Column, keyword: str) -> Column:
    """Non-overlapping occurrences of a keyword."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit("")))) / len(keyword)).cast("long")


def labels(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Labels of which a keyword occurs, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(contains_any(text, ks), F.lit(label)) for label, ks in lexicon.items()])))


def best_format(text: Column, lexicon: dict[str, list[str]], otherwise: str = "news") -> Column:
    """The format with most keywords present, the first of equals; `otherwise` if none is."""
    t = F.lower(F.coalesce(text, F.lit("")))
    scored = F.array_max(F.array(*[F.struct(count_any(t, ks).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("f")) for i, (name, ks) in enumerate(lexicon.items())]))
    return F.when(scored["n"] > 0, scored["f"]).otherwise(F.lit(otherwise))


def first_class(text: Column, classes: dict[str, list[str]], otherwise: str = "general") -> Column:
    """The first class of which a pattern occurs."""
    t = F.lower(text)
    out = F.lit(otherwise)
    for name, ks in reversed(classes.items()):
        out = F.when(contains_any(t, ks), F.lit(name)).otherwise(out)
    return out


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of n words."""
    last = F.size(words) - n
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: i <= last)
    return F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def meaningful(term: Column, stopwords: list[str]) -> Column:
    """Some word of the term is longer than two letters and no stopword."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.exists(F.split(term, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def valid_topic(topic: Column, brands: list[str], not_topics: list[str], common: list[str]) -> Column:
    """At least 3 letters, no brand in it, some word of 3 letters, and not one stopword alone."""
    words = F.split(topic, " ")
    has = lambda xs, w: F.array_contains(F.array(*[F.lit(x) for x in xs]).cast("array<string>"), w)
    ok = (F.length(topic) >= 3) & ~F.exists(words, lambda w: has(brands, w) | has(not_topics, w)) & F.exists(words, lambda w: F.length(w) >= 3)
    return ok & ~((F.size(words) == 1) & has(common, topic))


def headline_fragment(text: Column, verbs: list[str]) -> Column:
    """Looks like part of a headline: an action verb, four words or more, or 'in' within three words or more."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")
    return F.arrays_overlap(words, F.array(*[F.lit(v) for v in verbs])) | (F.size(words) >= 4) | (F.contains(F.lower(text), F.lit(" in ")) & (F.size(words) >= 3))


def ignored_entity(entity: Column, ignored: list[str], roles: list[str]) -> Column:
    """Too short, digits only, generic, or an executive role."""
    e = F.lower(F.trim(F.coalesce(entity, F.lit(""))))
    return (F.length(e) < 3) | e.rlike("^[0-9]+$") | e.isin([x.lower() for x in [*ignored, *roles]]) | e.rlike(r"^chief .*officer$") | (e.rlike(r"officer$") & (F.size(F.split(e, r"\s+")) <= 4))


def truncate_title(title: Column, most: int = 110) -> Column:
    """At a word border if it lies in the last 40 per cent, else hard, with an ellipsis."""
    cut = F.substring(title, 1, most)
    at_word = F.regexp_extract(cut, r"^(.*)\s\S*$", 1)
    kept = F.when(F.length(at_word) >= int(most * 0.6), F.rtrim(at_word)).otherwise(F.rtrim(cut))
    return F.when(F.length(title) <= most, title).otherwise(F.concat(kept, F.lit("…")))


def log_odds(a: Column, total_a: Column, b: Column, total_b: Column, prior: float = 1.0) -> Column:
    rate = lambda x, t: (x + prior) / (t + 2 * prior)
    return F.log(rate(a, total_a) / rate(b, total_b))


def gap_keywords(text: Column) -> Column:
    """Names, quoted terms, acronyms, money and years of a gap's text, each once."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 0), (r'"([^"]+)"', 1), (r"\b[A-Z]{2,6}\b", 0), (r"[$€£]\s?[0-9][0-9,.]*\s?(?:million|billion|m|bn)?", 0), (r"\b(?:19|20)[0-9]{2}\b", 0))]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.lower(F.trim(x))))


def phrases(text: Column, stopwords: list[str], known: list[str]) -> Column:
    """Words of three letters or more that are not common, then pairs of neighbours: known ones, and those of two words that are not common."""
    common = lambda w: w.isin(stopwords)
    words = F.filter(F.split(clean(text), " "), lambda w: w != "")

    def both(ws: Column) -> Column:
        single = F.filter(ws, lambda w: (F.length(w) >= 3) & ~common(w))
        pair = F.filter(ngrams(ws, 2), lambda g: g.isin(known) | ~(common(F.substring_index(g, " ", 1)) | common(F.substring_index(g, " ", -1))))
        return F.concat(single, pair)

    return once(words, both)


def regions(text: Column, lists: dict[str, list[str]], tribal: bool = True) -> Column:
    """Regions of which a phrase occurs, in the order of the lists. tribal: the word alone speaks for North America."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def found(t: Column) -> Column:
        hits = []
        for region, phrases_ in lists.items():
            hit = contains_any(t, phrases_)
            if tribal and region == "North America":
                hit = hit | F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(" tribal "))
            hits.append(F.when(hit, F.lit(region)))
        return F.array_compact(F.array(*hits))

    return once(low, found)
