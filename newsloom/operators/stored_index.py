"""A search index that outlives its queries: positional postings in buckets, written in segments.

    postings/segment=n/bucket=b   token, article_id, positions   (sorted by token)
    tokens/segment=n              token, bucket, df
    docs/segment=n                the display columns of each article, has_content
    gone/segment=n                articles of older segments that this segment holds anew
    manifest/version=v            the live segments; a version counts once its _SUCCESS is there

`add` writes new and changed articles as one more segment: its cost follows the batch. `merge` makes one segment of the
newest ones. Readers hold to the manifest that they opened with, so neither disturbs them; what a failed writer leaves is
overwritten by the next. One writer at a time.

`search` gives the rows of `operators.search.search` and reads no article: words choose buckets of postings, one aggregate
for each article says which words it has, phrases are positions that follow each other, and the steps fold into a
boolean over that. Which words count as tokens is read from the postings too.

Cases: rows without an article_id are not indexed; of rows with one id in a batch, the one whose text has the smallest
hash is; null and blank fields are no text; an article without text is in docs only; an empty batch is an empty segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import dealt, written
from . import search as scan

#: Words of 64 bits of the filter of replaced articles, at most.
FILTER_WORDS = 1 << 20
#: Bytes of texts that a task splits together.
CHUNK = 1 << 22
#: Ids of articles of several rows that are broadcast, at most.
FEW = 100_000
SHOWN = ["article_id", "title", "summary", "source", "link", "category", "published_date"]
_POSTINGS = "token string, article_id string, positions array<int>, segment int, bucket int"
_TOKENS = "token string, bucket int, df bigint, segment int"
_GONE = "article_id string, segment int"


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of article_id and search form as token, article_id and positions, one row for each token of an article: about CHUNK bytes of text are split, numbered and sorted together."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK, "right")) - 1)
            split = pc.split_pattern(texts.slice(a, b - a), " ")
            row = np.repeat(np.arange(a, b), split.value_lengths().to_numpy(zero_copy_only=False))
            some = pc.greater(pc.binary_length(split.flatten()), 0)
            row, coded = row[some.to_numpy(zero_copy_only=False)], pc.dictionary_encode(split.flatten().filter(some))
            at = np.arange(len(row)) - np.searchsorted(row, row)
            key = row * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(at[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(coded.indices.take(pa.array(order[first]))), ids.take(pa.array(row[order[first]])), positions], ["token", "article_id", "positions"])
            a = b


def _single(articles: DataFrame) -> DataFrame:
    """Articles with an id, one row for each. Ids alone tell which have several rows; whole rows are compared for these only, and no other row is dealt out."""
    d = articles.where(F.coalesce("article_id", F.lit("")) != "")
    several = written(d.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("article_id").alias("_id")), "index-repeated")
    n = several.count()
    if not n:
        return d
    told = F.broadcast(several) if n <= FEW else dealt(several)
    same = F.col("article_id") == F.col("_id")
    row = F.struct(*[c for c in d.columns if c != "article_id"])
    one = d.join(told, same, "left_semi").groupBy("article_id").agg(F.min_by(row, F.struct(F.xxhash64("title", "summary", "content"), row)).alias("d")).select("article_id", "d.*")
    return d.join(told, same, "left_anti").unionByName(one)


# ---- versions --------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, f"{folder}/manifest")
    if not fs.exists(path):
        return []
    whole = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


@dataclass(frozen=True)
class Index:
    """One version of a stored index: what it holds does not change, whatever is added after."""

    spark: SparkSession
    folder: str
    segments: tuple[int, ...]
    buckets: int

    def _table(self, name: str, schema: str, segments: tuple[int, ...] | None = None) -> DataFrame:
        live = self.segments if segments is None else segments
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/segment={n}" for n in live])

    def _alive(self, d: DataFrame, segments: tuple[int, ...] | None = None) -> DataFrame:
        """Rows of articles that no newer segment holds."""
        live = self.segments if segments is None else segments
        if len(live) < 2:
            return d
        newer = self._table("gone", _GONE, live).groupBy(F.col("article_id").alias("_id")).agg(F.max("segment").alias("_newest"))
        rest, asked = self._flagged(d, live)
        return rest.unionByName(asked.join(dealt(newer), (F.col("article_id") == F.col("_id")) & (F.col("segment") < F.col("_newest")), "left_anti"))

    def _flagged(self, d: DataFrame, live: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
        """d in two parts: rows that no newer segment holds, by a filter of bits that goes to all tasks, and rows that one may hold. Only the latter are dealt out to learn it."""
        n, m = self._table("gone", _GONE, live).count(), 64
        while m < 64 * FILTER_WORDS and m < 16 * n:
            m *= 2
        at = F.xxhash64("article_id").bitwiseAND(F.lit(m - 1))
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
        bits = self._table("gone", _GONE, live).select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit(F.col("_at"))).alias("_bits"))
        met = d.withColumn("_at", at).join(F.broadcast(bits), F.shiftright("_at", 6) == F.col("_word"), "left")
        hit = (F.col("segment") < max(live)) & F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_at"))) != 0, F.lit(False))
        return met.where(~hit).select(*d.columns), met.where(hit).select(*d.columns)

    def postings(self) -> DataFrame:
        return self._table("postings", _POSTINGS)

    def tokens(self) -> DataFrame:
        return self._table("tokens", _TOKENS)

    def docs(self) -> DataFrame:
        """Live articles: display columns, has_content, segment."""
        return self._alive(self._table("docs", ", ".join(f"{c} string" for c in SHOWN) + ", has_content boolean, segment int"))


def opened(spark: SparkSession, folder: str) -> Index | None:
    """The newest version, None where there is none."""
    found = _versions(spark, folder)
    if not found:
        return None
    rows = spark.read.parquet(f"{folder}/manifest/version={found[-1]}").collect()  # a row for each live segment
    return Index(spark, folder, tuple(sorted(r.live for r in rows if r.live is not None)), rows[0].buckets)


def _commit(spark: SparkSession, folder: str, segments: tuple[int, ...], buckets: int) -> Index:
    version = max(_versions(spark, folder), default=0) + 1
    rows = spark.createDataFrame([(s, buckets) for s in segments], "live int, buckets int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    return Index(spark, folder, segments, buckets)


def _write(spark: SparkSession, folder: str, number: int, postings: DataFrame, docs: DataFrame, gone: DataFrame) -> None:
    """A segment. Each task writes its own file of each bucket, so that postings, which are more than the texts, are not shuffled."""
    to = lambda d, name: d.write.mode("overwrite").parquet(f"{folder}/{name}/segment={number}")
    by_bucket = postings.select("token", "article_id", "positions", "bucket").sortWithinPartitions("bucket", "token")
    by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/segment={number}")
    read = spark.read.schema("token string, article_id string, positions array<int>, bucket int").parquet(f"{folder}/postings/segment={number}")
    to(read.groupBy("token", "bucket").agg(F.count(F.lit(1)).alias("df")), "tokens")
    to(docs, "docs")
    to(gone, "gone")


def add(articles: DataFrame, folder: str, buckets: int = 64) -> Index:
    """Articles as a new segment; those that the index has already are taken from the new segment from now on.

    buckets: of a new index; an index keeps the number it began with.
    """
    spark = articles.sparkSession
    now = opened(spark, folder)
    buckets = now.buckets if now else buckets
    number = max(now.segments, default=0) + 1 if now else 1
    d = _single(articles)
    missing = {c: F.lit(None).cast("string") for c in SHOWN if c not in d.columns}
    docs = d.withColumns(missing).select(*[F.col(c).cast("string").alias(c) for c in SHOWN], text.has_content(F.col("content")).alias("has_content"))
    entries = d.select("article_id", scan.search_text().alias("text")).mapInArrow(_postings, "token string, article_id string, positions array<int>")
    held = now.docs().select("article_id") if now and now.segments else docs.select("article_id").limit(0)
    gone = docs.select("article_id").join(held, "article_id", "left_semi")
    _write(spark, folder, number, entries.withColumn("bucket", _bucket(F.col("token"), buckets)), docs, gone)
    return _commit(spark, folder, (*(now.segments if now else ()), number), buckets)


def merge(spark: SparkSession, folder: str, newest: int | None = None) -> Index | None:
    """One segment of the newest ones (all, if no number is given), without what newer segments replace."""
    now = opened(spark, folder)
    chosen = () if now is None else now.segments[-newest:] if newest else now.segments
    if len(chosen) < 2:
        return now
    older, number = now.segments[: -len(chosen)], chosen[-1] + 1
    part = Index(spark, folder, chosen, now.buckets)
    gone = part._table("gone", _GONE).select("article_id").distinct()
    _write(spark, folder, number, part._alive(part.postings()), part.docs().drop("segment"), gone if older else gone.limit(0))
    return _commit(spark, folder, (*older, number), now.buckets)


def vacuum(spark: SparkSession, folder: str, versions: int = 1) -> int:
    """Deletes the segments that none of the newest versions has, and older manifests; how many segments went. Their readers must be gone."""
    found = _versions(spark, folder)
    kept = {r.live for v in found[-versions:] for r in spark.read.parquet(f"{folder}/manifest/version={v}").collect()}
    gone = set()
    for name in ("postings", "tokens", "docs", "gone"):
        fs, path = _fs(spark, f"{folder}/{name}")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            number = int(s.getPath().getName().split("=")[1])
            if number not in kept and number < max(kept, default=0):  # later ones may be in the making
                gone.add(number)
                fs.delete(s.getPath(), True)
    for v in found[:-versions]:
        fs, path = _fs(spark, f"{folder}/manifest/version={v}")
        fs.delete(path, True)
    return len(gone)


# ---- queries ---------------------------------------------------------------------------------------------------


def _tests(atom: tuple) -> list[tuple[str, str]]:
    """What tokens must be for an atom, place by place: (equal | part | end | start, word)."""
    kind, words = atom
    if kind != "phrase":
        return [("equal" if kind == "token" else "part", words[0])]
    return [("end", words[0]), *[("equal", w) for w in words[1:-1]], ("start", words[-1])]


def _meets(test: tuple[str, str]) -> Column:
    kind, word = test
    t, w = F.col("token"), F.lit(word)
    return {"equal": t == w, "part": F.contains(t, w), "end": F.endswith(t, w), "start": F.startswith(t, w)}[kind]


def _less(k: int) -> Column:
    """Where a phrase begins whose word k stands at the positions."""
    return F.transform("positions", lambda p: p - k)


def _hits(index: Index, atoms: list[tuple]) -> DataFrame:
    """article_id, a0, a1, ...: for each live article with a token that some atom asks for, which atoms it meets."""
    tests = sorted({t for a in atoms for t in _tests(a)})
    loose = [t for t in tests if t[0] != "equal"]
    places: dict = {}
    if loose:  # a set of at most `buckets` numbers for each
        row = index.tokens().where(reduce(lambda a, b: a | b, [_meets(t) for t in loose])).agg(*[F.collect_set(F.when(_meets(t), F.col("bucket"))).alias(f"b{i}") for i, t in enumerate(loose)]).first()
        places = {t: list(row[i]) for i, t in enumerate(loose)}
    asked = [(F.col("bucket").isin(places[t]) if t in places else F.col("bucket") == _bucket(F.lit(t[1]), index.buckets)) & _meets(t) for t in tests if places.get(t, True)]
    d = index._alive(index.postings().where(reduce(lambda a, b: a | b, asked, F.lit(False))))
    held = []
    for i, atom in enumerate(atoms):
        if atom[0] != "phrase":
            held.append(F.bool_or(_meets(_tests(atom)[0])).alias(f"a{i}"))
            continue
        begins = [F.flatten(F.collect_list(F.when(_meets(t), _less(k)))) for k, t in enumerate(_tests(atom))]
        held.append((F.size(reduce(F.array_intersect, begins)) > 0).alias(f"a{i}"))
    return d.groupBy("article_id").agg(*held)


class _Atoms:
    """Gathers the atoms of a query while its steps fold into conditions over their columns."""

    def __init__(self):
        self.found: list[tuple] = []

    def of(self, *atom) -> Column:
        if atom not in self.found:
            self.found.append(atom)
        return F.col(f"a{self.found.index(atom)}")

    def word(self, w: str, known: set[str], substring: bool) -> Column:
        return self.of("token" if len(w) < 4 or (w in known and not substring) else "part", (w,))

    def normal(self, value: str, known: set[str], substring: bool) -> Column:
        words = scan.normalize(value).split()
        return reduce(lambda a, b: a & b, [self.word(w, known, substring) for w in words]) if words else F.lit(False)

    def step(self, s: scan.Step, by: scan.Rules, substring: bool) -> Column:
        if s.op == "PHRASE":
            words = tuple(scan.normalize(s.value).split())
            return F.lit(True) if not words else self.of("part" if len(words) == 1 else "phrase", words)
        plain = scan._plain(s.value) if s.value in by.plain else None
        return self.word(plain, by.known, substring) if plain else self.normal(s.value, by.known, substring)


def _some(index: Index, atoms: _Atoms, tests: list[Column]) -> list[bool]:
    """For each condition, whether some article meets it."""
    if not tests:
        return []
    if not atoms.found:
        return [False] * len(tests)
    return list(_hits(index, atoms.found).agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(f"t{i}") for i, t in enumerate(tests)]).first())


def rules(index: Index, steps: list[scan.Step], substring: bool = False) -> scan.Rules:
    """As operators.search.rules, from postings: at most two small aggregates."""
    words, tokens = [] if substring else scan.words_of(steps), _Atoms()
    known = {w for w, hit in zip(words, _some(index, tokens, [tokens.of("token", (w,)) for w in words]), strict=True) if hit}
    values, mixed = sorted({s.value for s in steps if s.op != "PHRASE" and scan._plain(s.value)}), _Atoms()
    hits = _some(index, mixed, [mixed.normal(v, known, substring) for v in values])
    return scan.Rules(known, {v for v, hit in zip(values, hits, strict=True) if not hit})


def _matching(index: Index, steps: list[scan.Step], by: scan.Rules, substring: bool) -> DataFrame:
    """article_id of each match. Only a phrase of no word is met by articles without any of the words."""
    atoms = _Atoms()
    meets = scan.folded(steps, lambda s: atoms.step(s, by, substring))
    every = any(s.op == "PHRASE" and not scan.normalize(s.value) for s in steps)
    if not atoms.found:
        return index.docs().select("article_id").where(meets)
    found = _hits(index, atoms.found)
    if every:
        found = index.docs().select("article_id").join(found, "article_id", "left").na.fill(False)
    return found.where(meets).select("article_id")


def search(index: Index, query: str, substring: bool = False, sources: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """The articles that match, with the display columns and has_content."""
    steps = scan.parse(query)
    docs = index.docs().drop("segment")
    if sources:
        docs = docs.where(F.col("source").isin(sources))
    if categories:
        docs = docs.where(F.col("category").isin(categories))
    return docs.join(_matching(index, steps, rules(index, steps, substring), substring), "article_id", "left_semi")


def keyword_counts(index: Index, keywords: list[str]) -> DataFrame:
    """keyword, n: as operators.search.keyword_counts. One pass of the postings for all keywords, and no shuffle of articles' rows after it."""
    steps = {k: scan.parse(k) for k in dict.fromkeys(keywords)}
    by = rules(index, [s for parsed in steps.values() for s in parsed])
    atoms = _Atoms()
    meets = {k: scan.folded(parsed, lambda s: atoms.step(s, by, False)) for k, parsed in steps.items()}
    if not atoms.found:
        return index.spark.createDataFrame([], "keyword string, n bigint")
    one = _hits(index, atoms.found).agg(*[F.count_if(m).alias(f"k{i}") for i, m in enumerate(meets.values())])
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("n")) for i, k in enumerate(meets)]))
    return one.select(pairs).where("n > 0").orderBy(F.col("n").desc(), "keyword")
