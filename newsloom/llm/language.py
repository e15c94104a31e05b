"""Language ID by Bayesian evidence fusion.

Four kinds of evidence meet in one log posterior for each language: the text's likelihood (hashed byte 3-grams of
words, and whole words, in lower case), the language that the markup declares, the suffix of the address, and a prior of the
host. Host priors are smoothed hierarchically: a host's counts lean on its domain's, those on the whole corpus'.
The counts are sums of text posteriors by host, a grouped aggregate over all rows (partial first, so that a host
with a third of the rows is one row of each task); the smallest documents count as much as the longest.

Likelihoods are trained on a bounded sample of rows with a known language (`max_rows` dealt to the languages alike,
of each the smallest hashes of its documents; whole texts), so that each language with enough rows in the whole table is in the model. Byte grams of one text lean on each other, so its log likelihood is tempered. A text whose grams were mostly never
seen in training, or that has none, is in no known language ("und"); such rows, and rows whose best posterior is
below `least`, are rejected.

Cases: null and empty texts and texts without letters are "und" and rejected; null hosts share one prior; null or
unknown declarations and suffixes weigh nothing; repeated rows are decided each; without training rows all are
"und". Columns of the same names as the result's are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Upper-case bytes to lower-case ones: A-Z, and the second byte of U+00C0 to U+00DE in UTF-8.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AFTER_C3 = _LOWER.copy()
_AFTER_C3[0x80:0x9F] += 32
#: Top-level suffixes that speak for a language.
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
ADDED = ("language", "confidence", "coverage", "kept")


@dataclass
class Model:
    """logp: by bucket and language; seen: buckets met in training."""

    languages: list[str]
    logp: np.ndarray
    seen: np.ndarray
    bits: int


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    b, at = C.flat_bytes(texts)
    out = _LOWER[b]
    if len(b) > 1:
        second = np.concatenate([[False], b[:-1] == 0xC3])
        out[second] = _AFTER_C3[b[second]]
    return out, at


def _buckets(b: np.ndarray, bits: int):
    """(places, buckets) of the letters' 3-grams and of the words: grams of digits and signs alone don't count."""
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    for n, x, ok in C.ngrams(b, (3,), bits):
        m = len(x)
        ok = ok & (letter[:m] | letter[1 : m + 1]) & (letter[1 : m + 1])
        yield np.flatnonzero(ok), x[ok]
    starts, x = C.words(b, bits)
    ok = letter[starts]
    yield starts[ok], x[ok] ^ np.uint32(0x5A5A & ((1 << bits) - 1))


def train(rows: list[tuple[str, str]], bits: int = 17, least: int = 5) -> Model:
    """rows: text and language. Languages of fewer than `least` rows are left out."""
    tally: dict[str, int] = {}
    for _, lang in rows:
        tally[lang] = tally.get(lang, 0) + 1
    languages = sorted(x for x, n in tally.items() if n >= least)
    count = np.zeros((1 << bits, max(1, len(languages))), np.float64)
    for text, lang in rows:
        if lang in languages:
            for _, x in _buckets(_bytes(pa.array([text]))[0], bits):
                count[:, languages.index(lang)] += np.bincount(x, minlength=1 << bits)
    return _model(languages, count, bits)


def _model(languages: list[str], count: np.ndarray, bits: int) -> Model:
    """count: how often each bucket occurs in each language."""
    seen = count.sum(axis=1) > 0
    share = (count + 0.5) / (count.sum(axis=0) + 0.5 * (seen.sum() + 1))
    logp = np.log(share)
    logp -= logp.mean(axis=1, keepdims=True)
    logp[~seen] = 0
    return Model(languages, logp.astype(np.float32), seen, bits)


def evidence(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihoods (relative), number of grams and how many of them were seen in training, for each text."""
    k = len(model.languages)
    like, n, known = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for first, end in C.slices(texts, 1 << 18):
        b, at = _bytes(texts.slice(first, end - first))
        for places, x in _buckets(b, model.bits):
            row = np.searchsorted(at, places, "right") - 1 + first
            n += np.bincount(row, minlength=len(texts))
            known += np.bincount(row, model.seen[x], len(texts)).astype(np.int64)
            for j in range(k):
                like[:, j] += np.bincount(row, model.logp[x, j], len(texts))
    return like, n, known


def fit(documents: DataFrame, max_rows: int = 3000, language: str = "lang", **how) -> Model:
    """Train on `max_rows` rows with a language and a text, an equal part for each language: those whose doc_id hashes lowest.

    No language is left out for its share of the rows: each gets `least` rows of train() or more.
    """
    least = how.get("least", 5)
    bits = how.get("bits", 17)
    spark, known = documents.sparkSession, documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col(language).cast("string").alias("language"))
    known, language = known.where(F.col("language").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull()), "language"
    rows = known.select("doc_id", language).distinct()
    sizes = {r[0]: r[1] for r in rows.groupBy(language).agg(F.count(F.lit(1))).collect() if r[1] >= least}
    if not sizes:
        return train([], **how)
    part = max(least, max_rows // len(sizes))
    # hashes are spread evenly: a share that holds `part` rows of the language with room to spare, of which the lowest are taken
    shares = [(x, min(1.0, (part + 8 * part**0.5 + 40) / n)) for x, n in sizes.items()]
    below = F.broadcast(spark.createDataFrame(shares, T.StructType([T.StructField("_of", known.schema[language].dataType), T.StructField("_share", T.DoubleType())])))
    h = F.xxhash64(F.col("doc_id"), F.lit(3))
    some = rows.withColumn("_h", h).join(below, F.col(language) == F.col("_of")).where(F.col("_h") / 2.0**64 + 0.5 <= F.col("_share"))
    picked: dict = {}
    for r in sorted(some.select(F.col("_h"), "doc_id", language).collect()):
        if len(picked.setdefault(r[2], [])) < part:
            picked[r[2]].append(r[1])
    chosen = spark.createDataFrame([(i, x) for x, ids in picked.items() for i in ids], T.StructType([known.schema["doc_id"], known.schema[language]]))
    # at most `part` numbers for each language: a bounded side to broadcast
    met = known.join(F.broadcast(chosen), ["doc_id", language], "left_semi")
    texts = met.groupBy("doc_id", language).agg(F.min("text").alias("text")).select("text", language)  # of rows with one doc_id and language one counts
    languages = sorted(picked)
    places = {x: i for i, x in enumerate(languages)}

    def tally(batches):
        count = np.zeros((len(languages), 1 << bits), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, x in _buckets(_bytes(pa.array([text]))[0], bits):
                    count[places[lang]] += np.bincount(x, minlength=1 << bits)
        at, bucket = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bucket), pa.array(count[at, bucket])], ["at", "bucket", "n"])
        del count
        C.trim()

    # no text reaches the driver: sums for 2**bits buckets of each language do
    sums = texts.mapInArrow(tally, "at long, bucket long, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros((1 << bits, len(languages)), np.float64)
    count[sums["bucket"].to_numpy(), sums["at"].to_numpy()] = sums["n"].to_numpy()
    return _model(languages, count, bits)


def _softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_language(host: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.substring_index(host, ".", -1)))


def identify(
    documents: DataFrame, model: Model, host: Column | None = None, declared: Column | None = None, suffix: Column | None = None,
    temper: float = 0.3, declared_log_odds: float = 2.0, suffix_log_odds: float = 1.0, strength: float = 20.0, least: float = 0.5, coverage: float = 0.5, columns: list[str] | None = None,
    facts_of: DataFrame | None = None,
) -> DataFrame:
    """documents, each row with language, confidence (its posterior), coverage (share of grams known) and kept.

    columns: the columns of documents to return, all if None. facts_of: doc_id, host, declared, suffix, where a
    document's page is known (of several pages the least of each counts). host: whose prior counts; declared: the markup's language code; suffix: the language that the address speaks for.
    """
    spark = documents.sparkSession
    C.small_batches(spark)
    base = documents.drop(*ADDED)
    if not model.languages:
        return base.withColumns({"language": F.lit("und"), "confidence": F.lit(0.0), "coverage": F.lit(0.0), "kept": F.lit(False)})
    k, p = len(model.languages), C.free_prefix(base)
    sent = spark.sparkContext.broadcast(model)

    def run(at, echoed):
        def go(batches):
            for batch in batches:
                like, n, known_ = evidence(batch.column(at).cast(pa.string()), sent.value)
                z = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array((like * temper).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:echoed], z, pa.array(np.where(n > 0, known_ / np.maximum(n, 1), 0.0))], [*batch.schema.names[:echoed], f"{p}like", f"{p}known"])
            C.trim()

        return go

    nothing = F.lit(None).cast("string")
    facts = [(nothing if c is None else c.cast("string")).alias(name) for c, name in ((host, f"{p}host"), (declared, f"{p}declared"), (suffix, f"{p}suffix"))]

    def scored(columns: list[str]) -> DataFrame:
        """Those columns and the facts, with _like and _known; a text goes to Python once."""
        rows = base.select(*[F.col(f"`{c}`") for c in columns], *facts)
        echoed = len(rows.columns)
        schema = T.StructType([*rows.schema.fields, T.StructField(f"{p}like", T.ArrayType(T.DoubleType())), T.StructField(f"{p}known", T.DoubleType())])
        if "text" not in columns:
            rows = base.select(*[F.col(f"`{c}`") for c in columns], *facts, "text")
        return rows.mapInArrow(run(rows.columns.index("text"), echoed), schema)

    def with_facts(rows: DataFrame) -> DataFrame:
        """What facts_of knows of a document goes before the row's own."""
        if facts_of is None:
            return rows
        f = facts_of.where("doc_id is not null").groupBy(F.col("doc_id").alias(f"{p}doc")).agg(*[F.min(c).alias(f"{p}of{c}") for c in ("host", "declared", "suffix")])
        joined = rows.join(f, F.col("doc_id") == F.col(f"{p}doc"), "left")
        return joined.withColumns({f"{p}{c}": F.coalesce(F.col(f"{p}of{c}"), F.col(f"{p}{c}")) for c in ("host", "declared", "suffix")}).drop(f"{p}doc", f"{p}ofhost", f"{p}ofdeclared", f"{p}ofsuffix")

    kept = base.columns if columns is None else columns
    # without its text a row is a few numbers: scored once and written; with it, texts are scored again rather than written
    rows = scored(kept) if "text" in kept else C.written(scored(kept), "language-scores")
    posts = with_facts(rows if "text" not in kept else scored([*["doc_id"] * (facts_of is not None)]))
    posts = posts.where(F.col(f"{p}known") >= coverage).withColumn(f"{p}post", _softmax(F.col(f"{p}like")))
    sums = [F.sum(F.col(f"{p}post")[j]).alias(f"s{j}") for j in range(k)]
    by_host = C.written(posts.groupBy(F.col(f"{p}host").alias("_host")).agg(*sums), "host-language")
    prior = _priors(by_host, k, strength)
    names = F.array(*[F.lit(x) for x in model.languages])
    says = lambda column, odds: F.transform(names, lambda x: F.when(F.lower(F.substring(column, 1, 2)) == x, F.lit(odds)).otherwise(0.0))
    rows = with_facts(rows)
    rows = rows.join(prior.select(F.col("_host").alias(f"{p}of"), F.col("_prior").alias(f"{p}prior")), F.col(f"{p}host").eqNullSafe(F.col(f"{p}of")), "left")
    z = F.array(*[F.col(f"{p}like")[j] + F.coalesce(F.col(f"{p}prior")[j], F.lit(0.0)) + F.coalesce(says(F.col(f"{p}declared"), declared_log_odds)[j], F.lit(0.0)) + F.coalesce(says(F.col(f"{p}suffix"), suffix_log_odds)[j], F.lit(0.0)) for j in range(k)])
    rows = rows.withColumn(f"{p}p", _softmax(z)).withColumn("confidence", F.array_max(f"{p}p"))
    rows = rows.withColumn("language", F.when(F.col(f"{p}known") < coverage, F.lit("und")).otherwise(F.element_at(names, F.array_position(f"{p}p", F.col("confidence")).cast("int"))))
    rows = rows.withColumn("coverage", F.col(f"{p}known")).withColumn("kept", (F.col("language") != "und") & (F.col("confidence") >= least))
    return rows.select(*[F.col(f"`{c}`") for c in kept], *ADDED)


def known(documents: DataFrame, model: Model, **how) -> DataFrame:
    """The rows of documents that identify() keeps, without columns of its own.

    Texts are scored once, for a table of row numbers and decisions; of the rows themselves only those that the filter
    of the rejected numbers flags are shuffled.
    """
    name = C.free_name(documents, "rid")
    rows = C.numbered(documents, name)
    decided = identify(rows, model, columns=[name, "doc_id"], **how)
    gone = C.written(decided.where(~F.col("kept")).select(name), "language-rejected")
    return C.without(rows, name, gone).select(*[F.col(f"`{c}`") for c in documents.columns])


def _priors(by_host: DataFrame, k: int, strength: float) -> DataFrame:
    """_host, _prior: log priors; a host's sums are smoothed by its domain's, those by all."""
    d = by_host.withColumn("_domain", F.coalesce(domain(F.col("_host")), F.lit("")))
    by_domain = d.groupBy("_domain").agg(*[F.sum(f"s{j}").alias(f"d{j}") for j in range(k)])
    total = by_domain.agg(*[F.sum(f"d{j}").alias(f"t{j}") for j in range(k)])
    # one row
    x = d.join(by_domain, "_domain").crossJoin(F.broadcast(total))
    all_ = sum((F.col(f"t{j}") for j in range(1, k)), F.col("t0"))
    dom = sum((F.col(f"d{j}") for j in range(1, k)), F.col("d0"))
    own = sum((F.col(f"s{j}") for j in range(1, k)), F.col("s0"))
    whole = [(F.col(f"t{j}") + 1) / (all_ + k) for j in range(k)]
    mid = [(F.col(f"d{j}") + strength * whole[j]) / (dom + strength) for j in range(k)]
    return x.select("_host", F.array(*[F.log((F.col(f"s{j}") + strength * mid[j]) / (own + strength)) for j in range(k)]).alias("_prior"))
