"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fim, language, mixing, packing, periodic, pii, quality, rules, sharding, simhash, token_counts
from . import common as C
from .common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return quality.score(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir), limit=64 << 20).select("doc_id", "n_bytes", "shard_id", "shard_bytes", "shard_rows", "over_limit")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str, policy: str = "v3") -> DataFrame:
    book = rules.ledger(_documents(spark, sf_dir))
    base_failed = ~rules.passes("v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & rules.passes(policy)).alias("kept"), "failed")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def page_facts(pages: DataFrame) -> DataFrame:
    """What a document's page says: the document's number ends the path (but for a file's extension), the markup declares a language."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(
        F.regexp_extract("url", r"(?<!:/)(?<!^/)/([0-9]{1,18})(?:\.[A-Za-z]{1,5})?/?(?:[?#].*)?$", 1).try_cast("long").alias("doc_id"), F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]{0,200}?\slang=[\"']?([a-z]{2})", 1)), F.lit("")).alias("declared"), language.suffix_language(host).alias("suffix"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    facts = page_facts(_table(spark, sf_dir, "pages"))
    found = language.identify(documents, language.fit(documents), host=F.col("source"), facts_of=facts, columns=["doc_id", "lang", "source"])
    return found.select("doc_id", "language", "confidence", "coverage", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str, key: str = "a key of the release") -> DataFrame:
    return pii.replace(_documents(spark, sf_dir), key).select("doc_id", "text", "n_entities")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(mixing.sized(_documents(spark, sf_dir)).select("doc_id", "source", "size"), "mixing-sizes")
    return mixing.mixed(rows, mixing.allot(rows)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text; in one of ten documents the words from a place on become repetitions of those that follow it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    changes = F.coalesce(h % 10 == 0, F.lit(False))
    d = documents.select("doc_id", "text", F.when(changes, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(C.WORD), F.lit(0))).alias("words"), g.alias("g"))
    d = d.withColumn("n", F.size("words"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    period = F.slice("words", F.col("a") + 1, p)
    copies = F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), F.col("n") - F.col("a"))), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(with_planted_runs(_documents(spark, sf_dir))).withColumn("best", periodic.greatest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_documents(spark, sf_dir), columns=["doc_id"])
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_token_counts, op3_sharding, op4_simhash, op5_quality_rules, op6_bpe, op7_language, op8_exact_dedup, op9_pii, op10_mixing, op11_packing, op12_periodic, op13_fim)}

ORACLES = {
    "op5_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        a AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                     list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS BIGINT) AS n_capitals FROM d),
        w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM a),
        g AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL
                     THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g
              FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        h AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS twice FROM g),
        r AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM h),
        s AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM r GROUP BY doc_id),
        m AS (SELECT a.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, n_symbols, n_capitals,
                     CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
              FROM a LEFT JOIN s ON s.doc_id = a.doc_id),
        f AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
                     + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
                     + CASE WHEN 2 * n_capitals > word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
                     + CASE WHEN word_chars > 25 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f""",
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op13_fim": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
        r AS (SELECT *, CAST('0x' || h[1:8] AS UBIGINT) % (n + 1) AS r1, CAST('0x' || h[9:16] AS UBIGINT) % (n + 1) AS r2,
                     CAST('0x' || h[17:24] AS UBIGINT) % 100 AS r3, CAST('0x' || h[25:32] AS UBIGINT) % 100 AS r4 FROM d),
        c AS (SELECT *, CAST(least(r1, r2) AS BIGINT) AS a, CAST(greatest(r1, r2) AS BIGINT) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 90 THEN 'plain'
                          WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
        p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
