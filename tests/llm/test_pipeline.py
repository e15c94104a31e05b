"""The pipeline's stages against plain versions over the smallest table."""

import re
from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_dedup import plain_components, plain_fingerprint, squeezed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    seen = docs
    for name, stage in cp.STAGES:
        before = {r.doc_id for r in seen.select("doc_id").collect()}
        out = stage(spark, seen, SF)
        if name != "bpe":
            assert out.columns == docs.columns
        got = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "language_id":
            assert set(got) == before  # all of these are in a known language
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(squeezed(rows[i].text), i)
            assert got == Counter(first.values())
        elif name == "simhash_near_dedup":
            assert got == Counter(set(plain_components({i: plain_fingerprint(rows[i].text) for i in before}).values()))
        elif name == "mixing":
            words = sum(len(re.findall("[^\x20\x09-\x0d]+", rows[i].text)) * n for i, n in got.items())
            total = sum(len(re.findall("[^\x20\x09-\x0d]+", rows[i].text)) for i in before)
            assert abs(words - 1.5 * total) < 0.03 * total and max(got.values()) <= 2
        else:
            assert got == Counter(r.doc_id for r in seen.select("doc_id").collect())
        seen = out
    assert cp.run(spark, SF).count() == seen.count()


def test_pages_are_evidence(spark, monkeypatch):
    """The language stage gives each document what its page says."""
    given, identify = [], cp.language.identify
    monkeypatch.setattr(cp.language, "identify", lambda *a, **k: (given.append(k.get("facts_of")), identify(*a, **k))[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert cp.language_id(spark, docs, SF).columns == docs.columns
    assert given[0] is not None and given[0].where("doc_id is null or declared is null").isEmpty()


def test_run_without_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
