"""Exact and near duplicates, shards: against plain versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import exact_dedup, queries, sharding, simhash
from newsloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)


def squeezed(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_classes(spark):
    long = "x" * 70000
    rows = [(5, "a b"), (3, "a \t\n b"), (4, None), (9, ""), (1, long + "1"), (2, long + "2"), (7, long + "1"), (3, "a b"), (None, "z"), (6, " "), (8, "a b ")]
    got = exact_dedup.classes(docs(spark, rows), stride=4).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(squeezed(t), []).append(i)
    assert len(got) == len(rows)
    want = Counter((i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.kept <= (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup.deduplicate(docs(spark, rows), stride=4)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(groups)


def test_exact_empty(spark):
    assert exact_dedup.classes(docs(spark, []).limit(0)).count() == 0


def plain_fingerprint(t):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius=4):
    """fps: id -> fingerprint; smallest id reachable."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "one", "A b C", "a b c d e f g", "É é Ä x y z", "a\x0bb\x0cc\x1cd e", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_op4_equals_brute_force(spark):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in table.items()}
    want = plain_components(fps)
    got = queries.op4_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("most", [4096, 3])
def test_links_of_dense_groups(spark, most):
    """Chains and balls of near fingerprints, also when shards are cut into slices."""
    draw = np.random.default_rng(3)
    points = {0, (1 << 64) - 1}
    for _ in range(4):
        x = int(draw.integers(0, 1 << 63))
        for _ in range(25):
            points.add(x)
            for b in draw.choice(64, 4, replace=False):
                x ^= 1 << int(b)
    ps = sorted(points)
    want = plain_components(dict(enumerate(ps)))
    signed = [p - (1 << 64) if p >> 63 else p for p in ps]
    d = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.component for r in components(simhash.links(d, most=most)).collect()}
    name = lambda i: found.get(signed[i], signed[i])
    for i in range(len(ps)):
        for j in range(i):
            assert (name(i) == name(j)) == (want[i] == want[j])


def test_bk_tree_finds_all():
    draw = np.random.default_rng(1)
    ps = np.unique(draw.integers(0, 1 << 12, 500).astype(np.uint64) << np.uint64(20))
    got = {(a, b) for q, p in simhash.BKTree(ps).within(ps, 4) for a, b in zip(q.tolist(), p.tolist(), strict=True)}
    d = np.bitwise_count(ps[:, None] ^ ps[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 4), strict=True)}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two three four five six"), (4, "one two three four five six"), (None, "alone here with some words"), (None, "another one of quite other words")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, None), (None, None)])
    assert simhash.deduplicate(docs(spark, rows)).count() == 4
    assert simhash.near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_components_of_a_path(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(d).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_shards_fit(spark):
    rows = [(i, "w" * (i % 97)) for i in range(3000)]
    r = sharding.assign(docs(spark, rows), limit=5000).collect()
    assert len(r) == 3000 and sorted(x.doc_id for x in r) == list(range(3000))
    bytes_, of = Counter(), {}
    for x in r:
        bytes_[x.shard_id] += x.n_bytes
        of.setdefault(x.shard_id, x.shard_bytes)
        assert x.n_bytes == x.doc_id % 97 and not x.over_limit
    assert dict(bytes_) == of and max(bytes_.values()) <= 5000
    ids = sorted(bytes_)  # a prefix code: no shard's bits begin another's, and a split was needed for each
    assert not any(b.startswith(a) for a, b in zip(ids, ids[1:], strict=False))
    for s in ids:
        assert sum(n for k, n in bytes_.items() if k.startswith(s[:-1])) > 5000


def test_shards_of_repeated_and_large_rows(spark):
    rows = [(1, "x" * 100)] * 500 + [(2, "y" * 9000), (3, None), (None, "")]
    r = sharding.assign(docs(spark, rows), limit=1000).collect()
    bytes_ = Counter()
    for x in r:
        bytes_[x.shard_id] += x.n_bytes
    assert len(r) == 503 and [x.doc_id for x in r if x.over_limit] == [2]
    assert sorted(bytes_.values())[-2] <= 1000
    assert sharding.assign(docs(spark, []).limit(0)).count() == 0
    clash = docs(spark, rows).withColumn("shard_id", F.lit("old")).withColumn("h", F.lit(1))
    assert sharding.assign(clash, limit=1000).where("shard_id = 'old'").isEmpty()


def plain_shards(rows, limit):
    """Extendible hashing by hand: a bucket over the limit splits on one more bit. rows: (hash, bytes)."""
    out, todo = {}, [("", rows)]
    while todo:
        prefix, held = todo.pop()
        if sum(b for _, b in held) <= limit or len(prefix) == 64:
            out |= {h: prefix for h, _ in held}
        else:
            todo += [(prefix + bit, part) for bit in "01" if (part := [r for r in held if f"{r[0]:064b}"[len(prefix)] == bit])]
    return out


@pytest.mark.parametrize("limit", [64 << 20, 30_000])
def test_op3_equals_brute_force(spark, monkeypatch, limit):
    """The query as it is, and with a limit at which the table splits."""
    assign = sharding.assign
    monkeypatch.setattr(sharding, "assign", lambda d, **k: assign(d, limit=limit))
    got = queries.op3_sharding(spark, SF).collect()
    text = F.coalesce("text", F.lit(""))
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64(text)).alias("h"), F.octet_length(text).alias("n")).collect()
    want = plain_shards([(r.h % (1 << 64), r.n) for r in rows], limit)
    of = {r.doc_id: want[r.h % (1 << 64)] for r in rows}
    assert {r.doc_id: r.shard_id for r in got} == of
    size, many = Counter(), Counter(of.values())
    for r in rows:
        size[of[r.doc_id]] += r.n
    assert all((r.shard_bytes, r.shard_rows, r.over_limit) == (size[r.shard_id], many[r.shard_id], size[r.shard_id] > limit) for r in got)


def test_clashing_columns(spark):
    names = ["n_bytes", "shard_id", "pages", "h", "cell", "shard", "_n_h", "rid", "flag", "fp", "component", "digits", "size", "name"]
    d = docs(spark, [(i, f"some words number {i % 3} in a row") for i in range(20)])
    for n in names:
        d = d.withColumn(n, F.lit("mine"))
    assert sharding.assign(d, limit=200).count() == 20
    for out, n in ((exact_dedup.deduplicate(d), 3), (simhash.deduplicate(d), None)):
        assert out.columns == d.columns and out.where("rid = 'mine' and flag = 'mine'").count() == out.count() == (n or out.count()) > 0


def test_filter_misses_nothing(spark):
    from newsloom.llm import common

    rows, keys = spark.range(3000).withColumnRenamed("id", "k"), spark.range(0, 3000, 7)
    got = common.flagged(rows, F.col("k"), keys, "f").where("f").select("k")
    assert {r.id for r in keys.collect()} <= {r.k for r in got.collect()} and got.count() < 800
    assert {r.k for r in common.without(rows, "k", keys).collect()} == set(range(3000)) - set(range(0, 3000, 7))


def test_a_forest_finds_what_trees_find():
    draw = np.random.default_rng(4)
    points = draw.integers(0, 1 << 10, 400).astype(np.uint64)
    shard = np.sort(draw.integers(0, 60, 400))
    shard = np.unique(shard, return_inverse=True)[1]
    order = np.lexsort((points, shard))
    points, shard = points[order], shard[order]
    got = {(a, b) for q, p in simhash.BKTree(points, shard, int(shard[-1]) + 1).within(points, 2, shard) for a, b in zip(q.tolist(), p.tolist(), strict=True)}
    want = {(i, j) for i in range(400) for j in range(400) if shard[i] == shard[j] and (int(points[i]) ^ int(points[j])).bit_count() <= 2}
    assert got == want
    one = simhash.BKTree.loaded(simhash.BKTree(points[:50]).dumped())
    near = {(int(points[q]), int(one.point[p])) for qs, ps in one.within(points[:50], 2) for q, p in zip(qs, ps, strict=True)}
    assert near == {(int(a), int(b)) for a in points[:50] for b in points[:50] if (int(a) ^ int(b)).bit_count() <= 2}


def test_large_shards_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST", 3000)
    test_links_of_dense_groups(spark, 12)
