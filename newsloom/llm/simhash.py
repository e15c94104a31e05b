"""SimHash near-dedup with BK-trees.

Every text gets a 64-bit fingerprint of its word shingles; fingerprints that differ in at most `radius` bits are
linked. Equal fingerprints are one point, held with the smallest doc_id, so copies cost nothing after that.

Search. The 64 bits fall into parts; two fingerprints within the radius agree on at least
`parts - radius` of them, so each point goes to one shard for each choice of that many parts (the number of parts grows with
the number of points, so that a shard by chance holds few). Within a shard BK-trees find the links: a node's children are keyed
by their integer Hamming distance to it, and a search follows only edges within the radius of the distance to the
node. The shards of a run of rows are a forest of such trees, built and searched level by level, all at once.

A shard of more than `most` points is dealt, by hash, into slices. Each slice becomes one tree, a row of
bytes of bounded size; trees are broadcast, at most BROADCAST bytes at a time, and the shard's points, spread over all tasks, are
searched in every tree of their shard. So no task holds an unbounded group, no row is multiplied and no link is
lost. What a task found leaves it as a spanning forest of its links, at most one link for each point it has: the
components are the same, and a group of near copies gives no square of pairs.

Links of all shards then go through connected components over shared storage.

Cases: null and empty texts and texts of white space have fingerprint 0 and link like any other; texts of fewer
words than a shingle are one shingle; repeated rows are one point and all come back; a null doc_id is returned
with its component and is never a component's smallest unless all are null; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components


def fingerprint(text: str | None, size: int = 4) -> int:
    """The SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and white space of ASCII
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, 42)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    hashed = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - size + 1
    for first in range(0, n, 4096):
        last = min(n, first + 4096)
        h = np.array([hashed(line[a:b], 42) for a, b in zip(starts[first:last].tolist(), ends[first + size - 1 : last + size - 1].tolist(), strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, size: int = 4, row: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and rid (the column `row`, null if none is given) of each row."""
    C.small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(1)], ["doc_id", "fp", "rid"])
        C.trim()

    rid = F.lit(None).cast("long") if row is None else F.col(row)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, rid long")


#: Steps of a search that are taken at once.
STEPS = 1 << 14


class BKTree:
    """Nodes are points; the children of a node are keyed by their Hamming distance to it.

    Built level by level and held in arrays: the children of node v are nodes `first[v]` to `first[v] + count[v]`,
    in order of their edges' distances, `edge`. With `shard` (a number below `shards` for each point, none without
    a point) it is a forest of one tree for each shard, whose roots are the nodes of the shards' numbers.
    """

    def __init__(self, points: np.ndarray, shard: np.ndarray | None = None, shards: int = 1):
        n = len(points)
        self.order = np.zeros(n, np.int64)  # node -> place in points
        self.first, self.count, self.edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint8)
        self.point = np.zeros(n, np.uint64)
        if not n:
            return
        # a group: points that still hang below one edge; its first becomes the node
        group = np.zeros(n, np.int64) if shard is None else shard
        roots = np.unique(group, return_index=True)[1]
        node, level = shards, np.arange(shards)  # ids of this level's nodes, by group
        self.order[:shards], self.point[:shards] = roots, points[roots]
        rest = np.ones(n, bool)
        rest[roots] = False
        left, group = np.flatnonzero(rest), group[rest]
        while len(left):
            parent = level[group]
            d = np.bitwise_count(points[left] ^ self.point[parent])
            by = np.lexsort((d, parent))
            left, parent, d = left[by], parent[by], d[by]
            new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (d[1:] != d[:-1])])
            heads = np.flatnonzero(new)
            ids = node + np.arange(len(heads))
            self.order[ids], self.point[ids], self.edge[ids] = left[heads], points[left[heads]], d[heads]
            owners, where, many = np.unique(parent[heads], return_index=True, return_counts=True)
            self.first[owners], self.count[owners] = ids[where], many
            node += len(heads)
            group = (np.cumsum(new) - 1)[~new]
            left, level = left[~new], ids

    def within(self, queries: np.ndarray, radius: int, root: np.ndarray | None = None):
        """Pairs (place in queries, place in points) within the radius, in runs; root: each query's shard.

        Steps are (query, node) pairs; what a run of STEPS leads to is followed to its end before the next run, so that
        memory is bounded by the depth of the trees, however many nodes a query meets.
        """
        if not len(self.point):
            return
        runs = [(np.arange(len(queries)), np.zeros(len(queries), np.int64) if root is None else root)]
        while runs:
            q, v = runs.pop()
            if len(q) > STEPS:
                runs.append((q[STEPS:], v[STEPS:]))
                q, v = q[:STEPS], v[:STEPS]
            d = np.bitwise_count(queries[q] ^ self.point[v]).astype(np.int16)
            near = d <= radius
            if near.any():
                yield q[near], self.order[v[near]]
            many = self.count[v]
            kids = np.repeat(self.first[v] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            q, d = np.repeat(q, many), np.repeat(d, many)
            go = np.abs(self.edge[kids].astype(np.int16) - d) <= radius
            if go.any():
                runs.append((q[go], kids[go]))

    def dumped(self) -> bytes:
        """The tree as bytes, 21 for each point; places in points are not kept (nodes are known by their points)."""
        parts = (self.point, self.first.astype(np.uint32), self.count.astype(np.uint32), self.edge)
        return np.uint32(len(self.point)).tobytes() + b"".join(x.tobytes() for x in parts)

    @classmethod
    def loaded(cls, data: bytes) -> "BKTree":
        """A tree from its bytes; `order` numbers its nodes."""
        out, n, at = cls(np.zeros(0, np.uint64)), int(np.frombuffer(data, np.uint32, 1)[0]), 4
        for name, kind in (("point", np.uint64), ("first", np.uint32), ("count", np.uint32), ("edge", np.uint8)):
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            setattr(out, name, x.astype(np.int64) if kind is np.uint32 else x)
        out.order = np.arange(n)
        return out


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """Links enough to join what the pairs join; pairs: runs of two arrays of places below n."""
    root = np.arange(n)
    for a, b in pairs:
        keep = a != b
        a, b = a[keep], b[keep]
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:  # every point straight under its root
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return [(i, int(r)) for i, r in enumerate(root.tolist()) if r != i]


def plan(points: int, radius: int) -> list[tuple[int, ...]]:
    """The choices of parts for so many points: each part's mask's bits, as (first bit, end) of `parts` by combination."""
    parts = radius + 1
    # bits that a shard's points share; by chance a shard then holds points / 2**bits
    while parts < min(radius + 4, 64) and points / 2.0 ** (64 * (parts - radius) / parts) > 4:
        parts += 1
    return parts, list(combinations(range(parts), parts - radius))


def _masks(parts: int, choices) -> list[int]:
    edges = [64 * i // parts for i in range(parts + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(parts)]
    return [sum(part[i] for i in c) for c in choices]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: Bytes of trees that are broadcast at a time.
BROADCAST = 32 << 20


def links(points: DataFrame, radius: int = 4, most: int = 4096) -> DataFrame:
    """points: distinct fp. Result: a, b, links that join all fp within the radius of one another."""
    n = points.count()
    parts, choices = plan(n, radius)
    masks = [_signed(m) for m in _masks(parts, choices)]
    # (shard, fp): the shard's number and the fingerprint under its mask
    put = points.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "under"))
    size = put.groupBy("c", "under").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    shards = C.written(put.join(size.where("lo <> hi").select("c", "under", "n"), ["c", "under"]), "shards")
    # many shards go through one call: rows of a partition are sorted by shard, so that a shard is a run of rows
    small = shards.where(F.col("n") <= most).select("c", "under", "fp").repartition("c", "under").sortWithinPartitions("c", "under")

    def run(batches):
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            c, under = rows["c"].to_numpy(), rows["under"].to_numpy()
            other = np.flatnonzero((c != c[-1]) | (under != under[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield search(rows.iloc[:last])
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield search(held)
        held = None
        C.trim()

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        c, under, fp = (rows[x].to_numpy() for x in ("c", "under", "fp"))
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (under[1:] != under[:-1])])
        shard = np.cumsum(new) - 1
        tree = BKTree(fp.view(np.uint64), shard, int(shard[-1]) + 1)
        return _ends(fp, forest(len(fp), tree.within(fp.view(np.uint64), radius, shard)))

    found = small.mapInPandas(run, "a long, b long")
    large = shards.where(F.col("n") > most).select("c", "under", "n", "fp")
    if not large.isEmpty():
        found = found.unionByName(_large_links(large, radius, most))
    return found.distinct()


def _ends(fp: np.ndarray, found: list[tuple[int, int]]) -> pd.DataFrame:
    f = np.array(found, np.int64).reshape(-1, 2)
    a, b = fp[f[:, 0]], fp[f[:, 1]]
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _large_links(large: DataFrame, radius: int, most: int) -> DataFrame:
    """Links of shards of more than `most` points: each slice's tree meets all points of its shard, by broadcast."""
    spark = large.sparkSession
    slices = F.ceil(F.col("n") / most).cast("int")
    sliced = large.select("c", "under", F.pmod(F.xxhash64("fp", F.lit(1)), slices).cast("int").alias("s"), "fp")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = BKTree(np.sort(rows["fp"].to_numpy()).view(np.uint64))
        return pd.DataFrame({"c": rows["c"].iloc[:1], "under": rows["under"].iloc[:1], "tree": [tree.dumped()]})

    trees = sliced.groupBy("c", "under", "s").applyInPandas(build, "c int, under long, tree binary")
    trees = C.written(trees.withColumn("size", F.octet_length("tree")), "trees")
    total = trees.agg(F.sum("size")).first()[0]
    rounds = -(-total // BROADCAST)
    if rounds > 1:  # trees are of about one size and dealt by hash, half as many rounds more leave room for uneven ones
        rounds += rounds // 2 + 1
    points = C.written(large.select("c", "under", "fp").repartition(spark.sparkContext.defaultParallelism * 2, F.xxhash64("fp", F.lit(2))), "large-shards")
    every = None
    for k in range(rounds):
        mine = trees.where(F.pmod(F.xxhash64("c", "under", "tree"), F.lit(rounds)) == k)
        held: dict = {}
        for r in mine.select("c", "under", "tree").toLocalIterator():  # about BROADCAST bytes
            held.setdefault((r.c, r.under), []).append(bytes(r.tree))
        sent = spark.sparkContext.broadcast(held)

        def meet(batches):
            loaded = {shard: [BKTree.loaded(t) for t in ts] for shard, ts in sent.value.items()}
            for batch in batches:
                for shard, rows in batch.groupby(["c", "under"]):
                    trees_ = loaded.get((int(shard[0]), int(shard[1])), [])
                    if not trees_:
                        continue
                    asked = rows["fp"].to_numpy()
                    known = np.concatenate([asked, *[t.point.view(np.int64) for t in trees_]])
                    bases = np.cumsum([len(asked), *[len(t.point) for t in trees_]])
                    pairs = ((q, p + base) for t, base in zip(trees_, bases.tolist(), strict=False) for q, p in t.within(asked.view(np.uint64), radius))
                    # a point and its own node are one: joined without a link
                    fp, one = np.unique(known, return_inverse=True)
                    yield _ends(fp, forest(len(fp), ((one[a], one[b]) for a, b in pairs)))

        links_ = C.written(points.mapInPandas(meet, "a long, b long").distinct(), "large-links")
        every = links_ if every is None else every.unionByName(links_)
        sent.destroy()
    return every


def near_duplicates(documents: DataFrame, size: int = 4, radius: int = 4, most: int = 4096, row: str | None = None) -> DataFrame:
    """doc_id, fp (signed), component (its smallest fingerprint), component_id and rid (the column `row`) of each row."""
    rows = C.written(fingerprints(documents, size, row), "fingerprints")
    points = C.written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "points")
    linked = C.written(components(links(points.select("fp"), radius, most)), "linked")
    # the smallest doc_id of a component; a fingerprint that links to none is its own
    named = points.join(linked.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    alone = points.join(linked, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("fp").alias("component"), F.col("low").alias("component_id"))
    names = C.written(named.select("fp", "component").join(least, "component").select("fp", "component", "component_id").unionByName(alone), "names")
    return rows.join(names, "fp").select("doc_id", "fp", "component", "component_id", "rid")


def hexed(fp):
    """A signed fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(documents: DataFrame, size: int = 4, radius: int = 4, most: int = 4096) -> DataFrame:
    """The rows of documents that stay: of each component the one with the smallest doc_id (of rows that share it, one)."""
    name = C.free_name(documents, "rid")
    rows = C.numbered(documents, name)
    found = near_duplicates(rows, size, radius, most, name)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best")
    stay = found.groupBy("component").agg(best).select("component", F.col("best.rid").alias("stays"))
    gone = C.written(found.join(stay, "component").where("rid <> stays").select("rid"), "near-copies")
    return C.without(rows, name, gone).select(*documents.columns)
