"""Substring matching with a large dictionary: an Aho-Corasick automaton as arrays, run over Arrow batches.

The trie of the keywords' UTF-8 bytes is a table of edges (open addressing, state and byte to state) with a failure
link for each state; it is built on the driver, at most `MOST_BYTES` of keywords at a time, and broadcast. A batch's texts are
cut into chunks that overlap by the longest keyword, and all chunks step through the automaton together, a byte of each at a time:
a step is a look-up over an array, and states without the edge follow their failure links. So a text is read once,
whatever the number of keywords, and no keyword meets a text that does not hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of keywords in one automaton, which takes about 60 times as many bytes at most.
MOST_BYTES = 4 << 20
#: Bytes of a chunk besides its overlap.
CHUNK = 1024


class Automaton:
    """keywords: distinct, none empty. codes: a number of each keyword's label; `find` gives these."""

    def __init__(self, keywords: list[bytes], codes: list[int]):
        self.longest = max(map(len, keywords), default=0)
        edges: dict[int, int] = {}
        own: dict[int, list[int]] = {}
        n = 1
        parent, by = [0], [0]
        for word, code in zip(keywords, codes, strict=True):
            state = 0
            for b in word:
                to = edges.get(state << 8 | b)
                if to is None:
                    to = edges[state << 8 | b] = n
                    parent.append(state)
                    by.append(b)
                    n += 1
                state = to
            own.setdefault(state, []).append(code)
        # failure links, nearest states first: a state's depth is above its parent's
        depth = np.zeros(n, np.int32)
        for s in range(1, n):
            depth[s] = depth[parent[s]] + 1
        fail = [0] * n
        for s in np.argsort(depth, kind="stable")[1:].tolist():
            if parent[s]:
                at = fail[parent[s]]
                while (to := edges.get(at << 8 | by[s])) is None and at:
                    at = fail[at]
                fail[s] = to or 0
        # the nearest state on the way of failure links, itself included, that ends a keyword
        ends = [0] * n
        for s in np.argsort(depth, kind="stable")[1:].tolist():
            ends[s] = s if s in own else ends[fail[s]]
        self.fail, self.ends = np.array(fail, np.int32), np.array(ends, np.int32)
        self.size = np.zeros(n + 1, np.int64)
        for s, found in own.items():
            self.size[s] = len(found)
        self.first = np.cumsum(self.size) - self.size
        self.codes = np.array([c for s in sorted(own) for c in own[s]], np.int32)
        self.root = np.array([edges.get(b, 0) for b in range(256)], np.int32)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        to = np.fromiter(edges.values(), np.int32, len(edges))
        self.bits = max(8, (3 * len(keys)).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.key[at] < 0)
            slots, k = np.unique(at[free], return_index=True)
            self.key[slots], self.to[slots] = keys[free[k]], to[free[k]]
            rest = np.ones(len(keys), bool)
            rest[free[k]] = False
            keys, to, at = keys[rest], to[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _edge(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state by an edge, 0 where there is none."""
        key = state.astype(np.int64) << 8 | byte
        at = self._slot(key)
        out, going = np.zeros(len(key), np.int32), np.arange(len(key))
        while len(going):
            there = self.key[at]
            hit = there == key
            out[going[hit]] = self.to[at[hit]]
            go = ~hit & (there >= 0)
            going, key, at = going[go], key[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.root[byte]
        inner = np.flatnonzero(state)
        s = state[inner]
        while len(inner):
            to = self._edge(s, byte[inner])
            out[inner[to > 0]] = to[to > 0]
            s, inner = self.fail[s[to == 0]], inner[to == 0]
            s, inner = s[s > 0], inner[s > 0]  # at the root, root's edge stands
        return out

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of the keywords in each text, distinct, in order. Text i is data[offsets[i] : offsets[i + 1]]."""
        sizes = np.diff(offsets)
        chunks = np.where(sizes > 0, -(-sizes // CHUNK), 0)
        text = np.repeat(np.arange(len(sizes)), chunks)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = offsets[text] + turn * CHUNK
        stop = np.minimum(start + CHUNK + max(self.longest - 1, 0), offsets[text + 1])
        order = np.argsort(start - stop, kind="stable")  # the longest first: those that go on are a prefix
        text, start, length = text[order], start[order], (stop - start)[order]
        state, met = np.zeros(len(text), np.int32), []
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, "left"))
            state = self._step(state[:n], data[start[:n] + i])
            hit = np.flatnonzero(self.ends[state])
            if len(hit):
                met.append(text[hit] << 32 | self.ends[state[hit]])
        met = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        found = []
        while len(met):
            of, s = met >> 32, (met & 0xFFFFFFFF).astype(np.int64)
            n = self.size[s]
            codes = self.codes[np.arange(int(n.sum())) + np.repeat(self.first[s] - (np.cumsum(n) - n), n)]
            found.append(np.repeat(of, n) << 32 | codes)
            s = self.ends[self.fail[s]]
            met = np.unique((of << 32 | s)[s > 0])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both >> 32, (both & 0xFFFFFFFF).astype(np.int64)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, and where each begins; one place more for the end."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def tag(articles: DataFrame, column: Column, terms: DataFrame, key: str = "article_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, label: the labels of which a keyword stands in the lower-case text. terms: keyword, label, of any number.

    A dictionary of more than `most_bytes` is dealt into parts by hash, each a pass over the texts. Null texts
    have no labels; empty and null keywords match nothing; a key of several rows gets the labels of each of them once.
    """
    spark = articles.sparkSession
    low = terms.select(F.lower("keyword").alias("keyword"), "label").where("keyword <> '' and label is not null").distinct()
    total = low.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
    parts = max(1, -(-total // most_bytes))
    kind, out = articles.schema[key].dataType.simpleString(), None
    rows = articles.select(F.col(key).alias("key"), F.lower(column).alias("text"))
    for i in range(parts):
        part = [(r.keyword.encode(), r.label) for r in low.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == i).collect()]
        names = sorted({label for _, label in part})
        code = {label: k for k, label in enumerate(names)}
        sent = spark.sparkContext.broadcast((Automaton([w for w, _ in part], [code[label] for _, label in part]), names))

        def run(batches, sent=sent):
            automaton, names = sent.value
            labels = pa.array(names, pa.string())
            for batch in batches:
                text, found = automaton.find(*texts(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), labels.take(pa.array(found))], ["key", "label"])

        got = rows.mapInArrow(run, f"key {kind}, label string")
        out = got if out is None else out.unionByName(got)
    return out.withColumnRenamed("key", key).distinct()
