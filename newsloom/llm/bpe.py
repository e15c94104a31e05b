"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a block of documents form a small corpus. It is held as one linked sequence of symbols
with an inverted index from token pair to the places where the pair stands. Merges are replayed over this whole
corpus in rank order, one rank at a time: the places of its pairs are taken from the index and joined, all words
together, and only the two neighbours of each place are looked up again and go to the index under their new pairs.
Words that share a pair share the work of finding it; nothing is scanned twice.

Texts are cut first where bytes show that the pre-token pattern cuts too (`KNOWN`; by any other pattern they are
matched whole). The distinct pieces of a block are found as a column, and so are the ids that they give and, from these, those of
each text: no step goes over the words of the texts one by one. A store bounded in size holds the latest pieces with
their ids; only pieces that it does not hold go through the pattern and are merged.

Cases: null and empty texts give no ids. Where a merge makes a pair of a rank as low as its own, the word's places to
the right of it wait until that pair is merged, as one word alone would be encoded. Repeated rows are encoded each; other columns are ignored. Ids that
are not in the vocabulary raise KeyError when decoded.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The pattern by which `_pieces` cuts: letters, digits and other characters in runs, each with a space before it or none.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of bytes: a letter, a digit, a sign, or 0 for all that need a closer look (apostrophes may begin a match of letters).
KINDS = np.array([(33 <= b < 127 and b != 39) * (1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3) for b in range(256)], np.uint8)
#: The id of a pair that makes nothing.
NONE = np.int32(2**31 - 1)
#: Pre-tokens that are merged together at once, in bytes.
BLOCK = 2 << 20
#: A piece of more bytes is not held in the store.
LONG = 256


class PairTable:
    """The id that each pair of ids makes, by open addressing over a table at most a quarter full."""

    def __init__(self, pairs: dict[int, int], n: int):
        self.n = n
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        made = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.key, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.key[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            self.key[slots], self.made[slots] = keys[free[first]], made[free[first]]
            rest = np.ones(len(keys), bool)
            rest[free[first]] = False
            keys, made, at = keys[rest], made[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair makes; NONE for nothing."""
        key = a.astype(np.int64) * self.n + b
        at = self._slot(key)
        there = self.key[at]
        out = np.where(there == key, self.made[at], NONE)
        left = np.flatnonzero((there != key) & (there >= 0))
        key, at = key[left], at[left]
        for _ in range(self.probes):
            if not len(left):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.key[at]
            hit = there == key
            out[left[hit]] = self.made[at[hit]]
            go = ~hit & (there >= 0)
            left, key, at = left[go], key[go], at[go]
        return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


#: Fewer places than this are merged one by one: a step over arrays would cost more.
FEW = 128
NONE_ = int(NONE)


class PairIndex:
    """Token pair -> places where it stands, with the ranks that have places in a heap. A place may be out of date; who takes it looks."""

    def __init__(self, n: int):
        self.n, self.places, self.pairs, self.heap = n, {}, {}, []

    def put(self, sym: np.ndarray, after: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Places with a pair."""
        if not len(at):
            return
        key = sym[at].astype(np.int64) * self.n + sym[after[at]]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = [*starts[1:].tolist(), len(at)]
        for k, r, a, b in zip(key[starts].tolist(), rank[at[starts]].tolist(), starts.tolist(), ends, strict=True):
            self._open(k, r).append(at[a:b])

    def add(self, key: int, r: int, place: int) -> None:
        self._open(key, r).append(place)

    def _open(self, key: int, r: int) -> list:
        if (found := self.places.get(key)) is None:
            found = self.places[key] = []
            if (pairs := self.pairs.get(r)) is None:
                self.pairs[r] = [key]
                heapq.heappush(self.heap, r)
            else:
                pairs.append(key)
        return found

    def lowest(self) -> int | None:
        return self.heap[0] if self.heap else None

    def take(self, r: int) -> np.ndarray:
        """All places of the pairs of the lowest rank."""
        heapq.heappop(self.heap)
        single, runs = [], []
        for key in self.pairs.pop(r):
            for x in self.places.pop(key):
                (single if isinstance(x, int) else runs).append(x)
        if not runs:
            return np.array(single, np.int64)
        return np.concatenate([*runs, np.array(single, np.int64)]) if single or len(runs) > 1 else runs[0]


class Ranks:
    """The rank file at a path: ids of byte strings, and the byte string of each id. An id is the rank of the merge that makes it."""

    def __init__(self, path: str, pattern: str):
        self.ids: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ids[base64.b64decode(token)] = int(rank)
        self.bytes = {i: t for t, i in self.ids.items()}
        every = range(max(self.bytes) + 1)
        #: By id: in decimal with a space before, and the bytes.
        self.spelled = [pa.array([b" %d" % i for i in every], pa.large_binary()), pa.array([self.bytes.get(i, b"") for i in every], pa.large_binary())]
        self.first = np.array([self.ids[bytes([i])] for i in range(256)], np.int32)
        self.cut, self.known = regex.compile(pattern).findall, pattern == KNOWN
        n, ids, pairs = max(self.bytes) + 1, self.ids, {}
        for token, made in ids.items():
            for k in range(1, len(token)):
                if (x := ids.get(token[:k])) is not None and (y := ids.get(token[k:])) is not None:
                    pairs[x * n + y] = made
        self.pair = PairTable(pairs, n)
        #: Ids that are in a pair of a rank as low as their own.
        self.low = np.zeros(n, bool)
        keys, made = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        for part in np.divmod(keys, n):
            self.low[part[made <= part]] = True
        self.pairs, self.n = pairs, n

    def replay(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of these sizes in bytes, one word after the other, and how many each has: all merges of the block, in rank order."""
        sym = self.first[data]
        total = len(sym)
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(size)), size)
        after = np.arange(1, total + 1)
        after[ends[size > 0] - 1] = -1
        before = np.arange(-1, total - 1)
        before[(ends - size)[size > 0]] = -1
        rank = np.full(total, NONE, np.int32)
        has = np.flatnonzero(after >= 0)
        rank[has] = self.pair(sym[has], sym[has + 1])
        index = PairIndex(self.n)
        index.put(sym, after, rank, has[rank[has] != NONE])
        while (r := index.lowest()) is not None:
            places = index.take(r)
            if len(places) < FEW:
                self._merge_few(r, places, sym, after, before, rank, word, index)
            else:
                self._merge_many(r, places, sym, after, before, rank, word, index)
        left = sym >= 0
        return sym[left], np.bincount(word[left], minlength=len(size))

    def _merge_many(self, r, places, sym, after, before, rank, word, index) -> None:
        """One rank's places of all words at once."""
        p = _distinct(places)
        p = p[rank[p] == r]  # the others were merged away, or their pair changed
        if not len(p):
            return
        # of places that share a symbol every second one stands
        tied = np.concatenate([[False], after[p[:-1]] == p[1:]])
        runs = np.flatnonzero(~tied)
        p = p[(np.arange(len(p)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(p)]])))) % 2 == 0]
        q, left = after[p], before[p]
        right = after[q]
        lower = np.zeros(len(p), bool)
        if self.low[r]:  # the pairs that each makes when it comes, those left of it done and those right of it not
            joined = np.concatenate([[False], q[:-1] == left[1:]])
            l, m = left >= 0, right >= 0
            lower[l] = self.pair(np.where(joined[l], r, sym[left[l]]), np.full(l.sum(), r)) <= r
            lower[m] |= self.pair(np.full(m.sum(), r), sym[right[m]]) <= r
        if lower.any():  # the word's places after such a pair wait
            w = word[p]
            firsts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            so_far = np.cumsum(lower) - lower
            go = so_far == np.repeat(so_far[firsts], np.diff(np.concatenate([firsts, [len(w)]])))
            wait, p, q, right = p[~go], p[go], q[go], right[go]
        else:
            wait = p[:0]
        sym[p], sym[q], rank[q] = r, -1, NONE
        after[p] = right
        before[right[right >= 0]] = p[right >= 0]
        back = before[p]
        touched = _distinct(np.concatenate([p, back[back >= 0]]))
        nxt = after[touched]
        rank[touched] = np.where(nxt >= 0, self.pair(sym[touched], sym[nxt]), NONE)
        index.put(sym, after, rank, touched[rank[touched] != NONE])
        index.put(sym, after, rank, wait[rank[wait] == r])

    def _merge_few(self, r, places, sym, after, before, rank, word, index) -> None:
        """A rank of few places: one after the other, from the left."""
        get, n, held = self.pairs.get, self.n, -1
        sym_, after_, before_, rank_, word_ = (memoryview(x) for x in (sym, after, before, rank, word))
        for p in sorted(places.tolist()):
            if rank_[p] != r:
                continue
            if word_[p] == held:  # a pair as low stands left of it
                index.add(sym_[p] * n + sym_[after_[p]], r, p)
                continue
            q = after_[p]
            right, left = after_[q], before_[p]
            sym_[p], sym_[q], rank_[q], after_[p] = r, -1, NONE_, right
            rank_[p] = NONE_
            if right >= 0:
                before_[right] = p
                key = r * n + sym_[right]
                if (x := get(key)) is not None:
                    rank_[p] = x
                    index.add(key, x, p)
                    if x <= r:
                        held = word_[p]
            if left >= 0:
                key = sym_[left] * n + r
                x = get(key)
                rank_[left] = NONE_ if x is None else x
                if x is not None:
                    index.add(key, x, left)
                    if x <= r:
                        held = word_[p]

    def encode(self, text: str) -> list[int]:
        words = [w.encode("utf-8", "surrogatepass") for w in self.cut(text)]
        return self.replay(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text, `ends` of them at its end, in decimal (a space before each) and as the bytes they decode to."""
        out = []
        for table in self.spelled:
            parts, lengths = [], pc.binary_length(table).to_numpy()
            for at in range(0, len(ids), 1 << 20):
                parts.append(_columns(table.take(pa.array(ids[at : at + (1 << 20)])))[1])
            whole = b"".join(parts)
            at = np.concatenate([[0], np.cumsum(lengths[ids])])[ends].tolist()
            out.append([whole[x:y] for x, y in zip([0, *at], at, strict=False)])
        return out[0], out[1]


def _columns(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of an array of large strings: where each begins and the last ends, and the bytes."""
    _, at, data = strings.buffers()
    at = np.frombuffer(at, np.int64)[strings.offset : strings.offset + len(strings) + 1] if at else np.zeros(1, np.int64)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pa.array(values, pa.int32()))


def _sizes(lists: pa.LargeListArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


class Store:
    """The ids of the byte strings that were asked for last, `most` at most, in columns."""

    def __init__(self, most: int):
        self.most, self.keys, self.ids = most, pa.array([], pa.large_binary()), pa.array([], pa.large_list(pa.int32()))

    def ask(self, keys: pa.LargeBinaryArray, make: Callable[[pa.LargeBinaryArray], pa.LargeListArray]) -> pa.LargeListArray:
        """The ids of distinct keys; `make` makes those that are not held."""
        place = pc.index_in(keys, value_set=self.keys)
        new = place.is_null()
        made = make(keys.filter(new))
        new, place = new.to_numpy(zero_copy_only=False), place.fill_null(0).to_numpy().astype(np.int64)
        old = np.ones(len(self.keys), bool)
        old[place[~new]] = False
        place[new] = len(self.ids) + np.arange(len(made))
        out = pa.concat_arrays([self.ids, made]).take(pa.array(place))
        now = pa.array(np.flatnonzero(pc.binary_length(keys).to_numpy() <= LONG)[: self.most])
        old = pa.array(np.flatnonzero(old)[: self.most - len(now)])
        self.keys = pa.concat_arrays([keys.take(now), self.keys.take(old)])
        self.ids = pa.concat_arrays([out.take(now), self.ids.take(old)])
        return out


def _merged(words: pa.LargeBinaryArray, ranks: Ranks) -> pa.LargeListArray:
    """The ids of pre-tokens, merged in blocks of about so many bytes."""
    at, data = _columns(words)
    size, ids, sizes = np.diff(at), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    first = 0
    while first < len(size):
        end = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        i, n = ranks.replay(data[at[first] : at[end]], size[first:end])
        ids.append(i)
        sizes.append(n)
        first = end
    return _lists(np.concatenate(ids), np.concatenate(sizes))


def _encoded(pieces: pa.LargeBinaryArray, ranks: Ranks) -> pa.LargeListArray:
    """The ids of pieces, by those of their distinct pre-tokens.

    Pieces without a line feed and without white space at their ends (but one space before) are matched in one pass,
    a line feed between them: there it is always a match of its own.
    """
    plain = _plain(*_columns(pieces)) if ranks.known else np.zeros(len(pieces), bool)
    rest, tokens, n = np.flatnonzero(~plain), [], []
    for p in pieces.take(pa.array(rest)).cast(pa.large_string()).to_pylist():
        found = ranks.cut(p)
        tokens += found
        n.append(len(found))
    n_rest, run = len(tokens), np.flatnonzero(plain)
    if len(run):
        tokens += ranks.cut("\n".join(pieces.take(pa.array(run)).cast(pa.large_string()).to_pylist()))
    tokens = pa.array(tokens, pa.large_string()).cast(pa.large_binary()).dictionary_encode()
    codes = tokens.indices.to_numpy()
    between = codes == pc.index(tokens.dictionary, b"\n").as_py()
    between[:n_rest] = False
    ends = np.append(np.flatnonzero(between), len(codes)) - np.arange(1, len(run) + 1) + 1 if len(run) else np.zeros(0, np.int64)
    ids = _merged(tokens.dictionary, ranks).take(pa.array(codes[~between]))
    ends = np.concatenate([[0], np.cumsum(_sizes(ids))])[np.concatenate([np.cumsum(n, dtype=np.int64), ends])]
    place = np.empty(len(pieces), np.int64)
    place[np.concatenate([rest, run])] = np.arange(len(pieces))
    return _lists(ids.flatten().to_numpy(), np.diff(ends, prepend=0)).take(pa.array(place))


def _space_before(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before these places may be white space."""
    one, two, three = padded[at - 1], padded[at - 2], padded[at - 3]
    return (one <= 0x20) | (one > 0x7F) & ((two == 0xC2) | _wide(three, two))


def _space_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at these places may be white space."""
    one, two = padded[at], padded[at + 1]
    return (one <= 0x20) | (one == 0xC2) | _wide(one, two)


def _wide(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.isin(one.astype(np.uint16) << 8 | two, [0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380])


def _padded(data: np.ndarray) -> np.ndarray:
    """With three line feeds on both sides, so that white space is around all."""
    return np.concatenate([np.full(3, 10, np.uint8), data, np.full(3, 10, np.uint8)])


def _plain(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which pieces have no line feed, and no white space at their ends but one space before."""
    if not len(at) - 1:
        return np.zeros(0, bool)
    feeds, padded = np.concatenate([[0], np.cumsum(data == 10)]), _padded(data)
    first, end = at[:-1] + 3, at[1:] + 3
    first = first + (padded[first] == 0x20)
    return (feeds[at[1:]] == feeds[at[:-1]]) & (first < end) & ~_space_at(padded, np.minimum(first, end - 1)) & ~_space_before(padded, end)


def _pieces(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts, which begin at these places of the data (the last ends there), are cut, and the place of each among the cuts.

    The pattern `KNOWN` cuts between letters, digits and signs; before a space if a character other than white space stands before
    or after it (then the white space before the space, if any, is a match of its own); before a line feed if such a character or nothing stands
    before it, and then also after it if such a character stands there.
    """
    kind = KINDS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    padded = _padded(data)
    spaces = np.flatnonzero(data == 0x20)
    spaces = spaces[~begins[spaces]]
    cut[spaces] = True
    spaces = spaces[_space_before(padded, spaces + 3)]  # few
    cut[spaces[begins[spaces + 1] | _space_at(padded, spaces + 4)]] = False
    feeds = np.flatnonzero(data == 10)
    feeds = feeds[begins[feeds] | ~_space_before(padded, feeds + 3)]
    cut[feeds] = True
    cut[feeds[~_space_at(padded, feeds + 4)] + 1] = True
    cut |= begins
    bounds = np.flatnonzero(cut)
    return bounds, np.searchsorted(bounds, at)


def encode_texts(texts: list[str | None] | pa.Array, ranks: Ranks, store: Store):
    """For each text: number of ids, the ids in decimal joined by a space, and the bytes they decode to."""
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    at, data = _columns(texts.fill_null(""))
    if not len(data):
        yield from ((0, b"", b"") for _ in range(len(texts)))
        return
    bounds, before = _pieces(at, data) if ranks.known else np.unique(at, return_inverse=True)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    ids = store.ask(pieces.dictionary, lambda new: _encoded(new, ranks)).take(pieces.indices)
    ends = np.concatenate([[0], np.cumsum(_sizes(ids))])[before]
    decimal, decoded = ranks.spell(ids.flatten().to_numpy(), ends[1:])
    for n, i, d in zip(np.diff(ends).tolist(), decimal, decoded, strict=True):
        yield n, i[1:], d


_ranks: dict[tuple[str, str], Ranks] = {}


def _load(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _ranks:
        _ranks[path, pattern] = Ranks(path, pattern)
    return _ranks[path, pattern]


def encode(documents: DataFrame, ranks_path: str, pattern: str, store_size: int = 300_000, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row; ids too if `with_ids`. ranks_path: a file that every executor has."""
    C.small_batches(documents.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        ranks, store = _load(ranks_path, pattern), Store(store_size)
        sha = hashlib.sha256
        gc.disable()  # stores and indexes hold millions of tuples and no cycle; looking for cycles takes a sixth of the time
        try:
            for batch in batches:
                rows: list[tuple] = []
                for first, end in C.slices(batch.column(1), 4 << 20):
                    for n, ids, decoded in encode_texts(batch.column(1).slice(first, end - first), ranks, store):
                        rows.append((n, sha(ids).hexdigest(), sha(decoded).hexdigest()) + (([int(i) for i in ids.split()],) if with_ids else ()))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False))], names)
        finally:  # the worker lives on
            gc.enable()
            del store
            C.trim()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and data (the bytes) of rows with doc_id and ids; null ids give no bytes."""

    def run(batches):
        ranks = _load(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ranks.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")
