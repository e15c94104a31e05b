"""Token counts by rank-synchronous array merging.

A piece model (BPE with byte fallback) turns spaces into a mark and merges the neighbouring pair whose piece
scores best, the leftmost first. No piece has a mark after another character, so a text falls into pre-tokens
(marks, then other characters) that merge apart from each other. The distinct pre-tokens of a batch are held as
one ragged array of symbols; in each step every sequence applies its lowest-rank pair, all at once; what survives
is counted (a character that is no piece counts its UTF-8 bytes). Sequences of more than `SHORT` symbols are held
in blocks with the lowest rank of each, so that a step looks at one number for each block and at the blocks that
hold the sequence's lowest rank, and it applies all occurrences of the pair, from the left up to the first that
makes a pair of a rank as low: the steps of a sequence are about its distinct pairs, whatever its length.

Counts of pre-tokens are kept between batches in a store of bounded size.

Cases: null and empty texts have 0 tokens; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
SHORT = 64
BLOCK = 64
NONE = np.int32(2**31 - 1)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        i, shift, more = i + 1, shift + 7, b[i] >= 128
        if not more:
            return value, i


def _fields(b: bytes) -> Iterable[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Pieces:
    """The piece model at a path: ranks of pieces, and the piece that two neighbouring pieces make."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = f.read()
        pieces: list[tuple[str, float]] = []
        for number, value in _fields(message):
            if number == 1:
                x = dict(_fields(value))
                if x.get(3, 1) == 1:  # a normal piece
                    pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, bytes(4)))[0]))
            elif number == 2:
                spec = dict(_fields(value))
                if spec.get(3, 1) != 2:
                    raise ValueError("not a BPE model")
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece has a space after another character")
        levels = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.ids = {p: i for i, (p, _) in enumerate(pieces)}
        self.rank = np.array([levels[s] for _, s in pieces], np.int32)
        n = self.n = len(pieces)
        self.chars = np.arange(0x110000, dtype=np.int32) + n  # a character that is no piece: n and its code point
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        found = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    found[a * n + b] = i
        keys = np.array(sorted(found), np.int64)
        self.keys, self.made = keys, np.array([found[k] for k in keys.tolist()], np.int32)
        # open addressing over a table at most a quarter full: few probes, no binary search
        self.bits = max(8, int(len(keys) * 4 - 1).bit_length())
        self.slot_key, self.slot = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._hash(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.slot_key[slots], self.slot[slots] = keys[left[taken]], self.made[left[taken]]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, -1 for none."""
        out = np.full(len(a), -1, np.int32)
        open_ = np.flatnonzero((a < self.n) & (b < self.n))
        key = a[open_].astype(np.int64) * self.n + b[open_]
        at = self._hash(key)
        for _ in range(self.probes):
            if not len(open_):
                break
            there = self.slot_key[at]
            hit = there == key
            out[open_[hit]] = self.slot[at[hit]]
            go = ~hit & (there >= 0)
            open_, key, at = open_[go], key[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def cost(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens of a symbol that no merge took: 1, or its UTF-8 bytes if it is no piece."""
        code = symbols - self.n
        return np.where(code < 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        some = np.flatnonzero(sizes <= SHORT)
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            out[part] = self._together([words[i] for i in part.tolist()], sizes[part])
        # sequences of about one length need about as many steps
        long = np.flatnonzero(sizes > SHORT)
        long = long[np.argsort(sizes[long], kind="stable")]
        first = 0
        while first < len(long):
            end = first + max(1, int(np.searchsorted(np.cumsum(sizes[long[first:]]), 1 << 21, "right")))
            part = long[first:end]
            out[part] = self._in_blocks([words[i] for i in part.tolist()], sizes[part])
            first = end
        return out

    def _together(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Rank-synchronous: in each step, each sequence merges its lowest-rank pair, the leftmost of equals."""
        out = np.zeros(len(words), np.int64)
        text = "".join(words)
        sym = self.chars[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] if text else np.zeros(0, np.int32)
        size, which = sizes[sizes > 0].astype(np.int64), np.flatnonzero(sizes > 0)
        seq = np.repeat(np.arange(len(size)), size)
        made = self._pairs(sym, seq)
        rank = np.where(made < 0, NONE, self.rank[made])
        while len(sym):
            starts = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, starts)
            over = low == NONE
            if over.any():
                done = np.repeat(over, size)
                out[which[over]] = np.add.reduceat(self.cost(sym[done]), np.cumsum(size[over]) - size[over])
                sym, made, rank = sym[~done], made[~done], rank[~done]
                low, size, which = low[~over], size[~over], which[~over]
                if not len(sym):
                    break
                seq = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == np.repeat(low, size))
            of = seq[at]
            at = at[np.concatenate([[True], of[1:] != of[:-1]])]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # places after the gaps close: each sequence lost one symbol
            sym, seq, made, rank = sym[keep], seq[keep], made[keep], rank[keep]
            size -= 1
            for p in (at, at[at > 0] - 1):
                made[p] = pair = self._pairs_at(sym, seq, p)
                rank[p] = np.where(pair < 0, NONE, self.rank[pair])
        return out

    def _pairs_at(self, sym: np.ndarray, seq: np.ndarray, p: np.ndarray) -> np.ndarray:
        q = np.minimum(p + 1, len(sym) - 1)
        pair = self.merge(sym[p], sym[q])
        pair[(q == p) | (seq[p] != seq[q])] = -1
        return pair

    def _pairs(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        return self._pairs_at(sym, seq, np.arange(len(sym))) if len(sym) else np.zeros(0, np.int32)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece of each pair of symbols and its rank (NONE for no piece)."""
        made = self.merge(a, b)
        return made, np.where(made < 0, NONE, self.rank[made])

    def _in_blocks(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Rank-synchronous over blocks: in each step, each sequence merges all occurrences of its lowest-rank pair that come next."""
        n_blocks = -(-sizes // BLOCK)
        first_block = np.cumsum(n_blocks) - n_blocks
        total = int(n_blocks.sum()) * BLOCK
        place = np.arange(int(sizes.sum())) + np.repeat(first_block * BLOCK - (np.cumsum(sizes) - sizes), sizes)
        sym, made, rank = np.full(total + 1, self.n, np.int32), np.full(total, -1, np.int32), np.full(total, NONE, np.int32)
        sym[place] = self.chars[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        after, before = np.full(total + 1, -1, np.int64), np.full(total + 1, -1, np.int64)
        inner = np.ones(len(place), bool)
        inner[np.cumsum(sizes) - 1] = False
        after[place[inner]] = place[inner] + 1
        before[place[inner] + 1] = place[inner]
        alive = np.zeros(total, bool)
        alive[place] = True
        has = place[inner]
        made[has], rank[has] = self._rank_of(sym[has], sym[has + 1])
        by_block = rank.reshape(-1, BLOCK)
        low_of = by_block.min(axis=1)
        seq_of_block = np.repeat(np.arange(len(words)), n_blocks)
        blocks = np.arange(len(low_of))  # of the sequences that still merge
        while len(blocks):
            of = seq_of_block[blocks]
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            held = low_of[blocks]
            low = np.minimum.reduceat(held, starts)
            low = np.repeat(low, np.diff(np.concatenate([starts, [len(blocks)]])))
            if (low == NONE).any():
                blocks = blocks[low != NONE]
                continue
            hit = blocks[held == low]
            rows, columns = np.nonzero(by_block[hit] == held[held == low][:, None])
            p = hit[rows] * BLOCK + columns
            # of occurrences that share a symbol every second one stands
            tied = np.concatenate([[False], after[p[:-1]] == p[1:]])
            runs = np.flatnonzero(~tied)
            p = p[(np.arange(len(p)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(p)]])))) % 2 == 0]
            q, m, r = after[p], made[p], rank[p]
            # the pairs that each makes when it comes, those left of it done and those right of it not
            left = before[p]
            joined = np.concatenate([[False], q[:-1] == left[1:]])
            left_sym = np.where(joined, np.concatenate([m[:1], m[:-1]]), sym[left])
            lower = (left >= 0) & (self._rank_of(left_sym, m)[1] <= r)
            right = after[q]
            lower |= (right >= 0) & (self._rank_of(m, sym[right])[1] <= r)
            if lower.any():  # what comes after such a pair waits
                s = seq_of_block[p // BLOCK]
                firsts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                so_far = np.cumsum(lower) - lower
                go = so_far == np.repeat(so_far[firsts], np.diff(np.concatenate([firsts, [len(s)]])))
                p, q, m, right = p[go], q[go], m[go], right[go]
            sym[p], alive[q], rank[q] = m, False, NONE
            after[p] = right
            before[right[right >= 0]] = p[right >= 0]
            back = before[p]
            touched = np.unique(np.concatenate([p, back[back >= 0]]))
            nxt = after[touched]
            made[touched], found = self._rank_of(sym[touched], sym[nxt])
            rank[touched] = np.where(nxt >= 0, found, NONE)
            changed = np.unique(np.concatenate([touched, q]) // BLOCK)
            low_of[changed] = by_block[changed].min(axis=1)
        return np.bincount(seq_of_block[np.flatnonzero(alive) // BLOCK], self.cost(sym[:-1][alive]), len(words)).astype(np.int64)


class Store:
    """Values by key, at most about twice `most`: the older half goes when the newer is full."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: Iterable) -> list:
        """Keys without a value; those of the older half move to the newer."""
        out, new, old = [], self.new, self.old
        for k in set(keys).difference(new):
            if k in old:
                new[k] = old[k]
            else:
                out.append(k)
        return out

    def turn(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


_models: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def pretokens(text: str) -> list[str]:
    """What follows the first mark, split at spaces: 'a b' is mark+a, mark+b. Several spaces stay together with the word after them."""
    text = text.replace(MARK, " ")
    if "  " not in text and not text.startswith(" "):
        return text.split(" ") if text else []
    out, held = [], ""
    for w in (" " + text).split(" ")[1:]:
        if w:
            out.append(held + w)
            held = ""
        else:
            held += MARK
    return out + [held[:-1]] if held else out


def count_tokens(texts: list[str | None], pieces: Pieces, store: Store) -> list[int]:
    """Tokens of each text."""
    cut = [pretokens(t or "") for t in texts]
    everything = set()
    everything.update(*cut)
    store.turn()
    missing = store.missing(everything)
    if missing:
        missing.sort()
        store.new.update(zip(missing, pieces.counts([MARK + w for w in missing]).tolist(), strict=True))
    get = store.new.__getitem__
    return [sum(map(get, ws)) for ws in cut]


def with_token_counts(documents: DataFrame, model_path: str, limit: int = 4096, store_size: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) for each row. model_path: a file that every executor has."""
    C.small_batches(documents.sparkSession)

    def run(batches):
        pieces, store = _model(model_path), Store(store_size)
        for batch in batches:
            n: list[int] = []
            for first, end in C.slices(batch.column(1), 4 << 20):
                n += count_tokens(batch.column(1).slice(first, end - first).to_pylist(), pieces, store)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
