"""Packing token sequences into windows by sum-of-squares online packing.

Documents come one after the other, in the tasks that read them. A document of more than a window fills whole windows from its
beginning; what is left of it, and every shorter document, is placed into an open window: of all fill levels it
fits (a new window is level 0), the one after which the sum of the squared counts of open windows by level
is smallest. Moving a window from level h to h + s changes that sum by 2 (N[h + s] - N[h]) + 2, so a level array with the
cost of entering and the gain of leaving each level gives the choice as one minimum over an array, the fullest level of equals.
Counts stay even over the levels, so that for a document of any size a window that it closes is likely open.

At most `most_open` windows are open in a task, so its memory is bounded, whatever the sizes: beyond that, and at its
end, open windows are poured together, the emptiest into the fullest; only there are documents cut that would fit a window. Each
task leaves one window that is not full. Those of `group` tasks meet in one task, a window of each, and are poured
together again; what is left of a group is cut into sequences of powers of two, which need no padding. So padding is 0, and sequences
shorter than a window are at most 11 for each `group` tasks.

Ids are those of a tokenizer whose pre-tokens end at white space: each new word of a slice is encoded once and kept
in a store of bounded size. New words of plain letters and punctuation, most of them, are merged together over arrays by the
tokenizer file's merges; all others go to the library.

Packed pieces go to a table in shared storage before they are returned: an executor that is lost later takes nothing with it, and no
piece is packed twice.

Cases: null and empty texts have no ids but `end_id`; repeated rows are packed each; a null doc_id packs like any other;
columns other than doc_id and text are ignored; an empty table gives no rows. Which documents share a sequence depends on how
the table is split into tasks; every result is a whole packing.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bpe import NONE, PairTable

#: Columns of a piece: the document, where the piece begins in it, how long it is, the document's ids, and its place.
PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("whole", pa.bool_()), ("task", pa.int64()), ("ids", pa.binary()),
])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, whole boolean, task long, ids binary"


class Piece:
    """Consecutive ids of one document."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id, doc_tokens: int, start: int, ids: np.ndarray):
        self.doc_id, self.doc_tokens, self.start, self.ids = doc_id, doc_tokens, start, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.doc_tokens, self.start, self.ids[:n]), Piece(self.doc_id, self.doc_tokens, self.start + n, self.ids[n:])


class Packer:
    """Sum-of-squares packing of pieces into windows; full windows go to `closed`, a list of lists of pieces."""

    def __init__(self, window: int, most_open: int):
        self.window, self.most_open, self.n_open = window, most_open, 0
        self.enter = np.ones(window + 1, np.int64)  # 2 N + 1: what a window more at this level costs
        self.enter[window] = 0  # a full window is closed and counts no more
        self.leave = np.full(window + 1, -(1 << 40), np.int64)  # 2 N - 1: what a window less gains, where there is one
        self.leave[0] = 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.closed: list[list[Piece]] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, full = len(ids), len(ids) - len(ids) % self.window
        for at in range(0, full, self.window):
            self.closed.append([Piece(doc_id, n, at, ids[at : at + self.window])])
        if full < n:
            self.place(Piece(doc_id, n, full, ids[full:].copy()))

    def level(self, size: int) -> int:
        """The fill level that a piece of this size goes to."""
        cost = self.enter[size:] - self.leave[: self.window - size + 1]
        return self.window - size - int(cost[::-1].argmin())

    def place(self, piece: Piece) -> None:
        level, held = self.level(len(piece.ids)), []
        if level:
            held = self.open[level].pop()
            self._count(level)
            self.n_open -= 1
        held.append(piece)
        level += len(piece.ids)
        if level == self.window:
            self.closed.append(held)
        else:
            self.open[level].append(held)
            self._count(level)
            self.n_open += 1
        if self.n_open > self.most_open:
            self._reopen(self.pour())

    def _count(self, level: int) -> None:
        n = len(self.open[level])
        self.enter[level] = 2 * n + 1
        self.leave[level] = 2 * n - 1 if n else -(1 << 40)

    def _reopen(self, held: list[Piece]) -> None:
        level = sum(len(p.ids) for p in held)
        if level:
            self.open[level].append(held)
            self._count(level)
            self.n_open += 1

    def pour(self) -> list[Piece]:
        """Pours open windows together, the emptiest into the fullest. What is left, less than a window."""
        held = [w for level in reversed(self.open) for w in level]
        for level in range(1, self.window):
            if self.open[level]:
                self.open[level] = []
                self._count(level)
        self.n_open = 0
        first, last, spare = 0, len(held) - 1, []
        while first <= last:
            target, room = held[first], self.window - sum(len(p.ids) for p in held[first])
            first += 1
            while room and (spare or first <= last):
                if not spare:
                    spare, last = held[last], last - 1
                piece = spare.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    spare.append(rest)
                target.append(piece)
                room -= len(piece.ids)
            if room:
                return target
            self.closed.append(target)
            if first > last and spare:  # the window that was being poured out
                held, first, last, spare = [spare], 0, 0, []
        return []


def in_powers(held: list[Piece]) -> list[list[Piece]]:
    """Pieces of less than a window as sequences whose lengths are powers of two, the longest first."""
    left, out = sum(len(p.ids) for p in held), []
    rest = list(reversed(held))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            piece = rest.pop()
            if len(piece.ids) > room:
                piece, more = piece.cut(room)
                rest.append(more)
            sequence.append(piece)
            room -= len(piece.ids)
        out.append(sequence)
    return out


class Merges:
    """The BPE of a tokenizer file (byte level, word ends marked) over arrays, for pre-tokens whose bytes are known.

    A merge's id is above those of its parts, so all places of a sequence's lowest pair can be joined at once.
    """

    def __init__(self, model: dict):
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs, n = {}, len(ids)
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            made = ids[a + b]
            if made <= max(ids[a], ids[b]):
                raise ValueError("a merge comes before one of its parts")
            pairs[ids[a] * n + ids[b]] = made
        # printable bytes stand for themselves, the others are numbered from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {x: chr(x) for x in own} | {x: chr(256 + k) for k, x in enumerate(x for x in range(256) if x not in own)}
        self.inner = np.array([ids[signs[x]] for x in range(256)], np.int32)
        self.final = np.array([ids[signs[x] + suffix] for x in range(256)], np.int32)
        self.pair = PairTable(pairs, n)

    def __call__(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte sequences of these sizes (none is empty), one after the other, and how many each has."""
        last = np.cumsum(size) - 1
        sym = self.inner[data]
        sym[last] = self.final[data[last]]
        seq, done = np.arange(len(size)), []
        made = self._pairs(sym, last)
        while len(sym):
            first = np.cumsum(size) - size
            low = np.minimum.reduceat(made, first)
            over = low == NONE
            if over.any():
                gone = np.repeat(over, size)
                done.append((seq[over], size[over], sym[gone]))
                sym, made = sym[~gone], made[~gone]
                seq, size, low = seq[~over], size[~over], low[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(made == np.repeat(low, size))
            # of places that share a symbol every second one stands
            runs = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
            at = at[(np.arange(len(at)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(at)]])))) % 2 == 0]
            of = np.searchsorted(np.cumsum(size), at, "right")
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, made = sym[keep], made[keep]
            size = size - np.bincount(of, minlength=len(size))
            at -= np.arange(len(at))
            last = np.cumsum(size) - 1
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            made[touched] = self.pair(sym[touched], sym[np.minimum(touched + 1, len(sym) - 1)])
            made[last] = NONE
        if not done:
            return sym, size
        seq, size, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        at = np.cumsum(size) - size
        order = np.argsort(seq)
        return sym[ragged(at[order], size[order])], size[order]

    def _pairs(self, sym: np.ndarray, last: np.ndarray) -> np.ndarray:
        made = np.full(len(sym), NONE, np.int32)
        made[:-1] = self.pair(sym[:-1], sym[1:])
        made[last] = NONE
        return made


def ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of each run of this size."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(at - (end - size), size)


#: Words that are one run of letters, one of punctuation (no apostrophe, which can cut a suffix off), or the former before the latter: their pre-tokens are these runs.
PLAIN = r"^(?P<letters>[a-zß-öø-ÿ]*)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
ABLE = r"^[A-Za-zÀ-ÖØ-öø-ÿ]*[!-&(-/:-@\[-`{-~]*$"


class Words:
    """Ids of texts by words, for a tokenizer file whose pre-tokens end at white space.

    Words met before are in a store of about `most`; of new ones the plain ones are merged together, the others go to the library.
    """

    def __init__(self, path: str, end_id: int, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, most
        with open(path) as f:
            self.merges = Merges(json.load(f)["model"])
        self._keep(pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _keep(self, words: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        self.words, self.size, self.flat = words, size, ids
        self.at = np.cumsum(size) - size

    def _learn(self, words: pa.Array) -> None:
        text = words.cast(pa.large_string())
        able = pc.match_substring_regex(text, ABLE)
        lower = pc.utf8_lower(text.filter(able))
        parts = pc.extract_regex(lower, PLAIN)
        letters, signs = parts.field("letters"), parts.field("signs")
        sizes = np.stack([C.lengths(letters), C.lengths(signs)], axis=1).ravel()
        data = np.frombuffer(b"".join(lower.cast(pa.large_binary()).to_pylist()), np.uint8)
        made, n = self.merges(data, sizes[sizes > 0])
        counts = np.zeros(len(sizes), np.int64)
        counts[sizes > 0] = n
        plain = able.to_numpy(zero_copy_only=False)
        size = np.zeros(len(words), np.int64)
        size[plain] = counts.reshape(-1, 2).sum(axis=1)
        others = [e.ids for e in self.tokenizer.encode_batch_fast(text.filter(pc.invert(able)).to_pylist(), add_special_tokens=False)]
        size[~plain] = [len(x) for x in others]
        flat = np.empty(int(size.sum()), np.uint32)
        is_plain = np.repeat(plain, size)
        flat[is_plain] = made
        flat[~is_plain] = [i for x in others for i in x]
        self._keep(pa.concat_arrays([self.words, words]), np.concatenate([self.size, size]), np.concatenate([self.flat, flat]))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, and end_id after them."""
        b, begins = C.flat_bytes(texts)
        starts, words = C.word_array(b)
        which = pc.index_in(words, value_set=self.words)
        known = len(self.words)
        unknown = which.is_null()
        which = which.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = words.filter(unknown)
        if len(missing):
            coded = missing.dictionary_encode()
            self._learn(coded.dictionary)
            which[unknown.to_numpy(zero_copy_only=False)] = known + coded.indices.to_numpy(zero_copy_only=False)
        n = self.size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[ragged(self.at[which], n)]
        if len(self.words) > self.most:  # only what this slice used stays
            used = np.unique(which)
            self._keep(self.words.take(pa.array(used)), self.size[used], self.flat[ragged(self.at[used], self.size[used])])
        first = upto[np.searchsorted(starts, begins)]
        end = np.array([self.end_id], np.uint32)
        return [np.concatenate([flat[i:j], end]) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(flat)], strict=True)]


_tokenizers: dict = {}


def _words(path: str, end_id: int, store_size: int) -> Words:
    key = path, end_id, store_size
    if key not in _tokenizers:
        _tokenizers[key] = Words(*key)
    return _tokenizers[key]


def _rows(sequences: list[list[Piece]], first_id: int, whole: bool, task: int, with_ids: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in PIECE]
    for k, held in enumerate(sequences):
        offset = 0
        for p in held:
            raw = p.ids.astype("<u4").tobytes()
            n = len(p.ids)
            for c, v in zip(columns, (p.doc_id, p.start, n, zlib.crc32(raw), p.doc_tokens, first_id + k, offset, whole, task, raw if with_ids else None), strict=True):
                c.append(v)
            offset += n
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)


def pack(documents: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, with_ids: bool = False, most_open: int = 4096, group: int = 32, store_size: int = 300_000) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids (little-endian, 4 bytes each).

    tokenizer_path: a file that every executor has. Sequence numbers are unique, not gapless.
    """
    C.small_batches(documents.sparkSession)

    def run(batches):
        words, packer, task, n = _words(tokenizer_path, end_id, store_size), Packer(window, most_open), 0, 0
        for batch in batches:
            task = batch.column(2)[0].as_py() if batch.num_rows else task
            for first, end in C.slices(batch.column(1), 4 << 20):
                for doc_id, ids in zip(batch.column(0)[first:end].to_pylist(), words.ids(batch.column(1).slice(first, end - first)), strict=True):
                    packer.add(doc_id, ids)
                done, packer.closed = packer.closed, []
                yield _rows(done, (2 * task << 32) + n, True, task, with_ids)
                n += len(done)
        left = packer.pour()
        yield _rows(packer.closed, (2 * task << 32) + n, True, task, with_ids)
        n += len(packer.closed)
        if left:
            yield _rows([left], (2 * task << 32) + n, False, task, True)

    def of_group(key, table):
        packer = Packer(window, most_open)
        rows = sorted(table.to_pylist(), key=lambda r: (r["task"], r["offset"]))
        for r in rows:
            packer.place(Piece(r["doc_id"], r["doc_tokens"], r["start"], np.frombuffer(r["ids"], "<u4")))
        left = packer.pour()
        return pa.Table.from_batches([_rows(packer.closed + in_powers(left), (2 * key[0].as_py() + 1) << 32, True, -1, with_ids)])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("task"))
    packed = C.written(rows.mapInArrow(run, DDL), "packed")
    tails = packed.where("not whole").groupBy(F.expr(f"task div {group}").alias("group")).applyInArrow(of_group, DDL)
    out = packed.where("whole").unionByName(C.written(tails, "packed-tails"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids and the pieces (doc_id, start, length) in order, of `pack(..., with_ids=True)`; a group is one window."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), held.alias("held"))
    ids = F.reduce("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("held", lambda x: F.struct(x["doc_id"], x["start"], x["length"])).alias("pieces"))
