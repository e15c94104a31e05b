"""Periodic runs of words, found on a harmonic grid.

A run is a stretch of words with smallest period q, at least `least` times q and at least `shortest` words long, that no neighbouring word
extends. For a period p, the places whose word returns p words later form, in such a run, a stretch of at least
(least - 1) * p; so one of every that many places, the grid of p, lies in it. All periods of a text together have
a harmonic number of grid points, n ln n / least about, not n squared. For all pairs (period, grid point) at once, over all
texts of a slice:

* pairs whose two words differ go (most of them);
* prefix hashes of the words, modulo 2**64, say in constant time whether two stretches are equal, and a
  binary search over all pairs simultaneously gives how far the equality reaches to the right and to the left;
* pairs that reach far enough are candidates (start, end, period). Of those of one stretch the smallest period
  is verified word by word, so that no hash decides; if hashes lied, the pair is measured by comparing words.
  Multiples of the smallest period give the same stretch (a word of both periods p and q, at least p + q long, has
  their greatest common divisor as a period), so a run is what is left after duplicates go.

Words are numbered by exact dictionary encoding of their bytes. Pairs are made in blocks of bounded size, so that memory follows
the slice, a few times its words, and not the pairs.

Cases: null and empty texts have no words and no runs; a text of one word repeated is one run of period 1; repeated
rows give each their own result; texts of any length are read whole, alone in a slice if longer than one; columns
other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Pairs that are looked at together.
BLOCK = 1 << 20


def _pairs(sizes: np.ndarray, bases: np.ndarray, least: int, shortest: int):
    """Blocks of (text, period, grid point), for texts of `sizes` words that begin at `bases`."""
    n_periods = sizes // least
    before = np.cumsum(n_periods) - n_periods
    text = np.repeat(np.arange(len(sizes)), n_periods)
    period = np.arange(len(text)) - before[text] + 1
    step = np.maximum(least * period, shortest) - period
    points = np.maximum(sizes[text] - period, 0) // step
    upto = np.cumsum(points)
    first = 0
    while first < len(text):
        done = int(upto[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(upto, done + BLOCK, "right")))
        n = points[first:end]
        row = np.repeat(np.arange(first, end), n)
        turn = np.arange(int(n.sum())) - np.repeat(upto[first:end] - n - done, n) + 1
        yield text[row], period[row], bases[text[row]] + turn * step[row] - 1
        first = end


class _Hashes:
    """Prefix hashes of a sequence of word numbers: are two stretches equal? No equal ones are told apart; a few others may not be."""

    def __init__(self, ids: np.ndarray):
        v = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(32)
        self.powers = C.powers(len(ids) + 1)[0]
        self.upto = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(v * self.powers[:-1], out=self.upto[1:])

    def equal(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretch of `length` at `at` and the one `period` later are the same."""
        h, after = self.upto, at + period
        return (h[at + length] - h[at]) * self.powers[period] == h[after + length] - h[after]


def _reach(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """The largest value from low (which holds) to high that holds, for all pairs at once."""
    low, high = low.copy(), high.copy()
    going = np.flatnonzero(low < high)
    while len(going):
        mid = (low[going] + high[going] + 1) // 2
        yes = holds(going, mid)
        low[going[yes]] = mid[yes]
        high[going[~yes]] = mid[~yes] - 1
        going = going[low[going] < high[going]]
    return low


def _measured(ids: np.ndarray, at: int, period: int, first: int, end: int) -> tuple[int, int]:
    """Start and end of the stretch of this period around `at`, by comparing words."""
    same = ids[first : end - period] == ids[first + period : end]
    differs = np.flatnonzero(~same)
    k = int(np.searchsorted(differs, at - first))
    start = int(differs[k - 1]) + 1 if k else 0
    stop = int(differs[k]) if k < len(differs) else len(same)
    return first + start, first + stop + period


def _settle(ids: np.ndarray, rows: np.ndarray, bases: np.ndarray, sizes: np.ndarray, least: int, shortest: int, runs: dict) -> None:
    """Puts what words say about the pairs of one stretch (text, start, end, period, grid point, by period) into runs."""
    text, start, stop = rows[0, :3].tolist()
    first, end = int(bases[text]), int(bases[text] + sizes[text])
    known = runs.get((text, start, stop))
    for period, at in rows[:, 3:].tolist():
        if known is not None and known <= period:
            return
        if (
            np.array_equal(ids[start : stop - period], ids[start + period : stop])
            and (start == first or ids[start - 1] != ids[start - 1 + period]) and (stop == end or ids[stop] != ids[stop - period])
        ):
            runs[text, start, stop] = known = period
            continue
        s, e = _measured(ids, at, period, first, end)
        if e - s >= max(least * period, shortest):
            runs[text, s, e] = min(period, runs.get((text, s, e), period))


def find_runs(ids: np.ndarray, bases: np.ndarray, sizes: np.ndarray, least: int = 4, shortest: int = 6) -> np.ndarray:
    """Rows of text, start, end, period (places in ids), by text, start and period. Text k is ids[bases[k] : bases[k] + sizes[k]]."""
    hashes, runs = _Hashes(ids), {}
    for text, period, at in _pairs(sizes, bases, least, shortest):
        some = np.flatnonzero(ids[at] == ids[at + period])
        text, period, at = text[some], period[some], at[some]
        first, end = bases[text], bases[text] + sizes[text]
        right = _reach(np.ones(len(at), np.int64), end - at - period, lambda g, m: hashes.equal(at[g], period[g], m))  # noqa: B023
        left = _reach(np.zeros(len(at), np.int64), at - first, lambda g, m: hashes.equal(at[g] - m, period[g], m))  # noqa: B023
        start, stop = at - left, at + period + right
        long = np.flatnonzero(stop - start >= np.maximum(least * period, shortest))
        order = long[np.lexsort((at[long], period[long], stop[long], start[long]))]
        rows = np.stack([text, start, stop, period, at], axis=1)[order]
        new = np.flatnonzero((rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)) + 1
        for same in np.split(rows, new) if len(rows) else ():
            _settle(ids, same, bases, sizes, least, shortest, runs)
    return np.array(sorted((t, s, e, p) for (t, s, e), p in runs.items()), np.int64).reshape(-1, 4)


def _collapsed(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray, of: np.ndarray, kept: np.ndarray, n: int) -> pa.Array:
    """The kept words of each text, joined by one space."""
    gap = C.SPACE[b]
    b = np.where(gap, np.uint8(32), b)
    mask = ~gap
    if not kept.all():
        mask[mask] = np.repeat(kept, lengths)
    after = (starts + lengths)[kept]
    of = of[kept]
    mask[after] = True
    last = np.flatnonzero(np.concatenate([of[1:] != of[:-1], [True]])) if len(of) else np.zeros(0, np.int64)
    mask[after[last]] = False
    sizes = np.bincount(of, lengths[kept], n).astype(np.int64) + np.maximum(np.bincount(of, minlength=n) - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(b[mask])]).cast(pa.binary()).cast(pa.string())


def _of_slice(texts: pa.Array, least: int, shortest: int) -> list[pa.Array]:
    b, begins = C.flat_bytes(texts)
    starts, words = C.word_array(b)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bases = np.searchsorted(starts, begins)
    sizes = np.diff(np.concatenate([bases, [len(starts)]]))
    runs = find_runs(ids, bases, sizes, least, shortest)
    text, start, stop, period = runs.T
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, stop, -1)
    kept = np.cumsum(change[:-1]) == 0
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)) if len(words) else np.zeros(0, np.int64)
    held = pa.StructArray.from_arrays([pa.array(x) for x in (start - bases[text], stop - start, period)], ["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
    of = np.repeat(np.arange(len(texts)), sizes)
    return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), held), _collapsed(b, starts, lengths, of, kept, len(texts))]


def find(documents: DataFrame, least: int = 4, shortest: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and collapsed, the words without a run's repetitions."""
    C.small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            for first, end in C.slices(batch.column(1), 4 << 20):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), *_of_slice(part.column(1), least, shortest)], ["doc_id", "n_words", "runs", "collapsed"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def greatest(runs: Column) -> Column:
    """The run of the greatest length over period, compared without division; the first of equals. Null if there is none."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def listed(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
