"""Fill-in-middle transformation with a matcher of constant memory.

A text is cut into prefix, middle and suffix at the ends of two of its units, whose ranks are drawn from the
document's number. Units are what a matcher finds from left to right: code points, or the matches of any regular
expression (words, lines). A text is read twice. The first pass counts its units; the second advances a lazy iterator
of matches to the lower rank, then on to the higher one, and stops there. Neither pass keeps a list of units: the
iterator yields strides (how many units, where the last of them ends) and forgets them. A stride of a regular expression is one
match; a stride of code points is a block of a few hundred bytes, whose units are counted by their first bytes.

    plain   the text as it is: an empty one, one that holds a sentinel, or one drawn to stay so
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

As no cut text holds a sentinel, the first place of each sentinel in an output is the one that was put there, and
`restored` finds the text again with built-in functions.

Cases: null texts are empty, and plain; a null doc_id draws as the word null; rows that repeat are cut alike; units
that leave gaps (words) leave what stands between two of them to the part of the later one; texts of any
length are cut whole; an empty table gives no rows; added columns replace columns of the same names, others are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "output")


class CodePoints:
    """Units of one code point, in UTF-8: a stride is a block of about `step` bytes."""

    _one = rb"(?:[^\x80-\xBF][\x80-\xBF]*)"

    def __init__(self, step: int = 512):
        self.step, self._runs = step, {}

    def read(self, text: bytes) -> bytes:
        return text

    def strides(self, text: bytes) -> Iterator[tuple[int, int]]:
        at, n = 0, len(text)
        signed = np.frombuffer(text, np.int8)
        while at < n:
            stop = min(at + self.step, n)
            while stop < n and signed[stop] < -64:  # a byte that goes on with a code point
                stop += 1
            yield int(np.count_nonzero(signed[at:stop] >= -64)), stop
            at = stop

    def within(self, text: bytes, at: int, k: int) -> int:
        """Where the k-th unit from `at` ends."""
        run = self._runs.get(k)
        if run is None:
            run = self._runs[k] = re.compile(self._one + b"{%d}" % k)
        return run.match(text, at).end()

    def characters(self, part: bytes) -> int:
        return sum(n for n, _ in self.strides(part))

    def written(self, part: bytes) -> bytes:
        return part


class Matches:
    """Units that a regular expression matches: a stride is one match."""

    def __init__(self, pattern: str):
        self._one = re.compile(pattern)

    def read(self, text: bytes) -> str:
        return text.decode()

    def strides(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self._one.finditer(text):
            if m.end() > m.start():
                yield 1, m.end()

    def within(self, text: str, at: int, k: int) -> int:
        raise AssertionError("a stride of one unit is never cut")

    def characters(self, part: str) -> int:
        return len(part)

    def written(self, part: str) -> bytes:
        return part.encode()


def count(matcher, text) -> int:
    """First pass: how many units there are."""
    return sum(n for n, _ in matcher.strides(text))


def ends(matcher, text, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the unit of rank `low` ends and where that of rank `high` does (0: before the first)."""
    wanted, found, seen, at = [low, high], [], 0, 0
    for n, stop in matcher.strides(text):
        while wanted and seen + n >= wanted[0]:
            k = wanted.pop(0) - seen
            found.append(at if k == 0 else stop if k == n else matcher.within(text, at, k))
        if not wanted:
            break
        seen, at = seen + n, stop
    low_end, high_end = found + [0] * len(wanted)  # a text without units has ranks of 0 only
    return low_end, high_end


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4]) for i in (0, 4, 8, 12))


def cut(text: bytes, numbers: tuple[int, int, int, int], matcher, plain: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output."""
    data = matcher.read(text)
    n = count(matcher, data)
    h1, h2, h3, h4 = numbers
    if not text or any(s in text for s in (b"<P>", b"<S>", b"<M>")) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = h1 % (n + 1), h2 % (n + 1)
    i, j = ends(matcher, data, min(a, b), max(a, b))
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    if isinstance(matcher, CodePoints):
        sizes = min(a, b), abs(a - b)
    else:
        sizes = matcher.characters(prefix), matcher.characters(middle)
    prefix, middle, suffix = map(matcher.written, (prefix, middle, suffix))
    if h4 % 100 < spm:
        return n, "spm", *sizes, b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle
    return n, "psm", *sizes, b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle


def transform(documents: DataFrame, pattern: str | None = None, seed: str = "1", plain: int = 10, spm: int = 20, columns: list[str] | None = None) -> DataFrame:
    """documents (of it `columns`, all if None) with n_units, form, prefix_chars, middle_chars and output. pattern: of a unit, a code point if None; plain, spm: per cent."""
    C.small_batches(documents.sparkSession)
    # by position: a name may hold any sign
    places = [i for i, c in enumerate(documents.columns) if c.lower() not in ADDED and (columns is None or c in columns)]
    n, types = len(places), [f"c{i} {documents.dtypes[i][1]}" for i in places]
    d = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    doc_id, text = (F.col(f"c{documents.columns.index(c)}") for c in ("doc_id", "text"))
    rows = d.select(*[f"c{i}" for i in places], doc_id.cast("long").alias("id"), F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("bytes"))

    def run(batches):
        matcher = CodePoints() if pattern is None else Matches(pattern)
        for batch in batches:
            ids, texts = batch.column(n), batch.column(n + 1)
            for first, end in C.slices(texts, 8 << 20):
                made = [cut(t.as_py(), draws(d.as_py(), seed), matcher, plain, spm) for d, t in zip(ids[first:end], texts[first:end], strict=True)]
                units, form, before, middle, out = zip(*made, strict=True)
                new = [pa.array(units, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:n], *new], [*batch.schema.names[:n], *ADDED])

    made = rows.mapInArrow(run, ", ".join([*types, "n_units long", "form string", "prefix_chars long", "middle_chars long", "output string"]))
    return made.toDF(*[documents.columns[i] for i in places], *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of `transform` was made of."""
    place = lambda s: F.instr(output, s)
    between = lambda a, b: F.substring(output, place(a) + 3, place(b) - place(a) - 3)
    middle = F.substring(output, place(MIDDLE) + 3, F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
