"""Packing, periodic runs and fill-in-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from newsloom.llm import fim, packing, periodic, queries

SF = "/root/testdata/sf0.001"
TOKENIZER = P.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# packing


def check_packing(pieces, ids_of, window, padding=0):
    """Each id lies in exactly one piece; sequences have no gaps, and are full or a power of two long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for d, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lost = 0
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        lost += 0 if at & (at - 1) == 0 else window - at
    assert lost <= padding
    return len(by_sequence)


@pytest.mark.parametrize("parts", [1, 7])
def test_every_id_in_one_piece(spark, table, library, parts, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    ids = {d: library(t) for d, t in table.items()}
    n = check_packing(queries.op11_packing(spark, str(tmp_path)).collect(), ids, 2048)
    assert n <= sum(map(len, ids.values())) // 2048 + 11


def test_a_small_window_and_few_open_ones(spark, table, library):
    """Windows are poured together in the middle of a task, and long texts fill many."""
    d = spark.createDataFrame([(i, t) for i, t in table.items()] + [(-1, "word " * 5000), (-2, None), (-3, "")], "doc_id long, text string")
    ids = {r.doc_id: library(r.text) for r in d.collect()}
    check_packing(packing.pack(d, TOKENIZER, window=64, most_open=5, group=2, store_size=50).collect(), ids, 64)


def test_ids_equal_the_library(library):
    draw = random.Random(3)
    parts = ["a", "B", "é", "É", "É", "̀", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'LL", "it's", "1", "23", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "<|END", "Σ", "ΑΣ", "İ", "ﬁ", "!!", "$", "x" * 50, "\x00", "­", "�"]
    texts = [None, "", " ", "\n \t"] + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    words = packing.Words(TOKENIZER, 1, 100)
    for t, got in zip(texts, words.ids(pa.array(texts)), strict=True):
        assert got.tolist() == library(t), repr(t)


def test_the_level_minimises_the_sum_of_squares():
    draw = random.Random(1)
    packer, counts = packing.Packer(32, 10**9), [0] * 33
    for _ in range(3000):
        s = draw.choice([1, 2, 3, 5, 7, 11, 17, 20, 31])

        def after(h):
            c = counts[:]
            c[h] -= h > 0
            c[h + s] += h + s < 32
            return sum(x * x for x in c)

        open_levels = [h for h in range(32 - s + 1) if h == 0 or counts[h]]
        got = packer.level(s)
        assert got in open_levels and after(got) == min(map(after, open_levels)) and got == max(h for h in open_levels if after(h) == after(got))
        packer.place(packing.Piece(0, s, 0, np.zeros(s, np.uint32)))
        counts[got] -= got > 0
        counts[got + s] += got + s < 32
        assert [len(x) for x in packer.open] == counts[:32] and packer.n_open == sum(counts)


def test_open_windows_are_bounded():
    packer = packing.Packer(100, 50)
    for i in range(5000):
        packer.place(packing.Piece(i, 51, 0, np.zeros(51, np.uint32)))  # no two fit together
        assert packer.n_open <= 50
    left = packer.pour()
    assert sum(len(p.ids) for w in packer.closed for p in w) + sum(len(p.ids) for p in left) == 5000 * 51
    assert {sum(len(p.ids) for p in w) for w in packer.closed} == {100}
    assert sum(map(len, packing.in_powers(left))) >= len(left)


def test_sequences_hold_the_ids(spark, library):
    d = spark.createDataFrame([(1, "one two three"), (2, "four " * 40), (3, None), (None, "five")], "doc_id long, text string")
    rows = packing.sequences(packing.pack(d, TOKENIZER, window=16, with_ids=True)).collect()
    ids = {r.doc_id: library(r.text) for r in d.collect()}
    for r in rows:
        got = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(got) == r.n_tokens and got == [x for p in r.pieces for x in ids[p.doc_id][p.start : p.start + p.length]]
    assert sum(r.n_tokens for r in rows) == sum(map(len, ids.values()))


def test_packing_of_odd_tables(spark, library):
    d = spark.createDataFrame([(1, "a b", "x", 5), (1, "a b", "x", 5), (None, None, None, None)], "doc_id long, text string, ids string, task int")
    rows = packing.pack(d, TOKENIZER).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 1), (1, 3), (1, 3)]
    assert sorted((r.doc_id or 0, i) for r in rows for i in range(r.start, r.start + r.length)) == [(0, 0)] + [(1, i) for i in (0, 0, 1, 1, 2, 2)]
    assert packing.pack(d.limit(0), TOKENIZER).count() == 0


# periodic runs


def plain_runs(w, least=4, shortest=6):
    n, out = len(w), {}
    for p in range(1, n // least + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(shortest, least * p) and (i, j + p) not in out:
                out[i, j + p] = p
            i = j
    return sorted((s, e - s, p) for (s, e), p in out.items())


def plain_collapse(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def repetitive(draw):
    letters = "ab" if draw.random() < 0.5 else "abcdefgh"
    w = []
    while len(w) < draw.randint(0, 60):
        piece = [draw.choice(letters) for _ in range(draw.randint(1, 5))]
        w += piece * draw.choice([1, 1, 2, 4, 5, 9])
        if draw.random() < 0.3:
            w += piece[: draw.randint(0, len(piece))]
    return w


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_runs_equal_plain_ones(monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    draw = random.Random(4)
    texts = [repetitive(draw) for _ in range(400)] + [["a"] * n for n in (1, 5, 6, 7, 300)] + [["a", "b"] * 50, list("abc") * 4, list("abcd") * 3]
    joined = [draw.choice([" ", "\t ", "\n"]).join(w) + draw.choice(["", " "]) for w in texts] + [None, "", "  "]
    sizes, runs, kept = periodic._of_slice(pa.array(joined), 4, 6)
    for w, n, r, k in zip(texts + [[]] * 3, sizes.to_pylist(), runs.to_pylist(), kept.to_pylist(), strict=True):
        want = plain_runs(w)
        assert n == len(w) and [(x["start"], x["length"], x["period"]) for x in r] == want
        assert k == " ".join(plain_collapse(w, want))


def test_hashes_that_lie_change_nothing(monkeypatch):
    """With hashes that call all stretches equal, words decide."""
    monkeypatch.setattr(periodic._Hashes, "equal", lambda self, at, period, length: np.ones(len(at), bool))
    draw = random.Random(8)
    texts = [repetitive(draw) for _ in range(60)]
    _, runs, _ = periodic._of_slice(pa.array([" ".join(w) for w in texts]), 4, 6)
    for w, r in zip(texts, runs.to_pylist(), strict=True):
        assert [(x["start"], x["length"], x["period"]) for x in r] == plain_runs(w)


def test_a_word_that_defeats_hashes_modulo_a_power_of_two():
    """Thue-Morse words have equal hashes modulo 2**64 for every odd base."""
    t = [bin(i).count("1") % 2 for i in range(2048)]
    w = ["xy"[a] for a in t] + ["xy"[1 - a] for a in t] * 4 + ["z"]
    _, runs, _ = periodic._of_slice(pa.array([" ".join(w)]), 4, 6)
    assert [(x["start"], x["length"], x["period"]) for x in runs.to_pylist()[0]] == plain_runs(w)


def plain_op12(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(plain_collapse(w, runs))))


def test_op12_equals_a_plain_version(spark, table, tmp_path):
    extra = [(10**6 + i, "a b c d e f g " * i) for i in range(60)] + [(2 * 10**6 + i, t) for i, t in enumerate([None, "", " ", "a", "a a a a a a", "a b " * 5])]
    some = [(d, t) for d, t in table.items() if len(t or "") < 8000] + extra
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op12_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == len(some)
    for d, t in some:
        assert got[d] == plain_op12(d, t), d


def test_periodic_of_odd_tables(spark):
    d = spark.createDataFrame([(1, "a " * 9, 3), (1, "a " * 9, 3), (None, None, None)], "doc_id long, text string, runs int")
    rows = periodic.find(d).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.runs), r.collapsed) for r in rows) == [(0, 0, 0, ""), (1, 9, 1, "a"), (1, 9, 1, "a")]
    assert periodic.find(d.limit(0)).count() == 0


# fill in the middle


def test_op13_equals_its_sql(spark, tmp_path):
    texts = ["", None, "a", "é", "日本語 😀 x" * 300, "<P>", "x<S", "<<P", "P><S", "a" * 513, "é" * 700, "😀" * 129, "\x00", "<M"] * 40
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for at in (str(tmp_path), SF):
        con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet{'/*.parquet' if at != SF else ''}')")
        got = queries.op13_fim(spark, at)
        want = sorted(con.sql(queries.ORACLES["op13_fim"]).fetchall())
        assert sorted(map(tuple, got.collect())) == want
        assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def plain_cut(text, units, low, high):
    at = [0] + [m.end() for m in re.finditer(units, text)]
    return text[: at[low]], text[at[low] : at[high]], text[at[high] :]


@pytest.mark.parametrize("units", [r"(?s).", r"\S+", r"[^\n]*\n", "b"])
@pytest.mark.parametrize("step", [1, 5, 512])
def test_two_passes_cut_where_a_list_would(units, step):
    draw = random.Random(6)
    for _ in range(150):
        text = "".join(draw.choice("ab \né日😀") for _ in range(draw.randint(0, 40)))
        matcher = fim.CodePoints(step) if units == r"(?s)." else fim.Matches(units)
        data = matcher.read(text.encode())
        n = fim.count(matcher, data)
        assert n == len(re.findall(units, text))
        low, high = sorted((draw.randint(0, n), draw.randint(0, n)))
        i, j = fim.ends(matcher, data, low, high)
        assert tuple(matcher.written(x).decode() for x in (data[:i], data[i:j], data[j:])) == plain_cut(text, units, low, high)


def test_the_iterator_stops_at_the_higher_rank():
    seen = []

    class Watched(fim.Matches):
        def strides(self, text):
            for s in super().strides(text):
                seen.append(s)
                yield s

    assert fim.ends(Watched("."), "abcdefgh", 1, 3) == (1, 3) and len(seen) == 3


def test_fim_by_words_keeps_other_columns(spark):
    d = spark.createDataFrame([(i, f"word{i} two three four five", "s", "kept") for i in range(200)] + [(None, None, None, None), (None, "x y", "s", "k"), (None, "x y", "s", "k")], "doc_id long, text string, form string, `odd.name` string")
    made = fim.transform(d, pattern=r"\S+\s*", seed="9", plain=20, spm=50)
    assert made.columns == ["doc_id", "text", "odd.name", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("back", fim.restored(made.output, made.form)).collect()
    assert len(rows) == 203 and all(r.back == (r.text or "") for r in rows) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        if r.form == "psm":
            prefix, rest = r.output[3:].split("<S>")
            suffix, middle = rest.split("<M>")
            assert (len(prefix), len(middle)) == (r.prefix_chars, r.middle_chars) and all(x == "" or x[0] != " " for x in (middle, suffix))
    assert fim.transform(d.limit(0)).count() == 0
