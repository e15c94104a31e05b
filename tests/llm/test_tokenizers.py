"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest

from newsloom.llm import bpe, token_counts

PIECES = P.path("piece_bpe_32k.model")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  ", "   ", "a", "▁", "▁▁ a", " a", "a ", "a  ", "\n\n", " " * 40, " " * 300 + "a", "a" * 3000, "ab" * 500, "the" * 300, "\x00", "日本語", "é", "<s> </s> <|endoftext|>", "it's I'LL", " \n ", "a \n \n b", "x　y", "\x1c\x85z", "a\n b\n  c"]


def texts(n=400, seed=5):
    draw = random.Random(seed)
    parts = ["a", "b", "e", "th", " ", "  ", "\n", "\t", "é", "日", "😀", "▁", "ing", "\x00", "    ", "z", "1", "23", "'s", "x" * 60, "!!", "$", " \n", " \n ", "ß", "the "]
    return ODD + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(n)] + ["".join(draw.choice("abehinortsš日") for _ in range(draw.randint(100, 700))) for _ in range(20)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    import sentencepiece

    ts = texts()
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [len(x) for x in sp.encode(ts)]
    pieces = token_counts.Pieces(PIECES)
    assert token_counts.count_tokens(ts, pieces, token_counts.Store(10)) == want
    store = token_counts.Store(20)  # a store that turns over all the time
    assert [token_counts.count_tokens([t], pieces, store)[0] for t in ts] == want


def test_long_sequences_equal_the_library(monkeypatch):
    """Sequences longer than any bound, and all through blocks."""
    import sentencepiece

    draw = random.Random(2)
    ts = ["".join(draw.choice("abehinortsš日the") for _ in range(n)) for n in (64, 65, 127, 128, 129, 193, 1000, 20000)] + ["the" * 3000, "a" * 5001, "aab" * 3000, "internationalization" * 500, "\n".join(f"word{i}" for i in range(3000))]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = token_counts.Pieces(PIECES)
    assert token_counts.count_tokens(ts, pieces, token_counts.Store(10)) == [len(x) for x in sp.encode(ts)]
    monkeypatch.setattr(token_counts, "SHORT", 2)
    ts = texts()
    assert token_counts.count_tokens(ts, pieces, token_counts.Store(10)) == [len(x) for x in sp.encode(ts)]


@pytest.mark.parametrize("few", [0, 10**9])
def test_places_one_by_one_or_together(tiktoken_encoding, monkeypatch, few):
    monkeypatch.setattr(bpe, "FEW", few)
    ranks, ts = bpe.Ranks(RANKS, P.PATTERN), texts()
    for t, (n, ids, _) in zip(ts, bpe.encode_texts(ts, ranks, bpe.Store(30)), strict=True):
        assert ids.decode() == " ".join(map(str, tiktoken_encoding.encode_ordinary(t))), t


def test_ids_equal_the_library(tiktoken_encoding):
    ts = texts()
    ranks = bpe.Ranks(RANKS, P.PATTERN)
    store = bpe.Store(30)
    for t, (n, ids, data) in zip(ts, bpe.encode_texts(ts, ranks, store), strict=True):
        want = tiktoken_encoding.encode_ordinary(t)
        assert (n, ids.decode()) == (len(want), " ".join(map(str, want))), t
        assert data == t.encode()
    assert ranks.encode("Hello  world") == tiktoken_encoding.encode_ordinary("Hello  world")


def test_queries_equal_the_libraries(spark, tiktoken_encoding):
    from newsloom.llm import queries

    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in queries.op2_token_counts(spark, sf).collect():
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 4096)
    for r in queries.op6_bpe(spark, sf).collect():
        ids = tiktoken_encoding.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_rows_nobody_wants(spark):
    d = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a b", None), (2, "a b", None)], "doc_id long, text string, n_tokens string")
    r = {(x.doc_id, x.n_tokens) for x in token_counts.with_token_counts(d, PIECES).collect()}
    assert r == {(1, 0), (None, 0), (2, 2)}
    enc = bpe.encode(d, RANKS, P.PATTERN, with_ids=True)
    assert enc.count() == 4 and enc.where("doc_id = 1").first().ids == []
    back = {(x.doc_id, bytes(x.data)) for x in bpe.decode(enc, RANKS, P.PATTERN).collect()}
    assert back == {(1, b""), (None, b""), (2, b"a b")}
    assert token_counts.with_token_counts(d.limit(0), PIECES).count() == bpe.encode(d.limit(0), RANKS, P.PATTERN).count() == 0


SPACES = [" ", "  ", "   ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b"]
SIGNS = [".", ",", "'", "''", "'s", "'ll", "!'s", "_", "(", "—", "“", "”", "…", "«", "´", "²", "½", "€", "|", "\x00", "\x7f", "\u0301"]
LETTERS = ["a", "the", "Ab", "s", "t", "é", "Ü", "ß", "я", "日本", "ひ", "한", "ế", "ვ", "ª", "ⅷ", "7", "42", "٣", "😀"]


def test_cuts_by_bytes_equal_the_pattern(tiktoken_encoding):
    """All kinds of white space, signs, letters and digits beside each other, in slices and stores of any size."""
    import pyarrow as pa

    draw = random.Random(11)
    ts = ["".join(draw.choice(draw.choice([SPACES, SIGNS, LETTERS])) for _ in range(draw.randint(0, 25))) for _ in range(4000)]
    ts += [a + b + c for a in SPACES + SIGNS + LETTERS for b in (" ", "\n") for c in SPACES + SIGNS + LETTERS]
    want = [tiktoken_encoding.encode_ordinary(t) for t in ts]
    ranks = bpe.Ranks(RANKS, P.PATTERN)
    assert ranks.known
    for most, step in ((0, 700), (50, 700), (10**6, 100), (10**6, len(ts))):
        store, got = bpe.Store(most), []
        for at in range(0, len(ts), step):
            got += bpe.encode_texts(pa.array([None, *ts])[1:].slice(at, step), ranks, store)
            assert len(store.keys) == len(store.ids) <= most
        for t, ids, (n, decimal, data) in zip(ts, want, got, strict=True):
            assert (n, decimal.decode(), data) == (len(ids), " ".join(map(str, ids)), t.encode()), t


def test_words_held_are_neither_matched_nor_merged_again(monkeypatch, tiktoken_encoding):
    """Words known from other places, beside other signs, cost no work on their characters: that was most of the time of a large table."""
    ranks, store = bpe.Ranks(RANKS, P.PATTERN), bpe.Store(1000)
    words, signs = ["alonreth", "inthelle", "schungen", "2048"], [",", ".", ";", "!!", "|", "\n", "***"]
    list(bpe.encode_texts([w for w in words] + [" " + w for w in words] + signs, ranks, store))
    matched, merged = [], []
    cut, replay = ranks.cut, ranks.replay
    monkeypatch.setattr(ranks, "cut", lambda t: matched.append(t) or cut(t))
    monkeypatch.setattr(ranks, "replay", lambda *x: merged.append(x) or replay(*x))
    draw = random.Random(3)
    ts = ["".join(draw.choice(["", " "]) + draw.choice(words) + draw.choice(signs) for _ in range(200)) for _ in range(20)]
    assert [x[1].decode() for x in bpe.encode_texts(ts, ranks, store)] == [" ".join(map(str, tiktoken_encoding.encode_ordinary(t))) for t in ts]
    assert not matched and not merged


def test_other_patterns_match_whole_texts():
    import tiktoken

    pattern = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
    held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=held, special_tokens={})
    ranks, ts = bpe.Ranks(RANKS, pattern), texts() + ["(the end).\nThe end", "a. b.\n\nc 1234567 (d"]
    for t, (n, ids, data) in zip(ts, bpe.encode_texts(ts, ranks, bpe.Store(100)), strict=True):
        assert (ids.decode(), data) == (" ".join(map(str, library.encode_ordinary(t))), t.encode()), t
