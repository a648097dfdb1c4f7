"""Tokenising, the binary output and packing against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from sumveil.llm import packing, wavelet
from sumveil.llm.queries import tokenizer_path
from sumveil.llm.tokens import WordEncoder

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, start string, part int, name string"
ODD = [
    (None, "No id at all.", "x", 1, "n"),
    (3, None, "x", None, None),
    (1, "", None, 1, "n"),
    (2, "Same row. Twice!", "x", 1, "n"),
    (2, "Same row. Twice!", "x", 1, "n"),
    (7, "  blanks \n\n around\t", "x", 1, "n"),
    (9, "word " * 30_000, "x", 1, "n"),
    (8, "x" * 20_000 + " <|endoftext|>", "x", 1, "n"),
]


def library(name):
    """The library's own encoder, as it is loaded."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def assert_equal(enc, tokenizer, texts):
    ids, offsets = enc.encode(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, a, b, w in zip(texts, offsets, offsets[1:], want, strict=False) if ids[a:b].tolist() != w] == []


@pytest.mark.parametrize("name, spaced", [(BYTE, True), (WORD, False)])
def test_every_character_before_a_stop(name, spaced):
    enc = WordEncoder(tokenizer_path(name), spaced)
    for first in range(0, 0x30000, 0x4000):
        chars = [chr(c) for c in range(first, first + 0x4000) if not 0xD800 <= c < 0xE000]
        assert_equal(enc, library(name), [f"{c}. a{c}, {c}b. x{c}y {c}" for c in chars])


@pytest.mark.parametrize("name, spaced", [(BYTE, True), (WORD, False)])
def test_special_strings_give_their_ids(name, spaced):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b. c", " <|endoftext|> ", "x <|endoftext|>, y", "<|ENDOFTEXT|> z", "<|startoftext|>.<|endoftext|>", "\n<|endoftext|>\nq  <|endoftext|>", "w<|endoftext|>. v", "A<b> <"]
    assert_equal(WordEncoder(tokenizer_path(name), spaced), library(name), texts)
    plain = library(name)
    plain.encode_special_tokens = True
    assert_equal(WordEncoder(tokenizer_path(name), spaced, plain=True), plain, texts)


@pytest.mark.parametrize("name, spaced", [(BYTE, True), (WORD, False)])
def test_word_encoder_equals_whole_texts(name, spaced):
    rng = random.Random(1)
    letters = "ab.,'s!?  \n\n\t 　é0 19<|endoftext|>'LĹ漢\x1c\x85​-#Ως"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["", "\n", " ", "a\n", "A. b, c."]
    enc = WordEncoder(tokenizer_path(name), spaced)
    for _ in range(2):
        ids, offsets = enc.encode(pa.array(texts))
        want = [e.ids for e in library(name).encode_batch_fast(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_words_beyond_the_memory_are_encoded_too(monkeypatch):
    monkeypatch.setattr("sumveil.llm.tokens.REMEMBERED", 5)
    texts = [" ".join(f"w{i}." for i in range(k, k + 9)) for k in range(30)]
    enc = WordEncoder(tokenizer_path(BYTE), True)
    for t in texts:
        assert enc.encode(pa.array([t]))[0].tolist() == library(BYTE).encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 70_000), (511, 3), (5000, 40), (5000, 50_257), (3000, 200_000)])
def test_wavelet_matrix(n, top):
    x = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    wm, docs, known, lengths = wavelet.from_bytes(wavelet.to_bytes(x, np.arange(2), np.array([True, False]), np.array([n, 0])))
    assert (wm.all() == x).all() and known.tolist() == [True, False]
    for i in range(0, n, 97):
        assert wm.access(i) == x[i]
    for symbol in {int(v) for v in x[:5]} | {top}:
        at = np.flatnonzero(x == symbol)
        assert wm.rank(symbol, n) == len(at) and wm.rank(symbol, n // 2) == (at < n // 2).sum()
        assert [wm.select(symbol, j) for j in range(len(at))] == at.tolist()
        with pytest.raises(IndexError):
            wm.select(symbol, len(at))


def expected(path, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = sorted(((i, x or "") for i, x, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [(i, [*t.encode(x, add_special_tokens=False).ids, end]) for i, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_binary_round_trip(spark):
    path = tokenizer_path(BYTE)
    folder, manifest = wavelet.write_shards(spark.createDataFrame(ODD, SCHEMA), path, 0, shard_ids=20)
    got = sorted(map(tuple, wavelet.read_documents(folder, manifest).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, ids in expected(path, 0):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    empty = wavelet.write_shards(spark.createDataFrame([], SCHEMA), path, 0)
    assert wavelet.read_documents(*empty).count() == 0


def test_cuts_cost_least():
    rng = np.random.default_rng(0)
    pad = lambda n, w: 0 if n & (n - 1) == 0 else w - n
    for _ in range(300):
        w = 16
        ends = np.cumsum(rng.integers(1, w + 1, rng.integers(1, 14)))
        penalty = rng.choice([0, 2, 5], len(ends))
        at = dict(zip(ends.tolist(), penalty.tolist()))
        best = {0: 0}
        for j in ends.tolist():
            best[j] = min(best[i] + pad(j - i, w) + at[j] for i in best if j - i <= w)
        cuts = packing.best_cuts(ends, penalty, w).tolist()
        assert sum(pad(b - a, w) + at[b] for a, b in zip([0, *cuts], cuts)) == best[ends[-1]]


@pytest.mark.parametrize("window, held", [(64, 1), (4096, 1 << 20)])
def test_packing_covers_every_id_once(spark, window, held):
    path = tokenizer_path(WORD)
    rows = packing.pack(spark.createDataFrame(ODD, SCHEMA), path, 2, window=window, held_ids=held).collect()
    docs, by_row = expected(path, 2), {}
    for r in rows:
        by_row.setdefault(r.row_id, []).append(r)
    assert len(by_row) == len(docs)
    left = [(i, tuple(ids)) for i, ids in docs]
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.start)
        ids = next(x for x in left if x[0] == pieces[0].doc_id and len(x[1]) == pieces[0].doc_tokens and crc(x[1][: pieces[0].length]) == pieces[0].ids_crc32)
        left.remove(ids)
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == crc(ids[1][at : at + p.length]) and p.doc_tokens == len(ids[1])
            at += p.length
        assert at == len(ids[1])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        total += at
    assert padding < (0.05 if window > 64 else 0.2) * total
    assert packing.pack(spark.createDataFrame([], SCHEMA), path, 2).count() == 0
