"""Two-tier byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from sumveil.llm import byte_bpe
from sumveil.llm.queries import tokenizer_path

PATH, PATTERN = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(PATH, PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_minimal_and_perfect(bpe):
    keys = bpe.hash.keys
    assert bpe.hash.find(keys).tolist() == list(range(len(keys)))
    assert sorted(bpe.hash.at.tolist()) == list(range(len(keys)))  # each slot holds one string
    others = [b"", b"\xff\xfe\xfd", b"x" * 5000, *(k + b"\x00" for k in keys.slice(0, 500).to_pylist())]
    assert set(bpe.hash.find(pa.array(others, pa.binary())).tolist()) == {-1}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000])
def test_hash_of_small_sets(n):
    keys = pa.array([b"%d" % i for i in range(n)], pa.binary())
    assert byte_bpe.PerfectHash(keys).find(pa.array([b"%d" % i for i in range(n + 3)], pa.binary())).tolist() == [*range(n), -1, -1, -1]


def test_hash_refuses_repeats():
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash(pa.array([b"a", b"a"]))


def test_ids_equal_the_library(bpe, library):
    rng = random.Random(3)
    letters = "aabcdeThe.,'s!?  \n\n\t 　é0 19<|endoftext|>'LĹ漢\x1c\x85​-#Ως😀\U0010ffff\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["", "\n", " ", "I'll we've", "x" * 30_000, " " * 20_000 + "a", "ab" * 9000, "<|endoftext|>", "漢" * 4000]
    for _ in range(2):
        ids, bounds = bpe.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids.astype(np.int64), bounds).to_pylist() == [t.encode() for t in texts]


def test_every_character(bpe, library):
    texts = [f"a{chr(c)}1 {chr(c)}." for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    ids, bounds = bpe.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]


def test_merges_take_the_leftmost_of_equal_rank(tmp_path):
    path = tmp_path / "ranks"
    pieces = [bytes([b]) for b in range(256)] + [b"aa", b"aaa", b"ba"]
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    small = byte_bpe.ByteBpe(str(path), r"\S+")
    assert small.merge(b"aaaaa") == [256, 257] and small.merge(b"baaa") == [98, 257] and small.merge(b"zb") == [122, 98]


ODD = [
    (None, "No id at all.", "x", 1),
    (3, None, "x", None),
    (1, "", None, 1),
    (2, "Same row. Twice!", "x", 1),
    (2, "Same row. Twice!", "x", 1),
    (7, "  blanks \n\n around\t", "x", 1),
    (9, "Wörter " * 30_000, "x", 1),
    (8, "x" * 20_000 + " <|endoftext|>", "x", 1),
]


@pytest.mark.parametrize("slice_bytes", [64, byte_bpe.SLICE_BYTES])
def test_operator_round_trip(spark, library, monkeypatch, slice_bytes):
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", slice_bytes)
    docs = spark.createDataFrame(ODD, "doc_id long, text string, ids string, _key int")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ODD]
    key = lambda r: (r[0] or -1, len(r[1]))
    assert sorted(((r.doc_id, r.ids, bytes(r.bytes)) for r in decoded.collect()), key=key) == sorted(want, key=key)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(map(tuple, byte_bpe.digests(decoded).collect()), key=lambda r: (r[0] or -1, r[1]))
    assert got == [(i, len(x), sha(" ".join(map(str, x)).encode()), sha(b)) for i, x, b in sorted(want, key=key)]


def test_long_text_in_parts(bpe, library, monkeypatch):
    text = "Some words, with  double  blanks\n and 'quotes'll " * 400
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 100)
    parts = bpe.parts(text)
    assert len(parts) > 50 and "".join(parts) == text
    assert [i for p in parts for i in bpe.encode([p])[0].tolist()] == library.encode_ordinary(text)


def test_empty_null_and_foreign_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(docs, PATH, PATTERN).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.bytes for r in byte_bpe.decode(lists, PATH, PATTERN).collect()}
    assert got == {1: None, 2: bytearray(), 3: bytearray(b'!"')}
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), PATH, PATTERN).collect()


def test_other_vocabulary(spark):
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "Straße 漢字 und mehr")], "doc_id long, text string")
    row = byte_bpe.decode(byte_bpe.encode(docs, path, PATTERN), path, PATTERN).first()
    assert bytes(row.bytes).decode() == "Straße 漢字 und mehr"
