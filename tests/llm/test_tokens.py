"""BPE codec and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import bpe, tokencount

tokenizers = pytest.importorskip("tokenizers")
POOL = "ab cdehinorst \n\t'ĠéßЖ漢🙂0123.,!-_AZ  \x1c\x85İΣς́é"


def texts():
    rng = random.Random(1)
    out = ["", " ", "a" * 3000, "the quick brown fox " * 400, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|startoftext|>z", "<|end", None]
    for i in range(700):
        if i % 3:
            out.append("".join(rng.choice(POOL) for _ in range(rng.randint(0, 50))))
        else:
            out.append(" ".join(rng.choice(["the", "there", "aaaa" * rng.randint(1, 9), "information", "ants", "zzzz", "<|endoftext|>"]) for _ in range(6)))
    return out


def test_ids_and_decoding():
    path = bpe.default_path()
    codec, lib = bpe.ByteBpe(path), tokenizers.Tokenizer.from_file(path)
    for t in texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(codec.encode(t)) == ids, repr(t)
        assert codec.decode(np.array(ids, np.int64)) == lib.decode(ids, skip_special_tokens=False)


def test_every_token_decodes_and_cut_bytes_become_replacements():
    path = bpe.default_path()
    codec, lib = bpe.ByteBpe(path), tokenizers.Tokenizer.from_file(path)
    for i in range(0, 50_257, 37):
        assert codec.decode(np.array([i])) == lib.decode([i], skip_special_tokens=False)
    assert codec.decode(np.array([10**9, -1])) == ""


def test_counts():
    path = tokencount.default_path()
    counter, lib = tokencount.WordEndCounter(path), tokenizers.Tokenizer.from_file(path)
    ts = texts()
    assert counter.count(ts) == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in ts]


def test_merge_counts_take_overlaps_from_the_left():
    # Symbols 0; pair (0, 0) makes 1; pair (1, 1) makes 2.
    keys, made = np.array([0 * 9 + 0, 1 * 9 + 1]), np.array([1, 2])
    for n in range(1, 12):
        got = tokencount.merge_counts(np.zeros(n, np.int64), np.zeros(n, np.int64), 1, keys, made, 9)
        assert got[0] == n // 4 + (n % 4) // 2 + n % 2


def test_queries_on_odd_rows(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(ts)] + [(0, ts[0], "clash", [1]), (None, "null id", None, None)], "doc_id long, text string, decoded string, ids array<int>")
    path = bpe.default_path()
    lib = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.digest(bpe.decode(bpe.encode(df, path), path)).collect()}
    assert sorted(map(tuple, bpe.round_trip(df, path).collect()), key=repr) == sorted(map(tuple, bpe.decode(bpe.encode(df, path), path).collect()), key=repr)
    for i, t in enumerate(ts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    counts = tokencount.count_tokens(df, tokencount.default_path())
    assert counts.count() == len(ts) + 2
    assert counts.where("doc_id = 8").first().asDict() == {"doc_id": 8, "n_bytes": 0, "n_tokens": 0}
    assert counts.agg(F.sum("n_bytes")).first()[0] == sum(len((t or "").encode()) for t in ts) + len("null id")
    empty = df.limit(0)
    assert tokencount.count_tokens(empty, tokencount.default_path()).count() == bpe.decode(bpe.encode(empty, path), path).count() == 0


def test_long_pre_tokens():
    path = tokencount.default_path()
    counter, lib = tokencount.WordEndCounter(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(8)
    words = ["the", "quick", "information", "zebra", "ness", "aaa", "é", "漢", "x"]
    ts = ["".join(rng.choice(words) for _ in range(n)) for n in (450, 900, 5000, 20_000)]
    ts += ["".join(chr(rng.randint(97, 122)) for _ in range(30_000)), "a" * 9000, "ab" * 6000 + "a", "!" * 5000 + "word", "é" * 3000]
    assert counter.count(ts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in ts]


def test_indexed_merges_equal_dense_ones():
    rng = np.random.default_rng(2)
    base = 40
    for _ in range(60):
        pairs = {}
        for made in range(5, 30):
            pairs.setdefault((int(rng.integers(0, made)), int(rng.integers(0, made))), made)
        keys = np.array([a * base + b for a, b in pairs])
        made = np.array(list(pairs.values()))
        order = np.argsort(keys)
        sizes = rng.integers(1, 60, 5)
        owner, symbols = np.repeat(np.arange(5), sizes), rng.integers(0, 5, sizes.sum())
        args = (symbols, owner, 5, keys[order], made[order], base)
        assert tokencount.merge_counts_indexed(*args).tolist() == tokencount.merge_counts(*args).tolist()
