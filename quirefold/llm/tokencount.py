"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie in one flat numpy array of symbols with an array of owners. In each round every
pre-token finds its lowest-ranked adjacent pair and applies it at all its places at once; pre-tokens without a mergeable
pair are counted and leave the array. No merge makes a pair of lower rank than itself, so this equals one merge at a time.

A long pre-token would need a round over all its symbols for each of its many ranks; so pre-tokens beyond ``LONG_BYTES`` keep an index
of places by rank, and a round touches the places of its rank and their neighbours only.

Defined results: a null text counts 0 tokens and 0 bytes. Repeated rows count each on their own. Whole texts are counted;
memory is bounded by one batch and a cache of fixed size. Other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.bpe import CACHE_CHARS, byte_symbols
from quirefold.llm.common import keeps, read, small_batches, tidy

#: The splitting pattern of the word-end vocabulary file (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Lower case of capitals newer than Python's tables (fixed values), and of sigma without regard to word ends.
LOWER_CASE = str.maketrans({"\ua7cb": "\u0264", "\ua7dc": "\u019b", "\u03a3": "\u03c3"})
#: Entries each worker keeps in its pre-token cache before it starts afresh.
CACHE_ENTRIES = 250_000
#: Symbols merged at once.
CHUNK_SYMBOLS = 1 << 20
#: Bytes of a pre-token from which on its places are indexed by rank.
LONG_BYTES = 2048


def merge_counts(symbols: np.ndarray, owner: np.ndarray, n: int, keys: np.ndarray, made: np.ndarray, base: int) -> np.ndarray:
    """Symbols left in each of ``n`` sequences. ``keys``: sorted left * base + right; ``made``: symbol each makes, rising with rank."""
    counts = np.bincount(owner, minlength=n)
    none = np.iinfo(np.int64).max
    while len(symbols) > 1:
        key = symbols[:-1] * base + symbols[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank = np.where((keys[at] == key) & (owner[:-1] == owner[1:]), made[at], none)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(np.append(rank, none), starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        mine = np.repeat(best, sizes)
        hit = (rank == mine[:-1]) & (rank != none)
        # Overlapping places (a a a) are taken from the left, every other one.
        i = np.flatnonzero(hit)
        if not len(i):
            break
        run = np.concatenate([[True], np.diff(i) > 1])
        first = i[np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))]
        i = i[(i - first) % 2 == 0]
        symbols = symbols.copy()
        symbols[i] = mine[i]
        keep = mine != none  # the rest is done
        counts -= np.bincount(owner[i], minlength=n)
        keep[i + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return counts


def merge_counts_indexed(symbols: np.ndarray, owner: np.ndarray, n: int, keys: np.ndarray, made: np.ndarray, base: int) -> np.ndarray:
    """As ``merge_counts``, by an index of places by rank; ranks rise over all sequences at once, which are apart anyway."""
    size = len(symbols)
    counts = np.bincount(owner, minlength=n)
    none = np.iinfo(np.int32).max
    symbol = symbols.astype(np.int32)
    after = np.arange(1, size + 1, dtype=np.int32)
    after[np.flatnonzero(np.append(owner[1:] != owner[:-1], True))] = -1
    before = np.arange(-1, size - 1, dtype=np.int32)
    before[np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))] = -1
    rank = np.full(size, none, np.int32)
    places: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def note(at: np.ndarray):
        """Ranks of the pairs that begin at these places, and their entries in the index."""
        for part in range(0, len(at), CHUNK_SYMBOLS):
            i = at[part : part + CHUNK_SYMBOLS]
            rank[i] = none
            i = i[after[i] >= 0]
            key = symbol[i].astype(np.int64) * base + symbol[after[i]]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[k] == key
            i, r = i[hit], made[k[hit]]
            rank[i] = r
            order = np.argsort(r, kind="stable")
            i, r = i[order], r[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            for value, group in zip(r[np.concatenate([[0], cut])].tolist() if len(r) else (), np.split(i, cut)):
                if value not in places:
                    places[value] = []
                    heapq.heappush(queue, value)
                places[value].append(group)

    note(np.arange(size))
    while queue:
        r = heapq.heappop(queue)
        i = np.unique(np.concatenate(places.pop(r)))
        i = i[rank[i] == r]
        if not len(i):
            continue
        # Overlapping places (a a a) are taken from the left, every other one.
        run = np.concatenate([[True], after[i[:-1]] != i[1:]])
        nth = np.arange(len(i)) - np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))
        i = i[nth % 2 == 0]
        gone = after[i]
        counts -= np.bincount(owner[i], minlength=n)
        symbol[i], rank[gone] = r, none
        after[i] = after[gone]
        follows = after[i] >= 0
        before[after[i][follows]] = i[follows]
        led = before[i]
        note(np.unique(np.concatenate([i, led[led >= 0]])))
    return counts


class WordEndCounter:
    """Counter for a vocabulary file of the tokenizers library with word ends, NFC, collapsed space and lower case."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = len(vocab) + 1
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if (np.diff(made) <= 0).any():
            raise ValueError("token ids must rise in merge order")
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        self.pattern = regex.compile(PATTERN)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(LOWER_CASE)
        return self.pattern.findall(text.lower())

    def _learn(self, new: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        self._merge([b for b in raw if len(b) <= LONG_BYTES], merge_counts)
        self._merge([b for b in raw if len(b) > LONG_BYTES], merge_counts_indexed)

    def _merge(self, new: list[bytes], merge) -> None:
        while new:
            part, size = [], 0
            while new and (size < CHUNK_SYMBOLS or not part):
                part.append(new.pop())
                size += len(part[-1])
            sizes = np.array([len(b) for b in part])
            raw = np.frombuffer(b"".join(part), np.uint8)
            symbols = self.inner[raw]
            last = np.cumsum(sizes) - 1
            symbols[last] = self.final[raw[last]]
            counts = merge(symbols, np.repeat(np.arange(len(part)), sizes), len(part), self.keys, self.made, self.base)
            self.cache.update(zip((b.decode("utf-8", "surrogatepass") for b in part), counts.tolist()))

    def count(self, texts: list[str | None]) -> list[int]:
        split, extra = [], []
        for t in texts:
            if not t:
                split.append([])
                extra.append(0)
            elif self.special_re is None or not self.special_re.search(t):
                split.append(self.pieces(t))
                extra.append(0)
            else:
                parts = self.special_re.split(t)
                split.append([p for x in parts for p in self.pieces(x)])
                extra.append(len(parts) - 1)
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        get = self.cache.__getitem__
        new: set[str] = set()
        for s in split:
            new.update(set(s).difference(self.cache))
        self._learn(list(new))
        out = [sum(map(get, s)) + e for s, e in zip(split, extra)]
        for p in new:
            if len(p) > CACHE_CHARS:
                del self.cache[p]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> WordEndCounter:
    return WordEndCounter(path)


keeps("tokencount", counter.cache_clear)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", group: int = 256) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of ``df``. ``group``: texts whose pre-tokens are merged together."""

    def run(batches):
        c = counter(path)
        for b in batches:
            col, n = b.column(1), []
            for at in range(0, len(col), group):
                n += c.count(col.slice(at, group).to_pylist())
            size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(tidy(run, "tokencount"), f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    small_batches(spark)
    return count_tokens(read(spark, sf_dir, "documents"), default_path()).withColumn("over_limit", F.col("n_tokens") > limit)


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE_SQL: dict[str, str] = {}
