"""BPE encoding and decoding.

Encoding: one Aho-Corasick pass over a pre-token finds every vocabulary entry in it. A backtracking search takes the
longest match first and keeps it only if the pair (previous token, this token) is compatible, that is, if merging by
rank would never join across that border; dead positions are marked so each is left at most once. The surviving path is
exactly the result of applying the merges by rank. Decoding gathers byte ranges through an offset table.

Defined results: a null text is the empty text (no ids, decoded to ''). Repeated rows are encoded each on its own.
Whole texts are processed; memory is bounded by one batch and by caches of fixed size. Other columns are not read.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import keeps, read, small_batches, tidy

#: The byte-level splitting pattern of the vocabulary files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries each worker keeps of pre-tokens met more than once, of those met lately, and of pairs, before it starts afresh.
CACHE_ENTRIES, LATELY_ENTRIES, PAIR_ENTRIES = 250_000, 120_000, 200_000
#: Longer pre-tokens are not kept in a cache: they hardly come again, and may be very long.
CACHE_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stays, the rest moves to 256+."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Decoder:
    """The bytes of all tokens of a byte-level vocabulary file, one after another, and an offset table over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {s: b for b, s in enumerate(byte_symbols())}
        as_bytes = {t: bytes(to_byte[c] for c in s) for s, t in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        table = [as_bytes.get(i, b"") for i in range(max([*as_bytes, *self.special.values()]) + 1)]
        for s, t in self.special.items():
            table[t] = s.encode()
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in table])])
        self._read(spec["model"], as_bytes)

    def _read(self, model: dict, as_bytes: dict[int, bytes]) -> None:
        pass

    def decode(self, ids: np.ndarray) -> str:
        """Ids outside the vocabulary stand for nothing; invalid UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        total = int(size.sum())
        if not total:
            return ""
        put = np.cumsum(size) - size
        take = np.arange(total) + np.repeat(start - put, size)
        return self.blob[take].tobytes().decode("utf-8", "replace")


class ByteBpe(Decoder):
    """Encoder, too."""

    def _read(self, model: dict, as_bytes: dict[int, bytes]) -> None:
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.joined = {(vocab[a], vocab[b]): vocab[a + b] for a, b in pairs}
        # The search compares token ids as ranks: ids must rise in merge order.
        made = list(self.joined.values())
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("token ids must rise in merge order")
        self.parts = {t: ab for ab, t in self.joined.items()}
        # Texts are matched as Latin-1 strings, one character a byte.
        self.automaton = ahocorasick.Automaton()
        for t, b in as_bytes.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), t))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.lately: dict[str, tuple[int, ...]] = {}

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a border between two tokens that each stand for themselves.

        Undo merges on both sides of the border, latest first; the border falls if some pair met on the way would have
        been merged before the merge that hid it.
        """
        hidden_by = 1 << 62
        a, b = left, right
        while True:
            joined = self.joined.get((a, b))
            if joined is not None and joined < hidden_by:
                return False
            pa_, pb_ = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb_ is None:
                return True
            # On a tie (same token on both sides) the left merge happens first, so the right one is undone first.
            if pb_ is None or (pa_ is not None and a > b):
                hidden_by, a = a, pa_[1]
            else:
                hidden_by, b = b + 1, pb_[0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        # The search's first try: the longest match at every place. Mostly all its pairs are compatible.
        fits = self.compatible
        first = [token for _, (_, token) in self.automaton.iter_long(text)]
        for pair in zip(first, first[1:]):
            ok = fits.get(pair)
            if ok is None:
                ok = fits[pair] = self._fits(*pair)
            if not ok:
                return self._search(text)
        return tuple(first)

    def _search(self, text: str) -> tuple[int, ...]:
        n = len(text)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(text):
            found[end - length + 1].append((end + 1, token))  # shorter first
        alive = bytearray(b"\1") * (n + 1)
        fits, path, pos, last = self.compatible, [], 0, -1
        k = len(found[0]) - 1 if n else -1
        while pos < n:
            here = found[pos]
            while k >= 0:
                end, token = here[k]
                if alive[end]:
                    if last < 0:
                        break
                    ok = fits.get((last, token))
                    if ok is None:
                        ok = fits[last, token] = self._fits(last, token)
                    if ok:
                        break
                k -= 1
            if k >= 0:
                path.append((pos, k, token))
                pos, last = end, token
                if pos < n:
                    k = len(found[pos]) - 1
            else:
                alive[pos] = 0
                pos, k, _ = path.pop()
                k -= 1
                last = path[-1][2] if path else -1
        return tuple(t for _, _, t in path)

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        pieces = self.pattern.findall(text)
        cache, lately = self.cache, self.lately
        new = set(pieces).difference(cache)
        for p in new:
            known = lately.pop(p, None)
            if known is None:
                cache[p] = lately[p] = self.encode_piece(p)
            else:
                cache[p] = known
        out = [cache[p] for p in pieces]
        for p in new:
            if len(p) > CACHE_CHARS:
                del cache[p]
                lately.pop(p, None)
            elif p in lately:  # met in this text only
                del cache[p]
        return out

    def encode(self, text: str | None) -> array:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        if len(self.lately) > LATELY_ENTRIES:
            self.lately.clear()
        if len(self.compatible) > PAIR_ENTRIES:
            self.compatible.clear()
        if not text:
            return array("i")
        if self.special_re is None or not self.special_re.search(text):
            return array("i", chain.from_iterable(self._plain(text)))
        out, at = array("i"), 0
        for m in self.special_re.finditer(text):
            out.extend(chain.from_iterable(self._plain(text[at : m.start()])))
            out.append(self.special[m[0]])
            at = m.end()
        out.extend(chain.from_iterable(self._plain(text[at:])))
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


keeps("bpe", codec.cache_clear, decoder.cache_clear)


def _id_lists(c: ByteBpe, col: pa.Array) -> pa.ListArray:
    ids = [c.encode(t.as_py()) for t in col]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.frombuffer(x, np.int32) for x in ids if len(x)] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _texts(c: Decoder, col: pa.ListArray) -> pa.Array:
    flat, off, valid = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([c.decode(flat[off[i] : off[i + 1]]) if valid[i] else "" for i in range(len(col))], pa.string())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of ``df``; ``path``: a byte-level vocabulary file on every machine."""

    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _id_lists(c, b.column(1))], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(tidy(run, "bpe"), f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded text) for every row of ``df``; a null array decodes to the empty text."""

    def run(batches):
        c = decoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _texts(c, b.column(1))], [id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(tidy(run, "bpe"), f"`{id_col}` {kind}, ids array<int>, decoded string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded text) as ``decode(encode(df))`` gives it, in one pass through one worker."""

    def run(batches):
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                ids = _id_lists(c, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _texts(c, ids)], [id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(tidy(run, "bpe"), f"`{id_col}` {kind}, ids array<int>, decoded string")


def digest(coded: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return coded.select(
        id_col,
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    small_batches(spark)
    return digest(round_trip(read(spark, sf_dir, "documents"), path))


QUERIES = {"op5_bpe_codec": op5_bpe_codec}
ORACLE_SQL: dict[str, str] = {}
