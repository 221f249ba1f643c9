"""Blocked Bloom filters of bounded size.

A filter has at most ``MAX_BLOCKS`` blocks of 512 bits, so 16 MB, and holds 8 million keys well; with more it lets more
through, and beyond ``WORTH`` keys none is built and every row counts as possible. A key sets one bit in each of the eight
words of one block; of more than 2^16 blocks the number shares bits with the place in the first word, which then tells less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 18
BITS_A_KEY = 16
#: Of more keys a full filter has under four bits for each, and lets a third of all other rows through.
WORTH = MAX_BLOCKS * 512 // 4


def n_blocks(n_keys: int) -> int:
    """A power of two."""
    need = max(1, -(-n_keys * BITS_A_KEY // 512))
    return min(MAX_BLOCKS, 1 << (need - 1).bit_length())


def place(h: Column, blocks: int) -> tuple[Column, Column]:
    """Of a well mixed 64-bit hash: its block, and an array of its bit in each of the block's words."""
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 16 + 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]
    return h.bitwiseAND(F.lit(blocks - 1)), F.array(*bit)


def build(keys: DataFrame, h: Column, blocks: int) -> DataFrame:
    """(bloom_block, w0 .. w7): at most ``blocks`` rows, built by partial aggregation."""
    block, bits = place(h, blocks)
    return keys.select(block.alias("bloom_block"), bits.alias("m")).groupBy("bloom_block").agg(*[F.bit_or(F.col("m")[i]).alias(f"w{i}") for i in range(8)])


def collect(keys: DataFrame, h: Column, n_keys: int) -> np.ndarray:
    """The filter of ``n_keys`` hashes as an array of blocks x 8 words."""
    if n_keys > WORTH:
        return np.full((1, 8), np.iinfo(np.uint64).max)
    blocks = n_blocks(n_keys)
    out = np.zeros((blocks, 8), np.uint64)
    got = build(keys, h, blocks).toArrow()
    if got.num_rows:
        words = np.stack([got.column(f"w{i}").to_numpy().view(np.uint64) for i in range(8)], 1)
        out[got.column("bloom_block").to_numpy()] = words
    return out


def test(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    block = bloom[(h & np.uint64(len(bloom) - 1)).astype(np.int64)]
    ok = np.ones(len(h), bool)
    for i in range(8):
        ok &= (block[:, i] >> ((h >> np.uint64(16 + 6 * i)) & np.uint64(63))) & np.uint64(1) == 1
    return ok


def probe(rows: DataFrame, h: Column, keys: DataFrame, key: str, n_keys: int, into: str) -> DataFrame:
    """``rows`` with a boolean column: whether ``keys`` may hold the hash. The filter sent to all has at most MAX_BLOCKS rows."""
    if n_keys > WORTH:
        return rows.withColumn(into, F.lit(True))
    blocks = n_blocks(n_keys)
    filter_ = build(keys, F.col(key), blocks).select(F.struct("bloom_block", *[f"w{i}" for i in range(8)]).alias("__bloom"))
    block, bits = place(h, blocks)
    joined = rows.withColumn("__place", F.struct(block.alias("block"), bits.alias("bits"))).join(F.broadcast(filter_), F.col("__place.block") == F.col("__bloom.bloom_block"), "left")
    hit = F.lit(True)
    for i in range(8):
        hit &= F.coalesce(F.col(f"__bloom.w{i}").bitwiseAND(F.col("__place.bits")[i]) == F.col("__place.bits")[i], F.lit(False))
    return joined.withColumn(into, hit).drop("__place", "__bloom")


def drop_keys(rows: DataFrame, h: Column, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose hash is not in ``keys``. Only rows that the filter lets through are shuffled for the exact anti-join."""
    n = keys.count()
    if not n:
        return rows
    if n > WORTH:
        return rows.withColumn("__key", h).join(keys.select(F.col(key).alias("__key")), "__key", "left_anti").select(*rows.columns)
    marked = probe(rows, h, keys, key, n, "__maybe")
    sure = marked.where("not __maybe").drop("__maybe")
    rest = marked.where("__maybe").withColumn("__key", h).join(keys.select(F.col(key).alias("__key")), "__key", "left_anti").select(*rows.columns)
    return sure.unionByName(rest)
