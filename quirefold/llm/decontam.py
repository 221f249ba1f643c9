"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and case; numbers, names (capitalised) and units (after a number) become typed
placeholders. Each window has up to four readings: all values as they are; numbers and units as slots; capitalised words
inside a sentence too; and those that begin one too. The first two do not depend on letter case, so an item in small or capital letters is
found; the last finds an item whose sentences begin with a name. Windows of template tokens are hash-joined between documents
and benchmark items. The windows of one document, item, diagonal (place in the text less place in the item) and reading are one
alignment; it counts if its slots are consistent: each value of the item's slots stands for one value of the document, so the
item itself, or the item with other numbers and names put in throughout, but not a text that merely has the same shape. A
document is contaminated by an item if consistent alignments cover at least ``least`` of the item's windows.

A reading that leaves a window fewer than ``literals`` plain words is not used. Other names in a text of one case are not found.
Only windows that pass a Bloom filter of the benchmark's (of bounded size) leave a document, so the join's input is small
on both sides and Spark picks its kind by size.

Defined results: null and empty texts on either side match nothing; an item shorter than a window is one window of all its
tokens. Rows of one id and text are one document, with one row for
each item it holds; repeated items match alike. Columns beside id and text are not read. Whole texts are processed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bloom
from quirefold.llm.common import read, small_batches, store, tidy
from quirefold.llm.words import Words, batches_of, mix, run_hashes, span_hash

WINDOW, LITERALS, LEAST = 8, 4, 0.5
#: Unit words (fixed values); they are placeholders after a number only.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers kilometre kilometres"
    " mg g kg t oz lb lbs gram grams kilogram kilograms pound pounds ton tons ml cl l liter liters litre litres gallon gallons"
    " s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " hz khz mhz ghz b kb mb gb tb w kw v a j kj cal kcal k c f degree degrees percent usd eur gbp dollar dollars euro euros cent cents"
).split()
_NUMBER, _NAME, _UNIT = (mix(np.array([x], np.uint64))[0] for x in (11, 13, 17))

_CORE = np.zeros(256, bool)
_CORE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True


class Template:
    """Template tokens of a batch: ``value`` hashes, ``offset`` of each text's tokens, and for each reading ``slot`` (not a plain
    word) and ``shape`` hashes. A reading's slots hold those of the reading before it."""

    def __init__(self, texts: pa.Array):
        w = Words(texts)
        data = w.data
        core = np.append(np.flatnonzero(_CORE[data]), len(data))
        # Each word from its first to its last letter, digit or non-ASCII byte.
        first = core[np.searchsorted(core, w.start)]
        last = core[np.maximum(np.searchsorted(core, w.end) - 1, 0)]
        keep = first < w.end
        word_doc = np.repeat(np.arange(len(w.offset) - 1), np.diff(w.offset))
        stop = np.zeros(len(w.start), bool)
        if len(w.start):
            # A sentence ends with a word that has a stop behind its core.
            stops = np.concatenate([[0], np.cumsum(_STOP[data])])
            stop = stops[w.end] > stops[np.where(keep, np.minimum(last + 1, w.end), w.start)]
        begins = np.concatenate([[True], stop[:-1] | (word_doc[1:] != word_doc[:-1])]) if len(stop) else stop
        low = data.copy()
        upper = (data >= 65) & (data <= 90)
        low[upper] += 32
        if len(data) > 1:
            latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
            low[latin] += 0x20
            capital = upper.copy()
            capital[latin - 1] = True
        else:
            capital = upper
        f = first[keep]
        self.value = run_hashes(low, f, last[keep] + 1)
        doc = word_doc[keep]
        self.offset = np.searchsorted(doc, np.arange(len(w.offset)))
        lead = data[f]
        number = (lead >= 0x30) & (lead <= 0x39)
        # The word before may be mere punctuation that ended a sentence.
        run = np.concatenate([[0], np.cumsum(begins)])
        at = np.flatnonzero(keep)
        prev = np.concatenate([[-1], at[:-1]]) if len(at) else at
        fresh = run[at + 1] > run[prev + 1]
        unit = np.isin(self.value, _unit_hashes()) & np.concatenate([[False], number[:-1] & (doc[1:] == doc[:-1])]) if len(at) else number
        name = capital[f] & ~number & ~unit
        self.slot = [np.zeros(len(f), bool), number | unit, number | unit | name & ~fresh, number | unit | name]
        kind = np.where(number, _NUMBER, np.where(unit, _UNIT, _NAME))
        self.shape = [np.where(slot, kind, self.value) for slot in self.slot]

    def windows(self, size: int, literals: int):
        """(reading, first tokens, hashes, readings) of the windows of ``size`` tokens within a text, each under every reading that
        differs from those before it; ``readings``: bits of all readings in which the window is the same."""
        n = np.maximum(np.diff(self.offset) - size + 1, 0)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offset[:-1], n)
        count = []
        for slot in self.slot:
            sums = np.concatenate([[0], np.cumsum(slot, dtype=np.int32)])
            count.append(sums[at + size] - sums[at])
        for k, shape in enumerate(self.shape):
            use = (count[k] > count[k - 1]) & (count[k] <= size - min(literals, size)) if k else np.ones(len(at), bool)
            bits = sum((count[r][use] == count[k][use]).astype(np.int32) << r for r in range(k, len(self.shape)))
            yield k, at[use], span_hash(shape, at[use], at[use] + size), bits

    def slots(self, reading: int, at: int, size: int) -> list[tuple[int, int]]:
        """(type, value) hashes of the slots of a window."""
        i = np.flatnonzero(self.slot[reading][at : at + size]) + at
        return list(zip(self.shape[reading][i].view(np.int64).tolist(), self.value[i].view(np.int64).tolist()))


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        _units.append(np.unique(Words(pa.array([" ".join(UNITS)])).hash))
    return _units[0]


SLOTS = "array<struct<kind:long,value:long>>"


def _emit(part: pa.RecordBatch, ids: list[int], t: Template, size: int, reading: int, at: np.ndarray, h: np.ndarray, bits: np.ndarray | None = None):
    doc = np.searchsorted(t.offset, at, "right") - 1
    d = pa.array(doc)
    slots = [[{"kind": a, "value": b} for a, b in t.slots(reading, x, size)] if reading else [] for x in at.tolist()]
    kind = pa.list_(pa.struct([("kind", pa.int64()), ("value", pa.int64())]))
    more = {} if bits is None else {"readings": pa.array([[r for r in range(len(t.slot)) if b >> r & 1] for b in bits.tolist()], pa.list_(pa.int32()))}
    return pa.RecordBatch.from_arrays([*(part.column(c).take(d) for c in ids), pa.array(h.view(np.int64)), pa.array((at - t.offset[doc]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(slots, kind), *more.values()], [*(part.schema.names[c] for c in ids), "h", "pos", "size", "slots", *more])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, literals: int = LITERALS, least: float = LEAST) -> DataFrame:
    """(id, key, item, covered, verbatim) for every document and item that contaminates it.

    ``key``: a hash of id and text; ``covered``: share of the item's windows; ``verbatim``: all of them have the item's values.
    """
    spark = small_batches(docs.sparkSession)
    item_kind, doc_kind = (x.schema[c].dataType.simpleString() for x, c in ((benchmark, item_col), (docs, id_col)))

    def cut_items(batches):
        for b in batches:
            for part in batches_of(b, 1):
                t = Template(part.column(1))
                size = np.diff(t.offset)
                for s in np.unique(np.minimum(size, window)).tolist():
                    if not s:
                        continue
                    for reading, at, h, bits in t.windows(s, literals):
                        doc = np.searchsorted(t.offset, at, "right") - 1
                        mine = np.minimum(size[doc], window) == s
                        yield _emit(part, [0], t, s, reading, at[mine], h[mine], bits[mine])

    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")).distinct().mapInArrow(cut_items, f"item {item_kind}, h long, pos int, size int, slots {SLOTS}, readings array<int>")
    items = store(items, "decontam-items")
    sizes = items.groupBy("size").agg(F.count("*").alias("c")).collect()  # at most ``window`` rows
    blooms = spark.sparkContext.broadcast({r["size"]: bloom.collect(items.where(F.col("size") == r["size"]), F.col("h"), r["c"]) for r in sizes})

    def scan(batches):
        for b in batches:
            for part in batches_of(b, 2):
                t = Template(part.column(2))
                for size, sieve in blooms.value.items():
                    for reading, at, h, _ in t.windows(size, literals):
                        hit = bloom.test(sieve, h)
                        if hit.any():
                            yield _emit(part, [0, 1], t, size, reading, at[hit], h[hit])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(1), F.col(id_col).cast("string"), F.col(text_col)).alias("key"), F.col(text_col).alias("t"))
    found = texts.mapInArrow(tidy(scan), f"id {doc_kind}, key long, h long, pos int, size int, slots {SLOTS}")
    right = items.select("item", "h", "size", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "readings")
    pairs = found.join(right, ["h", "size"]).select("id", "key", "item", "size", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", F.arrays_zip("item_slots", "slots").alias("z"), F.explode("readings").alias("reading"))
    # Each (kind, item's value) may stand for one value only; equal hashes have equal kinds place by place.
    filled = F.transform("z", lambda z: F.struct(z["item_slots"]["kind"].alias("kind"), z["item_slots"]["value"].alias("a"), z["slots"]["value"].alias("b")))
    line = pairs.groupBy("id", "key", "item", "diagonal", "reading").agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(filled))).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["a"]))))
    total = items.groupBy("item").agg(F.countDistinct("pos").alias("total"))
    places = lambda at: F.size(F.array_distinct(F.flatten(F.collect_list(at))))
    best = line.where(consistent).groupBy("id", "key", "item").agg(places(F.col("at")).alias("n"), places(F.when(F.col("reading") == 0, F.col("at"))).alias("same"))
    best = best.withColumn("verbatim", F.col("n") == F.col("same"))
    share = F.col("n") / F.col("total")
    return best.join(total, "item").where(share >= least).select(F.col("id").alias(id_col), "key", F.col("item").alias(item_col), F.round(share, 4).alias("covered"), "verbatim")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, each with every item that it holds."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
