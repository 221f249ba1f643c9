"""Substring dedup by relative Lempel-Ziv parsing.

A word goes if some window of ``width`` words in a row covers it that also starts anywhere else. Every window is routed by
its anchor, the smallest hash among its grams; equal windows have equal anchors. A run of windows with one anchor and the
words they cover are a context. Contexts whose words occur twice are repeats as a whole and need no parsing. The others
whose anchor occurs elsewhere become the reference blocks, with one copy of each repeated context of their anchors: a
block is indexed by one suffix order, each context is factored greedily, from left to right, by lookups in the index of all others
of its block; factors of ``width`` words or more become spans, and of the other windows those that straddle a factor's border are
looked up too. Anchors with very many contexts are salted over several blocks, and then all their windows meet once more by two
hashes of their own, so no task holds all of them.

Defined results: a null or empty text has no words; texts with fewer words than a window keep all. Repeated rows are repeats
of each other. Null ids are ids like others. Words keep their bytes; kept words are joined by one space. Whole texts are
processed; all columns of the input pass through, but for those that bear the name of one of the three that are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bloom
from quirefold.llm.common import forget, read, release, shuffle_width, small_batches, small_tables, store, tidy
from quirefold.llm.words import Words, batches_of, grams, mix, sliding_argmin, span_hash

#: Words of a window, and of the grams that anchor it.
WIDTH, GRAM = 35, 10
#: Contexts of one anchor in a block before it is salted; words of a block, hot windows of a range.
SALT_AT, BLOCK_WORDS, RANGE_WINDOWS = 16_384, 1 << 19, 1 << 20


#: Columns that the operator adds.
ADDED = ("n_words", "n_removed", "kept")


class Contexts:
    """The contexts of a batch: ``doc``, first window ``start`` (a word of the batch), number of windows ``n``, anchor ``h``, digest ``dg``."""

    def __init__(self, w: Words, width: int, gram: int):
        size = np.diff(w.offset)
        n = np.maximum(size - width + 1, 0)
        doc = np.repeat(np.arange(len(size)), n)
        window = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + w.offset[:-1][doc]
        g = w.grams(gram)
        anchor = sliding_argmin(g, width - gram + 1)[window] if len(window) else window
        first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(doc) != 0)])) if len(window) else window
        self.doc, self.start = doc[first], window[first]
        self.n = np.diff(np.append(first, len(window)))
        self.h = g[anchor[first]]
        self.dg = span_hash(w.hash, self.start, self.start + self.n + width - 1)


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """A row's name in the steps between: a hash of id and text, and another. Equal rows share it, which does no harm."""
    return [F.xxhash64(F.lit(1), F.col(id_col).cast("string"), F.col(text_col)).alias("k1"), F.xxhash64(F.lit(2), F.col(id_col).cast("string"), F.col(text_col)).alias("k2")]


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _both(h: np.ndarray, dg: np.ndarray, k1: np.ndarray | None = None) -> np.ndarray:
    x = mix(h ^ mix(dg))
    return x if k1 is None else mix(x + mix(k1))


class Index:
    """All places of a reference block from which a factor may be copied (``starts``), in the order of what follows them.

    Texts end where ``owner`` changes. The order comes from doubling: ranks by 1, 2, 4 ... words, exact by construction and for
    matches of up to ``most`` words.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray, starts: np.ndarray, most: int):
        n = len(words)
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        self.end = last[np.searchsorted(last, np.arange(n))].astype(np.int32)
        self.ranks, size = [np.unique(words, return_inverse=True)[1].astype(np.int32)], 1
        while size < most:
            now, ahead = self.ranks[-1], np.arange(n) + size
            then = np.where(ahead <= self.end, now[np.minimum(ahead, n - 1)] + 1, 0)  # a text that ends goes first
            self.ranks.append(np.unique(now * np.int64(n + 1) + then, return_inverse=True)[1].astype(np.int32))
            size *= 2
        self.order = starts[np.argsort(self.ranks[-1][starts], kind="stable")] if n else starts
        self.place = np.full(n, -1, np.int64)
        self.place[self.order] = np.arange(len(self.order))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a and b on are the same, by halving over the ranks."""
        length, last = np.zeros(len(a), np.int64), len(self.end) - 1
        for level in range(len(self.ranks) - 1, -1, -1):
            step, rank = 1 << level, self.ranks[level]
            fits = (a + length + step - 1 <= self.end[a]) & (b + length + step - 1 <= self.end[b])
            length += step * (fits & (rank[np.minimum(a + length, last)] == rank[np.minimum(b + length, last)]))
        return length

    def longest(self, places: np.ndarray) -> np.ndarray:
        """For each of ``places``, all of them starts: the words from there on that also follow another start. The longest match
        stands next to it in the order."""
        at, out = self.place[places], np.zeros(len(places), np.int64)
        for to in (at - 1, at + 1):
            ok = np.flatnonzero((to >= 0) & (to < len(self.order)))
            out[ok] = np.maximum(out[ok], self._common(places[ok], self.order[to[ok]]))
        return out


def parse(index: Index, first: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the spans of contexts whose starts are ``first`` and the ``n`` - 1 places after it.

    Each context is factored greedily from the left, all of them side by side: a factor is the longest copy there is of what comes
    next, or else one word. Factors of ``width`` words are spans; windows that begin in a factor and end beyond it are looked up.
    """
    none = np.zeros(0, np.int64)
    spans = [(none, none, none)]
    who, at = np.flatnonzero(n > 0), np.zeros(int((n > 0).sum()), np.int64)
    while len(who):
        size = np.maximum(index.longest(first[who] + at), 1)
        to = at + size
        whole = size >= width
        spans.append((who[whole], at[whole], to[whole]))
        low = np.maximum(at + 1, to - width + 1)
        count = np.maximum(np.minimum(to, n[who]) - low, 0)
        border = np.repeat(np.arange(len(who)), count)
        s = np.arange(len(border)) - np.repeat(np.cumsum(count) - count, count) + low[border]
        match = index.longest(first[who[border]] + s)
        hit = match >= width
        spans.append((who[border[hit]], s[hit], s[hit] + match[hit]))
        more = to < n[who]
        who, at = who[more], to[more]
    return tuple(np.concatenate(x) for x in zip(*spans))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, salt_at: int = SALT_AT, block_words: int = BLOCK_WORDS, range_windows: int = RANGE_WINDOWS, shortcut: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space); a column of ``docs`` of one of
    these names gives way to it. ``shortcut``: contexts that occur twice become spans by their digest; else they are parsed too."""
    out = removed(docs, id_col, text_col, width, gram, salt_at, block_words, range_windows, shortcut)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, salt_at: int = SALT_AT, block_words: int = BLOCK_WORDS, range_windows: int = RANGE_WINDOWS, shortcut: bool = True) -> DataFrame:
    """(row, n_words, n_removed, kept): as ``remove_repeats``, each row of ``docs`` a struct."""
    spark = small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    texts = docs.select(*_row_keys(docs, id_col, text_col), F.col(text_col).alias("t"))

    def count(batches):
        """(h, dg, c, k1) of each batch: contexts, counted before any shuffle; k1 of a row that has it."""
        for b in batches:
            for part in batches_of(b, 1):
                x = Contexts(Words(part.column(1)), width, gram)
                if not len(x.h):
                    continue
                k1 = part.column(0).to_numpy()[x.doc]
                order = np.lexsort((k1, x.dg, x.h))
                h, dg = x.h[order], x.dg[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (dg[1:] != dg[:-1])]))
                yield pa.RecordBatch.from_arrays([_i64(h[first]), _i64(dg[first]), _i64(np.diff(np.append(first, len(h)))), _i64(k1[order][first])], ["h", "dg", "c", "k1"])

    seen = texts.select("k1", "t").mapInArrow(tidy(count), "h long, dg long, c long, k1 long").groupBy("h", "dg").agg(F.sum("c").alias("c"), F.min("k1").alias("k1"))
    anchors = seen.groupBy("h").agg(F.sum("c").alias("all"), F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("alone")).where("all > 1")
    parts = F.when(F.col("alone") > 0, F.ceil(F.col("kinds") / salt_at)).otherwise(0).cast("int") if shortcut else F.ceil(F.col("all") / salt_at).cast("int")
    shared = store(seen.join(anchors, "h").select("h", "dg", "c", "k1", parts.alias("salts")), "substring-contexts")
    n_whole, n_parsed, n_hot = shared.agg(F.count_if(F.col("c") > 1), F.count_if(F.col("salts") > 0), F.count_if(F.col("salts") > 1)).first()
    whole, parsed = shared.where("c > 1" if shortcut else "false").select("h", "dg"), shared.where("salts > 0")

    def sieve(keys: DataFrame, n: int):
        # Of hashes that executors can make again in numpy.
        return spark.sparkContext.broadcast(bloom.collect(keys.mapInArrow(_pack, "x long"), F.col("x"), n))

    # With the shortcut a context that occurs twice is reference once, in the row ``k1``; else it is parsed wherever it occurs.
    named = ["h", "dg", "k1"] if shortcut else ["h", "dg"]
    whole_sieve, parsed_sieve = sieve(whole, n_whole), sieve(parsed.select(*named), n_parsed)

    def repeats(batches):
        """Contexts that may be repeats as a whole; equal ones in a row are one."""
        for b in batches:
            for part in batches_of(b, 2):
                w = Words(part.column(2))
                x = Contexts(w, width, gram)
                i = np.flatnonzero(bloom.test(whole_sieve.value, _both(x.h, x.dg)))
                if not len(i):
                    continue
                new = np.concatenate([[True], (x.h[i[1:]] != x.h[i[:-1]]) | (x.dg[i[1:]] != x.dg[i[:-1]]) | (x.doc[i[1:]] != x.doc[i[:-1]]) | (x.start[i[1:]] != x.start[i[:-1]] + x.n[i[:-1]])])
                to = np.append(np.flatnonzero(new)[1:], len(i)) - 1
                f, t = i[new], i[to]
                d = pa.array(x.doc[f])
                s = x.start[f] - w.offset[x.doc[f]]
                e = x.start[t] + x.n[t] + width - 1 - w.offset[x.doc[f]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(d), part.column(1).take(d), _i64(x.h[f]), _i64(x.dg[f]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["k1", "k2", "h", "dg", "s", "e"])

    spans = texts.mapInArrow(tidy(repeats), "k1 long, k2 long, h long, dg long, s int, e int").join(whole, ["h", "dg"], "left_semi").select("k1", "k2", "s", "e")
    if n_parsed:
        most = 2 * width - gram  # words of a context
        spans = spans.unionByName(_factored(texts, parsed, named, parsed_sieve, max(1, -(-n_parsed * most // block_words)), n_hot and -(-n_hot * most // range_windows), width, gram))
    # Spans that touch are one; a document's spans are as many as its length allows.
    by_row = store(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "substring-spans")
    n_rows = by_row.count()
    # Only rows that may have spans are shuffled to meet them.
    keyed = bloom.probe(docs.select(*_row_keys(docs, id_col, text_col), row), F.col("k1"), by_row.select("k1"), "k1", n_rows, "maybe")
    touched = keyed.where("maybe").join(by_row, ["k1", "k2"], "left")
    clean = keyed.where("not maybe").withColumn("spans", F.lit(None).cast("array<struct<s:int,e:int>>"))

    def cut(batches):
        for whole_rows in batches:
            rows = whole_rows.column(0)
            b = pa.RecordBatch.from_arrays([rows, rows.field(text_col), whole_rows.column(1)], ["row", "t", "spans"])
            for part in batches_of(b, 1):
                w = Words(part.column(1))
                n = np.diff(w.offset)
                gone = np.zeros(len(w.hash) + 1, np.int64)
                for i, got in enumerate(part.column(2).to_pylist()):
                    for x in got or ():
                        gone[w.offset[i] + x["s"]] += 1
                        gone[w.offset[i] + x["e"]] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                kept = np.add.reduceat(np.append(keep, False), w.offset[:-1].clip(max=len(keep))) if len(n) else n
                kept = np.where(n > 0, kept, 0)
                yield pa.RecordBatch.from_arrays([part.column(0), _i64(n), _i64(n - kept), pa.array(_joined(w, keep), pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept"])

    both = touched.select("row", "spans").union(clean.select("row", "spans"))
    return both.mapInArrow(tidy(cut), _out_schema(keyed.schema["row"]))


def _out_schema(row):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("row", row.dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _pack(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([_i64(_both(*(b.column(i).to_numpy().view(np.uint64) for i in range(b.num_columns))))], ["x"])


def _joined(w: Words, keep: np.ndarray) -> list[bytes]:
    """Of each text the words to keep, joined by one space."""
    data, take = w.data.copy(), np.zeros(len(w.data) + 1, np.int8)
    i = np.flatnonzero(keep)
    if len(i):
        take[w.start[i]] += 1
        take[w.end[i]] -= 1
    take = np.cumsum(take, dtype=np.int8)[:-1].astype(bool)
    if len(i):
        doc = np.searchsorted(w.offset, i, "right")
        gap = w.end[i[:-1]][doc[:-1] == doc[1:]]  # the byte after a word that another one follows
        take[gap] = True
        data[gap] = 0x20
    out = data[take].tobytes()
    # Bytes before each text's first word.
    at = np.concatenate([[0], np.cumsum(take)])
    edge = np.append(w.start, len(w.data))[w.offset]
    edge[0] = 0
    place = at[edge]
    return [out[a:b] for a, b in zip(place[:-1], place[1:])]


def _factored(texts: DataFrame, parsed: DataFrame, named: list[str], sieve, blocks: int, ranges: int, width: int, gram: int) -> DataFrame:
    """Spans of contexts that are no repeats as a whole, by factoring them within their blocks."""
    blocks = max(shuffle_width(texts.sparkSession), blocks)

    def contexts(batches):
        for b in batches:
            for part in batches_of(b, 2):
                w = Words(part.column(2))
                x = Contexts(w, width, gram)
                row = part.column(0).to_numpy().view(np.uint64)[x.doc] if "k1" in named else None
                i = np.flatnonzero(bloom.test(sieve.value, _both(x.h, x.dg, row)))
                if len(i):
                    d = pa.array(x.doc[i])
                    last = x.start[i] + x.n[i] + width - 1
                    text = [w.text(p, q) for p, q in zip(x.start[i].tolist(), last.tolist())]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(d), part.column(1).take(d), _i64(x.h[i]), _i64(x.dg[i]), pa.array((x.start[i] - w.offset[x.doc[i]]).astype(np.int32)), pa.array(text, pa.binary()).cast(pa.string())], ["k1", "k2", "h", "dg", "s", "ctx"])

    found = texts.mapInArrow(tidy(contexts), "k1 long, k2 long, h long, dg long, s int, ctx string").join(parsed if "k1" in named else parsed.drop("k1"), named)
    # Of a repeated context one copy is reference; the rare row that has it twice gives it twice, which changes nothing.
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("dg", "k1", "s"), F.col("salts"))).otherwise(0)
    dealt = found.select(F.pmod(F.xxhash64("h", salt), F.lit(blocks)).alias("block"), "k1", "k2", "s", "ctx", (F.col("salts") > 1).alias("hot"), (F.col("c") == 1 if "k1" in named else F.lit(True)).alias("alone"))

    def factor(table: pa.Table) -> pa.Table:
        forget()
        hashes, size = _hashed(table.select(["ctx"]))
        offset = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(size)), size)
        starts = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(offset[:-1], offset[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
        index = Index(hashes, owner, starts, 64 if width < 64 else 1 << width.bit_length())
        base = table.column("s").to_numpy().astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
        alone = table.column("alone").to_numpy(zero_copy_only=False).astype(bool) if table.num_rows else np.zeros(0, bool)
        asked = np.flatnonzero(alone)
        row, s, e = parse(index, offset[:-1][asked], np.maximum(size - width + 1, 0)[asked], width)
        row = asked[row]
        s, e = base[row] + s, base[row] + e
        del index
        pick = pa.array(row, pa.int64())
        none = pa.nulls(len(row), pa.int32())
        out = {"k1": table.column("k1").take(pick), "k2": table.column("k2").take(pick), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32)), "range": none, "windows": pa.nulls(len(row), pa.binary())}
        result = pa.table(out)
        hot = table.column("hot").to_numpy(zero_copy_only=False).astype(bool) if table.num_rows else np.zeros(0, bool)
        if hot.any():
            # Windows of salted anchors by their own hash: those repeated here count twice and stand for themselves once.
            o = owner[starts]
            mine = hot[o]
            h, where, o = grams(hashes, width)[starts[mine]], starts[mine], o[mine]
            rec = np.zeros(len(h), _WINDOW)
            rec["h"], rec["g"], rec["k1"], rec["k2"] = h, grams(mix(hashes ^ _SECOND), width)[where], table.column("k1").to_numpy()[o], table.column("k2").to_numpy()[o]
            rec["s"] = base[o] + where - offset[o]
            rec["c"] = np.where(alone[o], 1, 2)
            rec, first = _same_windows(rec)
            total = np.add.reduceat(rec["c"], first)
            rec = rec[first]
            rec["c"] = np.minimum(total, 2)
            part = (rec["h"] >> np.uint64(40)).astype(np.int64) % ranges
            rows = [(r, rec[part == r].tobytes()) for r in np.unique(part).tolist()]
            null = pa.nulls(len(rows), pa.int64())
            more = pa.table({"k1": null, "k2": null, "s": pa.nulls(len(rows), pa.int32()), "e": pa.nulls(len(rows), pa.int32()), "range": pa.array([r for r, _ in rows], pa.int32()), "windows": pa.array([x for _, x in rows], pa.binary())})
            result = pa.concat_tables([result, more])
        release()
        return small_tables(result)

    factors = dealt.groupBy("block").applyInArrow(factor, "k1 long, k2 long, s int, e int, range int, windows binary")
    if not ranges:
        return factors.select("k1", "k2", "s", "e")
    factors = store(factors, "substring-factors")

    def meet(table: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x, _WINDOW) for x in table.column("windows").to_pylist()] or [np.zeros(0, _WINDOW)])
        rec, first = _same_windows(rec)
        total = np.add.reduceat(rec["c"], first) if len(rec) else first
        rec = rec[(np.repeat(total, np.diff(np.append(first, len(rec)))) > 1) & (rec["c"] == 1)] if len(rec) else rec
        return pa.table({"k1": pa.array(rec["k1"].copy()), "k2": pa.array(rec["k2"].copy()), "s": pa.array(rec["s"].copy()), "e": pa.array(rec["s"] + np.int32(width))})

    met = factors.where("range is not null").select("range", "windows").groupBy("range").applyInArrow(meet, "k1 long, k2 long, s int, e int")
    return factors.where("range is null").select("k1", "k2", "s", "e").unionByName(met)


def _same_windows(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows with equal ones side by side, and the first place of each kind; two hashes of 64 bits tell them apart."""
    rec = rec[np.lexsort((rec["g"], rec["h"]))]
    new = (rec["h"][1:] != rec["h"][:-1]) | (rec["g"][1:] != rec["g"][:-1])
    return rec, np.flatnonzero(np.concatenate([[True], new])) if len(rec) else np.zeros(0, np.int64)


def _hashed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a one-column table of texts, one after another, and how many each text has; made slice by slice."""
    out, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in table.to_batches():
        for part in batches_of(b, 0):
            w = Words(part.column(0))
            out.append(w.hash)
            size.append(np.diff(w.offset))
    return np.concatenate(out), np.concatenate(size)


#: Turns word hashes into others, for a second hash of a window.
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_WINDOW = np.dtype([("h", np.uint64), ("g", np.uint64), ("k1", np.int64), ("k2", np.int64), ("s", np.int32), ("c", np.int32)])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
