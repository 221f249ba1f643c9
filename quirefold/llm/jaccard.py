"""N-gram Jaccard join by signature trees.

Documents with equal shingle sets are one class. A set that links with another shares at least three quarters of its
shingles with it; so of its n shingles at most n // 4 are nobody else's. A sieve counts, for the shingles of smallest hash
of every class, which are shared, and drops the classes that have too few. What is left goes into blocks: connected
groups of classes that share a shingle among their rarest n // 4 + 1, outside of which no link can be. Within a block a
signature tree holds, in each node, the OR of its sets' token bitmaps and the range of their sizes; two trees are walked
together, and a pair of nodes goes if the largest overlap their bitmaps and sizes allow is too small, or if all its sets
are linked already. What remains is compared exactly. Blocks too large for a task are cut into chunks by size and hash:
chunks are solved alone, then one set of each component of each chunk together, and then the sets outside the block's
largest component against all chunks.

Defined results: a document without words or text has the empty set and is linked with nothing. With fewer words than a
shingle the whole sequence is one. Repeated rows are linked, having equal sets; rows of equal id and other text are judged
apart. A null id counts as larger than any other; a component of null ids only has a null component id.
Shingles and sets are named by 64-bit hashes. Columns beside id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bloom
from quirefold.llm.common import forget, read, release, shuffle_width, small_batches, small_tables, store, tidy
from quirefold.llm.components import components
from quirefold.llm.words import Words, batches_of, mix, span_hash

SHINGLE = 5
#: Entries of a sieve range, and shingles of a chunk of a block: what a task holds.
RANGE_ENTRIES, CHUNK_TOKENS = 1 << 20, 2 << 20
#: A token is hot from this many sets on, and from this share of all of them on (one in ...).
HOT_AT, HOT_SHARE = 4096, 128
#: Sets of a leaf, and children of a node.
LEAF, FAN = 16, 8
LEADERS = 12


class Sets:
    """The shingle sets of a batch: sorted distinct ``token`` of set i at ``offset[i]:offset[i + 1]``, and a ``name`` for each set."""

    def __init__(self, texts: pa.Array, k: int = SHINGLE):
        w = Words(texts, lower=True)
        size = np.diff(w.offset)
        n = np.where(size >= k, size - k + 1, np.minimum(size, 1))
        doc = np.repeat(np.arange(len(size)), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + w.offset[:-1][doc]
        end = np.minimum(at + k, w.offset[1:][doc])
        token = span_hash(w.hash, at, end)
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]) if len(token) else np.zeros(0, bool)
        self.token, self.doc = token[new], doc[new]
        self.offset = np.searchsorted(self.doc, np.arange(len(size) + 1))
        self.n = np.diff(self.offset)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.token ^ np.uint64(0xA5A5)), dtype=np.uint64)])
        self.name = mix(sums[self.offset[1:]] - sums[self.offset[:-1]] + self.n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(self) -> np.ndarray:
        """One place of every set of the batch that is not empty."""
        full = np.flatnonzero(self.n)
        return full[np.unique(self.name[full], return_index=True)[1]]


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0] .. + counts[0], starts[1] .. + counts[1], and so on."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def sieve_size(n):
    """How many shingles of smallest hash the sieve looks at, for arrays and for columns alike."""
    return n // 4 + n // 10 + 1


class Forest:
    """Linked sets, by union-find."""

    def __init__(self, label: np.ndarray):
        self.up = np.arange(len(label))
        first = np.unique(label, return_index=True, return_inverse=True)
        self.up = first[1][first[2]].copy()

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            new = up[up]
            if (new == up).all():
                return up
            up = self.up = new

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def overlaps(token: np.ndarray, offset: np.ndarray, a: int, others: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of set a with others."""
    mine = token[offset[a] : offset[a + 1]]
    n = offset[others + 1] - offset[others]
    theirs = token[_spread(n, offset[others])]
    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
    hit = np.concatenate([[0], np.cumsum(mine[at] == theirs)])
    to = np.cumsum(n)
    return hit[to] - hit[to - n]


def linked(common, n_a, n_b):
    """100 * intersection >= 75 * union."""
    return 7 * common >= 3 * (n_a + n_b)


class Tree:
    """A signature tree over sets in the given order: levels[0] are leaves of up to LEAF sets."""

    def __init__(self, token: np.ndarray, offset: np.ndarray, order: np.ndarray, bits: int):
        self.order = order
        n = offset[order + 1] - offset[order]
        row = np.repeat(np.arange(len(order)), n)
        bit = (token[_spread(n, offset[order])] >> np.uint64(17)) & np.uint64(bits - 1)
        flags = np.zeros((len(order), bits // 8), np.uint8)
        np.bitwise_or.at(flags, (row, (bit >> np.uint64(3)).astype(np.int64)), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        self.bits = flags.view(np.uint64)
        self.n = n
        self.excess = n - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.levels = []
        lo, hi, most, bitmap, fan = n, n, self.excess, self.bits, LEAF
        while not self.levels or len(self.levels[-1][0]) > 1:
            cut = np.arange(0, len(lo), fan)
            lo, hi, most, bitmap, fan = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(most, cut), np.bitwise_or.reduceat(bitmap, cut, axis=0), FAN
            self.levels.append((lo, hi, most, bitmap))

    def uniform(self, comp: np.ndarray) -> list[np.ndarray]:
        """For each level and node the one component of its sets, or -1."""
        out, low, high, fan = [], comp[self.order], comp[self.order], LEAF
        for _ in self.levels:
            cut = np.arange(0, len(low), fan)
            low, high, fan = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), FAN
            out.append(np.where(low == high, low, -1))
        return out


def _possible(a, b, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of nodes i of one level and j of another can overlap enough."""
    (alo, ahi, aex, abits), (blo, bhi, bex, bbits) = a, b
    ok = (4 * ahi[i] >= 3 * blo[j]) & (4 * bhi[j] >= 3 * alo[i])
    k = np.flatnonzero(ok)
    i, j = i[k], j[k]
    most = np.zeros(len(k), np.int64)
    step = max(1, (1 << 22) // max(1, abits.shape[1]))
    for s in range(0, len(k), step):
        x, y = i[s : s + step], j[s : s + step]
        most[s : s + step] = np.bitwise_count(abits[x] & bbits[y]).sum(1)
    most = np.minimum(most + np.minimum(aex[i], bex[j]), np.minimum(ahi[i], bhi[j]))
    ok[k] = 7 * most >= 3 * (alo[i] + blo[j])
    return ok


def solve(token: np.ndarray, offset: np.ndarray, label: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets that can be reached from each other, beyond those of equal ``label``.

    ``left``: if given, only pairs with at least one set of these are looked at.
    """
    n = np.diff(offset)
    forest, out = Forest(label), []
    everyone = np.arange(len(n))
    mine = everyone if left is None else left

    def add(a: int, b: np.ndarray):
        out.extend((a, int(x)) for x in b if forest.link(a, int(x)))

    # Leaders: sets of many common tokens link most of a group at once.
    _, code, count = np.unique(token, return_inverse=True, return_counts=True)
    shared = np.add.reduceat(count[code], offset[:-1])
    for a in mine[np.argsort(-shared[mine], kind="stable")[:LEADERS]].tolist():
        comp = forest.roots()
        other = np.flatnonzero((comp != comp[a]) & (4 * n >= 3 * n[a]) & (4 * n[a] >= 3 * n))
        if len(other):
            add(a, other[linked(overlaps(token, offset, a, other), n[a], n[other])])
    comp = forest.roots()
    if (comp == comp[0]).all():
        return out
    bits = int(min(8192, max(256, 1 << int(2 * n.max() - 1).bit_length())))
    near = np.lexsort((n, token[offset[:-1]]))  # sets of one smallest token side by side
    tree = Tree(token, offset, near, bits)
    other = tree if left is None else Tree(token, offset, near[np.isin(near, left)], bits)
    # Walk both trees from their roots, one level of either at a time.
    la, lb = len(tree.levels) - 1, len(other.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ua, ub = tree.uniform(comp), other.uniform(comp)
    while True:
        go = ~((ua[la][i] == ub[lb][j]) & (ua[la][i] >= 0))
        i, j = i[go], j[go]
        go = _possible(tree.levels[la], other.levels[lb], i, j)
        i, j = i[go], j[go]
        if not la and not lb:
            break
        if la >= lb:
            la -= 1
            kids = np.minimum(FAN, len(tree.levels[la][0]) - i * FAN)
            i, j = _spread(kids, i * FAN), np.repeat(j, kids)
        else:
            lb -= 1
            kids = np.minimum(FAN, len(other.levels[lb][0]) - j * FAN)
            i, j = np.repeat(i, kids), _spread(kids, j * FAN)
        if tree is other and la == lb:
            go = i <= j
            i, j = i[go], j[go]
    one = (tree.n, tree.n, tree.excess, tree.bits)
    two = (other.n, other.n, other.excess, other.bits)
    for s in range(0, len(i), 64):
        x, y = i[s : s + 64], j[s : s + 64]
        kx, ky = np.minimum(LEAF, len(tree.n) - x * LEAF), np.minimum(LEAF, len(other.n) - y * LEAF)
        p = _spread(kx, x * LEAF)
        per = np.repeat(np.arange(len(x)), kx)
        q = _spread(ky[per], y[per] * LEAF)
        p = np.repeat(p, ky[per])
        comp = forest.roots()
        go = comp[tree.order[p]] != comp[other.order[q]]
        p, q = p[go], q[go]
        go = _possible(one, two, p, q)
        a, b = tree.order[p[go]], other.order[q[go]]
        for u in np.unique(a).tolist():
            v = b[a == u]
            root = forest.root(u)
            v = np.array([z for z in v.tolist() if forest.root(z) != root], np.int64)
            if len(v):
                add(u, v[linked(overlaps(token, offset, u, v), n[u], n[v])])
    return out


def _ranged(token: np.ndarray, owner: np.ndarray, names: np.ndarray, ranges: int):
    """Entries (token, owner) by range of token: (range, names of the owners, entries) with 48 bits of token and 16 of owner."""
    part = (token >> np.uint64(16)) % np.uint64(ranges)
    order = np.argsort(part, kind="stable")
    part, token, owner = part[order], token[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), np.append(first[1:], len(part)).tolist()):
        for c in range(a, b, 65_536):
            d = min(b, c + 65_536)
            who, code = np.unique(owner[c:d], return_inverse=True)
            yield int(part[a]), names[who].tobytes(), ((token[c:d] & ~np.uint64(0xFFFF)) | code.astype(np.uint64)).tobytes()


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (token, name) of a range, sorted."""
    token, name = [], []
    for names, packed in zip(table.column("names").to_pylist(), table.column("entries").to_pylist()):
        e = np.frombuffer(packed, np.uint64)
        token.append(e & ~np.uint64(0xFFFF))
        name.append(np.frombuffer(names, np.uint64)[(e & np.uint64(0xFFFF)).astype(np.int64)])
    if not token:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    token, name = np.concatenate(token), np.concatenate(name)
    order = np.lexsort((name, token))
    token, name = token[order], name[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (name[1:] != name[:-1])])
    return token[new], name[new]


def _frequency(token: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    c = np.diff(np.append(first, len(token)))
    return np.repeat(c, c)


_COUNTED = np.dtype([("name", np.uint64), ("token", np.uint64), ("f", np.uint32)])
ENTRY, COUNTED = "range int, names binary, entries binary", "part int, counted binary"


def _by_part(rec: np.ndarray, parts: int) -> pa.RecordBatch:
    """Records of sets' tokens, packed by part of the sets' names."""
    part = (rec["name"] % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rec = rec[order]
    there, first = np.unique(part[order], return_index=True)
    cut = zip(first.tolist(), np.append(first[1:], len(rec)).tolist())
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([rec[a:b].tobytes() for a, b in cut], pa.binary())], ["part", "counted"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, range_entries: int = RANGE_ENTRIES, chunk_tokens: int = CHUNK_TOKENS, hot_at: int = HOT_AT) -> DataFrame:
    """(id, key, n_shingles, component_id, component) of every row of ``docs``.

    ``key``: a hash of id and text; ``component``: a name of the component, null for the empty set.
    """
    spark = small_batches(docs.sparkSession)
    width = shuffle_width(spark)
    texts = docs.select(F.col(text_col).alias("t"))

    def describe(batches):
        for b in batches:
            for part in batches_of(b, 1):
                s = Sets(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _i64(s.n), _i64(s.name)], ["id", "key", "n", "name"])

    rows = store(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.lit(1), F.col(id_col).cast("string"), F.col(text_col)).alias("key")).mapInArrow(tidy(describe), "id long, key long, n long, name long"), "jaccard-rows")
    classes = rows.where("n > 0").groupBy("name").agg(F.min("id").alias("least"), F.first("n").alias("n"))
    n_tokens = int(classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    ranges = max(width, -(-n_tokens * 2 // 5 // range_entries))

    # 1. The sieve. Shingles that several sets of a slice have are known as shared there: their sets are counted at once and only
    # one of them goes to the shingle's range, so a range holds a common shingle once a slice. A set met in several slices may be
    # counted more than once, which lets more through and loses none.
    def offer(batches):
        for b in batches:
            for part in batches_of(b, 0):
                s = Sets(part.column(0), shingle)
                i = s.once()
                take = _spread(np.minimum(sieve_size(s.n[i]), s.n[i]), s.offset[i])
                token, owner = s.token[take], s.doc[take]
                order = np.argsort(token, kind="stable")
                token, owner = token[order], owner[order]
                several = _frequency(token) > 1
                first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else several
                known, c = np.unique(owner[several], return_counts=True)
                rows = list(_ranged(token[first], owner[first], s.name, ranges))
                if len(known):
                    rows.append((int(s.name[known[0]] % np.uint64(ranges)), np.stack([s.name[known], c.astype(np.uint64)], 1).tobytes(), None))
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["range", "names", "entries"])

    def shared(table: pa.Table) -> pa.Table:
        forget()
        known = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.filter(table.column("entries").is_null()).column("names").to_pylist()]
        token, name = _entries(table.filter(table.column("entries").is_valid()))
        who, c = np.unique(name[_frequency(token) > 1], return_counts=True)
        pairs = np.concatenate([np.stack([who, c.astype(np.uint64)], 1), *known])
        out = pa.table({"name": _i64(pairs[:, 0].copy()), "c": _i64(pairs[:, 1].copy())})
        release()
        return small_tables(out)

    counts = texts.mapInArrow(tidy(offer), ENTRY).groupBy("range").applyInArrow(shared, "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))
    n = F.col("n")
    own = F.floor(n / 4)
    looked = F.least(own + F.floor(n / 10) + 1, n)
    survivors = store(counts.join(classes, "name").where(F.col("c") >= looked - own).select("name"), "jaccard-survivors")
    n_survivors = survivors.count()
    sieve = spark.sparkContext.broadcast(bloom.collect(survivors, F.col("name"), n_survivors))

    # 2. The sets of what is left.
    def gather(batches):
        for b in batches:
            for part in batches_of(b, 0):
                s = Sets(part.column(0), shingle)
                i = s.once()
                i = i[bloom.test(sieve.value, s.name[i])]
                if len(i):
                    yield pa.RecordBatch.from_arrays([_i64(s.name[i]), _i64(s.n[i]), pa.array([s.token[s.offset[k] : s.offset[k + 1]].tobytes() for k in i.tolist()], pa.binary())], ["name", "n", "tokens"])

    sets = store(texts.mapInArrow(tidy(gather), "name long, n long, tokens binary").join(survivors, "name", "left_semi").dropDuplicates(["name"]), "jaccard-sets")
    total = int(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    few = max(1, -(-total // range_entries))

    # 3. The rarest tokens of each set: tokens meet by range to be counted, and their counts meet again by set. Tokens of very many
    # sets are no rare ones; they come last in everybody's order, uncounted, and go to no range.
    def slices(batches):
        """Names, tokens and the place of each token's set, of some sets at a time."""
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                size = part.column(2).to_numpy()
                yield part.column(0).to_numpy().view(np.uint64), np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64), np.repeat(np.arange(len(size)), size)

    def often(batches):
        for names, token, _ in slices(batches):
            token, c = np.unique(token, return_counts=True)
            keep = c >= max(2, len(names) // 64)
            yield pa.RecordBatch.from_arrays([_i64(token[keep]), _i64(c[keep])], ["token", "c"])

    triples = sets.select("name", "tokens", "n")
    # At most HOT_SHARE times the mean size of a set, as each is in that share of all sets.
    most = max(hot_at, n_survivors // HOT_SHARE)
    hot_rows = triples.mapInArrow(tidy(often), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= most).select("token").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(hot_rows.column("token").to_numpy().view(np.uint64)) if hot_rows.num_rows else np.zeros(0, np.uint64))

    def spell(batches):
        for names, token, owner in slices(batches):
            cold = ~np.isin(token, hot.value)
            for row in _ranged(token[cold], owner[cold], names, few):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["range", "names", "entries"])

    def spell_hot(batches):
        for names, token, owner in slices(batches):
            k = np.flatnonzero(np.isin(token, hot.value))
            rec = np.zeros(len(k), _COUNTED)
            rec["name"], rec["token"], rec["f"] = names[owner[k]], token[k], np.iinfo(np.uint32).max
            yield _by_part(rec, few)

    def common(table: pa.Table) -> pa.Table:
        """Tokens that several sets have, with in how many sets they are, packed by part of the sets' names."""
        forget()
        token, name = _entries(table)
        f = _frequency(token)
        keep = np.flatnonzero(f > 1)
        rec = np.zeros(len(keep), _COUNTED)
        rec["name"], rec["token"], rec["f"] = name[keep], token[keep], f[keep]
        out = pa.Table.from_batches([_by_part(rec, few)])
        release()
        return small_tables(out)

    def rarest(sizes: pa.Table, counted: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x, _COUNTED) for x in counted.column("counted").to_pylist()] or [np.zeros(0, _COUNTED)])
        rec = rec[np.lexsort((rec["token"], rec["f"], rec["name"]))]
        name, n = sizes.column("name").to_numpy().view(np.uint64), sizes.column("n").to_numpy()
        order = np.argsort(name)
        name, n = name[order], n[order]
        first = np.searchsorted(rec["name"], name)
        shared = np.searchsorted(rec["name"], name, "right") - first
        need = np.clip(n // 4 + 1 - (n - shared), 0, shared)  # tokens nobody else has come first
        take = _spread(need, first)
        out = pa.table({"name": _i64(rec["name"][take].copy()), "token": _i64(rec["token"][take].copy())})
        release()
        return out

    met = triples.mapInArrow(tidy(spell), ENTRY).groupBy("range").applyInArrow(common, COUNTED)
    if len(hot.value):
        met = met.unionByName(triples.mapInArrow(tidy(spell_hot), COUNTED))
    part = F.pmod(F.conv(F.hex("name"), 16, 10).cast("decimal(20,0)"), F.lit(few)).cast("int")
    sized = sets.select("name", "n", part.alias("part"))
    index = sized.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(rarest, "name long, token long")
    index = store(index, "jaccard-index")
    least = index.groupBy("token").agg(F.min("name").alias("b"), F.count("*").alias("c")).where("c > 1")
    meet = index.join(least, "token").select(F.col("name").alias("a"), "b").distinct()
    block = components(meet, "jaccard-blocks").withColumnsRenamed({"node": "name", "component": "block"})

    # 4. Blocks, cut into chunks of neighbouring sizes where they are too large.
    weight = block.join(sets.select("name", "n"), "name").groupBy("block").agg(F.sum("n").alias("weight"))
    cut = F.ceil(F.col("weight") / chunk_tokens)
    # Sizes that differ by a third or more never link; a band holds the sizes within one such step.
    band = F.floor(F.log(4 / 3, F.col("n").cast("double")))
    chunk = F.when(cut > 1, F.xxhash64(band, F.pmod(F.xxhash64("name"), cut))).otherwise(F.lit(0))
    members = store(block.join(sets, "name").join(weight, "block").select("block", chunk.alias("chunk"), (cut > 1).alias("large"), "name", "n", "tokens"), "jaccard-members")
    bins = max(width, -(-total // chunk_tokens))

    def local(table: pa.Table) -> pa.Table:
        a, b = [], []
        for names, token, offset, label, left in _groups(table):
            for x, y in solve(token, offset, label, left):
                a.append(names[x])
                b.append(names[y])
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def solved(parts: DataFrame) -> DataFrame:
        """Links within each group (block, chunk) of (block, chunk, name, n, tokens, label, left)."""
        return parts.withColumn("bin", F.pmod(F.xxhash64("block", "chunk"), F.lit(bins))).groupBy("bin").applyInArrow(local, "a long, b long")

    alone = members.select("block", "chunk", "name", "n", "tokens", F.col("name").alias("label"), F.lit(True).alias("left"))
    links = store(solved(alone), "jaccard-links")
    large = members.where("large")
    if not large.isEmpty():
        links = store(links.unionByName(_across(large, links, solved, chunk_tokens)), "jaccard-links")
    comp = components(links, "jaccard-components")

    # 5. Every row's component: the least id of any class in it.
    labelled = classes.join(comp.withColumnsRenamed({"node": "name"}), "name", "left").withColumn("component", F.coalesce("component", "name"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = labelled.join(smallest, "component").select("name", "component_id", "component")
    full = rows.where("n > 0").join(by_class, "name").select(F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), "component_id", "component")
    none = F.lit(None).cast("long").alias("component")
    return full.unionByName(rows.where("n = 0").select(F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), none))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (a null id last). Rows with the empty set all stay."""
    found = store(jaccard_components(docs.select(id_col, text_col), id_col, text_col), "jaccard-found")
    linked_ = found.where("component is not null")
    first = linked_.groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "key")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    together = linked_.join(first.select("component", F.col("first.key").alias("chosen")), "component")
    losers = store(together.where("key <> chosen").select("key").distinct(), "jaccard-losers")
    again = store(together.where("key = chosen").groupBy("key").count().where("count > 1").select("key"), "jaccard-again")
    h = F.xxhash64(F.lit(1), F.col(id_col).cast("string"), F.col(text_col))
    left = bloom.drop_keys(docs, h, losers, "key")
    n = again.count()
    if not n:
        return left
    marked = bloom.probe(left, h, again, "key", n, "__maybe").withColumn("__key", h)
    sure, rest = marked.where("not __maybe"), marked.where("__maybe")
    twice = rest.join(again.withColumnRenamed("key", "__key"), "__key", "left_semi").dropDuplicates(["__key"])
    other = rest.join(again.withColumnRenamed("key", "__key"), "__key", "left_anti")
    return sure.unionByName(twice).unionByName(other).select(*docs.columns)


def _groups(table: pa.Table):
    """Each (block, chunk) of a bin: names, tokens, offsets, labels, and which sets to compare (None: all)."""
    if not table.num_rows:
        return
    key = np.stack([table.column(c).to_numpy() for c in ("block", "chunk")], 1)
    order = np.lexsort((key[:, 1], key[:, 0]))
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    tokens = table.column("tokens")
    names, labels, wanted = table.column("name").to_numpy(), table.column("label").to_numpy(), table.column("left").to_numpy(zero_copy_only=False).astype(bool)
    for a, b in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
        if b - a < 2:
            continue
        i = order[a:b]
        parts = [np.frombuffer(tokens[k].as_py(), np.uint64) for k in i.tolist()]
        offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        left = np.flatnonzero(wanted[i])
        if len(left):
            yield names[i].tolist(), np.concatenate(parts), offset, labels[i], None if len(left) == len(i) else left


def _across(large: DataFrame, links: DataFrame, solved, chunk_tokens: int) -> DataFrame:
    """Links between the chunks of large blocks."""

    def labelled(by: DataFrame) -> DataFrame:
        comp = components(by, "jaccard-chunks")
        return large.join(comp.withColumnRenamed("node", "name"), "name", "left").withColumn("label", F.coalesce("component", "name")).drop("component")

    # One set of each component in each chunk, dealt again into chunks.
    now = labelled(links)
    pivots = now.groupBy("block", "chunk", "label").agg(F.min("name").alias("name"))
    pivots = now.drop("chunk").join(pivots.select("name"), "name", "left_semi")
    heavy = pivots.groupBy("block").agg(F.ceil(F.sum("n") / chunk_tokens).alias("cut"))
    dealt = pivots.join(heavy, "block").withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("cut")))
    merged = store(links.unionByName(solved(dealt.select("block", "chunk", "name", "n", "tokens", "label", F.lit(True).alias("left")))), "jaccard-merged")
    # Any link left has an end outside its block's largest component.
    now = store(labelled(merged), "jaccard-labelled")
    size = now.groupBy("block", "label").agg(F.count("*").alias("c"))
    giant = size.groupBy("block").agg(F.max_by("label", F.struct("c", "label")).alias("giant"))
    outer = now.join(giant, "block").where("label <> giant").drop("giant")
    # Sizes that link are at most one band apart.
    band = F.floor(F.log(4 / 3, F.col("n").cast("double")))
    spans = now.groupBy("block", "chunk").agg(F.first(band).alias("band"))
    out_chunks = outer.groupBy("block", "chunk").agg(F.first(band).alias("out_band")).withColumnRenamed("chunk", "out_chunk")
    tasks = out_chunks.join(spans, "block").where("abs(band - out_band) <= 1").select("block", "out_chunk", "chunk", F.xxhash64("out_chunk", "chunk").alias("task"))
    ends = now.join(tasks.select("block", "chunk", "task"), ["block", "chunk"]).select("block", F.col("task").alias("chunk"), "name", "n", "tokens", "label", F.lit(False).alias("left"))
    starts = outer.join(tasks.select("block", F.col("out_chunk").alias("chunk"), "task"), ["block", "chunk"]).select("block", F.col("task").alias("chunk"), "name", "n", "tokens", "label", F.lit(True).alias("left"))
    both = ends.unionByName(starts).groupBy("block", "chunk", "name").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("label").alias("label"), F.bool_or("left").alias("left"))
    return merged.unionByName(solved(both))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLE_SQL: dict[str, str] = {}
