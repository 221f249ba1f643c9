"""Words, substring dedup and the Jaccard join against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quirefold.llm.components import components
from quirefold.llm.jaccard import jaccard_components, keep_one
from quirefold.llm.substring import Index, parse, remove_repeats
from quirefold.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def test_words_of_random_batches():
    rng = random.Random(3)
    for _ in range(300):
        ts = ["".join(rng.choice("abAB \n\té漢\x0b\x1f\xa0") for _ in range(rng.randint(0, 14))) if rng.random() > 0.1 else None for _ in range(rng.randint(0, 6))]
        cut, lower = rng.randint(0, 2), rng.random() < 0.5
        w = Words(pa.array(ts, pa.string()).slice(cut), lower)
        named = {}
        for j, t in enumerate(ts[cut:]):
            want = WORD.findall(t or "")
            place = range(w.offset[j], w.offset[j + 1])
            assert [w.data[w.start[i] : w.end[i]].tobytes().decode() for i in place] == want
            for i, x in zip(place, want):
                x = x.translate(LOW) if lower else x
                assert named.setdefault(x, w.hash[i]) == w.hash[i]
        assert len(set(named.values())) == len(named)


def test_match_lengths_and_factors():
    rng = random.Random(4)
    for _ in range(60):
        lists = [[rng.randint(0, 2) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 5))]
        words = np.array([x for s in lists for x in s], np.uint64)
        owner = np.repeat(np.arange(len(lists)), [len(s) for s in lists])
        starts = np.flatnonzero(np.array([rng.random() < 0.7 for _ in words]))
        end = np.concatenate([np.full(len(s), e) for s, e in zip(lists, np.cumsum([len(s) for s in lists]))])

        def common(a, b):
            k = 0
            while a + k < end[a] and b + k < end[b] and words[a + k] == words[b + k]:
                k += 1
            return k

        index = Index(words, owner, starts, 16)
        assert index.longest(starts).tolist() == [max([common(a, b) for b in starts if b != a], default=0) for a in starts]
        # Factors and their borders cover what all places together cover, with fewer lookups.
        every = np.arange(len(words))
        index, first, looked = Index(words, owner, every, 16), np.cumsum([0] + [len(s) for s in lists[:-1]]), []
        full, longest = index.longest(every).tolist(), index.longest
        index.longest = lambda places: (looked.extend(places.tolist()), longest(places))[1]
        who, s, e = parse(index, first, np.array([len(x) for x in lists]), 3)
        assert len(set(looked)) == len(looked)
        covered = {first[w] + i for w, a, b in zip(who, s, e) for i in range(a, b)}
        assert covered == {i for p, m in enumerate(full) if m >= 3 for i in range(p, p + m)}


def brute_substring(rows, width):
    ws = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, ws):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(rng, n, most):
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(60)] for _ in range(5)]
    out = []
    for i in range(n):
        w = []
        while len(w) < rng.randint(0, most):
            if rng.random() < 0.3:
                s = rng.randint(0, 40)
                w += rng.choice(base)[s : s + rng.randint(1, 30)]
            elif rng.random() < 0.05:
                w += ["ax"] * rng.randint(1, 40)
            else:
                w += [rng.choice("abcdefghijklmnop") + rng.choice("xyzuvw") for _ in range(rng.randint(1, 9))]
        out.append((rng.choice([i, i, i, None, 3]), rng.choice([" ", "\n", "  "]).join(w) + rng.choice(["", " "])))
    return out + [(7, None), (8, ""), (9, " \n "), out[0], out[0], (99, "é漢 " * 50)]


@pytest.mark.parametrize("width,limits", [(8, {"gram": 3}), (35, {}), (8, {"gram": 3, "salt_at": 2, "block_words": 200, "range_windows": 50}), (8, {"gram": 3, "shortcut": False}), (35, {"salt_at": 3, "shortcut": False})])
def test_substring_dedup(spark, width, limits):
    rows = passages(random.Random(width), 90, 110)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, k1 long, spans string")
    out = remove_repeats(df, width=width, **limits)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect()), key=key)
    assert got == sorted(brute_substring(rows, width), key=key)
    assert out.columns == ["doc_id", "text", "k1", "spans", "n_words", "n_removed", "kept"]


def test_substring_dedup_of_a_very_long_text_and_clashing_names(spark):
    rng = random.Random(11)
    rows = [(1, " ".join(str(rng.randint(0, 10**6)) for _ in range(150_000))), (2, "x y z " * 20_000)]
    rows += [(3, " ".join(rows[0][1].split()[70_000:70_090])), (4, "plain and short")]
    df = spark.createDataFrame([(d, t, "k", 5, 6) for d, t in rows], "doc_id long, text string, kept string, n_words int, n_removed int")
    got = sorted(tuple(r) for r in remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect())
    assert got == sorted(brute_substring(rows, 35))


def test_substring_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0
    assert [tuple(r)[2:] for r in remove_repeats(spark.createDataFrame([(1, "a b")], df.schema)).collect()] == [(2, 0, "a b")]


def test_components(spark):
    rng = random.Random(5)
    edges = [(a, a + 1) for a in range(40)] + [(100, b) for b in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def shingles(t, k=5):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_jaccard(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(rng, n, low, high, rate):
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(low, high))] for _ in range(max(2, n // 25))]
    out = []
    for i in range(n):
        b = list(rng.choice(bases[: 3 if rng.random() < 0.5 else None]))
        for _ in range(rng.randint(0, max(1, int(len(b) * rate)))):
            j, x = rng.randrange(len(b)), rng.random()
            if x < 0.4:
                b[j] = rng.choice(vocab)
            elif x < 0.7:
                b.insert(j, rng.choice(vocab))
            elif len(b) > 1:
                del b[j]
        t = " ".join(b)
        out.append((i, t.upper() if rng.random() < 0.2 else t))
    return out + [(n + 1, None), (n + 2, ""), (n + 3, " \n"), out[0], (None, out[1][1]), (None, "lone null row here with words enough"), (5, "other text of id five one two three"), (n + 4, "a b"), (n + 5, "A\tB"), (n + 6, "a b c d"), (n + 7, "a b c d e"), (n + 8, "a b c d e a b c d e a b c d e")]


@pytest.mark.parametrize("shape,limits", [((250, 5, 90, 0.05), {}), ((250, 20, 120, 0.04), {"chunk_tokens": 1500, "range_entries": 500}), ((250, 20, 120, 0.04), {"hot_at": 6}), ((250, 10, 60, 0.05), {"hot_at": 2, "chunk_tokens": 900, "range_entries": 300})])
def test_jaccard_join(spark, shape, limits):
    rows = near_copies(random.Random(shape[0] + len(limits)), *shape)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, name long")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in jaccard_components(df, **limits).select("doc_id", "n_shingles", "component_id").collect()), key=key)
    want = brute_jaccard(rows)
    assert got == sorted(want, key=key)
    if not limits:
        kept = keep_one(df)
        assert kept.columns == df.columns
        full = collections.Counter(w[2] for w in want if w[1])
        empties = sum(1 for w in want if not w[1])
        assert kept.count() == len(full) + empties
        assert {r.doc_id for r in kept.collect() if r.doc_id is not None and shingles(r.text)} == {c for c in full if c is not None}


def test_jaccard_join_of_one_block_of_many_groups(spark):
    # All texts share a passage, so all are one block; it is cut into chunks, and links join neighbours of several sizes.
    rng = random.Random(21)
    common = " ".join(f"c{i}" for i in range(14))
    bases = [[f"g{g}w{rng.randint(0, 500)}" for _ in range(rng.randint(20, 60))] for g in range(25)]
    rows = []
    for i in range(220):
        b = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, common + " " + " ".join(b[: len(b) - rng.randint(0, 3)])))
    rows.append((500, " ".join(f"long{i}" for i in range(60_000))))
    rows.append((501, rows[-1][1] + " and a bit more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_components(df, chunk_tokens=1200, range_entries=400, hot_at=20).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(brute_jaccard(rows))


def test_jaccard_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(df).count() == 0
    assert keep_one(df).count() == 0
