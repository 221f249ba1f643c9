"""Search, language, leaks, URLs, chats and pages: against SQL, brute force or held-out rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import bloom, chat, decontam, htmlmain, knn, langid, registry, urlfilter


@pytest.mark.parametrize("name", ["op1_voronoi_knn", "op8_url_filters", "op9_chat_formatting"])
def test_queries_match_sql(name, same_rows):
    same_rows(registry.queries()[name], registry.oracle_sql()[name])


def test_knn_with_ties_repeats_and_odd_vectors(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(300)] + [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]
    rows += [(700, None), (800, [1.0, None]), (900, [float("nan")]), (1000, [float("inf"), 1.0]), (1100, []), (1200, [0.5]), (None, [0.5]), (1, [0.5, 0.5, 0.5, 0.5]), (1300, [3e38, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in knn.top_k(df, df.where("vec_id % 100 = 0"), 10, chunk_rows=40, block_queries=2, pivots=(4, 6)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and i != 1300 and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for qid, q in good:
        if qid % 100 == 0:
            best = sorted(((-dot(q, v), i) for i, v in good if i != qid))[:10]
            assert sorted(got[qid]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert set(got) == {i for i, _ in good if i % 100 == 0}
    empty = df.limit(0)
    assert knn.top_k(empty, empty, 10).count() == knn.top_k(df, empty, 10).count() == 0


def brute_top(rows, k):
    """The k best of each query (ids divisible by 100) among rows of other ids, by plain comparison."""
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    return {qid: [(r, i, -s) for r, (s, i) in enumerate(sorted(((-dot(q, v), i) for i, v in good if i != qid))[:k], 1)] for qid, q in sorted(good) if qid % 100 == 0}


@pytest.mark.parametrize("others", [20, 4, 200])
def test_knn_with_many_rows_of_the_querys_own_id(spark, others):
    rng = random.Random(others)
    # The repeated id's rows are the nearest to every pivot, and pivots themselves.
    rows = [(20_500, [1.0, 0.0])] * 30 + [(i, [rng.choice([0.5, 0.25]), rng.choice([0.0, 0.5])]) for i in range(1, others + 1)] + [(700, [0.5, 0.5])] * 15
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for limits in ({}, {"chunk_rows": 7, "block_queries": 1, "pivots": (3, 5)}):
        got = {}
        for r in knn.top_k(df, df.where("vec_id % 100 = 0"), 10, **limits).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {q: sorted(v) for q, v in got.items()} == brute_top(rows, 10)


def test_blocks_of_queries():
    apart = np.abs(np.arange(6)[:, None] - np.arange(6)[None]).astype(float)
    first, n = knn._blocks({0: 3, 1: 4, 2: 25, 4: 5, 5: 5}, apart, 10)
    assert n.tolist() == [1, 1, 3, 1, 1, 1]
    assert first[0] == first[1] == 0 and first[2] == 1 and first[4] == first[5] == 4
    assert knn._blocks({3: 2}, apart, 10)[0][3] == 0


def test_language_of_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = langid.fit(train, F.col("lang"), F.col("text"), F.col("doc_id"))
    out = langid.identify(held, model, "doc_id", "text", None, None, None).join(held.select("doc_id", "lang"), "doc_id")
    n, right, kept = out.agg(F.count("*"), F.count_if(F.col("language") == F.col("lang")), F.count_if("accepted")).first()
    assert right >= 0.97 * n and kept >= 0.97 * n


def test_language_evidence(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame(
        [(1, "", "en", "s"), (2, None, None, None), (3, "日本語のテキストです。これは言語識別のテストです。", None, "s"), (4, "123 ###", "en", "s"), (5, "the thing of the and that", None, None), (5, "the thing of the and that", None, None), (6, "ou", "fr", "s")],
        "doc_id long, text string, lang string, source string",
    )
    got = {r.doc_id: r for r in langid.identify_documents(odd, docs).collect()}
    assert [got[i].language for i in range(1, 6)] == ["und", "und", "und", "und", "en"]
    assert [got[i].accepted for i in range(1, 6)] == [False] * 4 + [True]
    assert langid.identify_documents(odd.limit(0), docs).count() == 0
    assert {r.language for r in langid.identify_documents(odd.where("lang is null")).collect()} == {"und"}
    pages = spark.read.parquet(f"{small}/pages.parquet")
    wrong = langid.identify_pages(pages, docs).join(pages.select("page_id", F.regexp_extract("html", 'html lang="(..)"', 1).alias("lang")), "page_id").where("language <> lang")
    assert wrong.count() == 0


def brute_language(rows, model):
    """Language and confidence of each row (text, declared, suffix, host), the evidence fused one row at a time."""
    import pyarrow as pa

    names, table = model
    k, codes = len(names), [*names, langid.NONE]
    grams = langid.Trigrams(pa.array([r[0] for r in rows], pa.string()))
    size = np.diff(grams.offset)
    logp = table.astype(np.float32).astype(float)
    ll = np.array([logp[:, grams.bucket[a : a + n]].sum(1) * langid.WEIGHT * min(n, langid.MOST_TRIGRAMS) / n if n else np.zeros(k + 1) for a, n in zip(grams.offset[:-1], size)])
    text = np.exp(ll + np.log([*[(1 - langid.BACKGROUND) / k] * k, langid.BACKGROUND]))
    post = text / text.sum(1, keepdims=True)
    told = [i for i in range(len(rows)) if size[i]]
    total = post[told].sum(0)
    prior = (total + 1 / (k + 1)) / (total.sum() + 1)
    known = lambda x: None if not x else x if x in names else "other"
    domain = lambda h: ".".join(h.split(".")[-2:])

    def given(value, of):
        if value is None:
            return np.zeros(k + 1)
        like = [i for i in told if of(rows[i]) == value]
        if not like:
            return np.zeros(k + 1)
        return np.log((post[like].sum(0) + langid.TABLE * len(like) / total.sum()) / (langid.TABLE + total))

    out = []
    for i, (t, declared, suffix, host) in enumerate(rows):
        if not size[i]:
            out.append((langid.NONE, 0.0))
            continue
        start = prior
        if host is not None:
            near = [j for j in told if rows[j][3] is not None and domain(rows[j][3]) == domain(host)]
            wide = (post[near].sum(0) + langid.DOMAIN * prior) / (len(near) + langid.DOMAIN)
            same = [j for j in told if rows[j][3] == host and j != i]
            start = (post[same].sum(0) + langid.HOST * wide) / (len(same) + langid.HOST)
        fused = np.log(start) + ll[i] + given(known(declared), lambda r: known(r[1])) + given(suffix, lambda r: r[2])
        p = np.exp(fused - fused.max())
        out.append((codes[int(p.argmax())], p.max() / p.sum()))
    return out


def test_fused_evidence_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs, F.col("lang"), F.col("text"), F.col("doc_id"))
    rng = random.Random(4)
    texts = [" ".join((r.text or "").split()[a : a + rng.choice([1, 2, 3, 40])]) for r in docs.orderBy("doc_id").limit(120).collect() for a in (0, 7)] + [None, "", "12 #", "x y"]
    rows = [(t, rng.choice([*model[0], "xx", "", None]), rng.choice(["de", "com", None]), rng.choice(["a.b.de", "c.b.de", "b.de", "one", None, "x.y.com"])) for t in texts]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, declared string, suffix string, host string")
    got = {r.id: r for r in langid.identify(df, model).collect()}
    for i, (language, confidence) in enumerate(brute_language(rows, model)):
        assert got[i].language == language and abs(got[i].confidence - confidence) < 1e-6, (i, rows[i])
        assert got[i].accepted == (language != langid.NONE and confidence >= 0.5)


def test_every_language_is_fitted(spark):
    sets = [chr(97 + i // 9) + "qz" + chr(97 + i % 9) for i in range(81)]
    docs = spark.createDataFrame([(i, f"{w}{w} {w} o{w} {w}u " * 4, w, None) for i, w in enumerate(sets)], "doc_id long, text string, lang string, source string")
    assert {r.language for r in langid.identify_documents(docs).collect()} == set(sets)


def test_a_host_tips_a_text_that_says_nothing(spark):
    langs = {"aa": "kappa rolanda tikku ", "bb": "zuvex milor penn "}
    rows = [(i, langs[x] * 3, x, f"{x}.example.org") for i, x in enumerate(["aa", "bb"] * 20)] + [(100, "qqq", None, "aa.example.org"), (101, "qqq", None, "bb.example.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.language for r in langid.identify_documents(df).collect()}
    assert (got[100], got[101]) == ("aa", "bb")


ITEM = "Alice has 12 apples and gives 5 km of them to Bob before lunch. How many apples does Alice have left?"


def test_leaks(spark):
    items = spark.createDataFrame([(1, ITEM, 0), (2, "short one here", 0), (3, None, 0), (4, "", 0), (5, "12 + 7 = 19", 0), (1, ITEM, 0), (6, "We walk along the very old road to see what is there and then go home again.", 0)], "item_id long, text string, h int")
    docs = [
        (1, "Intro text. " + ITEM + " Bye."),
        (2, "Intro. Zed has 99 apples and gives 7 mg of them to Kim before lunch. How many apples does Zed have left? Bye"),
        (3, "Intro. Zed has 99 pears and takes 7 mg of it from Kim after lunch. How few apples will Zed have sold? Bye"),
        (4, None), (5, ""), (6, "a short one here and"), (7, "some 12 + 7 = 19 thing"), (8, "some 12 + 8 = 20 thing"), (9, "Alice has 12 apples. Then nothing else of that sort follows."),
        (10, "x " * 5000 + ITEM), (11, "oh " + "We walk along the very old road to see what is there and then go home again.".upper()), (1, "Intro text. " + ITEM + " Bye."),
    ]
    df = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, item string")
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(df, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2), (7, 5), (10, 1), (11, 6)}
    assert got[1, 1].verbatim and got[1, 1].covered == 1 and not got[2, 1].verbatim
    assert decontam.find_leaks(df.limit(0), items).count() == decontam.find_leaks(df, items.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    text = "we ask whether {} likes seven long walks with {} and so whether {} walks at all today my dear"
    items = spark.createDataFrame([(1, text.format("Ann", "Ben", "Ann"))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text.format("Kim", "Lou", "Kim")), (2, text.format("Kim", "Lou", "Max"))], "doc_id long, text string")
    assert [r.doc_id for r in decontam.find_leaks(docs, items).collect()] == [1]


def test_every_verbatim_item_is_found(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    one = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    texts, asked = [(r.doc_id, one(r.text)) for r in docs.collect()], [(r.item_id, one(r.text)) for r in items.collect()]
    want = {(d, i) for d, t in texts for i, x in asked if x in t}
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()} == want and want


def test_bloom_filter(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    sieve = bloom.collect(keys, F.col("h"), 3000)
    other = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy().view(np.uint64)
    assert bloom.test(sieve, keys.toPandas()["h"].to_numpy().view(np.uint64)).all()
    assert bloom.test(sieve, other).mean() < 0.02
    rows = spark.range(6000).withColumn("w0", F.lit(1))
    assert bloom.drop_keys(rows, F.xxhash64("id"), keys, "h").count() == 3000
    assert bloom.drop_keys(rows, F.xxhash64("id"), keys.limit(0), "h").count() == 6000


@pytest.mark.parametrize("n_keys", [3000, 3_000_000, bloom.WORTH + 1])
def test_bloom_filters_of_every_size_lose_no_key(spark, n_keys):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    sieve = bloom.collect(keys, F.col("h"), n_keys)
    assert sieve.shape == ({3000: 1 << 7, 3_000_000: 1 << 17}.get(n_keys, 1), 8)
    rows = spark.range(6000)
    got = bloom.probe(rows, F.xxhash64("id"), keys, "h", n_keys, "maybe").withColumn("h", F.xxhash64("id")).toPandas()
    assert got[got.id < 3000].maybe.all() and len(got) == 6000
    assert (bloom.test(sieve, got.h.to_numpy().view(np.uint64)) == got.maybe).all()
    assert got[got.id >= 3000].maybe.mean() < 0.02 or n_keys > bloom.WORTH


def test_keys_go_without_a_filter_too(spark, monkeypatch):
    monkeypatch.setattr(bloom, "WORTH", 100)
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    rows = spark.range(6000).withColumn("w0", F.lit(1))
    left = bloom.drop_keys(rows, F.xxhash64("id"), keys, "h")
    assert left.columns == ["id", "w0"] and sorted(r.id for r in left.collect()) == list(range(3000, 6000))


def test_urls(spark):
    urls = ["https://A.Example.COM/en/71?x#y", "http://b.com/en/1", "ftp://example.com/en/8", "x://com/en/", "https://b.net/de/8", "https://q.example.net/de/81", "http://notcom/en/", "http://a.org/es/x", None, "no scheme", "http://h", "a://b://c/d", "http://list.ed/p/?utm_source=q&b=2&a=1#f", "https://www.list.ed/p?a=1&b=2", "http://list.ed/p?a=1", ""]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(12, urls[12], "h")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://list.ed/p?b=2&a=1",), ("HTTP://LIST.ED/p?b=2&a=1",), (None,)], "url string")
    out = urlfilter.judge(pages, listed)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(urls) + 1
    assert [got[i] for i in range(12)] == [
        ("a.example.com", "/en/71", "example.com/en/7", "allow"), ("b.com", "/en/1", "com/en/", "block"), ("example.com", "/en/8", "com/en/", "block"), ("com", "/en/", "com/en/", "block"),
        ("b.net", "/de/8", "net/de/", "allow"), ("q.example.net", "/de/81", "example.net/de/8", "block"), ("notcom", "/en/", None, "allow"), ("a.org", "/es/x", "org/es/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]
    assert [got[i][3] for i in (12, 13, 14)] == ["block", "block", "allow"]
    assert urlfilter.judge(pages.limit(0), listed).count() == 0
    assert urlfilter.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 5


def test_chats_read_back(spark):
    rng = random.Random(9)
    pieces = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<\\|", "<\\\\|", "\\", "<", "|", "\n", "assistant", " é🙂", "$1", "x"]
    say = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb\\n", None]), rng.choice([say(), say(), None])) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (2, None, "assistant", "first"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == len(texts[c])
        runs = sum(1 for i, r in enumerate(turns) if not i or (turns[i - 1][2] or "") != (r[2] or ""))
        assert texts[c].count("<|im_start|>") == texts[c].count("<|im_end|>") == runs
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_minimum_cut_is_minimum():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 8)
        costs = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def energy(keep):
            return sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(costs, keep)) + sum(w for i, j, w in edges if keep[i] != keep[j])

        assert energy(htmlmain.min_cut(costs, edges)) == min(energy(k) for k in itertools.product([False, True], repeat=n))


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class=site><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href="/x">Menu entry</a></ul></nav><div id="cookie-notice">We use cookies on this site, please agree to all of them now.</div>
<main><h1>Title&#39;s here</h1><p>Short.</p><p>A long paragraph with many words in it,
 so that it counts &lt;b&gt; for sure.<form><p>Sign up for our news letter today</p></form><div class="ad-box">Buy this now, it is a very long advert text, truly.</div>
<p>x &amp; y<br>next</p><!-- <p>hidden</p> --></main><section class="comments"><p>This is a reader comment which is quite long and opinionated.</p></section><aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark):
    assert htmlmain.main_text(PAGE) == "Title's here\nShort.\nA long paragraph with many words in it, so that it counts <b> for sure.\nx & y next"
    assert htmlmain.main_text("<p>just a paragraph</p>") == "just a paragraph"
    for odd in (None, "", "<", "<div>", "<!--", "<script>", "<p title='", "</p></p>", "<a" * 50, "&#xZ; &bogus;"):
        assert isinstance(htmlmain.main_text(odd), str)
    long = "<article>" + "<p>Word and word again.</p>" * 4000 + "</article>"
    df = spark.createDataFrame([(1, long, "t"), (2, None, None), (2, None, None)], "page_id long, html string, text string")
    got = sorted((r.page_id, r.text) for r in htmlmain.extract(df).collect())
    assert got == [(1, "\n".join(["Word and word again."] * 4000)), (2, ""), (2, "")]
    assert htmlmain.extract(df.limit(0)).count() == 0


def article_of(page):
    import html as h

    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    want = [re.sub(r"\s+", " ", h.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x)))).strip() for x in re.split(r"</?(?:p|h1|h2|ul|li)>", inside)]
    return [x for x in want if x]


def test_articles_of_the_test_pages(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        assert htmlmain.main_text(r.html) == "\n".join(article_of(r.html))


def test_the_cut_decides_where_markup_says_nothing():
    import pyarrow.parquet as pq

    pages = [p for p in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()]
    cut = sign = 0
    for page in pages:
        want = article_of(page)
        blocks, costs, keep = htmlmain.labels_of(re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', ""))
        cut += [b.text for b, k in zip(blocks, keep) if k] == want
        sign += [b.text for b, c in zip(blocks, costs) if c > 0] == want
    assert cut > sign and cut >= 0.9 * len(pages)


NEUTRAL = """<body><div><a href="/">Home</a> <a href="/n">News of the day</a> <a href="/a">About us</a></div>
<div><h1>A title</h1><p>%s</p><p>Short one</p><p><a href="/x">A linked line</a></p><p>%s</p><div>Mid remark without a stop</div><p>%s</p></div>
<div>Alle Rechte vorbehalten. Impressum Datenschutz Kontakt und alles, was sonst noch am Ende einer Seite steht.</div></body>"""


def test_a_page_without_helpful_names():
    long = ["This paragraph number %d has quite some words in it, so that anybody would take it for a part of the article itself, and goes on for a while." % i for i in range(3)]
    blocks, costs, keep = htmlmain.labels_of(NEUTRAL % tuple(long))
    flipped = [b.text for b, c, k in zip(blocks, costs, keep) if (c > 0) != k]
    assert htmlmain.main_text(NEUTRAL % tuple(long)) == "\n".join(["A title", long[0], "Short one", "A linked line", long[1], "Mid remark without a stop", long[2]])
    assert "A linked line" in flipped


def test_hidden_text_and_several_marks():
    page = '<article><p>Seen text of the article here.</p><p hidden>never</p><div style="display:none"><p>nor this</p></div><div class="share">Tell your friends about it all today, and tomorrow, and the day after, too.</div><p>End of it.</p></article>'
    assert htmlmain.main_text(page) == "Seen text of the article here.\nEnd of it."
