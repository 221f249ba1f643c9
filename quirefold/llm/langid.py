"""Language ID by Bayesian evidence fusion.

A row's evidence is its text, the language its markup declares, the suffix of its address and its host. A trigram model
gives the text's likelihood under every language and under a background model of no language; grouped aggregation of the
text's own posteriors gives how often each language is declared as what, what it is under each suffix, and the languages of
each host, smoothed towards its domain's, its domain's towards all (a row's own text left out). The product of all is the
posterior. A row is accepted if it has letters and its best language has at least ``least`` of the posterior.

The text model is fitted on a bounded sample of labelled rows: of each label the rows of smallest hash, ``sample_rows`` of
them on average. Everything else covers all rows.

Defined results: a null or empty text, or one without letters, is rejected with language ``und``; so is a text that the
background explains best. Missing (null) evidence of the other kinds says nothing. Repeated rows are judged each on their
own. With no labelled rows everything is ``und``. Ties go to the first language by code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import ascii_lower, read, small_batches, store, tidy
from quirefold.llm.urlfilter import host_of, path_of
from quirefold.llm.words import batches_of

BUCKETS = 1 << 15
#: Labelled rows of each label that the text model is fitted on, on average. Every label is fitted; each takes 128 kB of the model
#: that is sent out, so its size is bounded by the number of languages.
SAMPLE_ROWS = 2_000
#: Trigrams that count at most (neighbours are not independent), and the weight of each.
MOST_TRIGRAMS, WEIGHT = 120, 0.5
#: Strength of the smoothing of host towards domain and of domain towards all; of declared and suffix tables; of the background.
HOST, DOMAIN, TABLE, BACKGROUND = 5.0, 20.0, 2.0, 1e-3
NONE = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Trigrams:
    """Hashed letter trigrams of a batch: ``bucket`` of each and ``doc`` it is of; anything but letters counts as a space."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("") if texts.null_count else texts
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        # A space before and after each text, so that the shortest words have trigrams.
        if len(off) > 1:
            data = np.insert(data, np.repeat(off, np.concatenate([[1], np.full(len(off) - 2, 2), [1]])), 0x20)
            off = off + np.concatenate([[0], 2 * np.arange(1, len(off))])
        low = _FOLD[data]
        if len(data) > 1:  # capitals of Latin-1 in UTF-8
            capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
            low[capital] += 0x20
        x = low.astype(np.uint32)
        n = max(len(x) - 2, 0)
        h = (x[:n] * np.uint32(0x9E3779B1)) ^ (x[1 : n + 1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D)) if n else np.zeros(0, np.uint32)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = (h >> np.uint32(17)).astype(np.int64)
        blank = low == 0x20
        keep = (blank[:n].astype(np.int8) + blank[1 : n + 1] + blank[2:]) < 2 if n else np.zeros(0, bool)
        # Trigrams over a text's end belong to nobody.
        last = off[1:-1]
        for back in (1, 2):
            edge = last - back
            keep[edge[(edge >= 0) & (edge < n)]] = False
        at = np.flatnonzero(keep)
        self.bucket = bucket[at]
        self.offset = np.searchsorted(at, off)


def fit(rows: DataFrame, label: Column, text: Column, key: Column, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods of every bucket under each of them and under the background (last)."""
    base = rows.select(label.alias("label"), text.alias("t"), key.alias("k")).where("label is not null")
    found = base.groupBy("label").count().collect()  # one row a language
    if not found:
        return [], np.full((1, BUCKETS), -np.log(BUCKETS))
    share = F.create_map(*[x for r in found for x in (F.lit(r["label"]), F.lit(min(1.0, sample_rows / r["count"])))])
    chosen = base.where(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col("label")), F.lit(0.0)) * float(1 << 30)).select("label", "t")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for part in batches_of(b, 1):
                g = Trigrams(part.column(1))
                doc = np.repeat(np.arange(part.num_rows), np.diff(g.offset))
                labels = np.array(part.column(0).to_pylist(), object)
                for name in set(labels.tolist()):
                    got = np.bincount(g.bucket[(labels == name)[doc]], minlength=BUCKETS)
                    total[name] = total.get(name, 0) + got
        for name, c in total.items():
            i = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(c[i].astype(np.int64))], ["label", "bucket", "c"])

    got = chosen.mapInArrow(tidy(count), "label string, bucket int, c long").groupBy("label", "bucket").agg(F.sum("c").alias("c")).toArrow()
    names = sorted(r["label"] for r in found)
    counts = np.zeros((len(names), BUCKETS))
    place = {x: i for i, x in enumerate(names)}
    np.add.at(counts, (np.array([place[x] for x in got.column("label").to_pylist()], np.int64), got.column("bucket").to_numpy()), got.column("c").to_numpy())
    model = np.log((counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * BUCKETS))
    return names, np.vstack([model, np.full((1, BUCKETS), -np.log(BUCKETS))])


def _log_sum(a: Column) -> Column:
    """log(sum(exp(a))) of an array."""
    most = F.array_max(a)
    return most + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - most)))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "id", text_col: str = "text", declared_col: str | None = "declared", suffix_col: str | None = "suffix", host_col: str | None = "host", least: float = 0.5) -> DataFrame:
    """(id, key, language, confidence, text_language, accepted) of every row; ``key``: a hash of id and text."""
    spark = small_batches(rows.sparkSession)
    names, table = model
    k = len(names)
    codes = [*names, NONE]
    table32 = spark.sparkContext.broadcast(np.ascontiguousarray(table.T.astype(np.float32)))
    kind = rows.schema[id_col].dataType.simpleString()
    optional = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    declared = F.regexp_extract(ascii_lower(F.trim(optional(declared_col))), "^[a-z]+", 0)
    known = F.when(optional(declared_col).isNull() | (declared == ""), F.lit(None)).when(declared.isin(names), declared).otherwise("other") if names else F.lit(None).cast("string")
    source = rows.select(F.col(id_col).alias("i"), F.xxhash64(F.lit(1), F.col(id_col).cast("string"), F.col(text_col)).alias("key"), known.alias("declared"), optional(suffix_col).alias("suffix"), optional(host_col).alias("host"), F.col(text_col).alias("t"))

    def score(batches):
        logp = table32.value
        for b in batches:
            for part in batches_of(b, 5):
                g = Trigrams(part.column(5))
                n = np.diff(g.offset)
                ll = np.zeros((len(n), logp.shape[1]))
                full = np.flatnonzero(n)
                if len(full):
                    for j in range(logp.shape[1]):
                        ll[full, j] = np.add.reduceat(logp[:, j][g.bucket].astype(np.float64), g.offset[full])
                    ll[full] *= (WEIGHT * np.minimum(n[full], MOST_TRIGRAMS) / n[full])[:, None]
                flat = pa.array(ll.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * ll.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(5)), pa.array(n.astype(np.int64)), lists], ["i", "key", "declared", "suffix", "host", "n", "ll"])

    scored = source.mapInArrow(tidy(score), f"i {kind}, key long, declared string, suffix string, host string, n long, ll array<double>")
    flat = F.array(*[F.lit(float(np.log(max((1 - BACKGROUND) / max(k, 1), 1e-300)))) for _ in names], F.lit(float(np.log(BACKGROUND)) if k else 0.0))
    text = F.zip_with("ll", flat, lambda a, b: a + b)
    scored = scored.withColumn("text", text).withColumn("norm", _log_sum(F.col("text"))).withColumn("post", F.transform("text", lambda x: F.exp(x - F.col("norm")))).drop("text", "norm")
    # Rows without letters tell nothing of their kind.
    scored = store(scored.withColumn("domain", F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1)), "langid-scored")
    evidence = scored.where("n > 0")
    sums = lambda g: g.agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("post")[j]) for j in range(k + 1)]).alias("s"))
    whole = sums(evidence.groupBy()).first()
    total = np.array([x or 0.0 for x in whole["s"]])
    overall = (total + 1 / (k + 1)) / (total.sum() + 1)
    prior = F.array(*[F.lit(float(x)) for x in overall])

    def given_language(col: str) -> DataFrame:
        """For each value of ``col``: how likely it is under each language, as a log. Known values only have a say."""
        t = sums(evidence.where(F.col(col).isNotNull()).groupBy(col))
        per = F.array(*[F.lit(float(TABLE + x)) for x in total])
        # Smoothed towards the value's overall share.
        share = F.col("n") / F.lit(float(max(total.sum(), 1.0)))
        return t.select(col, F.zip_with("s", per, lambda s, m: F.log((s + TABLE * share) / m)).alias(f"{col}_given"))

    # The declared values are the languages, "other" and null: a table of bounded size.
    out = scored.join(F.broadcast(given_language("declared")), "declared", "left")
    if suffix_col:
        out = out.join(given_language("suffix"), "suffix", "left")
    if host_col:
        domains = sums(evidence.where("domain <> ''").groupBy("domain")).select("domain", F.zip_with("s", prior, lambda s, p: s + DOMAIN * p).alias("d"), (F.col("n") + DOMAIN).alias("dn"))
        hosts = sums(evidence.where("host is not null").groupBy("host", "domain")).join(domains, "domain").select("host", F.col("n").alias("hn"), F.col("s").alias("hs"), F.transform("d", lambda x: x / F.col("dn")).alias("domain_prior"))
        out = out.join(hosts, "host", "left")
        own = F.when(F.col("n") > 0, F.col("post")).otherwise(F.array_repeat(F.lit(0.0), k + 1))
        counted = F.greatest(F.col("hn") - F.when(F.col("n") > 0, 1).otherwise(0), F.lit(0))
        rest = F.zip_with("hs", own, lambda s, o: F.greatest(s - o, F.lit(0.0)))
        host_prior = F.zip_with(rest, "domain_prior", lambda s, p: F.log((s + HOST * p) / (counted + HOST)))
        start = F.coalesce(host_prior, F.transform(prior, lambda x: F.log(x)))
    else:
        start = F.transform(prior, lambda x: F.log(x))
    fused = F.zip_with(start, "ll", lambda a, b: a + b)
    for col in ("declared", *(["suffix"] if suffix_col else [])):
        fused = F.zip_with(fused, F.coalesce(F.col(f"{col}_given"), F.array_repeat(F.lit(0.0), k + 1)), lambda a, b: a + b)
    languages = F.array(*[F.lit(c) for c in codes])
    best = F.col("fused")
    at = F.array_position(best, F.array_max(best)).cast("int")
    confidence = F.exp(F.array_max(best) - _log_sum(best))
    seen = F.col("n") > 0
    out = out.withColumn("fused", fused)
    language = F.when(seen, F.element_at(languages, at)).otherwise(NONE)
    return out.select(
        F.col("i").alias(id_col),
        "key",
        language.alias("language"),
        F.when(seen, confidence).otherwise(0.0).alias("confidence"),
        F.when(seen, F.element_at(languages, F.array_position("post", F.array_max("post")).cast("int"))).otherwise(NONE).alias("text_language"),
        (seen & (language != NONE) & (confidence >= least)).alias("accepted"),
    )


def identify_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Of a table of documents: ``lang`` is what is declared, ``source`` the host, and what follows its last dot, if it has one, the
    suffix. ``labelled``: rows to fit on, else the same; a declared language then speaks as a label and as evidence."""
    base = docs if labelled is None else labelled
    model = fit(base, F.col("lang"), F.col("text"), F.col("doc_id"))
    suffix = F.regexp_extract(F.col("source").cast("string"), r"[^.]\.([^.]+)$", 1)
    return identify(docs.select("doc_id", "text", "lang", "source", F.when(suffix != "", ascii_lower(suffix)).alias("suffix")), model, "doc_id", "text", "lang", "suffix", "source")


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Of a table of pages: the root element's ``lang`` is declared; host, country or language part of the address from the URL."""
    model = fit(labelled, F.col("lang"), F.col("text"), F.col("doc_id"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[#\w]+;", " ")
    lang = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z-]+)", 1)
    suffix = F.concat_ws("/", F.regexp_extract(host, r"\.([^.]+)$", 1), F.regexp_extract(path, r"^/([a-z]{2})(?:[-_][a-zA-Z]{2})?(?:/|$)", 1))
    rows = pages.select("page_id", body.alias("text"), F.when(lang != "", lang).alias("declared"), F.when(host != "", suffix).alias("suffix"), F.when(host != "", host).alias("host"))
    return identify(rows, model, "page_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(read(spark, sf_dir, "documents")).drop("key")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents")).drop("key")


QUERIES = {"op2_language_id": op2_language_id, "language_id_pages": language_id_pages}
ORACLE_SQL: dict[str, str] = {}
