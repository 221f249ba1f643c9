"""URL filters: host and path rules first, then a list of URLs behind a blocked Bloom filter.

Listed canonical URLs set bits in a blocked Bloom filter: one 64-bit hash picks a block of 512 bits and eight bits in it,
one in each 64-bit word. The filter's blocks are a small table; a URL meets its own block by key, and only URLs with all
eight bits set go on to an exact hash join with the list, which removes the false positives. All of it runs in the JVM.

The filter's size is bounded (see ``bloom``), so sending it to every executor is; a list too long for it raises the share of
false positives, which the exact join still removes.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule, has no canonical form and is
allowed. Repeated rows are judged each on their own; repeated list entries count once. Of equally long rules that fit, the longer host
wins, then block. An empty table gives no rows, an empty list blocks nothing by itself. URLs of any length are judged whole.
Columns beside the id and the URL are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bloom
from quirefold.llm.common import ascii_lower, read

#: Query parameters that never change the page; dropped from canonical URLs.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Labels of registered names whose pages the production list holds.
LISTED_NAMES = ("cheap-pills", "adult-x")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and path without closing slashes, with the query parameters that matter; no scheme, no fragment.

    Null without a host.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))), "&")
    whole = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host_of(url) != "", whole)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Of equally long ones the longer host wins, then block."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, possible) for every row. ``possible``: the Bloom filter let it through to the exact join."""
    keys = listed.select(canonical(F.col(list_col)).alias("k")).where("k is not null").distinct()
    n_keys = keys.agg(F.approx_count_distinct("k")).first()[0]
    hashed = keys.select(F.xxhash64("k").alias("h"))
    host, path = F.col("host"), F.col("path")
    rows = (
        pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"))
        .select("i", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), canonical(F.col("u")).alias("k"))
        .withColumn("best", fitting_rule(host, path, rules))
    )
    rows = bloom.probe(rows, F.xxhash64("k"), hashed, "h", n_keys, "possible").withColumn("possible", F.col("possible") & F.col("k").isNotNull())
    rows = rows.withColumn("k", F.when(F.col("possible"), F.col("k")))
    # Rows the filter stopped have a null key: they skip the exact join, so one key does not gather them.
    through = rows.where("k is not null").join(keys.withColumn("listed", F.lit(True)), "k", "left")
    rest = rows.where("k is null").withColumn("listed", F.lit(None).cast("boolean"))
    out = through.select("i", "host", "path", "best", "possible", "listed").unionByName(rest.select("i", "host", "path", "best", "possible", "listed"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("i").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "possible")


def production_list(pages: DataFrame) -> DataFrame:
    """The URLs on hosts under one of ``LISTED_NAMES``."""
    return pages.select("url").where(host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_NAMES)})\."))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, production_list(pages)).drop("possible")


SQL = r"""
with p as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
c as (
  select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
    string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') as k
  from p),
listed as (select distinct k from c where regexp_matches(host, '(^|\.)(cheap-pills|adult-x)\.')),
rules(verdict, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best as (
  select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as v
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select c.page_id, host, path, rule, coalesce(v, case when listed.k is not null then 'block' else 'allow' end) as verdict
from c left join best on best.page_id = c.page_id left join listed on listed.k = c.k
"""
QUERIES = {"op8_url_filters": op8_url_filters}
ORACLE_SQL = {"op8_url_filters": SQL}
