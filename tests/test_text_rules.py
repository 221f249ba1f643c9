"""Text expressions against restatements in plain Python, on random Unicode and on the cases of the rules."""

import random
import re

from pyspark.sql import functions as F

from quirefold.functions import text as T

ALPHABET = "ab Zé\t\n\x1c\x85\xa0 –—•-:;.,%/()'’“”7½²ǅßœ_ "


def norm(s):
    s = re.sub("[‐-—]", "-", s.strip()).replace("•", "- ")
    s = re.sub(r"\s+", " ", re.sub(r"[^\w\s/%.:\-()’']+", "", s)).strip()
    return s[:-1].strip() if s.endswith(":") else s


def toks(s):
    return re.sub(r"[^\w\s/%.']", " ", re.sub("[‐-—]", " ", s.lower())).split()


def mark(s):
    return " ".join(sorted(t for t in toks(s) if t not in T.STOP_WORDS and (t.isdigit() or len(t) >= 2)))


def test_random_text(spark):
    rng = random.Random(4)
    # Word characters beyond letters, digits and the underscore differ between engines; superscripts and fractions are numbers to both.
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", T.normalize_text(F.col("s")).alias("n"), T.tokenize(F.col("s")).alias("t"), T.fingerprint(F.col("s")).alias("f"), T.strip(F.col("s")).alias("p"), T.split_lines(F.col("s")).alias("l"))
    for r in df.collect():
        s = texts[r.i]
        assert r.p == s.strip()
        assert r.n == norm(s), repr(s)
        assert r.t == toks(s), repr(s)
        assert r.l == (s.splitlines() or [])
        if not any(c in s for c in "½²"):
            assert r.f == mark(s), repr(s)


CASES = [
    ("Do not combine both drugs together", "other", "unclear", "contraindication", "must", False),
    ("Known pregnancy in the patient", "other", "unclear", "exclusion", "must", False),
    ("Seek emergency evaluation today", "other", "may", "red_flag", "may", True),
    ("Pressure of 180 mmhg or greater", "other", "unclear", "threshold", "unclear", True),
    ("Pressure of 180 mm Hg or greater", "other", "unclear", "other", "unclear", True),
    ("Clinicians should reassess weekly", "other", "unclear", "follow_up", "should", False),
    ("It is reasonable to consider a diuretic", "other", "must", "other", "consider", True),
    ("Signes nouveaux chez la personne", "population", "must", "follow_up", "unclear", True),
]


def test_rules(spark):
    df = spark.createDataFrame(CASES, "s string, t string, g string, wt string, wg string, wr boolean")
    kind = T.refine_fact_type(F.col("s"), F.col("t"))
    out = df.withColumn("kind", kind).withColumn("strength", T.refine_strength(F.col("s"), F.col("g"), F.col("kind"))).withColumn("review", T.needs_review(F.col("strength"), F.lit(False)))
    for r in out.collect():
        assert (r.kind, r.strength, r.review) == (r.wt, r.wg, r.wr), r.s


def test_junk_page_numbers_and_citations(spark):
    rows = [("Table of dose per class", True, False), ("Short one", True, False), ("Page 3", True, True), ("3 / 9", True, True), ("1234", True, False), ("A sentence of some length", False, False)]
    for r in spark.createDataFrame(rows, "s string, junk boolean, page boolean").select("*", T.is_header_or_junk(F.col("s")).alias("j"), T.is_page_number(F.col("s")).alias("p")).collect():
        assert (r.j, r.p) == (r.junk, r.page), r.s
    one = spark.range(1).select(T.format_citation(F.lit("c1"), F.lit(2), F.lit(None)).alias("a"), T.numbered_id("f", F.lit(12345)).alias("b")).first()
    assert (one.a, one.b) == ("`c1:2-?`", "f12345")
