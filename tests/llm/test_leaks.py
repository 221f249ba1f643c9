"""Contaminated documents that letter case or a sentence's first word must not hide."""

import random
import re

import pytest

from quirefold.llm import decontam

PENCILS = "On Monday the teacher Mr Brown gave 24 pencils to Anna and 36 pencils to Peter. If Anna then gives 6 of the pencils to Peter, how many pencils does Anna have?"
APFEL = "Am Montag kauft Anna auf dem Markt 12 Birnen und 5 Gurken, und ihr Bruder Paul isst davon 3 Birnen und eine Gurke. Wie viel bleibt Anna?"
CLIPS = "Natalia sold 48 clips in April. Natalia then sold 24 clips in May. Natalia gave 12 clips to her friends. How many clips did Natalia have at the end of it all?"
PENS = "Tom has 12 red pens. Tom buys 5 more pens. Tom then gives 3 pens to the school. Tom lost 2 of the pens. How many pens are left now?"


def leaks(spark, items, docs):
    rows = decontam.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r.doc_id, r.item_id): r for r in rows.collect()}


def test_letter_case_does_not_hide_an_item(spark):
    other = PENCILS.replace("24", "77").replace("36", "58").lower()
    got = leaks(spark, [PENCILS, APFEL], ["so: " + PENCILS.lower() + " yes", PENCILS.upper(), APFEL.lower(), APFEL.upper(), other, PENCILS.lower().replace("pencils", "long red pens")])
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 0)}
    assert all(got[k].covered == 1 and got[k].verbatim for k in [(0, 0), (1, 0), (2, 1), (3, 1)]) and not got[4, 0].verbatim


@pytest.mark.parametrize("item,name,numbers", [(CLIPS, "Natalia", ("48", "24", "12")), (PENS, "Tom", ("12", "5", "3", "2"))])
def test_first_words_are_names_too(spark, item, name, numbers):
    changed = item.replace(name, "Igor")
    for n in numbers:
        changed = changed.replace(f" {n} ", f" {int(n) + 100} ")
    mixed = changed.replace("Igor", "Olga", 2)
    got = leaks(spark, [item], ["Some text before. " + changed + " And after.", mixed])
    assert set(got) == {(0, 0)} and got[0, 0].covered > 0.9 and not got[0, 0].verbatim


CORE = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]")
CAPITAL = {*map(chr, range(65, 91)), *(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)}
FOLD = str.maketrans({c: c.lower() for c in CAPITAL})


def template(text):
    """(value, kind, may be a name only as first word of a sentence) of every token, word by word."""
    out, fresh, after_number = [], True, False
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        core = [m.start() for m in CORE.finditer(word)]
        if core:
            body = word[core[0] : core[-1] + 1]
            value = body.translate(FOLD)
            kind = "number" if body[0] in "0123456789" else "unit" if after_number and value in decontam.UNITS else "name" if body[0] in CAPITAL else "word"
            out.append((value, kind, fresh))
            fresh, after_number = False, kind == "number"
        fresh |= bool(re.search("[.!?:;]", word[core[-1] + 1 :] if core else word))
    return out


def readings(tokens):
    """What is a slot under each reading."""
    return [
        [False] * len(tokens),
        [k in ("number", "unit") for _, k, _ in tokens],
        [k in ("number", "unit") or (k == "name" and not f) for _, k, f in tokens],
        [k != "word" for _, k, _ in tokens],
    ]


def brute_leaks(docs, items, window=8, literals=4, least=0.5):
    """(document, item): share of the item's windows that consistent alignments cover, and whether all of them verbatim."""
    out = {}
    for i, item in enumerate(items):
        b = template(item)
        size = min(window, len(b))
        if not size:
            continue
        slots_b = readings(b)
        for d, text in enumerate(docs):
            a = template(text)
            slots_a, covered, same = readings(a), set(), set()
            for diagonal in range(-len(b), len(a)):
                for r in range(4):
                    at, values = [], {}
                    consistent = True
                    for p in range(len(b) - size + 1):
                        q = p + diagonal
                        if q < 0 or q + size > len(a):
                            continue
                        sb, sa = slots_b[r][p : p + size], slots_a[r][q : q + size]
                        # A reading with too few plain words is not used; a window reads as before where it has no further slots.
                        if sum(sb) > size - min(literals, size) or sb != sa:
                            continue
                        x, y = b[p : p + size], a[q : q + size]
                        if any((u[1] != v[1]) if s else (u[0] != v[0]) for u, v, s in zip(x, y, sb)):
                            continue
                        at.append(p)
                        for u, v, s in zip(x, y, sb):
                            if s:
                                consistent &= values.setdefault((u[1], u[0]), v[0]) == v[0]
                    if at and consistent:
                        covered.update(at)
                        if r == 0:
                            same.update(at)
            share = len(covered) / (len(b) - size + 1)
            if share >= least:
                out[d, i] = (round(share, 4), covered == same)
    return out


def test_against_brute_force(spark):
    rng = random.Random(12)
    words = "the old man and his dog went to see what could be there for them while it was still light so they took".split()
    names, units = ["Anna", "Paul", "Élise", "Tom", "Kim"], ["km", "kg", "hours", "cents"]

    def sentence(n):
        out = []
        while len(out) < n:
            x = rng.random()
            out += [rng.choice(names)] if x < 0.15 else [str(rng.randint(1, 99)), *([rng.choice(units)] if x < 0.22 else [])] if x < 0.3 else [rng.choice(words)]
        return (out[0].capitalize() + " " + " ".join(out[1:]) + rng.choice([".", "?", " !", ","])).strip()

    items = [" ".join(sentence(rng.randint(5, 14)) for _ in range(rng.randint(1, 3))) for _ in range(12)] + ["short one", "", "12 + 7 = 19"]

    def changed(t):
        for n in set(re.findall(r"\d+", t)):
            t = re.sub(rf"\b{n}\b", str(int(n) + 100) if rng.random() < 0.8 else n, t)
        for n in names:
            if rng.random() < 0.5:
                t = t.replace(n, rng.choice(["Zoe", "Max", n]))
        if rng.random() < 0.4:
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(["extra", "Anna", "7", "the"])
            t = " ".join(w)
        return rng.choice([t, t, t.lower(), t.upper(), t.replace(" ", "\n", 2)])

    docs = [sentence(8) + " " + changed(rng.choice(items)) + " " + sentence(6) for _ in range(70)] + [sentence(30), "", "so 12 + 8 = 20 it is"]
    got = {k: (r.covered, r.verbatim) for k, r in leaks(spark, items, docs).items()}
    assert got == brute_leaks(docs, items) and len(got) > 30


def test_rows_that_repeat_and_very_long_texts(spark):
    long = "word and more of it " * 60_000 + PENCILS + " and so on" * 10
    got = leaks(spark, [PENCILS, PENCILS], [long, "nothing"])
    assert set(got) == {(0, 0), (0, 1)}
    row = (1, "so: " + PENCILS)
    df = spark.createDataFrame([row, row, (1, "other text of one id")], "doc_id long, text string")
    assert [r.doc_id for r in decontam.find_leaks(df, spark.createDataFrame([(5, PENCILS)], "item_id long, text string")).collect()] == [1]
