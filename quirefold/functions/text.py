"""Text rules as column expressions. They follow Python's idea of white space, words and line ends; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as str.isspace has it, for Java and RE2 alike.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Line ends as str.splitlines has them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
OTHER_SPACE = SPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")
#: The same white space, one sign after another.
SPACE_SIGNS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
DASH = r"[\x{2010}-\x{2014}]"
#: The same dashes, one after another: replacing each costs less than a pattern.
DASHES = "".join(map(chr, range(0x2010, 0x2015)))
#: What normalisation deletes, and what stands between tokens.
DROPPED = rf"[^\p{{L}}\p{{N}}_/%.:\-()\x{{2019}}'{SPACE[1:-1]}]+"
NO_TOKEN = r"[^\p{L}\p{N}_/%.']+"
LOWER_FIRST = r"^(?U)\p{Lower}"

# Words that matching ignores, English then French.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "with", "on", "at", "by", "as", "is", "are",
    "le", "la", "les", "un", "une", "des", "et", "ou", "de", "du", "au", "aux", "dans", "pour", "avec",
    "sur", "chez", "en", "est", "sont", "être",
)
# Words of table and section headers, French and English.
HEADER_WORDS = (
    "table", "figure", "annexe", "référence", "references",
    "médicament", "médicaments", "medicament", "medicaments",
    "posologie", "dose", "doses", "dosage",
    "modalités", "modalites", "ajustement",
    "contre-indications", "contreindications", "contraindications",
    "effets", "indésirables", "indesirables", "adverse", "effects",
    "classe", "class",
    "sbp", "dbp", "ta", "pa", "bp", "mmhg", "mg", "g", "ml",
    "bid", "tid", "qid", "po",
)
CAPTION_WORDS = ("table", "figure", "annexe")
# Marks of headers and footers.
FOOTER_MARKS = ("page", "copyright", "©", "http", "www.", "ines", "msss")
# Fact types and strengths; strengths from weakest to strongest.
FACT_TYPES = ("population", "threshold", "exclusion", "contraindication", "red_flag", "action", "diagnostic", "follow_up", "other")
STRENGTHS = ("unclear", "may", "consider", "should", "must")
# Near misses of fact types.
TYPE_ALIASES = {
    "precaution": "other",
    "precautions": "other",
    "warning": "red_flag",
    "warnings": "red_flag",
    "contraindications": "contraindication",
    "contraindication": "contraindication",
    "diagnosis": "diagnostic",
    "followup": "follow_up",
    "follow-up": "follow_up",
}
# Cues of fact types and strengths, each list a rule; they are looked for anywhere, inside words too.
TYPE_CUES = {
    "contraindication": ("contre-indication", "contre indication", "contraindication", "do not", "ne pas", "éviter", "eviter"),
    "exclusion": ("exclusion", "grossesse", "allaitement", "pregnancy", "breastfeeding"),
    "red_flag": ("urgence", "urgent", "immédiat", "immediat", "emergency", "immediately", "référer", "refer"),
    "threshold": ("≥", ">=", "<=", ">", "<"),
    "follow_up": ("suivi", "réévaluation", "reevaluation", "monitor", "reassess", "follow-up", "follow up", "répéter", "repeter", "mesurer", "measure"),
    "action": ("prescrire", "initier", "commencer", "start", "initiate", "titrer", "titrate", "administrer", "administer"),
    "onset": ("apparition", "aggravation", "signes", "symptômes", "symptomes", "atteinte des organes cibles"),
}
DOSE = r"(?U)\b\d{2,3}\s*(?:mmhg|mg|g|ml)\b"
#: The same patterns for Java alone, which tries them at every sign: one cheap look passes over most signs that start no match.
_DROPPED = rf"(?![a-z ]){DROPPED}"
_SPACES = rf"(?![!-~])(?:{SPACE}{{2,}}|{OTHER_SPACE})"
_DOSE = DOSE.replace("(?U)", r"(?U)(?=\d)")
STRENGTH_CUES = {
    "must": ("do not", "ne pas", "jamais", "never", "contre-indication", "contraindication", "doit", "must", "required"),
    "should": ("devrait", "should", "recommand", "recommended", "recommandé", "recommandee"),
    "option": ("considérer", "consider", "peut être envisagé", "peut etre envisage", "may", "peut"),
    "weighing": ("consid", "envisag"),
}


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, whatever uses them: Spark neither merges a generator of one row with the
    projections above nor pushes filters on its columns below it, which would evaluate the same expression again."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[x.alias(k) for k, x in columns.items()]))))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_SIGNS))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_SIGNS))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space; single plain spaces are no matches, as most are of that kind."""
    return F.regexp_replace(c, _SPACES, " ")


def any_of(c: Column, cues) -> Column:
    """Whether one of the cues is in the text, literally."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(x)) for x in cues))


def split_lines(c: Column) -> Column:
    """array of the text's lines; a line end at the very end starts no line, and the empty text has none."""
    closed = F.regexp_replace(c, rf"(?:{LINE_END})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(closed, LINE_END, -1))


def normalize_text(c: Column) -> Column:
    """Statement text: dashes unified, bullets to dashes, odd signs gone, spaces squeezed, one closing colon dropped."""
    t = reduce(lambda t, dash: F.replace(t, F.lit(dash), F.lit("-")), DASHES, c)
    t = F.regexp_replace(F.replace(t, F.lit("•"), F.lit("- ")), _DROPPED, "")
    # Squeezed text has plain spaces only.
    t = F.trim(squeeze(t))
    return F.trim(F.regexp_replace(t, ":$", ""))


def tokenize(c: Column) -> Column:
    """Runs of letters, digits and the few signs that stay, in lower case."""
    return F.filter(F.split(F.lower(c), NO_TOKEN, -1), lambda x: x != "")


def fingerprint(c: Column, tokens: Column | None = None) -> Column:
    """Sorted tokens without stop words and lone letters; repeats stay. ``tokens``: those of the text, if known."""
    kept = F.filter(tokenize(c) if tokens is None else tokens, lambda x: ~x.isin(*STOP_WORDS) & ((F.length(x) >= 2) | x.rlike("^[0-9]+$")))
    return F.array_join(F.sort_array(kept), " ")


def is_page_number(c: Column) -> Column:
    t = F.lower(strip(c))
    return t.rlike(rf"^(?:[0-9]{{1,3}}|page{SPACE}*[0-9]{{1,3}}|[0-9]{{1,3}}{SPACE}*/{SPACE}*[0-9]{{1,3}})$")


def is_footer_like(c: Column) -> Column:
    return any_of(F.lower(c), FOOTER_MARKS) | is_page_number(c)


def is_header_or_junk(c: Column, min_chars: int = 10, tokens: Column | None = None) -> Column:
    tokens = tokenize(c) if tokens is None else tokens
    heads = F.size(F.filter(tokens, lambda x: x.isin(*HEADER_WORDS)))
    return (F.length(c) < min_chars) | (F.size(tokens) == 0) | ((heads >= 2) & (F.size(tokens) <= 10)) | F.coalesce(F.try_element_at(tokens, F.lit(1)).isin(*CAPTION_WORDS), F.lit(False))


def alias_fact_type(c: Column) -> Column:
    """Near misses of fact types; anything else as it is, for the schema to judge."""
    table = F.create_map(*[x for kv in TYPE_ALIASES.items() for x in map(F.lit, kv)])
    return F.coalesce(F.try_element_at(table, F.lower(strip(c))), c)


def refine_fact_type(statement: Column, current: Column, low: Column | None = None) -> Column:
    s = F.lower(statement) if low is None else low
    has = lambda rule: any_of(s, TYPE_CUES[rule])
    return (
        F.when(has("contraindication"), "contraindication")
        .when(has("exclusion"), "exclusion")
        .when(has("red_flag"), "red_flag")
        .when(current.isin("other", "follow_up", "diagnostic") & (has("threshold") | s.rlike(_DOSE)), "threshold")
        .when((current == "other") & has("follow_up"), "follow_up")
        .when((current == "other") & has("action"), "action")
        .when((current == "population") & has("onset"), "follow_up")
        .otherwise(current)
    )


def refine_strength(statement: Column, current: Column, fact_type: Column, low: Column | None = None) -> Column:
    s = F.lower(statement) if low is None else low
    has = lambda rule: any_of(s, STRENGTH_CUES[rule])
    return (
        F.when(has("must"), "must")
        .when(has("should"), "should")
        .when(has("option"), F.when(has("weighing"), "consider").otherwise("may"))
        .when(fact_type.isin("exclusion", "contraindication"), "must")
        .when(current == "must", "unclear")
        .otherwise(current)
    )


def needs_review(strength: Column, current: Column) -> Column:
    return strength.isin("may", "consider", "unclear") | current


def strength_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STRENGTHS)), c)


def parse_condition(c: Column) -> Column:
    """struct(input_id, expected) of ``inNNN == true|false``, else null."""
    pattern = rf"(?i)^{SPACE}*(in[0-9]+){SPACE}*=={SPACE}*(true|false){SPACE}*$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("input_id"), (F.lower(F.regexp_extract(c, pattern, 2)) == "true").alias("expected")))


def gate_title(name: Column, place: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(any_of(n, ("population", "eligible")), "Eligibility")
        .when(any_of(n, ("exclusion", "contra")), "Exclusions / Contraindications")
        .when(any_of(n, ("red", "flag", "urgent")), "Red Flags / Escalation")
        .otherwise(F.concat(F.lit("Gate "), place.cast("string")))
    )


def markdown_escape(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\n"), F.lit(" ")))


def format_citation(chunk_id: Column, start: Column, end: Column) -> Column:
    mark = lambda c, none: F.coalesce(c.cast("string"), F.lit(none))
    return F.concat(F.lit("`"), mark(chunk_id, "c????"), F.lit(":"), mark(start, "?"), F.lit("-"), mark(end, "?"), F.lit("`"))


def numbered_id(prefix: str, n: Column) -> Column:
    """f0001, f0002 ...; wider than four digits where needed."""
    return F.format_string(prefix + "%04d", n)


def join_warnings(*lists: Column) -> Column:
    """Warnings of one step after another; a step without any (null) adds none."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(x, none) for x in lists])


def merge_meta(base: Column, more: Column) -> Column:
    """One level of two maps as one: a key of ``more`` takes the place of the same key of ``base``."""
    return F.when(base.isNull(), more).when(more.isNull(), base).otherwise(F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more))
