"""Rule classifiers as ordered ``when`` chains over lower-cased text.

Patterns are written in the subset Java and RE2 share, except the explicit
boundaries: the reference's ``\\b`` is ASCII-only, so ASCII words get an explicit
ASCII edge, and the Polish word 'staż' gets a Unicode left edge only (a superset of
the original, see README "decisions")."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.common import col_of

A_L, A_R = "(?<![a-z0-9_])", "(?![a-z0-9_])"   # ASCII word edges
U_L = r"(?<![\p{L}\p{N}_])"                      # Unicode left edge


def w(word: str) -> str:
    return f"{A_L}{word}{A_R}"


# Contract classifier rules, first match wins (pattern, label).
CONTRACT_RULES = [
    ("umowa o prac", "umowa o pracę"),
    (f"{w('b2b')}|kontrakt b2b", "B2B"),
    ("umowa zlecen", "umowa zlecenie"),
    ("umowa o dzieł", "umowa o dzieło"),
    ("kontrakt", "kontrakt"),
    (f"{U_L}staż|praktyk", "staż"),
]

# Seniority classifier rules, first match wins (pattern, label).
SENIORITY_RULES = [
    (f"{w('senior')}|starszy", "senior"),
    (f"{w('lead')}|team lead|kierownik|menedżer|{w('manager')}", "lead"),
    (f"{w('mid')}|{w('regular')}", "mid"),
    (f"{w('junior')}|młodszy", "junior"),
    (f"{w('intern')}|praktykant|{U_L}staż|praktyk", "intern"),
]

# Internship title pattern (entry-level filter without an experience filter).
ENTRY_LEVEL_RE = f"sta[zż]yst|staż|staz{A_R}|praktyk|intern|trainee"

# Label keyword sets used to pick contract / experience labels.
CONTRACT_LABEL_RE = "umowa|kontrakt|b2b|zlecen|o prac|dzie[łl]o"
EXPERIENCE_LABEL_RE = "junior|mid|senior|praktykant|sta[żz]|asystent|specjalista|ekspert|mened|kierownik|dyrektor"


def classify(text, rules) -> Column:
    """First rule whose pattern matches the lower-cased text; null if none or text empty."""
    low = F.lower(col_of(text))
    out = None
    for pat, label in rules:
        out = (F.when(low.rlike(pat), F.lit(label)) if out is None else out.when(low.rlike(pat), F.lit(label)))
    return F.when(F.coalesce(col_of(text), F.lit("")) != "", out)


def contract_type(text) -> Column:
    return classify(text, CONTRACT_RULES)


def seniority(text) -> Column:
    return classify(text, SENIORITY_RULES)


def entry_level(title, experience=None, exp_filter: str | None = None) -> Column:
    """Experience equality (upper-cased) when a filter is given, else the internship title pattern."""
    if exp_filter:
        return F.upper(F.coalesce(col_of(experience), F.lit(""))) == F.lit(exp_filter.upper())
    return F.lower(F.coalesce(col_of(title), F.lit(""))).rlike(ENTRY_LEVEL_RE)


def pick_label(labels, pattern: str) -> Column:
    """First array element matching ``pattern`` (case-insensitive); null if none."""
    return F.get(F.filter(col_of(labels), lambda x: F.lower(x).rlike(pattern)), 0)


def keep_labels(labels, max_len: int = 59) -> Column:
    """Card labels of 1..max_len characters."""
    return F.filter(col_of(labels), lambda x: (F.length(x) >= 1) & (F.length(x) <= max_len))


def infer_remote(rule: str, *texts) -> Column:
    """Remote flag rules:
    * ``any``      'zdaln|remote' in the joined texts → true/false
    * ``only_true`` same pattern → true, otherwise null
    * ``word``     'zdaln|praca zdalna|remote'(ASCII word) → true/false
    * ``labels``   joined labels: 'zdaln' → true, 'stacjonarn' → false, else null
    """
    if rule == "labels":
        joined = F.lower(F.array_join(texts[0], " | "))
        return F.when(joined.rlike("zdaln"), F.lit(True)).when(joined.rlike("stacjonarn"), F.lit(False))
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(col_of(t), F.lit("")) for t in texts]))
    if rule == "any":
        return joined.rlike("zdaln|remote")
    if rule == "only_true":
        return F.when(joined.rlike("zdaln|remote"), F.lit(True))
    if rule == "word":
        return joined.rlike(f"zdaln|praca zdalna|{w('remote')}")
    raise ValueError(f"unknown remote rule {rule!r}")


# Block-signal needles (detail bodies) and the extended list-page set.
BLOCK_NEEDLES = ["captcha", "just a moment", "cf-chl", "datadome", "access denied", "attention required"]
BLOCK_NEEDLES_EXTENDED = BLOCK_NEEDLES + ["cloudflare", "verifying you are human", "verify you are human",
                                          "unusual traffic"]


def block_flag(body, status, needles=None, has_content=None) -> Column:
    """True when the status is 403/429 or a needle appears anywhere in the body.  With
    ``has_content`` the needles are only searched when the expected structured content is
    missing (a real offer page may mention 'captcha' in a script)."""
    from jobtide.functions.literals import let
    low = F.lower(F.coalesce(col_of(body), F.lit("")))
    needle = let(low, lambda t: reduce(Column.__or__, [t.contains(n) for n in needles or BLOCK_NEEDLES]))
    if has_content is not None:
        needle = ~F.coalesce(has_content, F.lit(False)) & needle
    return F.coalesce(col_of(status).isin(403, 429), F.lit(False)) | needle


def block_mark(body, needles=None) -> Column:
    """The first needle (in list order) that the body holds; null if none."""
    from jobtide.functions.literals import let
    low = F.lower(F.coalesce(col_of(body), F.lit("")))
    return let(low, lambda t: F.coalesce(*[F.when(t.contains(n), F.lit(n)) for n in needles or BLOCK_NEEDLES]))


def detail_has_content(body, source: str) -> Column:
    """Structured content whose presence disables the needle scan (per source):
    justjoin any JSON-LD block, rocketjobs a parsed JobPosting (at the top of a block or in its array),
    talentdays a JSON body, olx a JSON body with ``data``; nofluffjobs a JSON body (the original always scans)."""
    from jobtide.functions.html import first_job_posting, jsonld_blocks
    b = col_of(body)
    if source == "justjoin":
        return F.size(jsonld_blocks(b)) > 0
    if source == "rocketjobs":
        return first_job_posting(b).isNotNull()
    if source in ("talentdays", "nofluffjobs"):
        return F.try_parse_json(b).isNotNull()
    if source == "olx":
        return F.try_variant_get(F.try_parse_json(b), "$.data", "variant").isNotNull()
    return F.lit(False)


def detail_malformed(body, source: str) -> Column:
    """Content that is there but can't be read: justjoin's first JSON-LD block is no JSON."""
    from jobtide.functions.html import jsonld_blocks
    if source != "justjoin":
        return F.lit(False)
    first = F.get(jsonld_blocks(col_of(body)), 0)
    return F.coalesce(first.isNotNull() & F.try_parse_json(first).isNull(), F.lit(False))
