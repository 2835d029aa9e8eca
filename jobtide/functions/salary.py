"""Salary text → (salary_from, salary_to, salary_currency), four card dialects,
plus the tracker's salary display text.  Pure column expressions: the number
tokens are extracted with ``regexp_extract_all`` and converted with ``try_cast``
(ANSI casts would raise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.common import col_of, normalize_spaces, rx

DIALECTS = ("olx", "indeed", "pracuj", "theprotocol")


def _nums(text: Column, token_re: str, strip_re: str, comma_to_dot: bool = False) -> Column:
    toks = F.regexp_extract_all(text, rx(token_re), F.lit(0))

    def conv(t):
        t = F.regexp_replace(t, rx(strip_re), F.lit("")) if strip_re else t
        if comma_to_dot:
            t = F.regexp_replace(t, rx(","), F.lit("."))
        return F.try_cast(t, "double") if hasattr(F, "try_cast") else t.try_cast("double")

    return F.transform(toks, conv)


def _currency(t: Column, with_usd: bool, loose_zl: bool) -> Column:
    low = F.lower(t)
    zl = "z[łl]|pln" if loose_zl else "zł|pln"
    c = F.when(low.rlike(zl), F.lit("PLN")).when(low.rlike("eur|€"), F.lit("EUR"))
    if with_usd:
        c = c.when(low.rlike(r"\$|usd"), F.lit("USD"))
    return c


def _ascii_word(word: str) -> str:
    # The reference's word boundary is ASCII-only; spell it out so Java's Unicode
    # boundary does not change the result next to Polish letters.
    return rf"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"


def parse_salary(text, dialect: str) -> Column:
    """Struct<salary_from double, salary_to double, salary_currency string>."""
    raw = col_of(text)
    t = normalize_spaces(raw)
    if dialect == "olx":
        squeezed = F.regexp_replace(t, rx(r"\s(?=\d)"), F.lit(""))
        nums = F.filter(_nums(squeezed, r"\d+(?:[.,]\d+)?", "", comma_to_dot=True), lambda n: n.isNotNull())
        has = F.size(nums) > 0
        frm, to = F.when(has, F.get(nums, 0)), F.when(has, F.get(nums, 1))
        cur = F.when(has, _currency(t, with_usd=False, loose_zl=False))
    elif dialect == "indeed":
        ok = F.lower(t).rlike("zł|pln")
        nums = F.filter(_nums(t, r"\d[\d .]*\d|\d+", "[ .]"), lambda n: n.isNotNull() & (n >= 100))
        n = F.size(nums)
        only_to = t.rlike(_ascii_word("do")) & ~t.rlike(_ascii_word("od"))
        frm = F.when(ok & (n >= 2), F.get(nums, 0)).when(ok & (n == 1) & ~only_to, F.get(nums, 0))
        to = F.when(ok & (n >= 2), F.get(nums, 1)).when(ok & (n == 1) & only_to, F.get(nums, 0))
        cur = F.when(frm.isNotNull() | to.isNotNull(), F.lit("PLN"))
    elif dialect == "pracuj":
        nums = F.filter(_nums(t, r"\d[\d\s.]*\d|\d", r"[\s.]"), lambda n: n.isNotNull() & (n >= 10))
        frm, to = F.get(nums, 0), F.get(nums, 1)
        cur = _currency(t, with_usd=True, loose_zl=True)
    elif dialect == "theprotocol":
        s = F.regexp_replace(t, rx(r"\s"), F.lit(" "))
        nums = F.filter(_nums(s, r"\d[\d ]*\d|\d", " "), lambda n: n.isNotNull())
        frm, to = F.get(nums, 0), F.get(nums, 1)
        cur = _currency(s, with_usd=True, loose_zl=False)
    else:
        raise ValueError(f"unknown salary dialect {dialect!r}")
    nul = raw.isNull() | (raw == "")
    return F.struct(
        F.when(~nul, frm).cast("double").alias("salary_from"),
        F.when(~nul, to).cast("double").alias("salary_to"),
        F.when(~nul, cur).alias("salary_currency"),
    )


def _num_text(x: Column) -> Column:
    # JS prints integral doubles without '.0'; Spark's cast prints '4500.0'.
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string"))
            .otherwise(x.cast("string")))


def salary_text(salary_from, salary_to, salary_currency, salary_raw=None) -> Column:
    """Tracker salary: non-null bounds joined by an en dash, then ' ' + currency; else the
    raw salary text if any, else ''."""
    f, t, c = col_of(salary_from), col_of(salary_to), col_of(salary_currency)
    bounds = F.concat_ws("–", _num_text(f), _num_text(t))
    with_cur = F.concat(bounds, F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" "), c)).otherwise(F.lit("")))
    fallback = F.coalesce(col_of(salary_raw), F.lit("")) if salary_raw is not None else F.lit("")
    return F.when(f.isNotNull() | t.isNotNull(), with_cur).otherwise(fallback)
