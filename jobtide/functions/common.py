"""Small helpers shared by the column-expression modules."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(pattern: str) -> Column:
    """Regex patterns always travel as literals (no SQL-string escaping)."""
    return F.lit(pattern)


def blank_to_null(c) -> Column:
    """JS ``x || null`` for text: '' (and null) → null."""
    return F.nullif(col_of(c), F.lit(""))


WS_CHARS = " \t\n\x0b\f\r\u00a0\u202f\ufeff"


def js_trim(c) -> Column:
    """Trim every kind of leading/trailing whitespace (``F.trim`` only removes spaces).  Only the ends are looked at."""
    return F.btrim(col_of(c), F.lit(WS_CHARS))


def trimmed_or_null(c) -> Column:
    return F.nullif(js_trim(c), F.lit(""))


def first_nonblank(*cols) -> Column:
    """First candidate whose trimmed value is non-empty."""
    return F.coalesce(*[trimmed_or_null(c) for c in cols])


NBSP_CHARS = "\u00a0\u202f"


def normalize_spaces(c) -> Column:
    """No-break and narrow no-break spaces → plain space (Java ``\\s`` ignores them)."""
    return F.translate(col_of(c), NBSP_CHARS, "  ")


def _fold_table() -> tuple[str, str]:
    """Accent-folding table built by rule: every Latin letter in U+00C0..U+024F and
    U+1E00..U+1EFF whose canonical decomposition is one base letter plus combining
    marks maps to that base letter.  Stroke letters that do not decompose (ł, Ł) are
    added explicitly because the reference maps them too."""
    src, dst = [], []
    for cp in list(range(0x00C0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(cp)
        dec = unicodedata.normalize("NFD", ch)
        base = "".join(x for x in dec if not (0x0300 <= ord(x) <= 0x036F))
        if len(dec) > 1 and len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    src += ["ł", "Ł"]
    dst += ["l", "L"]
    return "".join(src), "".join(dst)


FOLD_SRC, FOLD_DST = _fold_table()


def fold_accents(c) -> Column:
    """Strip diacritics (NFD + drop combining marks) for Latin text, ł → l."""
    # Combining marks that arrive already decomposed are removed as well.
    return F.regexp_replace(F.translate(col_of(c), FOLD_SRC, FOLD_DST), rx(r"[\u0300-\u036f]"), F.lit(""))
