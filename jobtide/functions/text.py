"""Text column expressions: slugs, city clean-up, place/date split, truncation,
section composition and list formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.common import col_of, fold_accents, js_trim, rx, trimmed_or_null
from jobtide.functions.html import blank_lines, trim_text
from jobtide.functions.literals import let


def slug(c, variant: str = "dash") -> Column:
    """Accent-folded slug, four variants used by the sources:

    * ``spaces``  fold, lower, trim, whitespace runs → '-'
    * ``dash``    fold, lower, trim, non-alphanumeric runs → '-', edge dashes removed
    * ``trim``    fold, trim, lower
    * ``fold``    fold, lower
    """
    v = fold_accents(F.coalesce(col_of(c), F.lit("")))
    if variant == "spaces":
        return F.regexp_replace(js_trim(F.lower(v)), rx(r"\s+"), F.lit("-"))
    if variant == "dash":
        d = F.regexp_replace(js_trim(F.lower(v)), rx("[^a-z0-9]+"), F.lit("-"))
        return F.regexp_replace(d, rx("^-+|-+$"), F.lit(""))
    if variant == "trim":
        return F.lower(js_trim(v))
    if variant == "fold":
        return F.lower(v)
    raise ValueError(f"unknown slug variant {variant!r}")


def clean_city(c, rule: str) -> Column:
    """City clean-up rules:
    * ``before_dash``  text before the first ' - ' (card "place - date" text)
    * ``postal``       strip a leading 'NN-NNN ' postal code
    * ``first_part``   first element of a ',' / newline split, else the whole trimmed text
    """
    x = col_of(c)
    if rule == "before_dash":
        return trimmed_or_null(F.substring_index(x, " - ", 1))
    if rule == "postal":
        return trimmed_or_null(F.regexp_replace(x, rx(r"^\d{2}-\d{3}\s*"), F.lit("")))
    if rule == "first_part":
        first = js_trim(F.get(F.split(x, r"[,\n]"), 0))
        return F.when(first != "", first).otherwise(trimmed_or_null(x))
    raise ValueError(f"unknown city rule {rule!r}")


def split_place_date(c) -> Column:
    """Date part of a 'place - date' text: everything after the first ' - ', trimmed; null without one."""
    return after_first(c, " - ")


def after_first(c, sep: str) -> Column:
    x = col_of(c)
    pos = F.locate(sep, x)
    return F.when(pos > 0, js_trim(x.substr(pos + len(sep), F.lit(1 << 30))))


def whole_text(c) -> Column:
    """The whole text; blank → null.  (The length limit of a spreadsheet cell has no
    counterpart here, so nothing is cut.)"""
    x = col_of(c)
    return F.when(F.length(js_trim(x)) > 0, x)


def bullet_list(arr) -> Column:
    """['a','b'] → '- a\\n- b' (null/empty → '')."""
    return F.array_join(F.transform(F.coalesce(col_of(arr), F.array().cast("array<string>")),
                                    lambda x: F.concat(F.lit("- "), x)), "\n")


def nonempty_array(arr) -> Column:
    a = col_of(arr)
    return F.when(a.isNotNull() & (F.size(a) > 0), a)


# Upper-case Polish section labels, in output order.
SECTION_LABELS = ["OPIS:", "WYMAGANIA:", "MILE WIDZIANE:", "OBOWIĄZKI:", "BENEFITY:"]


def compose_sections(description, musts, languages, nices, daily_tasks, responsibilities, benefits,
                     requirements_text=None) -> Column:
    """Join the non-empty sections with a blank line:

    OPIS (description), WYMAGANIA (requirement text, bullet list of musts, 'Języki: ' line),
    MILE WIDZIANE (bullets), OBOWIĄZKI (daily tasks if any, else responsibilities), BENEFITY (bullets).
    """
    desc = let(trim_text(col_of(description)), lambda d: F.when(d != "", d))
    req_parts = [trimmed_or_null(requirements_text)] if requirements_text is not None else []
    req_parts.append(F.when(F.size(F.coalesce(col_of(musts), F.array())) > 0, bullet_list(musts)))
    req_parts.append(F.when(F.size(F.coalesce(col_of(languages), F.array())) > 0,
                            F.concat(F.lit("Języki: "), F.array_join(col_of(languages), ", "))))
    req = F.nullif(F.concat_ws("\n", *req_parts), F.lit(""))
    nice = F.when(F.size(F.coalesce(col_of(nices), F.array())) > 0, bullet_list(nices))
    tasks_arr = F.when(F.size(F.coalesce(col_of(daily_tasks), F.array())) > 0, col_of(daily_tasks)) \
        .otherwise(col_of(responsibilities))
    tasks = F.when(F.size(F.coalesce(tasks_arr, F.array())) > 0, bullet_list(tasks_arr))
    ben = F.when(F.size(F.coalesce(col_of(benefits), F.array())) > 0, bullet_list(benefits))
    # A section without a body is null.
    parts = [F.concat(F.lit(label + "\n"), body) for label, body in zip(SECTION_LABELS, [desc, req, nice, tasks, ben])]
    return let(trim_text(blank_lines(F.concat_ws("\n\n", *parts))), lambda j: F.when(j != "", j))


def format_skills(skills) -> Column:
    """array<struct<name, level>> → ['name (level n)', 'name']; null when empty."""
    out = F.transform(
        F.filter(col_of(skills), lambda s: F.length(s["name"]) > 0),
        lambda s: F.when(s["level"].isNotNull(),
                         F.concat(s["name"], F.lit(" (level "), s["level"].cast("string"), F.lit(")")))
        .otherwise(s["name"]))
    return F.when(F.size(out) > 0, out)
