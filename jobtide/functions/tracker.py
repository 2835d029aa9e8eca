"""Tracker row expressions: place/form, source display name, 13-column projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.common import col_of
from jobtide.functions.salary import salary_text
from jobtide.schema import DEFAULT_CV_SENT, DEFAULT_STATUS, SOURCE_NAMES

HOME_CITY_NEEDLE = "wroc"           # fixed value: home-city match (lower-case substring)
HOME_CITY_LABEL = "Biuro - Wrocław"
OTHER_CITY_LABEL = "Biuro - poza Wrocławiem"


def place_form(remote, city, home_needle: str = HOME_CITY_NEEDLE, home_label: str = HOME_CITY_LABEL,
               other_label: str = OTHER_CITY_LABEL) -> Column:
    """remote=true → Zdalnie; city containing the home needle → home office; other
    non-empty city → office elsewhere; else Niejasne."""
    c = F.coalesce(col_of(city), F.lit(""))
    return (F.when(F.coalesce(col_of(remote), F.lit(False)), F.lit("Zdalnie"))
            .when(F.lower(c).contains(home_needle), F.lit(home_label))
            .when(c != "", F.lit(other_label))
            .otherwise(F.lit("Niejasne")))


def source_display(src) -> Column:
    """Display name of a source key; unknown keys show the key itself; null → ''."""
    m = F.create_map(*[x for k, v in SOURCE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    s = col_of(src)
    return F.coalesce(F.try_element_at(m, s), s, F.lit(""))


def to_tracker(df: DataFrame, id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """13 tracker columns (description excluded); B, K, L, M left empty.  The run's columns and ``keep`` stay."""
    src = F.coalesce(F.nullif(F.col("_src"), F.lit("")), F.col("source")) if "_src" in df.columns else F.col("source")
    raw_salary = F.col("salary") if "salary" in df.columns else None
    return df.select(
        *[c for c in ("run_tab", "run_id", *keep) if c in df.columns],
        F.col(id_col).cast("bigint").alias("id"),
        F.lit("").alias("applied_at"),
        F.coalesce(F.col("company"), F.lit("")).alias("company"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        source_display(src).alias("source_name"),
        salary_text("salary_from", "salary_to", "salary_currency", raw_salary).alias("salary"),
        place_form("remote", "city").alias("place_form"),
        F.lit(DEFAULT_CV_SENT).alias("cv_sent"),
        F.lit(DEFAULT_STATUS).alias("status"),
        F.lit("").alias("contact_at"),
        F.lit("").alias("duplicate"),
        F.lit("").alias("notes"),
    )
