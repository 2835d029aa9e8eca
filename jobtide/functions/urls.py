"""URL column expressions: dedup key, identity key, absolute URLs, query ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.common import col_of, rx


def url_key(url) -> Column:
    """Normalised URL key: cut at the first '?', drop trailing slashes, lower-case.

    A '#fragment' is kept and a null URL becomes ''.
    """
    u = F.coalesce(col_of(url).cast("string"), F.lit(""))
    return F.lower(F.regexp_replace(F.split_part(u, F.lit("?"), F.lit(1)), rx("/+$"), F.lit("")))


INDEED_JK = r"[?&]jk=([0-9a-fA-F]+)"


def query_id(url, name: str = "jk") -> Column:
    """Id carried in a query parameter (e.g. ``jk``), hex digits only; null if absent."""
    v = F.regexp_extract(F.coalesce(col_of(url), F.lit("")), rf"[?&]{name}=([0-9a-fA-F]+)", 1)
    return F.nullif(v, F.lit(""))


def identity_key(url, source) -> Column:
    """Run-dedup identity: the url key, plus ``?jk=<id>`` for sources whose id lives in the query."""
    key = url_key(url)
    jk = query_id(url, "jk")
    return F.when((col_of(source) == "indeed") & jk.isNotNull() & (key != ""),
                  F.concat(key, F.lit("?jk="), F.lower(jk))).otherwise(key)


def abs_url(href, base: str, relative_prefix: str | None = None) -> Column:
    """Absolutise a link: keep http(s) URLs, prefix '/'-paths with ``base``; other
    values get ``relative_prefix`` (e.g. a slug → job URL) when given, else ``base + '/'``."""
    h = F.trim(col_of(href))
    rel = F.lit(relative_prefix) if relative_prefix is not None else F.lit(base.rstrip("/") + "/")
    return (F.when(h.isNull() | (h == ""), F.lit(None).cast("string"))
            .when(h.rlike(r"(?i)^https?://"), h)
            .when(h.startswith("/"), F.concat(F.lit(base.rstrip("/")), h))
            .otherwise(F.concat(rel, h)))


def slug_from_url(url, marker: str = "/job/") -> Column:
    """Path segment after ``marker`` (up to '/', '?' or '#'), lower-cased; '' if none."""
    pat = "(?i)" + marker.replace("/", r"\/") + r"([^/?#]+)"
    return F.lower(F.regexp_extract(F.coalesce(col_of(url), F.lit("")), pat, 1))


def ad_id_from_url(url, min_digits: int = 6) -> Column:
    """Numeric ad id with at least ``min_digits`` digits taken from the URL; null if none."""
    v = F.regexp_extract(F.coalesce(col_of(url), F.lit("")), rf"(\d{{{min_digits},}})", 1)
    return F.nullif(v, F.lit(""))
