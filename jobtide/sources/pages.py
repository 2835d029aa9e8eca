"""Saved HTML pages: link harvest (A9), JSON-LD extraction (A10), embedded JSON blobs (A11).  Links and
embedded scripts are read as a parser sees them (``functions.markup``); the html column is dropped before any shuffle
(pages are wide)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.common import js_trim
from jobtide.functions.html import jsonld_blocks
from jobtide.functions.markup import attribute, links, raw_content, raw_elements
from jobtide.functions.variant_search import find_postings

# Marker of an offer link and what makes a heading inside it, by source.
LINK_RULES = {"nofluffjobs": ("/job/", ("h3",), ("data-cy", "title")), "pracuj": (",oferta,", ("h2",), None)}


def harvest_links(pages: DataFrame, marker: str, id_cols: Sequence[str] = ("page_id",), html: str = "html",
                  heading_tags: Sequence[str] = (), heading_attribute: tuple[str, str] | None = None) -> DataFrame:
    """Anchors whose href contains ``marker``, distinct per page (first wins); ``text`` is the text of the
    first heading inside the anchor if it has any, else the anchor's."""
    every = F.transform(links(html, heading_tags, heading_attribute), lambda x, i: F.struct(
        i.alias("link_pos"), x["href"].alias("href"),
        F.coalesce(F.nullif(x["heading"], F.lit("")), x["text"]).alias("text")))
    a = pages.select(*id_cols, F.filter(every, lambda x: x["href"].contains(marker)).alias("a"))
    # All links of a page are in one row, so repeats are found inside the array, without a shuffle.
    a = a.select(*id_cols, "a", F.col("a.href").alias("h"))
    first = F.filter("a", lambda x, i: F.array_position(F.col("h"), x["href"]) == i + 1)
    a = a.select(*id_cols, F.explode(first).alias("x"))
    return a.select(*id_cols, "x.link_pos", "x.href", "x.text")


def harvest_offers(pages: DataFrame, source: str, id_cols: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """A9 by a source's own rule."""
    return harvest_links(pages, LINK_RULES[source][0], id_cols, html, *LINK_RULES[source][1:])


def jsonld(html="html", type_: str | None = None) -> Column:
    """A10 as a column: the first JSON-LD block (``type_`` None) or the first block / array
    element whose ``@type`` equals ``type_``, as VARIANT; null when none."""
    blocks = F.transform(jsonld_blocks(html), lambda b: F.try_parse_json(b))
    if type_ is None:
        return F.get(blocks, 0)

    def cands(b):
        is_arr = F.schema_of_variant(b).startswith("ARRAY")
        return F.when(is_arr, F.try_variant_get(b, "$", "array<variant>")).otherwise(F.array(b))
    flat = F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), cands))
    return F.get(F.filter(flat, lambda x: F.try_variant_get(x, "$['@type']", "string") == F.lit(type_)), 0)


def extract_jsonld(pages: DataFrame, type_: str | None = None, id_cols: Sequence[str] = ("page_id",),
                   html: str = "html") -> DataFrame:
    """A10: ids and ``ld`` of every page."""
    return pages.select(*id_cols, jsonld(html, type_).alias("ld"))


# Types of scripts that hold data.
DATA_TYPES = ["application/json", "application/ld+json"]


def ingest_embedded(pages: DataFrame, id_cols: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """Embedded JSON script blobs longer than 20 characters; the first blob (in page
    order) that yields postings wins; one row per posting."""
    data = F.filter(raw_elements(html, "script"), lambda t: F.lower(attribute(t, "type")).isin(DATA_TYPES))
    blobs = F.filter(F.transform(data, lambda t: js_trim(raw_content(t))), lambda b: F.length(b) > 20)
    first = F.get(F.filter(F.transform(blobs, find_postings), lambda a: F.size(a) > 0), 0)
    return pages.select(*id_cols, F.posexplode(first).alias("item_pos", "item"))
