"""HTML as a parser's tokenizer reads it, with native column expressions.

``tokens`` cuts a text into comments, elements whose content is raw text (with that content), tags and text, so
that what stands in a comment or a script is never taken for markup, and a ``>`` inside a quoted value doesn't end
a tag.  ``attribute`` reads one attribute of a tag: double-quoted, single-quoted, bare or without value; of repeated
attributes the first counts; names compare without case and whole (``data-href`` is not ``href``).

``links`` writes the tokens anew with one control character for each kind of mark, so that anchors and headings inside
them can be cut out by a plain pattern in one more pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.common import col_of, js_trim, rx
from jobtide.functions.html import decode_entities

_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+"""
_INSIDE = rf"(?:[\s/=]++|{_ATTRIBUTE})*+"
# Elements whose content is text to a parser (a template's content is no part of the document).
RAW_ELEMENTS = ["script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "template"]
TOKEN = "|".join([
    r"<!---?>|<!--.*?(?:--!?>|\z)",                                                     # comment
    rf"<({'|'.join(RAW_ELEMENTS)})(?=[\s/>]){_INSIDE}>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)",  # raw element
    rf"</?[a-z][^\s/>]*+{_INSIDE}>",                                                    # tag
    r"<[!?/][^>]*+(?:>|\z)",                                                            # declaration, stray end
    r"</?[a-z].*\z",                                                                    # a tag the text breaks off in
    "[^<]++|<"])


def tokens(html) -> Column:
    """array<string>: the whole text, cut into tokens."""
    return F.regexp_extract_all(col_of(html), rx(f"(?is){TOKEN}"), F.lit(0))


def tag_name(token: Column) -> Column:
    """Lower-case name of a start tag; '' for any other token."""
    return F.lower(F.regexp_extract(token, r"^<([a-zA-Z][^\s/>]*)", 1))


def attribute(token: Column, name: str) -> Column:
    """Value of the first attribute of that name in a start tag, entities decoded; '' if it has no value, null if
    there is none."""
    head = F.regexp_extract(token, rf"(?is)^<[a-z][^\s/>]*+({_INSIDE})>", 1)
    mine = F.get(F.filter(F.regexp_extract_all(head, rx(_ATTRIBUTE), F.lit(0)),
                          lambda a: a.rlike(rf"(?is)^{name}(?:\s*=|$)")), 0)
    raw = F.regexp_replace(mine, rx(r"(?s)^[^=]*=?\s*"), F.lit(""))
    quoted = raw.rlike("""^["']""")
    return decode_entities(F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))


def raw_elements(html, name: str) -> Column:
    """Tokens of the elements of that name (with raw content), in document order."""
    return F.filter(tokens(html), lambda t: tag_name(t) == name)


def raw_content(token: Column) -> Column:
    """Content of a raw element's token."""
    inner = F.regexp_replace(token, rx(rf"(?is)^<[a-z][^\s/>]*+{_INSIDE}>"), F.lit(""))
    return F.regexp_replace(inner, rx(r"(?is)</[a-z]+(?=[\s/>])[^>]*+>\z"), F.lit(""))


_LINK, _HREF, _HEAD, _CLOSE, _NAME = "\x01", "\x02", "\x03", "\x04", "\x05"
_MARKS = _LINK + _HREF + _HEAD + _CLOSE + _NAME


def links(html, heading_tags: Sequence[str] = (), heading_attribute: tuple[str, str] | None = None) -> Column:
    """array<struct<href, text, heading>> of every anchor with an href, in document order.

    ``heading`` is the text of the first heading inside the anchor (an element of ``heading_tags`` or one whose attribute
    holds the given text), null if there is none.  An anchor ends at its end tag or at the next anchor.
    """
    quiet = lambda text: F.translate(text, _MARKS, "")  # noqa: E731 - the marks are no text

    def marked(t):
        name = tag_name(t)
        heading = name.isin(list(heading_tags)) if heading_tags else F.lit(False)
        if heading_attribute:
            has = F.coalesce(attribute(t, heading_attribute[0]), F.lit("")).contains(heading_attribute[1])
            heading = heading | (F.lower(t).contains(heading_attribute[0]) & has)
        href = attribute(t, "href")
        closed = F.lower(F.regexp_extract(t, r"^</([a-zA-Z][^\s/>]*)", 1))
        raw = name.isin(RAW_ELEMENTS) | t.rlike("^<(?:[!?]|/[^a-zA-Z])")
        mark = lambda kind, *rest: F.concat(F.lit(kind), *rest)
        return F.when(~t.startswith("<") | (t == "<"), decode_entities(quiet(t))) \
            .when(raw, F.lit("")) \
            .when(name == "a", mark(_LINK, F.coalesce(quiet(href), F.lit(_CLOSE)), F.lit(_HREF))) \
            .when(heading, mark(_HEAD, name, F.lit(_NAME))) \
            .when(closed != "", mark(_CLOSE, closed, F.lit(_NAME))).otherwise(F.lit(""))

    flat = F.array_join(F.transform(tokens(html), marked), "")
    anchor = rf"{_LINK}([^{_HREF}]*){_HREF}((?:[^{_LINK}{_CLOSE}]++|{_CLOSE}(?!a{_NAME}))*+)"
    hrefs, inner = (F.regexp_extract_all(flat, rx(anchor), F.lit(k)) for k in (1, 2))
    plain = lambda t: js_trim(F.regexp_replace(t, rx(rf"[{_HEAD}{_CLOSE}][^{_NAME}]*{_NAME}"), F.lit("")))
    head = rf"(?s){_HEAD}([^{_NAME}]*){_NAME}(.*?)(?:{_CLOSE}\1{_NAME}|\z)"
    found = F.zip_with(hrefs, inner, lambda h, t: F.struct(
        h.alias("href"), plain(t).alias("text"),
        F.when(t.contains(_HEAD), plain(F.regexp_extract(t, head, 2))).alias("heading")))
    return F.filter(found, lambda x: x["href"] != _CLOSE)
