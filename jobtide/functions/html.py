"""HTML → plain text without a DOM, as native regex column expressions.

A parsed-but-unrendered document's ``textContent`` is: body text with tags removed
(no separator added), comments dropped, entities decoded.  Script and style bodies
and the ``<head>`` are removed as well (the re-aim documented in the README)."""

from __future__ import annotations

import string
import zlib
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.common import WS_CHARS, col_of, js_trim, rx
from jobtide.functions.literals import let

# The standard's character names, from Python's library: those that end in ';' and the older ones
# that also count without it.
_NAMES = {f"&{name}": ch for name, ch in entities.html5.items()}


def _name_table(parts: int) -> str:
    """The names and their characters, cut into parts by the names' hash: a literal of few objects, since every task reads it."""
    table = ["\x02"] * parts
    for name, ch in _NAMES.items():
        table[zlib.crc32(name.encode()) % parts] += f"{name}\x03{ch}\x02"
    return "\x01".join(table)


_NAME_PARTS = 128
_NAME_TABLE = _name_table(_NAME_PARTS)
_OLD_NAMES = sorted((n for n in entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
NUMERIC_ENTITY = r"&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?"
ENTITY = rf"&[a-zA-Z][a-zA-Z0-9]{{1,31}};|&(?:{'|'.join(_OLD_NAMES)})|{NUMERIC_ENTITY}"
_ENTITY_START = [*string.ascii_letters, "#"]
ENTITY_CHARS = 33       # an entity's characters after the '&', at most
# Numeric references to 128–159 mean the characters Windows-1252 has there.
_C1 = {chr(i): bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}


def _decode_numeric_token(t: Column) -> Column:
    hexv = F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+);?$", 1)
    decv = F.regexp_extract(t, "^&#([0-9]+);?$", 1)
    cp = F.when(hexv != "", F.conv(hexv, 16, 10).cast("bigint")).when(decv != "", decv.cast("bigint"))
    ok = cp.isNotNull() & (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    ch = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    known = [(c, to) for c, to in _C1.items() if to]
    return F.when(ok, F.translate(ch, "".join(c for c, _ in known), "".join(to for _, to in known))).otherwise(t)


def decode_entities(c) -> Column:
    """Decode named and numeric entities in a single pass over the text's tokens, each exactly
    once, like a parser (so '&amp;lt;' becomes '&lt;').  Text without '&' is returned
    unchanged; a text is cut at its '&', and only the characters an entity can have are matched."""
    table = F.split(F.lit(_NAME_TABLE), "\x01", -1)      # folded to one constant

    def named(t):
        key = F.concat(F.lit("\x02"), t, F.lit("\x03"))
        return let(F.get(table, (F.crc32(F.encode(t, "UTF-8")) % F.lit(_NAME_PARTS)).cast("int")), lambda names: F.when(
            names.contains(key), F.substring_index(F.call_function("substring_index", names, key, F.lit(-1)), "\x02", 1)))

    def piece(p):
        start = F.concat(F.lit("&"), F.substring(p, 1, ENTITY_CHARS))
        return let(F.regexp_extract(start, f"^(?:{ENTITY})", 0), lambda t: F.when(t == "", F.concat(F.lit("&"), p)).otherwise(
            F.concat(F.coalesce(named(t), _decode_numeric_token(t)), F.substr(p, F.length(t)))))

    def decoded(x):
        return F.array_join(F.transform(F.split(x, "&", -1), lambda p, i: F.when(i == 0, p).when(
            F.substring(p, 1, 1).isin(_ENTITY_START), piece(p)).otherwise(F.concat(F.lit("&"), p))), "")

    # Bound once: the text is itself a chain of replacements, which each use would run again.
    return let(col_of(c), lambda x: F.when(x.contains("&"), decoded(x)).otherwise(x))


# A parser opens a tag only before a letter, '/', '!' or '?'; any other '<' is text.
TAG_RE = "<[a-zA-Z/!?][^>]*>"


def strip_noise(c, drop_head: bool = True) -> Column:
    """Remove the parts a body's textContent never shows here: the head, script and style
    bodies and comments.  Doing this first is order-independent with the profiles' tag
    rules, and lets all profiles share one evaluation (subexpression elimination)."""
    x = col_of(c)
    if drop_head:
        x = F.regexp_replace(x, rx(r"(?is)<head\b.*?</head>"), F.lit(""))
    return F.regexp_replace(x, rx(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"), F.lit(""))


def dom_text(c, drop_head: bool = True, noise_stripped: bool = False) -> Column:
    """textContent of the document body."""
    x = col_of(c) if noise_stripped else strip_noise(c, drop_head)
    x = F.regexp_replace(x, rx(TAG_RE), F.lit(""))
    return decode_entities(x)


def _sub(x: Column, pat: str, rep: str) -> Column:
    return F.regexp_replace(x, rx(pat), F.lit(rep))


def _sub_if(x: Column, has: Sequence[str], pat: str, rep: str) -> Column:
    """``_sub`` for a pattern that changes nothing in a text without any of the strings ``has``; finding those takes a
    tenth of the pattern's time."""
    return let(x, lambda y: F.when(reduce(Column.__or__, [y.contains(h) for h in has]), _sub(y, pat, rep)).otherwise(y))


def _without(x: Column, char: str, rep: str = "") -> Column:
    return let(x, lambda y: F.when(y.contains(char), F.replace(y, F.lit(char), F.lit(rep))).otherwise(y))


def blank_lines(x: Column) -> Column:
    return _sub_if(x, ["\n\n\n"], r"\n{3,}", "\n\n")


def _line_ends(x: Column) -> Column:
    return _sub_if(x, [" \n", "\t\n"], r"[ \t]+\n", "\n")


def trim_text(x: Column) -> Column:
    """``js_trim`` for texts that mostly need none: their ends are looked at first."""
    return let(x, lambda y: F.when(reduce(Column.__or__, [side(F.lit(w)) for w in WS_CHARS for side in (y.startswith, y.endswith)]),
                                   js_trim(y)).otherwise(y))


_TAG_START = [*string.ascii_letters, "/", "!", "?"]      # what TAG_RE has after '<'
_NOISE_TAGS = ["head", "script", "style", "!--"]


def _by_tags(html: Column, mark: Callable[[Column], Column], other: Callable[[Column], Column],
             special: Callable[[Column], Column] | None = None) -> Column:
    """The text with each tag replaced by ``mark`` (of what stands between '<' and '>'), cut at its '<' in one pass.

    A text goes through ``other``, a chain of patterns with the same result, if a tag in it may begin noise (``strip_noise``),
    is ``special`` (as above) or holds another '<' before its '>'."""
    def is_tag(s):
        return F.substring(s, 1, 1).isin(_TAG_START)

    def odd(s):
        start = F.lower(F.substring(s, 1, 6))
        found = reduce(Column.__or__, [start.startswith(t) for t in _NOISE_TAGS], ~s.contains(">"))
        return is_tag(s) & (found | special(s) if special else found)

    def piece(s):
        return let(F.substring_index(s, ">", 1), lambda t: F.concat(mark(t), F.substr(s, F.length(t) + 2)))

    def joined(parts):
        return F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s).when(is_tag(s), piece(s))
                                        .otherwise(F.concat(F.lit("<"), s))), "")

    return let(html, lambda x: let(F.split(x, "<", -1), lambda parts: F.when(
        F.exists(F.slice(parts, 2, F.size(parts)), odd), other(x)).otherwise(joined(parts))))


def _marks(br: str | None = None, li: str | None = None, closed: Mapping[str, str] | None = None) -> Callable[[Column], Column]:
    """What stands for <br>, <li…> and the end tags (names apart by '|' → text); '' for other tags."""
    def mark(t):
        low, out = F.lower(t), F.when(F.lit(False), F.lit(""))
        for names, text in (closed or {}).items():
            out = out.when(low.isin([f"/{n}" for n in names.split("|")]), F.lit(text))
        if li is not None:
            out = out.when(F.lower(F.substring(t, 1, 2)) == "li", F.lit(li))
        if br is not None:
            out = out.when(low.startswith("br") & low.rlike(r"^br\s*/?\z"), F.lit(br))
        return out.otherwise(F.lit(""))
    return mark


def _heading_caps(x: Column) -> Column:
    """<hN>t</hN> → blank line + UPPER(t without tags/trailing ':') + ':' + newline."""
    head_re = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"

    def fmt(h):
        t = js_trim(_sub(_sub(h, TAG_RE, " "), r"\s+", " "))
        t = _sub(t, r"[:\s]+$", "")
        return F.concat(F.lit("\n\n"), F.upper(t), F.lit(":\n"))

    def capped(y):
        heads = F.regexp_extract_all(y, rx(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
        return let(heads, lambda hs: F.array_join(F.transform(F.split(y, head_re, -1), lambda p, i: F.concat(
            p, F.coalesce(fmt(F.get(hs, i)), F.lit("")))), ""))

    return let(x, lambda y: F.when(y.rlike(head_re), capped(y)).otherwise(y))


def strip_fragment(c, noise_stripped: bool = False) -> Column:
    """Light strip for structured fields: plain text is only trimmed; text with '<' or '&'
    gets line breaks for <br> and block closes, then tags and entities are resolved."""
    def stripped(x):
        h = _sub(_sub(x, r"(?i)<br\s*/?>", "\n"), r"(?i)</(p|li|div|h[1-6]|tr|ul|ol|section)>", "\n")
        return F.when(x.contains("<") | x.contains("&"), js_trim(dom_text(h, noise_stripped=noise_stripped))).otherwise(js_trim(x))

    return let(col_of(c), stripped)


PROFILES = ("justjoin", "rocketjobs", "nofluffjobs", "talentdays", "olx")


def html_to_text(c, profile: str) -> Column:
    """Plain text of an HTML fragment under one of the five source profiles; blank → null."""
    x = col_of(c)
    if profile == "justjoin":
        t = decode_entities(_by_tags(x, _marks(), lambda y: _sub(strip_noise(y), TAG_RE, "")))
        t = trim_text(blank_lines(_without(t, "\r")))
    elif profile == "rocketjobs":
        ends = "p|div|li|ul|ol|tr|table|section"

        def other(y):
            h = _sub(_heading_caps(strip_noise(y)), r"(?i)<br\s*/?>", "\n")
            h = _sub(h, r"(?i)<li[^>]*>", "\n- ")
            return _sub(_sub(h, rf"(?i)</({ends})>", "\n"), TAG_RE, "")
        t = decode_entities(_by_tags(x, _marks("\n", "\n- ", {ends: "\n"}), other,
                                     lambda s: F.lower(F.substring(s, 1, 2)).isin([f"h{i}" for i in range(1, 7)])))
        t = _sub_if(_without(t, "\u00a0", " "), ["  ", "\t"], r"[ \t]+", " ")
        t = trim_text(blank_lines(_sub_if(t, [" \n", "\n "], r" *\n *", "\n")))
    elif profile == "nofluffjobs":
        ends = "p|li|div|h1|h2|h3|h4|h5|h6|tr|ul|ol|section"

        def other(y):
            return _sub(_sub(_sub(strip_noise(y), r"(?i)<br\s*/?>", "\n"), rf"(?i)</({ends})>", "\n"), TAG_RE, "")
        t = trim_text(decode_entities(_by_tags(x, _marks("\n", None, {ends: "\n"}), other)))
        t = trim_text(blank_lines(_line_ends(_without(t, "\r"))))
    elif profile == "talentdays":
        rows, blocks = "li|tr", "p|div|section|article|ul|ol|table|h1|h2|h3|h4|h5|h6"

        def other(y):
            h = _sub(strip_noise(y), r"(?i)<br\s*/?>", "\n")
            h = _sub(h, r"(?i)<li[^>]*>", "- ")
            return _sub(_sub(_sub(h, rf"(?i)</({rows})>", "\n"), rf"(?i)</({blocks})>", "\n\n"), TAG_RE, "")
        t = decode_entities(_by_tags(x, _marks("\n", "- ", {rows: "\n", blocks: "\n\n"}), other))
        t = trim_text(blank_lines(_line_ends(_without(_without(t, "\u00a0", " "), "\r"))))
    elif profile == "olx":
        ends = "p|li|div|h1|h2|h3|h4|h5|h6|ul|ol|tr"

        def other(y):
            h = _sub(_sub(strip_noise(y), r"(?i)<br\s*/?>", "\n"), rf"(?i)</({ends})>", "\n")
            return _sub(_sub(h, r"(?i)<li[^>]*>", "- "), TAG_RE, "")
        t = decode_entities(_by_tags(x, _marks("\n", "- ", {ends: "\n"}), other))
        t = trim_text(blank_lines(_line_ends(_without(t, "\r"))))
    else:
        raise ValueError(f"unknown html profile {profile!r}")
    return let(t, lambda y: F.when(y != "", y))


JSONLD_RE = r'''(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>((?:[^<]++|<(?!/script>))*+)</script>'''


def jsonld_blocks(html) -> Column:
    """Raw JSON-LD script bodies in document order."""
    return F.regexp_extract_all(col_of(html), rx(JSONLD_RE), F.lit(1))


def first_job_posting(html) -> Column:
    """The first JSON-LD object with ``@type`` JobPosting, at the top of a block or in its array, as VARIANT."""
    def objects(b):
        return let(F.try_parse_json(b), lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    every = F.flatten(F.transform(jsonld_blocks(html), objects))
    return F.get(F.filter(every, lambda x: F.try_variant_get(x, "$['@type']", "string") == F.lit("JobPosting")), 0)
