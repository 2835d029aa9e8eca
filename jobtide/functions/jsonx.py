"""VARIANT helpers for loosely-typed JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.common import col_of, js_trim
from jobtide.functions.html import strip_fragment
from jobtide.functions.literals import let


def list_values(v) -> Column:
    """Array, or {items: [...]}; elements are strings or objects carrying
    ``value`` / ``name`` / ``code`` (first present wins) → trimmed non-empty strings."""
    x = col_of(v)
    arr = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.try_variant_get(x, "$.items", "array<variant>"),
                     F.array().cast("array<variant>"))

    def one(el):
        # One typed read of an object's members; expressions in a lambda are computed anew at each use, hence the lets.
        text = let(F.try_variant_get(el, "$", "struct<value:string,name:string,code:string>"), lambda o: F.when(
            o.isNotNull(), F.coalesce(o["value"], o["name"], o["code"])).when(
            F.schema_of_variant(el) == "STRING", F.try_variant_get(el, "$", "string")))
        return let(F.coalesce(text, F.lit("")), lambda s: js_trim(strip_fragment(s, noise_stripped=True)))

    return F.filter(F.transform(arr, one), lambda s: s != "")


SKILL_LIST = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("level", T.LongType())]))


def embedded_skill_list(payload, key: str) -> Column:
    """I13 input: the escaped JSON list ``\\"<key>\\":[...]`` inside a page payload →
    array<struct<name, level>> (null when absent)."""
    start = '\\"' + key + '\\":['
    pat = r'\\"' + key + r'\\":\[([^\]]*)\]'

    def read(inner):
        fixed = F.replace(inner, F.lit('\\"'), F.lit('"'))
        return F.when(inner != "", F.from_json(F.concat(F.lit("["), fixed, F.lit("]")), SKILL_LIST))

    # The pattern is tried only on a payload that has its start.
    return F.when(col_of(payload).contains(start), let(F.regexp_extract(col_of(payload), pat, 1), read))
