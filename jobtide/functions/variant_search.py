"""Search for an array of postings in a payload of unknown shape (A3), as one column expression.

The payload is walked in breadth: level by level, and in order within a level.  An object with an array under
``postings`` gives that array, whatever it holds; an array whose elements all are objects with a ``title`` and a
``name`` or ``url`` gives itself.  The first that qualifies ends the row's walk.  Members of one object are taken in
the order of their names, since VARIANT keeps no other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEEPEST = 1000      # the JSON parser's own limit on nesting

_ARRAY, _OBJECT = "array<variant>", "map<string,variant>"


def _has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()      # a null value is a variant, a missing key none


def _qualifying(node: Column) -> Column:
    """The postings this node gives; null if none."""
    items = F.try_variant_get(node, "$", _ARRAY)
    posting = lambda x: x.isNotNull() & _has(x, "title") & (_has(x, "name") | _has(x, "url"))
    return F.coalesce(F.try_variant_get(node, "$.postings", _ARRAY),
                      F.when((F.size(items) > 0) & F.forall(items, posting), items))


def _children(node: Column) -> Column:
    """Elements or members of this node; none of a scalar."""
    return F.coalesce(F.try_variant_get(node, "$", _ARRAY), F.map_values(F.try_variant_get(node, "$", _OBJECT)),
                      F.array().cast(_ARRAY))


def find_postings(payload: Column) -> Column:
    """array<variant> of the first node that qualifies; null if there is none or the text is no JSON."""
    root = F.try_parse_json(payload)
    # A level opens with at least one bracket, so their number bounds the depth; steps behind the end do nothing.
    opened = F.length(payload) - F.length(F.translate(payload, "{[", ""))
    start = F.struct(F.when(root.isNotNull(), F.array(root)).otherwise(F.array().cast(_ARRAY)).alias("level"),
                     F.lit(None).cast(_ARRAY).alias("found"))

    def step(s, _):
        found = F.get(F.filter(F.transform(s["level"], _qualifying), lambda a: a.isNotNull()), 0)
        below = F.flatten(F.transform(s["level"], _children))
        down = F.transform(F.array(found), lambda f: F.struct(
            F.when(f.isNull(), below).otherwise(F.array().cast(_ARRAY)).alias("level"), f.alias("found")))[0]
        return F.when(s["found"].isNotNull() | (F.size(s["level"]) == 0), s).otherwise(down)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(opened, F.lit(DEEPEST)))), start, step)["found"]
