"""Large literals for column expressions.

A literal built from expressions is some 100,000 small objects that every task reads.  A session variable holds the value
as one binary array instead; an analysed plan takes over its present value, so the variable may be dropped as soon as
the DataFrame is built.  Callers bound the value's size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Literals:
    """Literals of one caller; ``drop`` frees them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def put(self, value: object, kind: str) -> Column:
        """A literal of the SQL type ``kind`` from a value that JSON can hold."""
        name = f"jobtide_{uuid.uuid4().hex}"
        self.spark.sql(f"DECLARE VARIABLE {name} {kind}")
        self.names.append(name)
        self.spark.sql(f"SET VAR {name} = from_json(:value, '{kind}')",
                       args={"value": json.dumps(value, separators=(",", ":"))})
        return F.expr(f"system.session.{name}")

    def drop(self) -> None:
        while self.names:
            self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {self.names.pop()}")

    def put_map(self, entries: Mapping[str, object], kind: str) -> Callable[[Column], Column]:
        """Lookup (null if missing) in a literal map, kept as an array of small maps by the keys' hash, since a lookup
        in one map reads all its keys."""
        import xxhash
        n = 1 << max(1, len(entries)).bit_length()
        maps: list[dict] = [{} for _ in range(n)]
        for key, value in entries.items():
            maps[xxhash.xxh64_intdigest(key.encode(), seed=42) & (n - 1)][key] = value
        table = self.put(maps, f"array<map<string,{kind}>>")
        return lambda key: F.get(table, F.xxhash64(key).bitwiseAND(F.lit(n - 1)).cast("int"))[key]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]
