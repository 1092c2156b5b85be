"""Registered queries, each beside the plain SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from pairloom.plans import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# The SQL texts as written, without the named sub-queries they use.
ORACLES: dict[str, str] = {}

# Named sub-queries the SQL texts may use; the derived inputs come first.
CTES: dict[str, str] = {
    name: text.format(events="events", embeddings="embeddings", cells="cells") for name, text in derived.SQL.items()
}
CTES["cells"] = "SELECT vec_id, uid, generate_subscripts(vals, 1) - 1 AS pos, unnest(vals) AS v FROM latents"


def with_ctes(body: str) -> str:
    """The body with every named sub-query it needs, directly or not, in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name, sub in CTES.items():
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) and name not in order:
                need(sub)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def _plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, as the SQL side returns them."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            column = column.cast("double")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Registers a query and, where plain SQL can express it, its twin."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain_types(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(*names: str, digits: int = 6) -> list:
    """Columns rounded for comparison between engines."""
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]
