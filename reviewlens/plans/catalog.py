"""Registry of named queries: a Spark plan plus (where SQL can express it) an oracle.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables.  Doubles are rounded to 6 places and integers are BIGINT on both
sides so the oracle comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.sources.tables import REVIEWS_SQL, TABLES

TABLES_FOR_ORACLE = TABLES

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def with_reviews(body: str) -> str:
    """Oracle SQL that can refer to the shared ``reviews`` view."""
    return f"WITH {REVIEWS_SQL.strip()},\n{body.strip()}"


def normalise(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, widen ints to BIGINT: the shape both engines agree on."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.round(c.cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("bigint").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def load_all() -> None:
    """Import every module that registers queries."""
    from reviewlens.plans import (  # noqa: F401
        queries_clustering, queries_io, queries_rouge, queries_search, queries_semantic, queries_text,
        queries_training,
        queries_vectors,
        queries_votes)
