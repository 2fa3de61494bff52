"""Registered queries (Spark) and their DuckDB oracles, collected by name."""

from __future__ import annotations

import importlib

_MODULES = ["retrieval", "text", "hybrid", "evaluation", "ingest", "history", "maintenance", "stores"]


def _collect(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(f"quarry.plans.{m}")
        out.update(getattr(mod, attr))
    return out


def _normalise(df):
    """Widen int -> bigint and float -> double so result schemas line up with
    the SQL oracles (whose integer results are BIGINT)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.FloatType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _wrap(fn):
    def run(spark, sf_dir):
        return _normalise(fn(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict:
    return {k: _wrap(v) for k, v in _collect("QUERIES").items()}


def all_oracles() -> dict:
    return _collect("SQL")
