"""Registration of queries and the shared output contract.

An output contract such as ``"water_year:i date:d swe:f3"`` lists the columns
with their types: ``i`` bigint, ``f[n]`` double rounded to n (default 6) places,
``s`` string, ``b`` boolean, ``d`` date and ``t`` timestamp, both as text. It is
applied to the DataFrame and to the SQL, so names and types agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(contract: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in contract.split()]


def project(df: DataFrame, contract: str) -> DataFrame:
    out = []
    for name, kind in _columns(contract):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind[0] == "f":
            c = F.round(c.cast("double"), int(kind[1:] or 6))
        elif kind == "d":
            c = c.cast("date").cast("string")
        elif kind == "t":
            c = F.substring(c.cast("timestamp_ntz").cast("string"), 1, 19)  # independent of the session zone
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def wrap_sql(body: str, contract: str) -> str:
    out = []
    for name, kind in _columns(contract):
        c = f'"{name}"'
        if kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind[0] == "f":
            c = f"ROUND(CAST({c} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0"  # no negative zero
        elif kind == "d":
            c = f"strftime({c}, '%Y-%m-%d')"
        elif kind == "t":
            c = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        elif kind == "b":
            c = f"CAST({c} AS BOOLEAN)"
        else:
            c = f"CAST({c} AS VARCHAR)"
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({body}) q"


def query(name: str, contract: str, sql: str | None = None, tables: str = ""):
    """Register a function ``Tables -> DataFrame`` and, when given, its SQL.

    ``tables`` names the bound tables (see ``bindings``) that the SQL uses.
    """
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: project(fn(Tables(spark, sf_dir)), contract)
        if sql is not None:
            ORACLES[name] = wrap_sql(with_tables(tables, sql), contract)
        return fn
    return register
