"""Point clouds made from the test tables: the same columns for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TIME = "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / 2405e0"
_TIME_SPARK = "CAST(datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS DOUBLE) / 2405e0"


def _component(k: int) -> str:
    return f"CAST(element_at(embedding, {k + 1}) AS DOUBLE)"


def _component_duck(k: int) -> str:
    return f"CAST(embedding[{k + 1}] AS DOUBLE)"


def _vectors(component) -> list[str]:
    out = ["CAST(vec_id AS BIGINT) AS id"]
    out += [f"({component(k)} + 1e0) / 2e0 AS {a}" for k, a in enumerate("xyz")]
    out += ["1e0 + CAST(label AS DOUBLE) AS w", f"{component(8)} AS s"]
    return out + [f"{component(4 + k)} AS v{a}" for k, a in enumerate("xyz")]


_LINES = [
    "CAST(l_quantity AS DOUBLE) / 51e0 AS x",
    "CAST(l_extendedprice AS DOUBLE) / 110000e0 AS y",
    "(CAST(l_discount AS DOUBLE) + 0.005e0) / 0.11e0 AS z",
    "CAST(l_extendedprice AS DOUBLE) / 110000e0 AS w",
    "CAST(l_tax AS DOUBLE) AS tax",
    "CAST(l_discount AS DOUBLE) AS disc",
    "CAST(l_quantity AS DOUBLE) / 50e0 AS qty",
]
#: The same with positions and weights in single precision.
_LINES_32 = [f"CAST(CAST({c.rsplit(' AS ', 1)[0]} AS FLOAT) AS DOUBLE) AS {c.rsplit(' AS ', 1)[1]}" for c in _LINES[:4]] + _LINES[4:]
_PARTS = [
    "CAST(p_partkey AS BIGINT) AS id",
    "CAST(p_size AS DOUBLE) / 51e0 AS x",
    "(CAST(p_retailprice AS DOUBLE) - 900e0) / 100e0 AS y",
    "CAST(p_retailprice AS DOUBLE) / 1000e0 AS w",
]
_CUSTOMERS = ["CAST(c_custkey AS BIGINT) AS id", "(CAST(c_acctbal AS DOUBLE) + 1000e0) / 11000e0 AS x", "1e0 AS w"]


def _power(x: str) -> str:
    """x to the sixth: most of what lay evenly is then close to 0."""
    return " * ".join([f"({x})"] * 6)


def _clustered(time: str) -> list[str]:
    out = ["CAST(o_orderkey AS BIGINT) AS id", f"{_power('CAST(o_totalprice AS DOUBLE) / 500000e0')} AS x"]
    return [*out, f"{_power(time)} AS y", "1e0 AS w"]


def _orders(time: str) -> list[str]:
    return ["CAST(o_orderkey AS BIGINT) AS id", "CAST(o_totalprice AS DOUBLE) / 500000e0 AS x", f"{time} AS y", "1e0 AS w"]


#: name: (table, Spark columns, DuckDB columns)
CLOUDS: dict[str, tuple[str, list[str], list[str]]] = {
    "V": ("embeddings", _vectors(_component), _vectors(_component_duck)),
    "L": ("lineitem", _LINES, _LINES),
    "L32": ("lineitem", _LINES_32, _LINES_32),
    "P": ("part", _PARTS, _PARTS),
    "C": ("customer", _CUSTOMERS, _CUSTOMERS),
    "O": ("orders", _orders(_TIME_SPARK), _orders(_TIME)),
    "K": ("orders", _clustered(_TIME_SPARK), _clustered(_TIME)),
}


def cloud(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, _ = CLOUDS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def cloud_sql(name: str) -> str:
    table, _, columns = CLOUDS[name]
    return f"SELECT {', '.join(columns)} FROM {table}"
