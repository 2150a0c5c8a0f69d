"""DataFrame helpers that every text operator uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.sources.shared import forget, shared_dir
from pointweave.sources.shared import written as materialize

__all__ = ["append_columns", "ascii_lower", "forget", "join_counted", "materialize", "name", "shared_dir"]

#: ``translate`` arguments that lower-case A-Z and leave every other character.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A key with more than 1 / HEAVY_SHARE of all rows is heavy, so at most
#: HEAVY_SHARE keys are: what is broadcast for them has that bound.
HEAVY_SHARE = 4096


def name(column: str) -> str:
    """A column name quoted for Spark, whatever characters it holds."""
    return "`" + column.replace("`", "``") + "`"


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right``, whose ``keys`` are unique and whose column
    ``count`` says how many rows of ``left`` each key has.

    ``right`` must be materialized. Keys with more than 1/HEAVY_SHARE of the
    counted rows go by a broadcast of at most HEAVY_SHARE rows; all others are
    shuffled, where no key can then dominate a task.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("how must be inner, left or left_semi")
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * HEAVY_SHARE > F.lit(int(total))
    hot = right.filter(heavy)
    flag = "_pw_hot"
    marked = left.join(
        F.broadcast(hot.select(*map(name, keys)).withColumn(flag, F.lit(True))), keys, "left"
    )
    first = marked.filter(F.col(flag)).drop(flag).join(F.broadcast(hot), keys, "inner" if how == "left" else how)
    rest = marked.filter(F.col(flag).isNull()).drop(flag).join(right.filter(~heavy), keys, how)
    return first.unionByName(rest)


def append_columns(df: DataFrame, text_col: str, added: str, make) -> DataFrame:
    """``df`` with columns that Python computes from Arrow batches.

    ``make()`` runs once a task and gives a function from a batch of a few MB to
    the arrays of the columns that ``added`` (a DDL string) names. Input columns
    of those names are replaced; all others pass unchanged.
    """
    import pyarrow as pa

    from pointweave.llm._text import steps

    fields = T.StructType.fromDDL(added)
    base = df.select(*[F.col(name(c)) for c in df.columns if c not in fields.names])
    names = [*base.columns, *fields.names]

    def run(batches):
        work = make()
        for batch in batches:
            for part in steps(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], names=names)

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields.fields]))
