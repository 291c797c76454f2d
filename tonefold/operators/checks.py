"""Fatal conditions: each is a DataFrame of problems, looked at before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rows: DataFrame, when: Column, what: str | Column, path: str = "path") -> DataFrame:
    """path, problem for the rows for which `when` holds."""
    return rows.filter(when).select(F.col(path).cast("string").alias("path"), (F.lit(what) if isinstance(what, str) else what).alias("problem"))


def refuse(*found: DataFrame, shown: int = 5) -> None:
    """Raises ValueError if any of the DataFrames of problems has a row; names the first few."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    if first := every.orderBy("path", "problem").limit(shown).collect():
        raise ValueError("; ".join(f"{r['path']}: {r['problem']}" for r in first))
