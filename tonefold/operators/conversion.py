"""Conversion of rate, depth and format, and what a run writes: plans of files, apart from their samples.

files: path, format, bits_per_sample, sample_rate, num_frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonefold.operators.checks import problems
from tonefold.operators.metadata import stretched_record

#: The depths that a file of each format can have.
DEPTHS = {"wav": (8, 16, 24, 32, 64), "flac": (8, 16, 20, 24)}


def _allowed(kind: Column, depth: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, depth.isin(*v)) for k, v in DEPTHS.items()], F.lit(False))


def inconvertible(files: DataFrame, depth: int | None = None, kind: str | None = None) -> DataFrame:
    """path, problem: files that can't have the asked depth in the asked format. One of them, and nothing is converted."""
    bits = F.lit(depth) if depth else F.col("bits_per_sample")
    wanted = F.lit(kind) if kind else F.col("format")
    return problems(files, ~_allowed(wanted, bits) if depth or kind else F.lit(False), F.concat(wanted, F.lit(" files can't have "), bits.cast("string"), F.lit(" bits")))


def conversion(files: DataFrame, rate: int | None = None, depth: int | None = None, kind: str | None = None) -> DataFrame:
    """files with the new format, depth, rate and length, and edited: a depth always counts as an edit, a rate or a format if it is another one.

    A metadata column is stretched with the length.
    """
    old, n = F.col("sample_rate"), F.col("num_frames")
    new = F.lit(rate) if rate else old
    edited = F.lit(depth is not None) | (new != old) | (F.lit(kind) != F.col("format") if kind else F.lit(False))
    changed = {"sample_rate": new, "num_frames": (n * (new / old)).cast("bigint"), "edited": edited}
    changed |= {"bits_per_sample": F.lit(depth)} if depth else {}
    changed |= {"format": F.lit(kind)} if kind else {}
    # The record first: in one step, the old rate within its lambdas would mean the new one.
    rows = files.withColumn("metadata", stretched_record(F.col("metadata"), new / old)) if "metadata" in files.columns else files
    return rows.withColumns(changed)


def write_plan(files: DataFrame, copies: bool = False, *more: str) -> DataFrame:
    """path, new_path, action, and more columns of files, for files(path, new_path, data_changed, format_changed): what has to be done to each changed file.

    With copies (an output folder or file) originals stay: everything is created anew. Else a file of another
    format is created and the old one deleted, changed samples at another place too, a path alone is a move.
    """
    moved = F.col("path") != F.col("new_path")
    changed = F.col("data_changed") | F.col("format_changed")
    if copies:
        return files.select("path", "new_path", F.lit("create").alias("action"), *more)
    action = F.when(changed & (moved | F.col("format_changed")), "create and delete").when(changed, "overwrite").when(moved, "move")
    return files.select("path", "new_path", action.alias("action"), *more).filter("action IS NOT NULL")


def edits(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """changed, added, gone: how many rows of two states with the same keys differ in values."""
    a, b = (x.select(*keys, F.struct(*values).alias(name)) for x, name in ((before, "a"), (after, "b")))
    both = a.join(b, keys, "full")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.equal_null("a", "b")).alias("changed"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("gone"),
    )


def undo_plan(log: DataFrame) -> DataFrame:
    """step, action, path, from_path for log(seq, action, path, from_path, copy): created files go, moves run back, copies come back, in this order and each from the last to the first."""
    order = F.when(F.col("action") == "create", 0).when(F.col("action") == "move", 1).otherwise(2)
    back = F.when(F.col("action") == "create", "delete").when(F.col("action") == "move", "move").otherwise("restore")
    path = F.when(F.col("action") == "move", F.col("from_path")).otherwise(F.col("path"))
    source = F.when(F.col("action") == "move", F.col("path")).when(F.col("action") != "create", F.col("copy"))
    return log.select(F.struct(order.alias("kind"), (-F.col("seq")).alias("place")).alias("step"), back.alias("action"), path.alias("path"), source.alias("from_path"))
