"""Seamless loops by search: zero crossings, one in each chunk, that sound alike afterwards."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonefold.operators import signals as O

#: A chunk, and how long two places are compared, strictly and at large, in milliseconds; samples that count as equal; and the least match, in per cent, and length, in seconds, of a loop.
CHUNK_MS, STRICT_MS, ALIKE_MS = 60, 0.227, 59
NEAR_ZERO, ALIKE, LEAST_MATCH, LEAST_SECONDS, NEARLY_ALL = 0.1, 0.07, 70, 0.001, 99


#: Samples after a crossing whose cells have to touch.
CELL_SAMPLES = 3


def crossings(df: DataFrame) -> DataFrame:
    """path, chunk, frame, sample: the frame of each chunk with the least sum of magnitudes (the first of equals), and its first channel's sample."""
    each = F.greatest(F.lit(1), (F.col("sample_rate") * (CHUNK_MS / 1000)).cast("bigint"))
    frames = df.groupBy("path", F.floor(F.col("frame") / each).alias("chunk"), "frame").agg(F.sum(F.abs("value")).alias("m"), F.max(F.when(F.col("channel") == 0, F.col("value"))).alias("sample"))
    return frames.groupBy("path", "chunk").agg(F.min(F.struct("m", "frame", "sample")).alias("z")).select("path", "chunk", "z.frame", "z.sample")


def loop_matches(df: DataFrame, strictness: float = 50) -> DataFrame:
    """path, start, end, match (per cent): pairs of crossings that could be a loop.

    Only crossings that agree on the few samples after them meet on the long stretch, so that pairs carry short arrays.
    """
    near = (100 - strictness) * 0.001 / 2
    found = crossings(df).filter(F.abs("sample") < NEAR_ZERO).join(O.in_rows(df), "path")
    rate, n = F.col("sample_rate"), F.col("num_channels").cast("int")
    length = (rate * (ALIKE_MS / 1000)).cast("int")
    after = lambda count: F.slice("samples", (F.col("frame") * n + 1).cast("int"), count)
    places = found.select("path", "chunk", "frame", "sample_rate", "num_frames", length.alias("length"), after(F.ceil(rate * (STRICT_MS / 1000) * n).cast("int")).alias("strict"), after(length * n).alias("long"))
    # Samples that are near lie in one cell or in two that touch: crossings meet by the cells of their first few, in all neighbouring cells.
    cell = [F.coalesce(F.floor(F.get("strict", k) / max(near, 1e-9)), F.lit(0)) for k in range(CELL_SAMPLES)]
    around = F.array(*[F.struct(*[(c + d).alias(f"c{k}") for k, (c, d) in enumerate(zip(cell, step))]) for step in itertools.product((-1, 0, 1), repeat=CELL_SAMPLES)])
    a = places.select("path", "chunk", "frame", "strict", F.explode(around).alias("cell"))
    own = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(cell)])
    b = places.select("path", F.col("chunk").alias("chunk2"), F.col("frame").alias("frame2"), F.col("strict").alias("strict2"), "length", "num_frames", "sample_rate", own.alias("cell"))
    far = (F.col("frame2") - F.col("frame")) >= F.floor((F.col("sample_rate") * (CHUNK_MS / 1000)).cast("bigint") / 4)
    pairs = a.join(b, ["path", "cell"]).filter((F.col("chunk2") > F.col("chunk")) & (F.col("frame2") + F.col("length") <= F.col("num_frames")) & far)
    pairs = pairs.filter(F.forall(F.zip_with("strict", "strict2", lambda x, y: F.abs(x - y) < near), lambda ok: ok)).select("path", "frame", "frame2")
    stretch = places.select("path", "frame", "long")
    both = pairs.join(stretch, ["path", "frame"]).join(stretch.select("path", F.col("frame").alias("frame2"), F.col("long").alias("long2")), ["path", "frame2"])
    equal = F.aggregate(F.zip_with("long", "long2", lambda x, y: F.when(F.abs(x - y) < ALIKE, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return both.select("path", F.col("frame").alias("start"), F.col("frame2").alias("end"), (equal / F.size("long") * 100).alias("match"))


def best_loop(matches: DataFrame) -> DataFrame:
    """path, start, end, match: the best match, and of those that match nearly everywhere the longest; the first of equals. Under LEAST_MATCH there is none."""
    long = F.when(F.col("match") > NEARLY_ALL, F.col("end") - F.col("start")).otherwise(F.lit(0))
    order = F.struct(F.when(F.col("match") > NEARLY_ALL, F.lit(101.0)).otherwise(F.col("match")), long, -F.col("start"), -F.col("end"))
    return matches.groupBy("path").agg(F.max_by(F.struct("start", "end", "match"), order).alias("b")).select("path", "b.*").filter(F.col("match") >= LEAST_MATCH)


def seamless(df: DataFrame, strictness: float = 50) -> DataFrame:
    """Signals cut to their best loop; those without one stay."""
    found = best_loop(loop_matches(df, strictness))
    rows = df.join(found.select("path", "start", "end"), "path", "left")
    ok = (F.col("end") - F.col("start")) / F.col("sample_rate") >= LEAST_SECONDS
    return O.kept_range(rows, F.when(ok, F.col("start")).otherwise(F.lit(0)), F.when(ok, F.col("end")).otherwise(F.col("num_frames"))).drop("start", "end")
