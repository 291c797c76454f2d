"""Pitch drift: chunks that jump, regions to leave alone, target pitches, and the signal played along the way to them.

chunks: path, chunk (0, 1, ... without gaps), hz (0 if unvoiced), as pitch.track gives with normalised=False.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonefold.functions import scalars as S
from tonefold.operators import signals as O
from tonefold.operators.checks import problems

#: Cents of a band of jumps and of pitches, times the usual jump that is too far, the most that a jump may be, cents within which regions are one pitch, and off an expected note.
JUMP_BAND, PITCH_BAND, TOO_FAR, MOST_JUMP, ONE_PITCH, EXPECTED = 10, 3, 5, 50.0, 30.0, 50.0
#: Chunks without a jump that end a bad region, least chunks of one, least chunks and voiced share of a signal.
GOOD_CHUNKS, BAD_CHUNKS, LEAST_CHUNKS, LEAST_VOICED = 7, 3, 3, 0.75
#: Fixed value: how fast the ratio follows at 48 kHz.
SMOOTHING = 0.00007


def banded(cents: Column, size: int) -> Column:
    return (F.round(cents / size) * size).cast("int")


def correctable(chunks: DataFrame) -> DataFrame:
    """The chunks of signals that are long enough, and voiced in most of them."""
    path = W.partitionBy("path")
    rows = chunks.withColumns({"n": F.count(F.lit(1)).over(path), "voiced": F.count_if(F.col("hz") != 0).over(path)})
    return rows.filter((F.col("n") >= LEAST_CHUNKS) & (F.col("voiced") >= LEAST_VOICED * F.col("n"))).drop("n", "voiced")


def with_outliers(chunks: DataFrame) -> DataFrame:
    """chunks with outlier: unvoiced, or further from the chunk before than usual.

    Usual is the mean jump in the commonest band of jumps (the lowest of equals). Where the second chunk
    is one, the first is too.
    """
    order = W.partitionBy("path").orderBy("chunk")
    rows = chunks.withColumn("before", F.lag("hz").over(order))
    jump = F.when((F.col("hz") != 0) & (F.col("before") != 0), S.cents_between(F.col("before"), F.col("hz")))
    rows = rows.withColumn("jump", jump).withColumn("band", banded(F.col("jump"), JUMP_BAND))
    usual = rows.filter("band IS NOT NULL").groupBy("path", "band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("jump")).alias("mean"))
    usual = usual.groupBy("path").agg((F.max_by("mean", F.struct("n", -F.col("band"))) * TOO_FAR).alias("usual"))
    rows = rows.join(usual, "path", "left").withColumn("far", F.least("usual", F.lit(MOST_JUMP)))
    moved = F.when(F.col("before") == 0, F.lit(0.0)).when(F.col("hz") == 0, F.lit(1e9)).otherwise(F.abs("jump"))
    rows = rows.withColumn("bad", F.col("far").isNotNull() & ((F.col("hz") == 0) | ((F.col("chunk") > 0) & (moved >= F.col("far")))))
    follows = F.coalesce(F.lead("bad").over(order), F.lit(False)) & (F.col("chunk") == 0) & F.col("far").isNotNull()
    return rows.withColumn("outlier", F.coalesce(F.col("bad") | follows, F.lit(False))).drop("before", "jump", "band", "usual", "far", "bad")


def with_ignored(chunks: DataFrame) -> DataFrame:
    """chunks(outlier) with ignored: inside a region of outliers that lie less than GOOD_CHUNKS good ones apart, if it is long enough. A first region begins at 0 if so few good ones stand before it."""
    order = W.partitionBy("path").orderBy("chunk")
    bad = chunks.filter("outlier").select("path", "chunk")
    gap = F.col("chunk") - F.lag("chunk").over(order) - 1
    bad = bad.withColumn("region", F.sum(F.when(gap < GOOD_CHUNKS, 0).otherwise(1)).over(order))
    spans = bad.groupBy("path", "region").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    spans = spans.withColumn("first", F.when((F.col("region") == 1) & (F.col("first") < GOOD_CHUNKS), F.lit(0).cast("long")).otherwise(F.col("first"))).filter(F.col("last") + 1 - F.col("first") >= BAD_CHUNKS)
    inside = spans.select("path", F.explode(F.sequence("first", "last")).alias("chunk"), F.lit(True).alias("ignored"))
    return chunks.join(inside, ["path", "chunk"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def with_targets(chunks: DataFrame) -> DataFrame:
    """chunks(ignored) with target: the mean pitch of the commonest band in each run of chunks that aren't ignored (null in ignored ones); one mean for all runs if they are all near each other."""
    order = W.partitionBy("path").orderBy("chunk")
    new = F.when(F.col("ignored") | (~F.col("ignored") & (F.coalesce(F.lag("ignored").over(order), F.lit(True)))), 1).otherwise(0)
    rows = chunks.withColumn("run", F.sum(new).over(order))
    voiced = rows.filter("NOT ignored AND hz <> 0").withColumn("band", banded(1200 * F.log2("hz"), PITCH_BAND))
    bands = voiced.groupBy("path", "run", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("hz").alias("mean"))
    runs = bands.groupBy("path", "run").agg(F.max_by("mean", F.struct("n", -F.col("band"))).alias("target"))
    path = W.partitionBy("path")
    together = S.cents_between(F.min("target").over(path), F.max("target").over(path)) <= ONE_PITCH
    runs = runs.withColumn("target", F.when(together, F.avg("target").over(path)).otherwise(F.col("target")))
    return rows.join(runs, ["path", "run"], "left").withColumn("target", F.when(~F.col("ignored"), F.col("target"))).drop("run")


def analysed(chunks: DataFrame) -> DataFrame:
    """The chunks that can be corrected, with outlier, ignored and target."""
    return with_targets(with_ignored(with_outliers(correctable(chunks))))


def off_expected(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """path, problem: signals of analysed() with a target too far from expected(path, expected_hz)."""
    off = rows.join(expected, "path").filter(F.abs(S.cents_between(F.col("expected_hz"), F.col("target"))) >= EXPECTED).select("path").distinct()
    return problems(off, F.lit(True), "the pitch is too far from the expected note")


def as_csv(rows: DataFrame) -> DataFrame:
    """path, chunk, line: detected pitch, outlier, ignored, target pitch, two decimals."""
    number = lambda c: F.format_string("%7.2f", F.coalesce(c, F.lit(0.0)))
    return rows.select("path", "chunk", F.concat_ws(",", number("hz"), F.col("outlier").cast("int").cast("string"), F.col("ignored").cast("int").cast("string"), number("target")).alias("line"))


def positions(frames: int, rate: float, size: int, hz: np.ndarray, outlier: np.ndarray, ignored: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Where in the signal each frame of the corrected one lies.

    The ratio follows a chunk's target over its pitch by one pole; inside a chunk that is a geometric
    series, whose sums are known. An ignored start has the first good chunk's ratio, a later ignored
    region 1; an outlier in a good region changes nothing.
    """
    good = np.flatnonzero(~ignored)
    if not len(good):
        return np.arange(frames, dtype=np.float64)
    wanted = np.where((hz > 0) & (target > 0), target / np.where(hz > 0, hz, 1), 1.0)
    keep = 1 - SMOOTHING / (rate / 48_000)
    at, out, aim, now = 0.0, [], None, None
    fallback = wanted[good[0]] if ignored[0] else 1.0
    for k in range(len(hz)):
        if ignored[k]:
            aim = fallback
        else:
            fallback = 1.0
            aim = wanted[k] if not outlier[k] else (1.0 if aim is None else aim)
        now = aim if now is None else now
        end = min((k + 1) * size, frames - 1 + 1e-9) if k == len(hz) - 1 else (k + 1) * size
        steps = int((end - at) / min(aim, now)) + 2
        power = keep ** np.arange(1, steps + 1)
        path = at + np.concatenate(([0.0], aim * np.arange(1, steps + 1) + (now - aim) * keep * (1 - power) / (1 - keep)))
        taken = int(np.searchsorted(path, end, side="left"))
        out.append(path[:taken])
        if taken:
            at, now = path[taken], aim + (now - aim) * (power[taken - 1])
    found = np.concatenate(out)
    return found[found <= frames - 1]


def played(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows at places between their samples, on cubics through four; edges repeat."""
    k = at.astype(np.int64)
    t, last = at - k, x.shape[1] - 1
    p = [x[:, np.clip(k + d, 0, last)] for d in (-1, 0, 1, 2)]
    # Lagrange's weights of the four points.
    w = (-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6)
    return sum(a * b for a, b in zip(w, p))


def corrected(df: DataFrame, rows: DataFrame, seconds: float = 0.06, sets: DataFrame | None = None) -> DataFrame:
    """Signals along their chunks' targets (rows of analysed() with chunks of `seconds`); those without any good chunk stay.

    With sets(path, set_key, authority) all members of a set go along their authority's targets, so that they stay aligned; signals
    in no set, and sets whose members differ in length, stay as they are.
    """
    order = F.sort_array(F.collect_list(F.struct("chunk", "hz", "outlier", "ignored", F.coalesce("target", F.lit(0.0)).alias("target"))))
    plans = rows.groupBy("path").agg(order.alias("plan"), F.count_if(~F.col("ignored")).alias("good")).filter("good > 0").drop("good")
    plans = plans if sets is None else O.of_authority(plans, sets, df)
    arrays = O.in_arrays(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = []
            for k in range(batch.num_rows):
                x, rate, plan = batch.column(2)[k].values.to_numpy(zero_copy_only=False), batch.column(5)[k].as_py(), batch.column(6)[k].values
                hz, target = (plan.field(f).to_numpy(zero_copy_only=False) for f in ("hz", "target"))
                outlier, ignored = (plan.field(f).to_numpy(zero_copy_only=False) for f in ("outlier", "ignored"))
                samples.append(played(x[None], positions(len(x), rate, int(seconds * rate), hz, outlier, ignored, target))[0])
            yield pa.RecordBatch.from_arrays([pa.array(samples, pa.list_(pa.float64())) if c == 2 else batch.column(c) for c in range(6)], batch.schema.names[:6])

    planned = arrays.select("path", "channel", "samples", "num_frames", "num_channels", "sample_rate").join(plans, "path")
    done = O.in_frames(planned.select("path", "channel", "samples", "num_frames", "num_channels", "sample_rate", "plan").mapInArrow(run, arrays.schema))
    return done.unionByName(df.join(plans.select("path"), "path", "left_anti").select(*O.SIGNAL))
