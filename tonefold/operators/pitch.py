"""Pitch: of chunks, of whole signals by the chunks' agreement and by octaves, and tuning to notes.

The pitch of a chunk is where its normalised autocorrelation first comes near its highest peak; chunks
are independent of each other, and those of one length are one FFT. A chunk without a clear peak has 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonefold.functions import scalars as S
from tonefold.operators import blocks
from tonefold.operators import signals as O
from tonefold.operators.sets import blend_plan

#: Hz that are looked for, how high a peak must be, and how near to the highest one the first may be.
LOWEST, HIGHEST, CLEAR, NEAR = 20.0, 3000.0, 0.6, 0.9
#: Cents by which a signal is shifted for the vote, Hz off that still agree, and width and height of the agreement of chunks.
OCTAVES, AGREE_HZ, WIDTH_HZ, HEIGHT, LOUD = (-2400, -1200, 0, 1200), 1.5, 0.9, 10.0, 1.5
#: Agreement beyond so many Hz is below what a double holds beside a chunk's agreement with itself.
BUCKET_HZ = 8.0


def chunk_pitch(x: np.ndarray, rate: float) -> np.ndarray:
    """Hz of each row, 0 where none is clear."""
    n = x.shape[1]
    longest, shortest = min(n // 2, int(rate / LOWEST)), max(2, int(rate / HIGHEST))
    out = np.zeros(len(x))
    if longest <= shortest + 1:
        return out
    x = x - x.mean(1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    product = np.fft.irfft(np.abs(np.fft.rfft(x, size, axis=1)) ** 2, size, axis=1)[:, : longest + 2]
    energy = np.concatenate((np.zeros((len(x), 1)), np.cumsum(x**2, 1)), 1)
    lags = np.arange(longest + 2)
    both = energy[:, n - lags] + energy[:, -1:] - energy[:, lags]
    like = 2 * product / np.maximum(both, 1e-30)
    peak = (like[:, 1:-1] >= like[:, :-2]) & (like[:, 1:-1] > like[:, 2:])
    peak[:, : shortest - 1] = False
    # Peaks before the correlation has first fallen below 0 belong to lag 0.
    peak &= np.cumsum(like[:, 1:-1] < 0, 1) > 0
    # Heights between lags, on the parabola through three of them.
    slope, bend = like[:, :-2] - like[:, 2:], like[:, :-2] - 2 * like[:, 1:-1] + like[:, 2:]
    off = np.where(bend < 0, 0.5 * slope / np.where(bend < 0, bend, 1), 0)
    height = np.where(peak, like[:, 1:-1] - 0.25 * slope * off, -1)
    best = height.max(1)
    rows = np.flatnonzero((best >= CLEAR) & (both[:, 0] > 1e-12))
    at = (height[rows] >= NEAR * best[rows, None]).argmax(1)
    out[rows] = rate / (at + 1 + off[rows, at])
    return out


def track(df: DataFrame, seconds: float = 0.1, normalised: bool = True, is_mono: bool = False) -> DataFrame:
    """path, chunk, at_seconds (its middle), hz (0 if unvoiced), rms, total_seconds: chunks of the channels' sum, scaled to peak 1 if normalised."""
    m, path = df if is_mono else O.mono(df), W.partitionBy("path")
    if normalised:
        m = m.withColumn("value", F.col("value") / F.coalesce(F.nullif(F.max(F.abs("value")).over(path), F.lit(0.0)), F.lit(1.0)))
    each = F.greatest(F.lit(1), (F.col("sample_rate") * seconds).cast("bigint"))
    rows = m.withColumns({"each": each, "chunk": F.floor(F.col("frame") / each)})
    points = F.sort_array(F.collect_list(F.struct("frame", "value")))
    chunks = rows.groupBy("path", "chunk").agg(
        F.transform(points, lambda x: x["value"]).alias("x"), F.max("sample_rate").alias("rate"), F.max("num_frames").alias("n"), (F.max("chunk") * F.max("each")).alias("first"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rates = batch.column(2), batch.column(3).to_numpy()
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            starts, hz = np.cumsum(sizes) - sizes, np.zeros(len(sizes))
            for n, rate in sorted(set(zip(sizes.tolist(), rates.tolist()))):
                own = np.flatnonzero((sizes == n) & (rates == rate))
                hz[own] = chunk_pitch(flat[starts[own][:, None] + np.arange(n)], rate)
            rest = [batch.column(k) for k in (0, 1, 3, 4, 5, 6)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(hz), pa.array(sizes.astype(np.int64))], ["path", "chunk", "rate", "n", "first", "rms", "hz", "size"])

    kind = df.schema["path"].dataType.simpleString()
    found = chunks.mapInArrow(run, f"path {kind}, chunk long, rate long, n long, first long, rms double, hz double, size long")
    return found.select("path", "chunk", ((F.col("first") + F.col("size") / 2) / F.col("rate")).alias("at_seconds"), "hz", "rms", (F.col("n") / F.col("rate")).alias("total_seconds"))


def best_chunk(chunks: DataFrame, *keys: str) -> DataFrame:
    """keys, hz of the chunk on which most voiced chunks of chunks(keys, chunk, hz, rms) agree, louder ones counting more; null if it is unvoiced.

    A signal's chunks are one list, in the order of their numbers; of equal ones the first counts.
    """
    lists = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "hz", "rms"))).alias("all"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [agreed_pitch(*(x.values.field(c).to_numpy(zero_copy_only=False) for c in ("hz", "rms"))) for x in batch.column("all")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, pa.float64())], [*keys, "hz"])

    return lists.mapInArrow(best, T.StructType([*(lists.schema[k] for k in keys), T.StructField("hz", T.DoubleType())]))


def agreed_pitch(hz: np.ndarray, rms: np.ndarray) -> float | None:
    """The pitch of the chunk of greatest weight. Only pitches near each other are compared; equal ones are counted together."""
    pitches, times = np.unique(hz[hz > 0], return_counts=True)
    agreed = np.zeros(len(hz))
    low, high = np.searchsorted(pitches, hz - 2 * BUCKET_HZ), np.searchsorted(pitches, hz + 2 * BUCKET_HZ, side="right")
    for k in np.flatnonzero(high > low):
        delta = pitches[low[k] : high[k]] - hz[k]
        agreed[k] = (times[low[k] : high[k]] * HEIGHT * np.exp(-delta * delta / (2 * WIDTH_HZ**2))).sum()
    least, most = rms.min(), rms.max()
    loud = 1 + LOUD * np.sin((rms - least) / (most - least) * (math.pi / 2)) if most > least else 1.0
    return float(hz[np.argmax(agreed * loud)]) or None


def octave_vote(found: DataFrame) -> DataFrame:
    """path, hz, confidence from found(path, cents, hz), the pitches of a signal shifted by cents: the one that most others agree with, shifted back.

    Null where the first of the best has no pitch. A signal's shifts are one list of a few.
    """
    lists = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("cents", "hz"))).alias("all"))
    back = lambda a, b: a["hz"] * F.pow(F.lit(2.0), (b["cents"] - a["cents"]) / 1200)
    agree = lambda a: F.size(F.filter("all", lambda b: a["hz"].isNotNull() & b["hz"].isNotNull() & (F.abs(back(a, b) - b["hz"]) < AGREE_HZ)))
    votes = F.transform("all", lambda a: F.struct(agree(a).alias("votes"), (-a["cents"]).alias("less"), a["hz"].alias("hz")))
    best = lists.select("path", F.array_max(votes).alias("b"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("b.votes") - 1) / (len(OCTAVES) - 1)))
    return best.select("path", (F.col("b.hz") * F.pow(F.lit(2.0), F.col("b.less") / 1200)).alias("hz"), F.when(F.col("b.hz").isNotNull(), sure).alias("confidence"))


def detected(df: DataFrame) -> DataFrame:
    """path, hz, confidence (0 to 1) of each signal; null where no pitch is found.

    The channels are mixed once, and all shifts of all signals are resampled and tracked together; the shift by nothing is the mix.
    """
    shifts = O.mono(df).withColumn("cents", F.explode(F.array(*map(F.lit, OCTAVES)))).withColumn("path", F.struct("path", "cents"))
    moved = blocks.resampled(shifts.filter("cents <> 0").withColumn("ratio", F.pow(F.lit(2.0), -F.col("cents") / 1200)))
    every = track(moved.unionByName(shifts.filter("cents = 0").select(*O.SIGNAL)), is_mono=True)
    return octave_vote(best_chunk(every.select("path.path", "path.cents", "chunk", "hz", "rms"), "path", "cents"))


def tuning(pitch: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """path, hz, note, cents: how far each signal of pitch(path, hz) has to move to its nearest note; 0 if it is less than a cent off, null without a pitch.

    With expected(path, expected), a note modulo 12 that the nearest one isn't gives null too.
    """
    rows = pitch.filter("hz IS NOT NULL").withColumn("note", S.nearest_note(F.col("hz")))
    cents = S.cents_between(F.col("hz"), S.note_pitch(F.col("note")))
    rows = rows.withColumn("cents", F.when(F.abs(cents) < 1, F.lit(0.0)).otherwise(cents))
    if expected is not None:
        rows = rows.join(expected.select("path", "expected"), "path", "left")
        rows = rows.withColumn("cents", F.when(F.col("expected").isNull() | ((F.col("expected") - F.col("note")) % 12 == 0), F.col("cents"))).drop("expected")
    none = pitch.filter("hz IS NULL").select("path", "hz", F.lit(None).cast("int").alias("note"), F.lit(None).cast("double").alias("cents"))
    return rows.select("path", "hz", "note", "cents").unionByName(none)


def auto_tuned(df: DataFrame, pitch: DataFrame, sets: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Signals tuned to their nearest notes; those without a pitch stay. With sets(path, authority) each moves as its set's authority does."""
    plan = tuning(pitch, expected)
    if sets is not None:
        plan = sets.select("path", F.col("authority").alias("lead")).join(plan.select(F.col("path").alias("lead"), "cents"), "lead").select("path", "cents")
    moves = plan.filter("cents <> 0").select("path", F.col("cents").alias("amount"))
    return O.retuned(df, moves).unionByName(df.join(moves, "path", "left_anti").select(*O.SIGNAL))


def blended(df: DataFrame, files: DataFrame, step: int) -> DataFrame:
    """folder, note, frame, channel, value: between each two neighbouring roots of files(path, folder, root) the notes `step` apart, both signals tuned there, weighted and added."""
    plan = blend_plan(files, step, name="path")
    part = lambda side: plan.select("folder", "note", F.col(f"{side}_file").alias("source"), F.col(f"{side}_weight").alias("weight"), ((F.col("note") - F.col(side)) * 100).alias("amount"))
    parts = part("lower").unionByName(part("upper"))
    key = F.to_json(F.struct("folder", "note", "source"))
    parts = parts.withColumn("key", key)
    rows = df.withColumnRenamed("path", "source").join(parts.select("source", "key"), "source").withColumnRenamed("key", "path").select(*O.SIGNAL)
    moved = O.retuned(rows, parts.select(F.col("key").alias("path"), "amount"))
    both = moved.join(parts.select(F.col("key").alias("path"), "folder", "note", "weight"), "path")
    return both.groupBy("folder", "note", "frame", "channel").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
