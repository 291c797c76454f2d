"""Spectra: mean magnitudes of overlapping windows, and levels of log-spaced bands.

A signal is cut into windows of `size` samples, half a window apart, under a Hann window; a row of windows
is one matrix product for short ones and one FFT for long ones, in batches of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonefold.operators.signals import mono

#: Window, bands, the lowest band's edge in Hz, and the level of silence.
SIZE, BANDS, LOWEST, SILENCE_DB = 4096, 32, 20.0, -120.0


def magnitudes(df: DataFrame, size: int = SIZE) -> DataFrame:
    """path, bin, magnitude, sample_rate: means over a signal's windows, scaled so that a full sine reads 1. Signals shorter than a window have 0 everywhere.

    The channels' mean is looked at. Windows are cut by arithmetic on frames, so a long signal is no single row.
    """
    hop = size // 2
    m = mono(df).join(df.groupBy("path").agg(F.max("num_channels").alias("nc")), "path").withColumn("value", F.col("value") / F.col("nc"))
    last = F.floor((F.col("num_frames") - size) / hop)
    own = F.floor(F.col("frame") / hop)
    # A frame lies in the window that begins in its half, and in the one before.
    cut = m.withColumn("window", F.explode(F.array(own, own - 1))).filter((F.col("window") >= 0) & (F.col("window") <= last))
    points = F.sort_array(F.collect_list(F.struct((F.col("frame") - F.col("window") * hop).alias("at"), "value")))
    windows = cut.groupBy("path", "window").agg(F.transform(points, lambda x: x["value"]).alias("x"), F.max("sample_rate").alias("sample_rate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hann = 0.5 * (1 - np.cos(2 * math.pi * np.arange(size) / (size - 1)))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            found = np.abs(np.fft.rfft(x * hann, axis=1)) * (2 / hann.sum())
            n, bins = found.shape
            rows = np.repeat(np.arange(n), bins)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(bins), n)), pa.array(found.ravel()), batch.column(2).take(pa.array(rows))], ["path", "bin", "magnitude", "sample_rate"])

    kind = df.schema["path"].dataType.simpleString()
    found = windows.select("path", "x", "sample_rate").mapInArrow(run, f"path {kind}, bin long, magnitude double, sample_rate long")
    means = found.groupBy("path", "bin").agg(F.avg("magnitude").alias("magnitude"), F.max("sample_rate").alias("sample_rate"))
    short = df.filter(F.col("num_frames") < size).groupBy("path").agg(F.max("sample_rate").alias("sample_rate"))
    nothing = short.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size // 2).cast("long"))).alias("bin"), F.lit(0.0).alias("magnitude"), "sample_rate")
    return means.select("path", "bin", "magnitude", "sample_rate").unionByName(nothing)


def bands(spectrum: DataFrame, size: int = SIZE, count: int = BANDS, lowest: float = LOWEST) -> DataFrame:
    """path, band, db: root mean square of the bins of each band, from `lowest` Hz to half the rate, equally wide in octaves. Neighbours share bins."""
    top, per_bin = F.col("sample_rate") / 2, F.col("sample_rate") / size
    edge = lambda k: lowest * F.pow(top / lowest, k / count)
    grid = spectrum.select("path", "sample_rate").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    low = F.greatest(F.lit(1), F.floor(edge(F.col("band")) / per_bin))
    high = F.least(F.lit(size // 2 + 1), F.ceil(edge(F.col("band") + 1) / per_bin) + 1)
    grid = grid.withColumn("bin", F.explode_outer(F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))))
    both = grid.join(spectrum.select("path", "bin", "magnitude"), ["path", "bin"], "left")
    rms = F.sqrt(F.avg(F.col("magnitude") * F.col("magnitude")))
    found = both.groupBy("path", "band").agg(rms.alias("rms"))
    return found.select("path", "band", F.when(F.col("rms") > 1e-12, 20 * F.log10("rms")).otherwise(F.lit(SILENCE_DB)).alias("db"))


def track_columns(track: DataFrame, columns: int = 96) -> DataFrame:
    """path, column, hz from track(path, chunk, at_seconds, hz, total_seconds): the upper median of the voiced chunks in each column's time.

    hz of 0 is unvoiced; a column of unvoiced chunks only has null. A column without a chunk has what the last chunk before it has, or the first chunk.
    """
    width = F.col("total_seconds") / columns
    column = F.least(F.lit(columns - 1), F.floor(F.col("at_seconds") / width)).cast("int")
    rows = track.filter("total_seconds > 0").withColumn("column", column)
    voiced = F.sort_array(F.collect_list(F.when(F.col("hz") > 0, F.col("hz"))))
    median = F.when(F.size(voiced) > 0, F.get(voiced, F.floor(F.size(voiced) / 2).cast("int")))
    full = rows.groupBy("path", "column").agg(median.alias("hz"), F.max_by("hz", "chunk").alias("last_hz"))
    path = rows.groupBy("path").agg(F.min_by("hz", "chunk").alias("first_hz"))
    grid = path.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).join(full.withColumn("here", F.lit(True)), ["path", "column"], "left")
    before = F.last("last_hz", ignorenulls=True).over(W.partitionBy("path").orderBy("column").rowsBetween(W.unboundedPreceding, -1))
    carried = F.nullif(F.coalesce(before, F.col("first_hz")), F.lit(0.0))
    return grid.select("path", "column", F.when(F.col("here"), F.col("hz")).otherwise(carried).alias("hz"))
