"""Filters and resampling of signals by blocks: no channel is ever one array.

Filters. A block of a second-order filter maps the two values of state that it starts with to those
that it ends with: an affine map, whose matrix all blocks share and whose vector is the end of a run
from rest. Maps compose associatively, so the states come from a scan in two levels, spans of blocks
and then the spans' starts; then each block runs again from its state.

Resampling. A block takes a halo of its neighbours' samples. It is low-passed by a Kaiser-designed
filter and brought to OVER times its rate in one multiplication of spectra (overlap-save), and read
off at the output's places by a short Kaiser interpolator, which the oversampling leaves a wide
transition. So any ratio, also one that changes from signal to signal, has the same attenuation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNAL = ["path", "frame", "channel", "value", "num_frames", "num_channels", "sample_rate"]
#: Frames of a block, and blocks of a span: a span's summaries, and all spans' of a channel, are lists of a row.
BLOCK, SPAN = 1 << 14, 1 << 12
Coefficients = tuple[tuple[float, float, float], tuple[float, float]]


def in_blocks(df: DataFrame, block: int, *more: str) -> DataFrame:
    """path, channel, block, samples, num_frames, num_channels, sample_rate and more columns that are the same for a whole signal."""
    points = F.array_sort(F.collect_list(F.struct("frame", "value")))
    rows = df.withColumn("block", F.floor(F.col("frame") / block))
    same = [F.max(c).alias(c) for c in ("num_frames", "num_channels", "sample_rate", *more)]
    return rows.groupBy("path", "channel", "block").agg(F.transform(points, lambda p: p["value"]).alias("samples"), *same)


def in_frames(rows: DataFrame) -> DataFrame:
    """The long form of rows(path, channel, first_frame, samples, num_frames, num_channels, sample_rate)."""
    points = rows.select("path", (F.col("first_frame")).alias("a"), F.posexplode("samples").alias("k", "value"), "channel", "num_frames", "num_channels", "sample_rate")
    return points.withColumn("frame", F.col("a") + F.col("k")).select(*SIGNAL)


def list_column(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0)))


def alike(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(values, row numbers, samples as a matrix) of the rows with one number of samples and the same values of columns."""
    lists = batch.column("samples")
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    keys: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(sizes.tolist(), *(batch.column(c).to_pylist() for c in columns))):
        keys.setdefault(key, []).append(k)
    for (n, *key), rows in keys.items():
        at = np.array(rows)
        yield tuple(key), at, flat[starts[at][:, None] + np.arange(n)]


# Recursive filters
#: Frames that run side by side within a block.
SIDE_BY_SIDE = 256


def matrix(a: tuple[float, float], n: int = 1) -> np.ndarray:
    """What n frames without input make of the state."""
    return np.linalg.matrix_power(np.array([[-a[0], 1.0], [-a[1], 0.0]]), n)


def recursed(x: np.ndarray, b: tuple[float, float, float], a: tuple[float, float], state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows filtered by y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] - a1 y[n-1] - a2 y[n-2], the states that they end with), from state or from rest.

    The state is what the frames so far add to the next two outputs. Parts of a row run side by side from rest; then each part's
    start, which follows from the part before, adds its own response, which is known.
    """
    rows, n = x.shape
    state = np.zeros((rows, 2)) if state is None else state
    if n % SIDE_BY_SIDE and n > SIDE_BY_SIDE:
        whole = n - n % SIDE_BY_SIDE
        first, state = recursed(x[:, :whole], b, a, state)
        last, state = recursed(x[:, whole:], b, a, state)
        return np.concatenate((first, last), axis=1), state
    size = min(SIDE_BY_SIDE, max(n, 1))
    parts = n // size
    ins = x.reshape(rows, parts, size)
    out, s1, s2 = np.empty((size, rows, parts)), np.zeros((rows, parts)), np.zeros((rows, parts))
    for k in range(size if n else 0):
        now = ins[:, :, k]
        y = b[0] * now + s1
        s1, s2 = b[1] * now - a[0] * y + s2, b[2] * now - a[1] * y
        out[k] = y
    out = out.transpose(1, 2, 0).copy()
    response, over = np.empty((size, 2)), np.eye(2)
    for k in range(size):
        response[k] = over[0]
        over = matrix(a) @ over
    for k in range(parts):
        out[:, k] += state @ response.T
        state = state @ over.T + np.stack((s1[:, k], s2[:, k]), axis=1)
    return out.reshape(rows, n), state


def filtered(df: DataFrame, design: Callable[[float], Coefficients], block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Each channel filtered from rest by the coefficients (b, a) that design gives for its rate."""
    blocks = in_blocks(df, block)
    kind = T.StructType([blocks.schema[c] for c in ("path", "channel", "block", "sample_rate")] + [T.StructField(c, T.DoubleType()) for c in ("s1", "s2")])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 2))
            for (rate,), at, x in alike(batch, "sample_rate"):
                out[at] = recursed(x, *design(rate))[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "channel", "block", "sample_rate")), pa.array(out[:, 0]), pa.array(out[:, 1])], kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, state = [None] * batch.num_rows, np.stack([batch.column(c).to_numpy() for c in ("s1", "s2")], axis=1)
            for (rate,), at, x in alike(batch, "sample_rate"):
                for k, row in zip(at, recursed(x, *design(rate), state[at])[0]):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([list_column(out) if c == "samples" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    followed = blocks.filter((F.col("block") + 1) * block < F.col("num_frames"))
    states = carried(followed.select("path", "channel", "block", "sample_rate", "samples").mapInArrow(ends, kind), design, block, span)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("s1", "s2")}
    ready = blocks.join(states, ["path", "channel", "block"], "left").withColumns(zero).withColumn("first_frame", F.col("block") * block)
    done = ready.select("path", "channel", "first_frame", "samples", "num_frames", "num_channels", "sample_rate", "s1", "s2")
    return in_frames(done.mapInArrow(run, done.schema))


def carried(ends: DataFrame, design: Callable[[float], Coefficients], block: int, span: int) -> DataFrame:
    """path, channel, block, s1, s2: the state that each block but the first starts with, from ends(path, channel, block, sample_rate, s1, s2) from rest."""
    key = ["path", "channel", "sample_rate"]
    part = F.array_sort(F.collect_list(F.struct("block", "s1", "s2")))
    spans = ends.groupBy(*key, F.floor(F.col("block") / span).alias("span")).agg(part.alias("parts"))
    names = lambda *more: T.StructType([*(spans.schema[c] for c in key), T.StructField("span", T.LongType()), *(T.StructField(c, k) for c, k in more)])
    double, listed = T.DoubleType(), T.ArrayType(T.DoubleType())

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states behind each block of a span that starts from rest."""
        for batch in batches:
            out1, out2 = [], []
            for rate, parts in zip(batch.column("sample_rate").to_pylist(), batch.column("parts")):
                over, s1, s2 = matrix(design(rate)[1], block), [], []
                state = np.zeros(2)
                for c1, c2 in zip(*(parts.values.field(c).to_numpy() for c in ("s1", "s2"))):
                    state = over @ state + (c1, c2)
                    s1.append(state[0])
                    s2.append(state[1])
                out1.append(np.array(s1))
                out2.append(np.array(s2))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "span")), list_column(out1), list_column(out2)], [*key, "span", "s1", "s2"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states that a channel's spans start with."""
        for batch in batches:
            rows, of = [], []
            for k, (rate, parts) in enumerate(zip(batch.column("sample_rate").to_pylist(), batch.column("parts").to_pylist())):
                over, state = matrix(design(rate)[1], block * span), np.zeros(2)
                for p in parts:
                    rows.append((p["span"], *state))
                    of.append(k)
                    state = over @ state + (p["e1"], p["e2"])
            span_, h1, h2 = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of, pa.int64())) for c in key), pa.array(span_, pa.int64()), pa.array(h1, pa.float64()), pa.array(h2, pa.float64())], [*key, "span", "h1", "h2"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States within a span, and what is left of its start."""
        for batch in batches:
            out1, out2 = [], []
            for rate, h1, h2, s1, s2 in zip(*(batch.column(c).to_pylist() for c in ("sample_rate", "h1", "h2")), batch.column("s1"), batch.column("s2")):
                over, state = matrix(design(rate)[1], block), np.array((h1, h2))
                left = np.empty((len(s1), 2))
                for k in range(len(left)):
                    left[k] = state = over @ state
                out1.append(s1.values.to_numpy() + left[:, 0])
                out2.append(s2.values.to_numpy() + left[:, 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "span")), list_column(out1), list_column(out2)], [*key, "span", "s1", "s2"])

    local = spans.mapInArrow(within, names(("s1", listed), ("s2", listed)))
    last = lambda c: F.element_at(c, -1)
    heads = local.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("span", last("s1").alias("e1"), last("s2").alias("e2")))).alias("parts"))
    both = local.join(heads.mapInArrow(across, names(("h1", double), ("h2", double))), [*key, "span"])
    states = both.mapInArrow(whole, names(("s1", listed), ("s2", listed)))
    each = states.select("path", "channel", "span", F.posexplode(F.arrays_zip("s1", "s2")).alias("k", "s"))
    return each.select("path", "channel", (F.col("span") * span + F.col("k") + 1).alias("block"), "s.s1", "s.s2")


# Resampling
#: Attenuation of what is cut off, in decibels, and the share of the lower rate's band below the cut; times the rate that is gone through.
ATTENUATION, PASSED, OVER = 183.0, 0.98, 4
BETA = 0.1102 * (ATTENUATION - 8.7)
#: Kaiser's lengths for these transitions: frames of the lower rate on either side of the low pass, and of OVER times the rate of the interpolator.
HALF = math.ceil((ATTENUATION - 7.95) / (2.285 * math.pi * (1 - PASSED)) / 2)
TAPS = math.ceil((ATTENUATION - 7.95) / (2.285 * math.pi * (2 - 2 / OVER)) / 2) + 2
#: Samples that are transformed together.
AT_ONCE = 1 << 20


def kaiser(share: np.ndarray) -> np.ndarray:
    """The window at shares -1 to 1 of its half."""
    return np.i0(BETA * np.sqrt(np.maximum(0, 1 - share * share))) / np.i0(BETA)


def reach(ratio: float) -> int:
    """Frames on either side that a block needs."""
    return math.ceil(HALF / min(1.0, ratio)) + TAPS + 2


@lru_cache(8)
def low_pass(ratio: float) -> np.ndarray:
    """Its taps at the old rate: flat to PASSED of the lower rate's band, nothing above the band."""
    lower = min(1.0, ratio)
    half = math.ceil(HALF / lower)
    k, cut = np.arange(-half, half + 1), lower * (1 + PASSED) / 2
    return cut * np.sinc(cut * k) * kaiser(k / half)


def smooth(n: int) -> int:
    """The least even number from n on with no prime factor over 5."""
    n += n % 2
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 2


def read_off(x: np.ndarray, low: int, ratio: float, a: int, b: int) -> np.ndarray:
    """Frames a to b of rows at ratio times their rate. x has the rows' frames from low on, as far as these frames reach or there are any."""
    out = np.zeros((len(x), b - a))
    if b <= a:
        return out
    taps, far = low_pass(ratio), reach(ratio)
    first = math.floor(a / ratio) - far
    n = math.floor((b - 1) / ratio) + far + 1 - first
    size = smooth(n + len(taps))
    spectrum = np.fft.rfft(taps, size)
    place = (np.arange(a, b) / ratio - first + (len(taps) - 1) // 2) * OVER
    base = np.floor(place).astype(np.int64)
    offsets = np.arange(1 - TAPS, TAPS + 1)
    distance = (place - base)[:, None] - offsets
    weights = np.sinc(distance) * kaiser(distance / TAPS)
    left, right = max(0, low - first), max(0, first - low)
    taken = x[:, right : right + n - left]
    for k in range(0, len(x), max(1, AT_ONCE // (OVER * size))):
        rows = slice(k, k + max(1, AT_ONCE // (OVER * size)))
        padded = np.zeros((len(taken[rows]), size))
        padded[:, left : left + taken.shape[1]] = taken[rows]
        high = np.zeros((len(padded), OVER * size // 2 + 1), complex)
        high[:, : size // 2 + 1] = np.fft.rfft(padded) * spectrum
        fine = np.fft.irfft(high, OVER * size) * OVER
        for j, offset in enumerate(offsets):
            out[rows] += fine[:, base + offset] * weights[:, j]
    return out


def resampled_rows(x: np.ndarray, ratio: float, block: int = BLOCK) -> np.ndarray:
    """Rows at ratio times their rate: trunc(frames * ratio) frames."""
    n = int(x.shape[1] * ratio)
    step = max(1, int(block * ratio))
    parts = [read_off(x, 0, ratio, a, min(n, a + step)) for a in range(0, n, step)]
    return np.concatenate(parts, axis=1) if parts else np.zeros((len(x), 0))


def resampled(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each channel at `ratio`, a column of df, times its rate, the nominal rate kept: trunc(frames * ratio) frames."""
    rows = in_blocks(df, block, "ratio")
    far = (F.ceil(F.lit(HALF) / F.least(F.lit(1.0), F.col("ratio"))) + TAPS + 2).cast("long")
    steps = F.ceil(far / block)
    to = rows.withColumn("to", F.explode(F.sequence(F.greatest(F.lit(0), F.col("block") - steps), F.least(F.floor((F.col("num_frames") - 1) / block), F.col("block") + steps))))
    begin = F.col("block") * block
    low, high = F.greatest(begin, F.col("to") * block - far), F.least(begin + F.size("samples"), (F.col("to") + 1) * block + far)
    pieces = to.filter(low < high).select(
        "path", "channel", F.col("to").alias("block"), low.alias("low"), F.slice("samples", (low - begin + 1).cast("int"), (high - low).cast("int")).alias("piece"), "num_frames", "num_channels", "sample_rate", "ratio",
    )
    joined = pieces.groupBy("path", "channel", "block").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "piece"))), lambda p: p["piece"])).alias("samples"), F.min("low").alias("low"), *[F.max(c).alias(c) for c in ("num_frames", "num_channels", "sample_rate", "ratio")],
    )
    kind = T.StructType([joined.schema["path"], joined.schema["channel"], T.StructField("first_frame", T.LongType()), joined.schema["samples"], *(joined.schema[c] for c in ("num_frames", "num_channels", "sample_rate"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, first, frames = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for (at_block, start, n, ratio), at, x in alike(batch, "block", "low", "num_frames", "ratio"):
                new = int(n * ratio)
                a, b = (min(new, math.ceil(k * block * ratio)) for k in (at_block, at_block + 1))
                b = new if (at_block + 1) * block >= n else b
                first[at], frames[at] = a, new
                for k, row in zip(at, read_off(x, start, ratio, a, b)):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("channel"), pa.array(first), list_column(out), pa.array(frames), batch.column("num_channels"), batch.column("sample_rate")], kind.names)

    return in_frames(joined.mapInArrow(run, kind))
