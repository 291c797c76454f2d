"""Scalar helpers on columns: levels, pitch, fades, panning, literals, strings."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


# Literals. Numbers are single precision, as amounts given on a command line are.
def gain_amount(text: str) -> float:
    """A multiplier from `-3db` or `50%`."""
    found = re.fullmatch(r"\s*(-?\d*\.?\d+)\s*(db|%)\s*", text.lower())
    if not found or (found[2] == "%" and float(found[1]) < 0):
        raise ValueError(f"not a gain: {text!r}")
    value = float(np.float32(found[1]))
    return value / 100 if found[2] == "%" else 10 ** (value / 20)


def duration_frames(text: str, sample_rate: Column, num_frames: Column) -> Column:
    """Frames of `10%`, `0.5s`, `20ms`, `100smp` or `100`: cut to whole frames, and to the signal's length."""
    found = re.fullmatch(r"\s*(\d*\.?\d+)\s*(s|ms|%|smp)?\s*", text.lower())
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    value, unit = float(np.float32(found[1])), found[2] or "smp"
    frames = {"s": value * sample_rate, "ms": value / 1000 * sample_rate, "%": min(value, 100.0) / 100 * num_frames, "smp": F.lit(value)}[unit]
    return F.least(frames.cast("bigint"), num_frames)


def pan_position(text: str) -> float:
    """-1 (left) to 1 (right) from `75L`, `100R`; decimals are cut."""
    found = re.fullmatch(r"\s*(\d+)(\.\d+)?\s*([LlRr])\s*", text)
    if not found or int(found[1]) > 100:
        raise ValueError(f"not a pan position: {text!r}")
    return int(found[1]) / 100 * (-1 if found[3] in "lL" else 1)


# Levels
def db_to_amp(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def amp_to_db(amp: Column) -> Column:
    """Null for silence."""
    return F.when(amp > 0, 20 * F.log10(amp))


def cents_between(low: Column, high: Column) -> Column:
    """1200 log2(high / low); 0 where low is 0."""
    return F.when(low == 0, F.lit(0.0)).otherwise(1200 * F.log2(high / low))


def with_cents(hz: Column, cents: Column) -> Column:
    return hz * F.pow(F.lit(2.0), cents / 1200)


def scaled(multiplier: Column, share: float) -> Column:
    """A multiplier's power: the share of it in decibels. 0 stays 0."""
    return F.when(multiplier == 0, F.lit(0.0)).otherwise(F.pow(multiplier, F.lit(float(share))))


def fade_gain(shape: str, at: Column, size: Column) -> Column:
    """Gain `at` frames from the silent end of a fade of `size` frames: exactly 0 there, 1 at size."""
    x = at / size
    db = 20 * F.log10(x)
    curve = {
        "linear": x,
        "sine": F.sin(x * (math.pi / 2)),
        "scurve": (1 - F.cos(x * math.pi)) / 2,
        "exp": F.pow(F.lit(0.5), (1 - x) * 5),
        "log": F.when(db < -30, x).otherwise((db + 30) / 30),
        "sqrt": F.sqrt(x),
    }[shape]
    return F.when(at == 0, F.lit(0.0)).when(at == size, F.lit(1.0)).otherwise(curve)


def pan_gain(position: float, channel: Column) -> Column:
    """Equal power: both channels at half power in the middle."""
    angle = position * math.pi / 4
    left, right = ((math.cos(angle) + s * math.sin(angle)) * math.sqrt(2) / 2 for s in (-1, 1))
    return F.when(channel == 0, F.lit(left)).otherwise(F.lit(right))


# Pitch
def note_pitch(note: Column) -> Column:
    """Hz of a MIDI note, to two decimals."""
    return F.round(440 * F.pow(F.lit(2.0), (note - 69) / 12), 2)


def nearest_note(hz: Column) -> Column:
    """The MIDI note 0 to 127 nearest in Hz, the lower one on a tie; 0 Hz gives 0."""
    about = F.when(hz > 0, F.round(69 + 12 * F.log2(hz / 440))).otherwise(F.lit(0.0)).cast("int")
    about = F.least(F.greatest(about, F.lit(1)), F.lit(126))
    near = F.transform(F.array(*[about + k for k in (-1, 0, 1)]), lambda n: F.struct(F.abs(note_pitch(n) - hz).alias("d"), n.alias("n")))
    far = F.when(hz <= 8.5, F.lit(0)).when(hz >= 12_200, F.lit(127))
    return F.coalesce(far, F.array_min(near)["n"])


def note_name(note: Column) -> Column:
    return F.concat(F.element_at(F.array(*[F.lit(n) for n in NOTE_NAMES]), (note % 12 + 1).cast("int")), (F.floor(note / 12) - 1).cast("string"))


def octave_near_middle_c(note: Column) -> Column:
    p = note % 12
    return F.when(p < 6, 60 + p).otherwise(48 + p)


# Strings
def snake_case(text: Column) -> Column:
    return F.translate(F.lower(text), " -", "__")


def camel_case(text: Column) -> Column:
    """Without spaces; upper case at the start, after a space and after a digit."""
    parts = F.split(text, " ")
    joined = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")
    pieces = F.split(joined, r"(?<=[0-9])")
    return F.array_join(F.transform(pieces, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))), "")


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def glob_regex(pattern: str) -> str:
    """`*` stays inside a folder, `**` does not; everything else is itself."""
    return "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", pattern))


def template(text: str, groups: dict[str, Column]) -> Column:
    """text with each `<name>` of groups put in."""
    parts = re.split(r"(<[^<>]+>)", text)
    return F.concat(*[groups[p[1:-1]].cast("string") if p[1:-1] in groups and p[:1] == "<" else F.lit(p) for p in parts if p])


def regex_groups(text: Column, pattern: str) -> dict[str, Column]:
    """`0`, `1`, ...: the groups of the whole-text match."""
    return {str(k): F.regexp_extract(text, whole(pattern), k) for k in range(re.compile(pattern).groups + 1)}


def alpha_id(n: Column) -> Column:
    """aaa, aab, ... zzz, then the number."""
    letter = lambda k: F.chr((97 + F.floor(n / k) % 26).cast("int"))
    return F.when(n < 17_576, F.concat(letter(676), letter(26), letter(1))).otherwise(n.cast("string"))
