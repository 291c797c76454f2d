"""Reports on signals: one record a file, as JSON, Lua or text, with fields picked by a pattern.

signals are in long form; about(path, bits_per_sample, metadata) is what their files say besides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonefold.functions import scalars as S
from tonefold.operators import metadata as M
from tonefold.operators import signals as O
from tonefold.operators import spectra as X

#: The fields of a report, in the order of their names.
FIELDS = (
    "bit_depth", "channels", "crest_factor", "crest_factor_db", "detected_pitch_cents_to_nearest", "detected_pitch_confidence", "detected_pitch_hz", "detected_pitch_nearest_note",
    "detected_pitch_nearest_note_midi", "frames", "length_seconds", "metadata", "peak_db", "peak_frame", "rms_db", "sample_rate",
)
#: Words that Lua keeps.
LUA_WORDS = "and break do else elseif end false for function if in local nil not or repeat return then true until while".split()


def info(signals: DataFrame, about: DataFrame | None = None, pitch: DataFrame | None = None) -> DataFrame:
    """path and FIELDS (those of a pitch only with pitch(path, hz, confidence)). Levels of silence are null, as is an empty record."""
    rows = O.levels(signals, "path").join(signals.groupBy("path").agg(F.max("num_channels").alias("channels"), F.max("sample_rate").alias("sample_rate")), "path")
    crest = F.when(F.col("rms") > 0, F.col("peak") / F.col("rms"))
    fields = {
        "bit_depth": F.lit(None).cast("int"), "metadata": F.lit(None).cast(M.METADATA), "channels": F.col("channels"), "sample_rate": F.col("sample_rate"), "frames": F.col("frames"), "length_seconds": F.col("frames") / F.col("sample_rate"),
        "rms_db": S.amp_to_db(F.col("rms")), "peak_db": S.amp_to_db(F.col("peak")), "peak_frame": F.col("peak_frame"), "crest_factor": crest, "crest_factor_db": S.amp_to_db(crest),
    }
    if about is not None:
        rows = rows.join(about.select("path", F.col("bits_per_sample").alias("_bits"), F.col("metadata").alias("_record")), "path", "left")
        fields |= {"bit_depth": F.col("_bits"), "metadata": F.when(~M.empty(F.col("_record")), F.col("_record"))}
    if pitch is not None:
        rows = rows.join(pitch.select("path", "hz", "confidence"), "path", "left")
        note = F.when(F.col("hz").isNotNull(), S.nearest_note(F.coalesce("hz", F.lit(0.0))))
        fields |= {
            "detected_pitch_hz": F.col("hz"), "detected_pitch_confidence": F.col("confidence"), "detected_pitch_nearest_note": S.note_name(note), "detected_pitch_nearest_note_midi": note,
            "detected_pitch_cents_to_nearest": S.cents_between(S.note_pitch(note), F.col("hz")),
        }
    return rows.select("path", *[fields[f].alias(f) for f in FIELDS if f in fields])


def picked(report: DataFrame, pattern: str) -> DataFrame:
    """path and the fields in whose name the pattern is found."""
    return report.select("path", *[c for c in report.columns if c != "path" and re.search(pattern, c)])


def as_json(report: DataFrame, path_as_key: bool = False) -> DataFrame:
    """path, json: a file's object, its fields in the order of their names and null where they have no value, with its path among them or as its one key."""
    names = sorted(c for c in report.columns if c != "path" or not path_as_key)
    fields = F.struct(*[F.col(c).cast("string").alias(c) if c == "path" else F.col(c) for c in names])
    options = {"ignoreNullFields": "false"}
    text = F.to_json(fields, options)
    if path_as_key:
        key = F.to_json(F.struct(F.col("path").cast("string").alias("k")))
        text = F.concat(F.lit("{"), F.substring(key, F.lit(6), F.length(key) - 6), F.lit(":"), text, F.lit("}"))
    return report.select("path", text.alias("json"))


def lua_key(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) and name not in LUA_WORDS else f'["{name}"]'


def lua_string(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.concat(F.lit('"'), text, F.lit('"'))


def lua(value: Column, kind, indent: int = 0) -> Column:
    """A value of a Spark type as Lua source; keys without a value are left out. Null is nil."""
    inner, outer = "  " * (indent + 1), "  " * indent

    def table(items: Column) -> Column:
        body = F.array_join(F.transform(items, lambda x: F.concat(F.lit(inner), x)), ",\n")
        return F.concat(F.lit("{\n"), body, F.when(F.size(items) > 0, F.lit("\n")).otherwise(F.lit("")), F.lit(outer + "}"))

    if kind.typeName() == "struct":
        parts = [F.when(value[f.name].isNotNull(), F.concat(F.lit(f"{lua_key(f.name)} = "), lua(value[f.name], f.dataType, indent + 1))) for f in sorted(kind, key=lambda f: f.name)]
        text = table(F.array_compact(F.array(*parts)))
    elif kind.typeName() == "array":
        text = table(F.transform(value, lambda x: F.coalesce(lua(x, kind.elementType, indent + 1), F.lit("nil"))))
    else:
        text = lua_string(value) if kind.typeName() == "string" else value.cast("string")
    return F.when(value.isNull(), F.lit("nil")).otherwise(text)


def as_lua(report: DataFrame) -> DataFrame:
    """path, lua: a file's table, its path among the fields."""
    names = sorted(report.columns)
    row = F.struct(*[F.col(c).cast("string").alias(c) if c == "path" else F.col(c) for c in names])
    kind = report.select(row.alias("r")).schema["r"].dataType
    return report.select("path", lua(row, kind, 1).alias("lua"))


def as_text(report: DataFrame) -> DataFrame:
    """path, text: a line for each thing to know."""
    two = lambda c, digits=2: F.format_string(f"%.{digits}f", F.col(c))
    record = F.coalesce(F.to_json("metadata"), F.lit("Contains no metadata"))
    lines = [
        record, F.format_string("Channels: %d", "channels"), F.format_string("Sample Rate: %d", "sample_rate"), F.format_string("Frames: %d", "frames"), F.concat(F.lit("Length: "), two("length_seconds"), F.lit(" seconds")),
        F.concat(F.lit("Bit-depth: "), F.col("bit_depth").cast("string")), F.concat(F.lit("RMS: "), two("rms_db"), F.lit(" dB")), F.concat(F.lit("Peak: "), two("peak_db"), F.format_string(" dB (at frame %d)", "peak_frame")),
        F.concat(F.lit("Crest Factor: "), two("crest_factor_db"), F.lit(" dB ("), two("crest_factor"), F.lit(")")),
    ]
    return report.select("path", F.concat_ws("\n", *lines).alias("text"))


def mir(signals: DataFrame, pitch: DataFrame | None = None, track: DataFrame | None = None, size: int = X.SIZE, columns: int = 96) -> DataFrame:
    """path, json: length, channels, correlation of a stereo signal, spectrum by bands, envelope, and with pitch(path, hz, confidence) and track (see pitch.track) those too."""
    listed = lambda df, key, value: df.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]).alias("values"))
    base = signals.groupBy("path").agg((F.max("num_frames") / F.max("sample_rate")).alias("length_seconds"), F.max("num_channels").alias("channels"), (F.max("sample_rate") / 2).alias("top"))
    base = base.join(O.phase_correlation(signals), "path", "left").withColumn("stereo", F.col("channels") > 1)
    parts = {"spectrum": listed(X.bands(X.magnitudes(signals, size), size), "band", "db"), "envelope": listed(O.envelope(signals, columns), "bucket", "rms")}
    # null columns keep their place in a list
    if track is not None:
        whole = X.track_columns(track, columns).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("column", "hz"))).alias("s"))
        parts["pitch_track"] = whole.select("path", F.transform("s", lambda x: x["hz"]).alias("values"))
    about = {
        "spectrum": ("dbfs", "log", F.lit(X.LOWEST), F.col("top")), "envelope": ("rms_linear", "linear", F.lit(0.0), F.col("length_seconds")), "pitch_track": ("hz", "linear", F.lit(0.0), F.col("length_seconds")),
    }
    for name, part in parts.items():
        unit, scale, low, high = about[name]
        base = base.join(part.withColumnRenamed("values", f"{name}_values"), "path", "left")
        record = F.struct(F.lit(unit).alias("unit"), F.lit(scale).alias("scale"), low.alias("min"), high.alias("max"), F.col(f"{name}_values").alias("values"))
        base = base.withColumn(name, record).drop(f"{name}_values")
    if pitch is not None:
        note = S.nearest_note(F.coalesce("hz", F.lit(0.0)))
        found = F.struct("hz", "confidence", S.note_name(note).alias("nearest_note"), note.alias("midi_note"), S.cents_between(S.note_pitch(note), F.col("hz")).alias("cents"))
        base = base.join(pitch.select("path", F.when(F.col("hz").isNotNull(), found).alias("pitch")), "path", "left")
    fields = F.struct("length_seconds", "channels", "stereo", F.col("correlation").alias("phase_correlation"), *[c for c in (*parts, "pitch") if c in base.columns])
    return base.select("path", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def pop_lines(pops: DataFrame) -> DataFrame:
    """path, channel, side (L, or R for any but the first), frames: the frames of a channel's pops in order, comma by comma."""
    frames = F.array_join(F.array_sort(F.collect_list("frame")).cast("array<string>"), ", ")
    return pops.groupBy("path", "channel").agg(frames.alias("frames"), F.count(F.lit(1)).alias("pops")).withColumn("side", F.when(F.col("channel") == 0, "L").otherwise("R"))
