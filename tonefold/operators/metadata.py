"""The metadata record of a signal: schema, JSON both ways, sampler mapping, loops, and the chunks of a WAV file as tables.

files: path, stem, folder, metadata (METADATA) and num_frames, sample_rate where an operator says so.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonefold.functions import scalars as S
from tonefold.operators.checks import problems
from tonefold.operators.sets import cut_end, cut_start, key_ranges, reversed_items, stretched

def fields(text: str) -> T.StructType:
    """A record of plain fields: `name type, name type`."""
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.split() for part in text.split(","))])


#: The record, its field names and their order; types of loops and of playing are numbers in this order.
SAMPLER = fields("fine_tune_cents int, gain_db int, low_note int, high_note int, low_velocity int, high_velocity int")
TIMING = fields("playback_type int, num_beats int, time_signature_denominator int, time_signature_numerator int, tempo float")
METADATA = T.StructType([
    T.StructField("midi_mapping", T.StructType([T.StructField("root_midi_note", T.IntegerType()), T.StructField("sampler_mapping", SAMPLER)])),
    T.StructField("timing_info", TIMING),
    T.StructField("loops", T.ArrayType(fields("name string, type int, start_frame bigint, num_frames bigint, num_times_to_loop int"))),
    T.StructField("markers", T.ArrayType(fields("name string, start_frame bigint"))),
    T.StructField("regions", T.ArrayType(fields("initial_marker_name string, name string, start_frame bigint, num_frames bigint"))),
])
LOOP_TYPES, PLAYBACK_TYPES = ("Forward", "Backward", "PingPong"), ("OneShot", "Loop")
#: What a mapping and timing hold before anything is set, and the limits that a file's fields allow.
DEFAULTS = {"fine_tune_cents": 0, "gain_db": 0, "low_note": 0, "high_note": 127, "low_velocity": 1, "high_velocity": 127}
TIMING_DEFAULTS = {"playback_type": 0, "num_beats": 4, "time_signature_denominator": 4, "time_signature_numerator": 4, "tempo": 0.0}
LIMITS = {"fine_tune_cents": (-50, 50), "gain_db": (-64, 64), "low_note": (0, 127), "high_note": (0, 127), "low_velocity": (1, 127), "high_velocity": (1, 127)}
ROOT = 60


# JSON
def empty(metadata: Column) -> Column:
    """Whether nothing is in a record; a null record is empty."""
    nothing = lambda c: F.coalesce(F.size(metadata[c]), F.lit(0)) < 1
    return metadata.isNull() | (metadata["midi_mapping"].isNull() & metadata["timing_info"].isNull() & nothing("loops") & nothing("markers") & nothing("regions"))


def exported(files: DataFrame) -> DataFrame:
    """line: a JSON object for each file, with its metadata (null if empty) and path."""
    record = F.when(~empty(F.col("metadata")), F.col("metadata"))
    return files.select(F.to_json(F.struct(record.alias("metadata"), F.col("path").cast("string").alias("path")), {"ignoreNullFields": "false"}).alias("line"))


def without_legacy_optionals(text: Column) -> Column:
    """JSON in which {"nullopt": true} has become null, and {"nullopt": false, "data": x} x, at any depth. Other text stays."""

    def plain(value):
        if isinstance(value, dict):
            if isinstance(value.get("nullopt"), bool):
                return None if value["nullopt"] else plain(value.get("data"))
            return {k: plain(v) for k, v in value.items()}
        return [plain(v) for v in value] if isinstance(value, list) else value

    @F.arrow_udf("string")
    def migrated(texts: pa.Array) -> pa.Array:
        def one(text: str | None) -> str | None:
            try:
                return text if text is None else json.dumps(plain(json.loads(text)), ensure_ascii=False)
            except ValueError:
                return text

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return F.when(F.contains(text, F.lit('"nullopt"')), migrated(text)).otherwise(text)


def entries(lines: DataFrame) -> DataFrame:
    """path, metadata, line from lines(value, line): an object a line, or an array of them in one value. Blank lines go; a broken one gives nulls."""
    one = f"struct<metadata: {METADATA.simpleString()}, path: string>"
    rows = lines.filter(F.trim("value") != "").withColumn("value", without_legacy_optionals(F.trim("value")))
    many = F.when(F.startswith("value", F.lit("[")), F.from_json("value", f"array<{one}>")).otherwise(F.array(F.from_json("value", one)))
    return rows.select("line", F.posexplode(many).alias("place", "e")).select("e.path", "e.metadata", F.struct("line", "place").alias("line"))


# The time axis
def on_items(metadata: Column, change) -> Column:
    """metadata with change(items, whether they have a length) for loops, markers and regions, in one new record; null stays."""
    fields = [(change(metadata[f.name], f.name != "markers") if f.name in ("loops", "markers", "regions") else metadata[f.name]).cast(f.dataType).alias(f.name) for f in METADATA]
    return F.when(metadata.isNotNull(), F.struct(*fields).cast(METADATA))


def stretched_record(metadata: Column, factor: Column) -> Column:
    return on_items(metadata, lambda items, lengths: stretched(items, factor, lengths))


def cut_record(metadata: Column, from_start: Column, num_frames: Column) -> Column:
    """After the signal was cut to num_frames and then lost from_start frames at its start."""
    return on_items(metadata, lambda items, lengths: cut_start(cut_end(items, num_frames, lengths), from_start))


def reversed_record(metadata: Column, num_frames: Column) -> Column:
    return on_items(metadata, lambda items, lengths: reversed_items(items, num_frames, lengths))


# Sampler mapping
def with_sampler(metadata: Column, root: Column | None = None, **fields: Column) -> Column:
    """metadata with the root note and fields of the sampler mapping set; null values leave what is there, or the default."""
    mapping = metadata["midi_mapping"]
    old = mapping["sampler_mapping"]
    sampler = F.struct(*[F.coalesce(*([fields[k].cast("int")] if k in fields else []), old[k], F.lit(v)).alias(k) for k, v in DEFAULTS.items()])
    note = F.coalesce(*([root.cast("int")] if root is not None else []), mapping["root_midi_note"], F.lit(ROOT))
    return with_field(metadata, "midi_mapping", F.struct(note.alias("root_midi_note"), sampler.alias("sampler_mapping")))


def with_field(metadata: Column, name: str, value: Column) -> Column:
    """metadata (an empty record where null) with another value of a field."""
    fields = [(value if f.name == name else metadata[f.name]).cast(f.dataType).alias(f.name) for f in METADATA]
    return F.struct(*fields).cast(METADATA)


def argument(text: str, stem: Column, least: int = 0) -> Column:
    """A value from `unchanged` (null), a number from `least` to 127, or a pattern whose one group names it in the whole stem."""
    if text == "unchanged":
        return F.lit(None).cast("int")
    if text.lstrip("-").isdigit():
        if not least <= int(text) <= 127:
            raise ValueError(f"not from {least} to 127: {text}")
        return F.lit(int(text))
    return F.when(stem.rlike(S.whole(text)), S.regex_groups(stem, text)["1"].try_cast("int"))


def unnamed_values(files: DataFrame, *texts: str) -> DataFrame:
    """path, problem: files whose stem a pattern among the arguments doesn't match, or in which it names no number."""
    found = problems(files, F.lit(False), "")
    for text in texts:
        if text != "unchanged" and not text.lstrip("-").isdigit():
            found = found.unionByName(problems(files, argument(text, F.col("stem")).isNull(), f"no number by {text}"))
    return found


#: What a root's argument may ask for, and the semitones it adds to the detected note.
DETECTED = {"auto-detect": 0, "auto-detect-octave-plus-1": 12, "auto-detect-octave-plus-2": 24, "auto-detect-octave-minus-1": -12, "auto-detect-octave-minus-2": -24}


def embed_root(files: DataFrame, text: str, pitch: DataFrame | None = None) -> DataFrame:
    """files whose metadata has the root note by an argument, or by pitch(path, hz) for the auto-detect ones; 60 where no pitch was found."""
    if not text.startswith("auto-detect"):
        return files.withColumn("metadata", with_sampler(F.col("metadata"), argument(text, F.col("stem"))))
    rows = files.join(pitch.select("path", "hz"), "path", "left")
    note = F.when(F.col("hz").isNotNull(), S.nearest_note(F.coalesce("hz", F.lit(0.0)))).otherwise(F.lit(ROOT))
    note = S.octave_near_middle_c(note) if text == "auto-detect-nearest-to-middle-c" else F.greatest(F.lit(0), F.least(F.lit(127), note + DETECTED[text]))
    return rows.withColumn("metadata", with_sampler(F.col("metadata"), note)).drop("hz")


def embed_note_range(files: DataFrame, low: str, high: str) -> DataFrame:
    return files.withColumn("metadata", with_sampler(F.col("metadata"), low_note=argument(low, F.col("stem")), high_note=argument(high, F.col("stem"))))


def embed_velocity_range(files: DataFrame, low: str, high: str) -> DataFrame:
    return files.withColumn("metadata", with_sampler(F.col("metadata"), low_velocity=argument(low, F.col("stem"), 1), high_velocity=argument(high, F.col("stem"), 1)))


def embed_mapped_ranges(files: DataFrame) -> DataFrame:
    """files whose note ranges fill 0 to 127 in each folder, by root note (60 where none is set)."""
    roots = files.withColumn("root", F.coalesce(F.col("metadata.midi_mapping.root_midi_note"), F.lit(ROOT)))
    return key_ranges(roots).withColumn("metadata", with_sampler(F.col("metadata"), low_note=F.col("low"), high_note=F.col("high"))).drop("root", "low", "high")


def without_sampler(files: DataFrame) -> DataFrame:
    """files without a midi mapping; loops, markers and regions stay."""
    return files.withColumn("metadata", F.when(F.col("metadata").isNotNull(), with_field(F.col("metadata"), "midi_mapping", F.lit(None))))


def within_limits(metadata: Column) -> Column:
    """metadata with the sampler's fields, and the root note, as far as a file's fields go."""
    mapping = metadata["midi_mapping"]
    bound = lambda c, low, high: F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))
    sampler = mapping["sampler_mapping"]
    fields = F.when(sampler.isNotNull(), F.struct(*[bound(sampler[k], *v).alias(k) for k, v in LIMITS.items()]))
    return with_field(metadata, "midi_mapping", F.when(mapping.isNotNull(), F.struct(bound(mapping["root_midi_note"], 0, 127).alias("root_midi_note"), fields.alias("sampler_mapping"))))


# Loops
def loop_points(files: DataFrame, start: str, end: str | None = None, length: str | None = None) -> DataFrame:
    """files with loop_start, loop_end: a start below 0 counts from the end of the signal, and so does an end of 0 or below."""
    if (end is None) == (length is None):
        raise ValueError("give an end or a length")
    rate, n = F.col("sample_rate"), F.col("num_frames")
    from_end = lambda text: n - S.duration_frames(text.strip().lstrip("-"), rate, n)
    first = from_end(start) if start.strip()[:1] == "-" else S.duration_frames(start, rate, n)
    if length is not None:
        last = first + S.duration_frames(length, rate, n)
    else:
        whole = float("".join(c for c in end if c.isdigit() or c in ".-") or 0) <= 0
        last = from_end(end) if whole else S.duration_frames(end, rate, n)
    return files.withColumns({"loop_start": first, "loop_end": last})


def unloopable(points: DataFrame) -> DataFrame:
    """path, problem of the files whose loop is empty or ends after the signal."""
    n = F.col("num_frames")
    return problems(points, (n > 0) & ((F.col("loop_start") >= F.col("loop_end")) | (F.col("loop_start") >= n) | (F.col("loop_end") > n)), "the loop is empty or leaves the signal")


def add_loop(files: DataFrame, start: str, end: str | None = None, length: str | None = None, name: str | None = None, kind: str = "Forward", times: int = 0) -> DataFrame:
    """files whose metadata has one more loop and plays as a loop. Empty signals stay as they are, as do those that unloopable() names."""
    points, m = loop_points(files, start, end, length), F.col("metadata")
    s, e, n = F.col("loop_start"), F.col("loop_end"), F.col("num_frames")
    loop = F.struct(F.lit(name).alias("name"), F.lit(LOOP_TYPES.index(kind)).alias("type"), s.alias("start_frame"), (e - s).alias("num_frames"), F.lit(times).alias("num_times_to_loop"))
    loops = F.concat(F.coalesce(m["loops"], F.array().cast(METADATA["loops"].dataType)), F.array(loop.cast(METADATA["loops"].dataType.elementType)))
    timing = F.struct(*[(F.lit(1) if k == "playback_type" else F.coalesce(m["timing_info"][k], F.lit(v))).alias(k) for k, v in TIMING_DEFAULTS.items()])
    changed = with_field(with_field(m, "loops", loops), "timing_info", timing)
    return points.withColumn("metadata", F.when((s < e) & (s < n) & (e <= n), changed).otherwise(m)).drop("loop_start", "loop_end")


# The chunks of a WAV file as tables: cues(path, cue_id, position), labels(path, cue_id, place, text), loops(path, cue_id, place, type, first, last, plays), regions(path, cue_id, place, name, length)
def texts_of(labels: DataFrame, last: bool) -> DataFrame:
    """path, cue_id, text: the last or the first label of each cue that has any text."""
    pick = F.max_by if last else F.min_by
    return labels.filter(F.length("text") > 0).groupBy("path", "cue_id").agg(pick("text", "place").alias("text"))


def named_loops(loops: DataFrame, labels: DataFrame, files: DataFrame) -> DataFrame:
    """path, place, name, type, start_frame, num_frames, num_times_to_loop of the loops inside files(path, num_frames). A loop's last frame is in it."""
    rows = loops.join(files.select("path", "num_frames"), "path").filter((F.col("first") < F.col("num_frames")) & (F.col("last") < F.col("num_frames")))
    kind = F.when(F.col("type") == 1, 2).when(F.col("type") == 2, 1).otherwise(0)
    return rows.join(texts_of(labels, last=True), ["path", "cue_id"], "left").select(
        "path", "place", F.col("text").alias("name"), kind.alias("type"), F.col("first").alias("start_frame"), (F.col("last") + 1 - F.col("first")).alias("num_frames"), F.col("plays").alias("num_times_to_loop"),
    )


def named_regions(regions: DataFrame, cues: DataFrame, labels: DataFrame, files: DataFrame) -> DataFrame:
    """path, place, initial_marker_name, name, start_frame, num_frames of the regions that have a cue and lie inside their signal."""
    rows = regions.join(cues, ["path", "cue_id"]).join(files.select("path", "num_frames"), "path").join(texts_of(labels, last=True), ["path", "cue_id"], "left")
    inside = (F.col("position") < F.col("num_frames")) & (F.col("position") + F.col("length") <= F.col("num_frames"))
    return rows.filter(inside).select("path", "place", F.col("text").alias("initial_marker_name"), F.when(F.length("name") > 0, F.col("name")).alias("name"), F.col("position").alias("start_frame"), F.col("length").alias("num_frames"))


def named_markers(cues: DataFrame, labels: DataFrame, files: DataFrame) -> DataFrame:
    """path, cue_id, name, start_frame of all cues up to their signal's end."""
    rows = cues.join(files.select("path", "num_frames"), "path").filter(F.col("position") <= F.col("num_frames"))
    return rows.join(texts_of(labels, last=False), ["path", "cue_id"], "left").select("path", "cue_id", F.col("text").alias("name"), F.col("position").alias("start_frame"))


def cues_of(files: DataFrame) -> DataFrame:
    """path, cue_id, name, position: the cues that loops, regions and markers of files(path, metadata) take when written, numbered in that order from 0."""
    parts = []
    for k, (field, name) in enumerate((("loops", "name"), ("regions", "initial_marker_name"), ("markers", "name"))):
        item = files.select("path", F.posexplode(F.col("metadata")[field]).alias("place", "x"))
        parts.append(item.select("path", F.lit(k).alias("kind"), "place", F.col("x")[name].alias("name"), F.col("x.start_frame").alias("position")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.withColumn("cue_id", F.row_number().over(W.partitionBy("path").orderBy("kind", "place")) - 1).select("path", "cue_id", "name", "position")
