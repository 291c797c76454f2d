"""Renaming: key ranges, regular expressions, prefix and suffix, notes, counters, pitch and folder, in that order.

files: path, folder (null without one), stem.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonefold.functions import scalars as S
from tonefold.operators.checks import problems
from tonefold.operators.sets import counted, key_ranges, note_to_midi

#: The variables of a new name.
VARIABLES = (
    "<counter>",
    "<alpha-counter>",
    "<detected-pitch>",
    "<detected-midi-note>",
    "<detected-midi-note-octave-plus-1>",
    "<detected-midi-note-octave-plus-2>",
    "<detected-midi-note-octave-minus-1>",
    "<detected-midi-note-octave-minus-2>",
    "<detected-midi-note-octave-nearest-to-middle-c>",
    "<detected-note>",
    "<parent-folder>",
    "<parent-folder-snake>",
    "<parent-folder-camel>",
)


@dataclass(frozen=True)
class AutoMap:
    """A pattern of whole stems, its group that holds the root note, and the new name: `<lo>`, `<hi>`, `<root>` and groups `<n>`."""

    pattern: str
    group: int
    template: str


def mapped_names(files: DataFrame, by: AutoMap) -> DataFrame:
    """files with auto_root, auto_name: null where the pattern doesn't match, or the group holds no note from 0 to 127."""
    groups = S.regex_groups(F.col("stem"), by.pattern)
    matched = F.col("stem").rlike(S.whole(by.pattern))
    root = F.when(matched, groups[str(by.group)].try_cast("int"))
    rows = files.withColumn("auto_root", F.when(root.between(0, 127), root))
    # Only files with a root share a folder's notes out.
    found = key_ranges(rows.filter("auto_root IS NOT NULL"), root="auto_root")
    name = S.template(by.template, groups | {"lo": F.col("low"), "hi": F.col("high"), "root": F.col("auto_root")})
    return found.withColumn("auto_name", name).drop("low", "high").unionByName(rows.filter("auto_root IS NULL").withColumn("auto_name", F.lit(None).cast("string")))


def unmappable(files: DataFrame, by: AutoMap) -> DataFrame:
    """path, problem: files that match the pattern without a root note from 0 to 127."""
    root = S.regex_groups(F.col("stem"), by.pattern)[str(by.group)].try_cast("int")
    return problems(files, F.col("stem").rlike(S.whole(by.pattern)) & ~F.coalesce(root.between(0, 127), F.lit(False)), "no root note from 0 to 127")


def with_pitch_variables(name: Column, hz: Column) -> Column:
    """The variables of a detected pitch: the nearest note's."""
    note = S.nearest_note(hz)
    text = lambda c: c.cast("int").cast("string")
    values = {f"<detected-midi-note-octave-{word}-{k}>": text(note + sign * 12 * k) for word, sign in (("plus", 1), ("minus", -1)) for k in (1, 2)}
    values |= {
        "<detected-midi-note-octave-nearest-to-middle-c>": text(S.octave_near_middle_c(note)), "<detected-pitch>": text(F.bround(S.note_pitch(note), 0)),
        "<detected-midi-note>": text(note), "<detected-note>": S.note_name(note),
    }
    for variable, value in values.items():
        name = F.replace(name, F.lit(variable), value)
    return name


def renamed(files: DataFrame, auto_map: AutoMap | None = None, regex: tuple[str, str] | None = None, prefix: str = "", suffix: str = "", notes: bool = False, zero_octave: int = -1, pitch: DataFrame | None = None) -> DataFrame:
    """files with name, renamed and new_path. pitch(path, hz) is joined only where a given text asks for it.

    A file that no step matches keeps its name; what problems_of() names is an error.
    """
    given = " ".join([auto_map.template if auto_map else "", regex[1] if regex else "", prefix, suffix])
    rows = mapped_names(files, auto_map) if auto_map else files
    name = F.coalesce("auto_name", "stem") if auto_map else F.col("stem")
    done = F.col("auto_name").isNotNull() if auto_map else F.lit(False)
    if regex:
        matched = name.rlike(S.whole(regex[0]))
        done, name = done | matched, F.when(matched, S.template(regex[1], S.regex_groups(name, regex[0]))).otherwise(name)
    rows = rows.withColumns({"name": F.concat(F.lit(prefix), name, F.lit(suffix)), "renamed": done | F.lit(bool(prefix or suffix))})
    if notes:
        rows = rows.withColumn("noted", note_to_midi(F.col("name"), zero_octave))
        rows = rows.withColumns({"renamed": F.col("renamed") | (F.col("noted") != F.col("name")), "name": F.col("noted")}).drop("noted")
    if "counter>" in given:
        asks = F.col("renamed") & (F.contains("name", F.lit("<counter>")) | F.contains("name", F.lit("<alpha-counter>")))
        some = counted(rows.filter(asks))
        number = F.replace("name", F.lit("<counter>"), F.col("counter").cast("string"))
        some = some.withColumn("name", F.replace(number, F.lit("<alpha-counter>"), S.alpha_id(F.col("counter")))).drop("counter")
        rows = some.unionByName(rows.filter(~asks))
    if "<detected-" in given and pitch is not None:
        rows = rows.join(pitch.select("path", "hz"), "path", "left")
        ready = F.col("renamed") & F.col("hz").isNotNull()
        rows = rows.withColumn("name", F.when(ready, with_pitch_variables(F.col("name"), F.col("hz"))).otherwise(F.col("name"))).drop("hz")
    if "<parent-folder" in given:
        folder, text = F.regexp_extract("folder", "([^/]*)$", 1), F.col("name")
        for variable, value in (("<parent-folder>", folder), ("<parent-folder-snake>", S.snake_case(folder)), ("<parent-folder-camel>", S.camel_case(folder))):
            text = F.replace(text, F.lit(variable), value)
        rows = rows.withColumn("name", F.when(F.col("renamed") & F.col("folder").isNotNull(), text).otherwise(F.col("name")))
    # The name's own last dotted part gives way to the extension.
    extension = F.regexp_extract("path", r"[^/](\.[^./]*)$", 1)
    new = F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""), extension)
    return rows.withColumn("new_path", F.when(F.col("renamed"), new).otherwise(F.col("path"))).drop("auto_root", "auto_name")


def problems_of(rows: DataFrame) -> DataFrame:
    """path, problem: renamed rows in whose name a variable is left: unknown, or without what it needs; and new paths that files share."""
    left = F.regexp_extract("name", "(" + "|".join(map(re.escape, VARIABLES)) + r"|<\w+>)", 1)
    shared = rows.groupBy("new_path").agg(F.count(F.lit(1)).alias("files"))
    return problems(rows, F.col("renamed") & (left != ""), F.concat(F.lit("no value for "), left)).unionByName(problems(shared, F.col("files") > 1, "more than one file would have this path", "new_path"))


def with_affixes(files: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """files with name: prefix, stem and suffix."""
    return files.withColumn("name", F.concat(F.lit(prefix), "stem", F.lit(suffix)))


def moved(files: DataFrame, folder: str) -> DataFrame:
    """files with new_path in folder."""
    return files.withColumn("new_path", F.concat(F.lit(f"{folder}/"), F.regexp_extract("path", "([^/]*)$", 1)))


def expected_note(files: DataFrame, pattern: str, zero_octave: int = -1) -> DataFrame:
    """files with expected (the note that the stem's group 1 names, octaves counted from zero_octave) and expected_hz; null where it names none from 0 to 127."""
    note = F.when(F.col("stem").rlike(S.whole(pattern)), S.regex_groups(F.col("stem"), pattern)["1"].try_cast("int"))
    note = F.when(note.between(0, 127), note + (zero_octave + 1) * 12)
    note = F.when(note.between(0, 127), note)
    return files.withColumns({"expected": note, "expected_hz": S.note_pitch(note)})
