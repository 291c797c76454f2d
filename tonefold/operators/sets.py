"""Operators on sets of files: grouping, matching, renaming, mapping, metadata."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonefold.functions import scalars as S
from tonefold.operators.checks import problems
from tonefold.session import checkpointed


def excluded(files: DataFrame, *globs: str, path: str = "path") -> DataFrame:
    for g in globs:
        files = files.filter(~F.col(path).rlike(S.whole(S.glob_regex(g))))
    return files


def audio_only(files: DataFrame, path: str = "path") -> DataFrame:
    """Names that don't begin with a dot and end in .wav or .flac."""
    return files.filter(F.col(path).rlike(r"(^|/)[^./][^/]*\.(wav|flac)$"))


def conflicts(files: DataFrame, path: str = "path") -> DataFrame:
    """Paths that more than one file would have."""
    return files.groupBy(path).agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def first_group(pattern: str) -> tuple[str, str, str] | None:
    """What stands before, in and after group 1, if it is a plain part of the whole: not nested, repeated, in an alternative or referred to."""
    depth, at, opened, closed, inside = 0, 0, None, None, False
    if re.search(r"\\[1-9]", pattern):
        return None
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            at += pattern[at + 1 : at + 2] in ("]", "^")
        elif c == "|" and not depth:
            return None
        elif c == "(":
            if opened is None and pattern[at + 1 : at + 2] != "?":
                if depth:
                    return None
                opened = at
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth and opened is not None and closed is None:
                closed = at
        at += 1
    if closed is None or pattern[closed + 1 : closed + 2] in ("?", "*", "+", "{"):
        return None
    return pattern[:opened], pattern[opened + 1 : closed], pattern[closed + 1 :]


def split_at_group(stem: Column, pattern: str) -> Column:
    """{before, group, after} of group 1 of the whole-text match; null where the pattern doesn't match."""
    if parts := first_group(pattern):
        whole = S.whole("({})({})({})".format(*parts))
        inner = re.compile(f"({parts[0]})({parts[1]})").groups
        piece = lambda k: F.regexp_extract(stem, whole, k)
        found = F.struct(piece(1).alias("before"), piece(1 + re.compile(parts[0]).groups + 1).alias("group"), piece(inner + 1).alias("after"))
        return F.when(stem.rlike(whole), found)

    @F.arrow_udf("before string, group string, after string")
    def split(texts: pa.Array) -> pa.Array:
        found = [t is not None and re.fullmatch(pattern, t) for t in texts.to_pylist()]
        rows = [{"before": m.string[: max(0, m.start(1))], "group": m[1] or "", "after": m.string[max(0, m.end(1)) :]} if m else None for m in found]
        return pa.array(rows, pa.struct([("before", pa.string()), ("group", pa.string()), ("after", pa.string())]))

    return split(stem)


def sample_sets(files: DataFrame, pattern: str, authority: str) -> DataFrame:
    """files(path, stem, ...) with set_key and the authority's path. The key is the stem with group 1's place taken by `*`; the first path is the authority."""
    rows = files.withColumn("found", split_at_group(F.col("stem"), pattern)).filter("found IS NOT NULL")
    rows = rows.withColumn("set_key", F.concat("found.before", F.lit("*"), "found.after"))
    lead = rows.filter(F.col("found.group") == authority).groupBy("set_key").agg(F.min("path").alias("authority"))
    return rows.drop("found").join(lead, "set_key", "left")


def unmatched(files: DataFrame, pattern: str) -> DataFrame:
    """The files that no set takes, each of which is an error."""
    return files.filter(~F.col("stem").rlike(S.whole(pattern)))


def uneven_sets(sets: DataFrame) -> DataFrame:
    """set_key, shortest, longest of the sets(set_key, num_frames) whose signals differ in length."""
    ends = sets.groupBy("set_key").agg(F.min("num_frames").alias("shortest"), F.max("num_frames").alias("longest"))
    return ends.filter("shortest <> longest")


def sets_without_authority(files: DataFrame, pattern: str, authority: str) -> DataFrame:
    return sample_sets(files, pattern, authority).filter("authority IS NULL").select("set_key").distinct()


def _by_root(files: DataFrame, folder: str, root: str, *names: str) -> W:
    """Files of a folder by root; equal roots by the first of names that files has, so that the order is one and the same in every run."""
    return W.partitionBy(folder).orderBy(root, *[n for n in names if n in files.columns][:1])


def key_ranges(files: DataFrame, folder: str = "folder", root: str = "root", name: str = "path") -> DataFrame:
    """files with low and high: the notes from 0 to 127 shared out between neighbouring roots of a folder; of equal roots the greater name lies higher."""
    w = _by_root(files, folder, root, name, "file")
    middle = lambda a, b: a + F.floor((b - a) / 2)
    before, after = F.lag(root).over(w), F.lead(root).over(w)
    low = F.coalesce(middle(before, F.col(root)) + 1, F.lit(0))
    return files.withColumns({"low": low.cast("long"), "high": F.coalesce(middle(F.col(root), after), F.lit(127)).cast("long")})


def blend_plan(files: DataFrame, step: int, folder: str = "folder", root: str = "root", name: str = "file") -> DataFrame:
    """For each two neighbouring roots of a folder the notes between them, `step` apart, with both files and their weights. Of equal roots, the least and the greatest name are neighbours of other roots."""
    w = _by_root(files, folder, root, name)
    pairs = files.withColumns({"upper": F.lead(root).over(w), "upper_file": F.lead(name).over(w)}).filter(F.col(root) + step < F.col("upper"))
    notes = pairs.withColumn("note", F.explode(F.sequence(F.col(root) + step, F.col("upper") - 1, F.lit(step).cast("int"))))
    span = F.col("upper") - F.col(root)
    return notes.select(folder, F.col(root).alias("lower"), "upper", "note", F.col(name).alias("lower_file"), "upper_file", (1 - (F.col("note") - F.col(root)) / span).alias("lower_weight"), (1 - (F.col("upper") - F.col("note")) / span).alias("upper_weight"))


def unblendable(files: DataFrame, folder: str = "folder", root: str = "root") -> DataFrame:
    """path, problem: folders with fewer than two files, and those in which two files have one root."""
    sizes = files.groupBy(folder).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(root).alias("roots"))
    return problems(sizes, F.col("n") < 2, "fewer than two files", folder).unionByName(problems(sizes, F.col("roots") < F.col("n"), "two files have one root", folder))


def unmoved(files: DataFrame) -> DataFrame:
    """path, problem: one row if no file of folderised() goes anywhere; the paths that several files would have."""
    none = files.agg(F.count_if(F.col("path") != F.col("new_path")).alias("moved"), F.count(F.lit(1)).alias("n"))
    shared = conflicts(files.select("new_path"), "new_path")
    return problems(none.withColumn("path", F.lit("*")), F.col("moved") == 0, "no file matches").unionByName(problems(shared, F.lit(True), "more than one file would have this path", "new_path"))


# Names
def renamed_by_regex(stem: Column, pattern: str, to: str) -> Column:
    return F.when(stem.rlike(S.whole(pattern)), S.template(to, S.regex_groups(stem, pattern))).otherwise(stem)


def note_to_midi(stem: Column, zero_octave: int = -1) -> Column:
    """The first note name that stands alone becomes its number, everywhere it stands in the name, until none is left. Sharps of E and B are no notes.

    Each exchange takes a letter from A to G away, so that as many steps as there are of them are enough.
    """
    base = F.create_map(*[F.lit(x) for k, v in (("c", 0), ("d", 2), ("e", 4), ("f", 5), ("g", 7), ("a", 9), ("b", 11)) for x in (k, v)])

    def exchanged(name: Column, _: Column) -> Column:
        note = F.regexp_extract(name, r"(?<![A-Za-z0-9])((?:[ACDFGacdfg]#?|[BEbe])-?[0-9])(?![A-Za-z0-9])", 1)
        number = F.element_at(base, F.lower(F.substring(note, 1, 1))) + F.when(note.contains("#"), 1).otherwise(0) + 12 * (F.regexp_extract(note, r"(-?[0-9])$", 1).cast("int") - zero_octave)
        return F.when(note != "", F.replace(name, note, number.cast("string"))).otherwise(name)

    return F.aggregate(F.regexp_extract_all(stem, F.lit("[A-Ga-g]"), 0), stem, exchanged)


def counted(files: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    """files with counter: 0, 1, ... by folder and path.

    Ranges of (folder, path) are sorted apart; a range's rows are numbered inside it, after the number of
    rows in the ranges before, of which there is one row a range.
    """
    ranges = checkpointed(files.repartitionByRange(folder, path).sortWithinPartitions(folder, path))
    rows = ranges.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(F.broadcast(sizes.select("part", "start")), "part").withColumn("counter", F.col("start") + F.col("place")).drop("part", "place", "start")


def folderised(files: DataFrame, pattern: str, to: str) -> DataFrame:
    """files with new_path: matching ones in the folder that the template names."""
    folder = S.template(to, S.regex_groups(F.col("stem"), pattern))
    return files.withColumn("new_path", F.when(F.col("stem").rlike(S.whole(pattern)), F.concat_ws("/", folder, F.regexp_extract("path", "([^/]*)$", 1))).otherwise(F.col("path")))


def output_path(path: Column, out: str) -> Column:
    """Inside the working folder sub-folders stay; from outside only the name."""
    return F.concat(F.lit(out + "/"), F.when(path.startswith("../") | path.startswith("/"), F.regexp_extract(path, "([^/]*)$", 1)).otherwise(path))


# Metadata: arrays of structs with start_frame (and num_frames)
def cut_start(items: Column, frames: Column) -> Column:
    """After `frames` frames went from the start: items before that go, others move."""
    return F.transform(F.filter(items, lambda x: x["start_frame"] >= frames), lambda x: x.withField("start_frame", x["start_frame"] - frames))


def cut_end(items: Column, num_frames: Column, lengths: bool = True) -> Column:
    """After the signal was cut to num_frames: what ends later goes."""
    return F.filter(items, lambda x: x["start_frame"] + x["num_frames"] <= num_frames if lengths else x["start_frame"] < num_frames)


def stretched(items: Column, factor: float | Column, lengths: bool = True) -> Column:
    scale = lambda v: (v * factor).cast("bigint")
    return F.transform(items, lambda x: x.withField("start_frame", scale(x["start_frame"])).withField("num_frames", scale(x["num_frames"])) if lengths else x.withField("start_frame", scale(x["start_frame"])))


def reversed_items(items: Column, num_frames: Column, lengths: bool = True) -> Column:
    return F.transform(items, lambda x: x.withField("start_frame", num_frames - x["start_frame"] - (x["num_frames"] if lengths else F.lit(0))))


def imported(files: DataFrame, entries: DataFrame) -> DataFrame:
    """files(path, metadata) with the metadata of entries(path, metadata, line): the last entry of a path counts (of one line number, the greatest).

    Where there is one entry in all, it is for every file, whatever its path.
    """
    last = entries.groupBy("path").agg(F.max_by("metadata", F.struct("line", "metadata")).alias("new"), F.lit(True).alias("found"))
    alone = entries.agg(F.count(F.lit(1)).alias("n"), F.max_by("metadata", F.struct("line", "metadata")).alias("only"))
    rows = files.join(last, "path", "left").crossJoin(F.broadcast(alone))
    return rows.select("path", F.when(F.col("n") == 1, F.col("only")).when(F.col("found"), F.col("new")).otherwise(F.col("metadata")).alias("metadata"))


def imported_for_all(files: DataFrame, entries: DataFrame) -> DataFrame:
    """files with the metadata of the one entry there is."""
    one = entries.agg(F.max_by("metadata", F.struct("line", "metadata")).alias("metadata"))
    return files.drop("metadata").crossJoin(F.broadcast(one))


def root_note(chunks: DataFrame) -> DataFrame:
    """path, root: from the instrument chunk, else the sampler chunk, else the tempo chunk if its flag is set."""
    pick = lambda kind: F.max(F.when((F.col("chunk") == kind) & F.col("valid"), F.col("note")))
    return chunks.groupBy("path").agg(F.coalesce(pick("inst"), pick("smpl"), pick("acid")).alias("root"))
