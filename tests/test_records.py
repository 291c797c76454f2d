"""Records, reports, names and plans: cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tonefold.operators import conversion as C
from tonefold.operators import metadata as M
from tonefold.operators import naming as N
from tonefold.operators import reports as R
from tonefold.operators import sets as G
from tonefold.operators.checks import refuse


@pytest.fixture(scope="module")
def files(spark):
    loop = {"name": "a", "type": 0, "start_frame": 5, "num_frames": 10, "num_times_to_loop": 0}
    full = {"midi_mapping": {"root_midi_note": 50, "sampler_mapping": {"fine_tune_cents": 7, "gain_db": -3, "low_note": 20, "high_note": 80, "low_velocity": 5, "high_velocity": 99}}, "timing_info": None, "loops": [loop], "markers": [{"name": None, "start_frame": 3}], "regions": []}
    rows = [("x/s_40.wav", "x", "s_40", 100, 1000, full), ("x/s_60.wav", "x", "s_60", 0, 1000, None), ("y/other.wav", "y", "other", 10, 1000, None)]
    kind = "path string, folder string, stem string, num_frames long, sample_rate long, metadata " + M.METADATA.simpleString()
    return spark.createDataFrame(rows, kind)


def by_path(df):
    return {r.path: r for r in df.collect()}


def test_sampler_values(files):
    got = by_path(M.embed_note_range(files, r"s_(\d+)", "unchanged"))
    assert [got[p].metadata.midi_mapping.sampler_mapping[2:4] for p in sorted(got)] == [(40, 80), (60, 127), (0, 127)]
    assert got["x/s_40.wav"].metadata.midi_mapping.root_midi_note == 50 and got["y/other.wav"].metadata.midi_mapping.root_midi_note == 60
    assert by_path(M.unnamed_values(files, r"s_(\d+)", "unchanged", "5")).keys() == {"y/other.wav"}
    with pytest.raises(ValueError, match="not from 1 to 127"):
        M.embed_velocity_range(files, "0", "unchanged")
    pitch = files.select("path", F.when(F.col("folder") == "x", 261.0).alias("hz"))
    root = lambda text: [r.metadata.midi_mapping.root_midi_note for r in M.embed_root(files, text, pitch).orderBy("path").collect()]
    assert root("auto-detect") == [60, 60, 60] and root("auto-detect-octave-minus-2") == [36, 36, 36] and root("100") == [100] * 3
    mapped = by_path(M.embed_mapped_ranges(M.embed_root(files, r"s_(\d+)")))
    assert [mapped[p].metadata.midi_mapping.sampler_mapping[2:4] for p in sorted(mapped)] == [(0, 50), (51, 127), (0, 127)]
    assert by_path(M.without_sampler(files))["x/s_40.wav"].metadata.midi_mapping is None and by_path(M.without_sampler(files))["x/s_60.wav"].metadata is None


def test_loops_and_the_time_axis(files):
    got = by_path(M.add_loop(files, "-30", "0", name="tail", kind="Backward", times=2))
    assert [tuple(x) for x in got["x/s_40.wav"].metadata.loops] == [("a", 0, 5, 10, 0), ("tail", 1, 70, 30, 2)] and got["x/s_40.wav"].metadata.timing_info.playback_type == 1
    assert got["x/s_60.wav"].metadata is None and tuple(got["y/other.wav"].metadata.loops[0]) == ("tail", 1, 0, 10, 2)
    assert by_path(M.unloopable(M.loop_points(files, "20ms", length="90"))).keys() == {"x/s_40.wav", "y/other.wav"}
    with pytest.raises(ValueError):
        M.loop_points(files, "0")
    of = lambda c: files.filter("num_frames = 100").select(c.alias("m")).first().m
    m = F.col("metadata")
    assert of(M.stretched_record(m, F.lit(0.5))).loops[0][2:4] == (2, 5) and of(M.stretched_record(m, F.lit(0.5))).markers[0].start_frame == 1
    assert of(M.cut_record(m, F.lit(4), F.lit(15))).loops[0].start_frame == 1 and of(M.cut_record(m, F.lit(4), F.lit(15))).markers == [] and of(M.cut_record(m, F.lit(0), F.lit(14))).loops == []
    assert of(M.reversed_record(m, F.lit(100))).loops[0].start_frame == 85 and of(M.reversed_record(m, F.lit(100))).markers[0].start_frame == 97
    assert files.select(M.stretched_record(m, F.lit(2)).alias("m")).filter("m IS NULL").count() == 2


def test_json_both_ways(spark, files):
    lines = {json.loads(r.line)["path"]: json.loads(r.line)["metadata"] for r in M.exported(files).collect()}
    assert lines["y/other.wav"] is None and lines["x/s_40.wav"]["loops"][0]["name"] == "a" and lines["x/s_40.wav"]["timing_info"] is None
    text = M.exported(files).select(F.col("line").alias("value"), F.lit(1).alias("line"))
    assert {r.path: r.metadata for r in M.entries(text).collect()} == {r.path: r.metadata for r in files.collect()}
    old = '{"path": "p", "metadata": {"midi_mapping": {"nullopt": false, "data": {"root_midi_note": 9, "sampler_mapping": {"nullopt": true}}}, "timing_info": {"nullopt": true, "data": {"num_beats": 3}}}}'
    odd = spark.createDataFrame([(old, 1), ("", 2), (f"[{old}, {old}]", 3), ("{broken", 4), ("[]", 5)], "value string, line int")
    got = [(r.path, r.metadata and r.metadata.midi_mapping.root_midi_note, r.metadata and r.metadata.timing_info) for r in M.entries(odd).orderBy("line").collect()]
    assert got == [("p", 9, None)] * 3 + [(None, None, None)]
    assert M.entries(odd.limit(0)).count() == 0


def test_reports(spark):
    report = spark.createDataFrame([("a\"b", 1.5, None, "x\ny", 3)], "path string, peak_db double, rms_db double, `end` string, frames int")
    assert json.loads(R.as_json(report).first().json) == {"end": "x\ny", "frames": 3, "path": 'a"b', "peak_db": 1.5, "rms_db": None}
    assert json.loads(R.as_json(R.picked(report, "_db$"), path_as_key=True).first().json) == {'a"b': {"peak_db": 1.5, "rms_db": None}}
    assert R.as_lua(report).first().lua == '{\n    ["end"] = "x\\ny",\n    frames = 3,\n    path = "a\\"b",\n    peak_db = 1.5\n  }'


def test_new_names(spark):
    files = spark.createDataFrame([("My Dir/a1.wav", "My Dir", "a1"), ("b2.flac", None, "b2"), ("My Dir/x.wav", "My Dir", "x")], "path string, folder string, stem string")
    got = by_path(N.renamed(files, regex=("([a-z])([0-9])", "<2><1>_<parent-folder-camel>_<counter>")))
    assert got["My Dir/a1.wav"].new_path == "My Dir/1a_MyDir_1.wav" and not got["My Dir/x.wav"].renamed and got["My Dir/x.wav"].new_path == "My Dir/x.wav"
    assert by_path(N.problems_of(N.renamed(files, regex=("([a-z])([0-9])", "<2>_<parent-folder>")))).keys() == {"b2.flac"}
    auto = by_path(N.renamed(files, N.AutoMap("([a-z])([0-9])", 2, "<lo>-<hi>")))
    assert auto["My Dir/a1.wav"].new_path == "My Dir/0-127.wav" and auto["b2.flac"].new_path == "0-127.flac"
    same = N.renamed(files, regex=("[ax].*", "same"))
    with pytest.raises(ValueError, match="more than one file"):
        refuse(N.problems_of(same))
    refuse(N.problems_of(N.renamed(files, prefix="ok_")))
    assert by_path(G.unmoved(G.folderised(files, "nothing", "z"))).keys() == {"*"}


def test_conversion(spark):
    files = spark.createDataFrame([("a", "wav", 24, 48_000, 1000), ("b", "flac", 20, 44_100, 1000)], "path string, format string, bits_per_sample int, sample_rate int, num_frames long")
    got = by_path(C.conversion(files, rate=44_100))
    assert (got["a"].num_frames, got["a"].edited, got["b"].num_frames, got["b"].edited) == (918, True, 1000, False)
    assert by_path(C.inconvertible(files, depth=20)).keys() == {"a"} and by_path(C.inconvertible(files, kind="wav")).keys() == {"b"} and C.inconvertible(files, depth=24, kind="wav").count() == 0
    assert C.inconvertible(files).count() == 0 and C.conversion(files, depth=16).filter("edited").count() == 2
