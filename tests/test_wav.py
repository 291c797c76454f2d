"""WAV files written and read back."""

import os

import numpy as np
from pyspark.sql import functions as F

from tonefold.sources import wav

RECORD = {
    "midi_mapping": {"root_midi_note": 200, "sampler_mapping": {"fine_tune_cents": -70, "gain_db": 3, "low_note": 10, "high_note": 90, "low_velocity": 0, "high_velocity": 127}},
    "timing_info": {"playback_type": 1, "num_beats": 6, "time_signature_denominator": 8, "time_signature_numerator": 6, "tempo": 92.5},
    "loops": [{"name": "round", "type": 1, "start_frame": 4, "num_frames": 10, "num_times_to_loop": 7}, {"name": None, "type": 2, "start_frame": 1, "num_frames": 2, "num_times_to_loop": 0}],
    "markers": [{"name": "hit", "start_frame": 9}],
    "regions": [{"initial_marker_name": "in", "name": "verse", "start_frame": 2, "num_frames": 5}],
}


def test_samples_of_every_depth():
    x = np.array([0, 0.25, -0.25, 0.999, -1, 1])
    for bits, off in ((8, 1 / 127), (16, 1 / 20000), (24, 3e-7), (32, 1e-7), (64, 1e-7)):
        back = wav.parsed(wav.file_of(x, 2, 48_000, bits), True)
        assert (back["num_frames"], back["num_channels"], back["sample_rate"], back["bits_per_sample"]) == (3, 2, 48_000, bits)
        assert np.abs(back["samples"] - x).max() <= off
    loud = wav.parsed(wav.file_of(np.array([2.0, -1.0]), 1, 8_000, 16), True)["samples"]
    assert np.allclose(loud, [1, -0.5], atol=1e-4)


def test_metadata_goes_round():
    back = wav.parsed(wav.file_of(np.zeros(20), 1, 44_100, 16, RECORD, {"INAM": "a name", "ICMT": ""}), False)
    got = back["metadata"]
    assert got["loops"] == RECORD["loops"] and got["regions"] == RECORD["regions"] and got["timing_info"] == RECORD["timing_info"]
    assert got["midi_mapping"] == {"root_midi_note": 127, "sampler_mapping": RECORD["midi_mapping"]["sampler_mapping"] | {"fine_tune_cents": -50, "low_velocity": 1}}
    # every cue is a marker: the loops' and the region's come first
    assert got["markers"] == [{"name": "round", "start_frame": 4}, {"name": None, "start_frame": 1}, {"name": "in", "start_frame": 2}, {"name": "hit", "start_frame": 9}]
    assert back["info"] == [("INAM", "a name")]
    short = wav.parsed(wav.file_of(np.zeros(6), 1, 44_100, 16, RECORD), False)["metadata"]
    assert [x["start_frame"] for x in short["loops"]] == [1] and short["regions"] == [] and [x["start_frame"] for x in short["markers"]] == [4, 1, 2]
    root = wav.parsed(wav.file_of(np.zeros(6), 1, 44_100, 16, {"midi_mapping": {"root_midi_note": 41, "sampler_mapping": None}}), False)["metadata"]
    assert root["midi_mapping"] == {"root_midi_note": 41, "sampler_mapping": None}


def test_broken_files_say_so():
    good = wav.file_of(np.zeros(6), 1, 44_100, 16)
    for bad in (b"", b"RIFF1234WAVE", good[:-3], good.replace(b"fmt ", b"xxxx")):
        assert wav.parsed(bad, True)["problem"]


def test_files_through_spark(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.5, -0.5, 0.25, 0.0], 2, 100), ("b", [0.125] * 3, 1, 50)], "path string, samples array<double>, num_channels int, sample_rate int")
    (tmp_path / "sub").mkdir()
    for r in wav.with_content(rows.withColumn("metadata", F.lit(None).cast(wav.METADATA))).collect():
        for name in (f"{r.path}.wav", f"sub/{r.path}.wav", f".{r.path}.wav", f"{r.path}.txt"):
            (tmp_path / name).write_bytes(bytes(r.content))
    names = lambda df: sorted(os.path.relpath(r.path.removeprefix("file:"), tmp_path) for r in df.select("path").collect())
    top = str(tmp_path)
    assert names(wav.found(spark, [top])) == ["a.wav", "b.wav"]
    assert names(wav.found(spark, [top], recursive=True)) == ["a.wav", "b.wav", "sub/a.wav", "sub/b.wav"]
    assert names(wav.found(spark, [top, f"{top}/a.wav"])) == ["a.wav", "b.wav"]
    assert names(wav.found(spark, [top], ["**/b.wav"], recursive=True)) == ["a.wav", "sub/a.wav"]
    assert wav.listed("a\r\n\nb") == ["a", "b"] and wav.listed("a\0b\n\0") == ["a", "b\n"]
    back = wav.read(wav.found(spark, [f"{top}/a.wav"]))
    assert wav.in_rows(wav.signals(back)).first().samples == [0.5, -0.5, 0.25, 0.0] and back.first().bits_per_sample == 24
    assert "samples" not in wav.read(wav.found(spark, [top]), with_samples=False).columns
