"""WAV files as rows, and rows as WAV files.

A row: path, sample_rate, num_channels, bits_per_sample, num_frames, samples (interleaved), metadata (see
operators.metadata) and info (texts of the INFO list). Reading goes through Spark's binaryFile source;
metadata alone is read without decoding a sample.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tonefold.functions import scalars as S
from tonefold.operators.metadata import METADATA, fields
from tonefold.operators.signals import in_rows  # noqa: F401  the form that is written

FIELDS = fields("path string, sample_rate int, num_channels int, bits_per_sample int, num_frames bigint")
READ = T.StructType([*FIELDS, T.StructField("metadata", METADATA), T.StructField("info", T.MapType(T.StringType(), T.StringType())), T.StructField("problem", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))])
#: Depths that a file can have, of which these are IEEE floats, and these are scaled down by a file's peak where it would clip.
DEPTHS, FLOATS, SCALED = (8, 16, 24, 32, 64), (32, 64), (8, 16)
#: Flags of the acid chunk, and loop types of the smpl chunk by the record's (forward, backward, ping-pong).
ONE_SHOT, ROOT_SET = 1, 2
SMPL_TYPES = (0, 2, 1)


def found(spark: SparkSession, paths: list[str], exclude: list[str] = (), recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content of the WAV files at or under paths, each once. A path that isn't there is an error.

    Patterns (`*` inside a folder, `**` across) take files out before any is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "false").load(list(paths))
    files = files.filter(F.col("path").rlike(r"/[^./][^/]*\.wav$"))
    for pattern in exclude:
        files = files.filter(~F.col("path").rlike(S.whole(S.glob_regex(pattern))))
    return files if len(paths) == 1 else files.dropDuplicates(["path"])


def listed(text: str) -> list[str]:
    """Paths from a list: ends are NULs if there is any, else line ends; empty ones go."""
    return [p for p in (text.split("\0") if "\0" in text else text.replace("\r\n", "\n").split("\n")) if p]


# Chunks
def chunks(content: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """(id, body) of a RIFF file's chunks."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    view, at = memoryview(content), 12
    while at + 8 <= len(content):
        size = int.from_bytes(view[at + 4 : at + 8], "little")
        yield bytes(view[at : at + 4]), view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def decoded(data: bytes | memoryview, bits: int, floats: bool) -> np.ndarray:
    """Samples as doubles, by way of single precision."""
    if floats:
        return np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(np.float32).astype(np.float64)
    if bits == 8:
        return (np.frombuffer(data, np.uint8) * np.float32(2 / 255) - np.float32(1)).astype(np.float64)
    if bits == 24:
        x = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        values = (x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8
    else:
        values = np.frombuffer(data, f"<i{bits // 8}")
    return (values / 2.0 ** (bits - 1)).astype(np.float32).astype(np.float64)


def encoded(samples: np.ndarray, bits: int, peak: float | None = None) -> bytes:
    """Samples as a file holds them. Whole numbers are scaled down together where one would clip, but not those of 24 bits: peak is the whole file's, these samples' own if not given."""
    if bits in FLOATS:
        return samples.astype("<f4" if bits == 32 else "<f8").tobytes()
    peak = np.abs(samples).max(initial=0) if peak is None else peak
    x = samples if bits not in SCALED or peak <= 1 else samples * (1 / peak)
    if bits == 8:
        return ((x + 1) / 2 * 255).astype(np.uint8).tobytes()
    top = 2.0 ** (bits - 1)
    scaled = np.where(x < 0, x * top, x * (top - 1))
    whole = np.trunc(scaled + np.copysign(0.5, scaled)).astype("<i4")
    return whole.astype("<i2").tobytes() if bits == 16 else whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def text_of(body: memoryview) -> str | None:
    return bytes(body).split(b"\0")[0].decode("utf-8", "replace") or None


def metadata_of(found: Iterable[tuple[bytes, memoryview]], frames: int) -> tuple[dict | None, dict[str, str], list[str]]:
    """(the record, INFO texts, warnings). A chunk that can't be read is left out with a warning, and the others count.

    Names come by cue from labels; what leaves the signal is left out; the root note is the inst, else the smpl, else the acid chunk's.
    """
    cues: dict[int, int] = {}
    labels, regions, loops, info, roots, parts, warnings = [], [], [], {}, {}, {}, []
    for kind, body in found:
        try:
            if kind == b"cue ":
                points = [struct.unpack("<6I", body[4 + 24 * k : 28 + 24 * k]) for k in range(struct.unpack("<I", body[:4])[0])]
                for point in points:
                    cues.setdefault(point[0], point[5])
            elif kind == b"smpl":
                head = struct.unpack("<9I", body[:36])
                loops += [struct.unpack("<6I", body[36 + 24 * k : 60 + 24 * k]) for k in range(head[7])]
                roots.setdefault("smpl", head[3])
            elif kind == b"inst":
                note, *rest = struct.unpack("<7b", body[:7])
                roots.setdefault("inst", note)
                parts["sampler"] = dict(zip(("fine_tune_cents", "gain_db", "low_note", "high_note", "low_velocity", "high_velocity"), rest))
            elif kind == b"acid":
                flags, note, _, _, beats, lower, upper, tempo = struct.unpack("<IHHfIHHf", body[:24])
                if flags & ROOT_SET:
                    roots.setdefault("acid", note)
                parts["timing"] = {"playback_type": 0 if flags & ONE_SHOT else 1, "num_beats": beats, "time_signature_denominator": lower, "time_signature_numerator": upper, "tempo": tempo}
            elif kind == b"LIST":
                for name, part in sub_chunks(body):
                    if bytes(body[:4]) == b"INFO":
                        info[name.decode("latin-1")] = text_of(part) or ""
                    elif name == b"labl":
                        labels.append((struct.unpack("<I", part[:4])[0], text_of(part[4:])))
                    elif name == b"ltxt":
                        cue, length = struct.unpack("<2I", part[:8])
                        regions.append((cue, length, text_of(part[20:])))
        except struct.error:
            warnings.append(f"a {kind.decode('latin-1').strip()} chunk of {len(body)} bytes can't be read")
    named = [(cue, text) for cue, text in labels if text]
    first, last = dict(reversed(named)), dict(named)
    record = {
        "midi_mapping": {"root_midi_note": next((roots[k] for k in ("inst", "smpl", "acid") if k in roots), 60), "sampler_mapping": parts.get("sampler")} if roots else None,
        "timing_info": parts.get("timing"),
        "loops": [{"name": last.get(c), "type": SMPL_TYPES.index(t) if t in SMPL_TYPES else 0, "start_frame": a, "num_frames": b + 1 - a, "num_times_to_loop": n} for c, t, a, b, _, n in loops if a < frames and b < frames],
        "markers": [{"name": first.get(c), "start_frame": at} for c, at in cues.items() if at <= frames],
        "regions": [{"initial_marker_name": last.get(c), "name": name, "start_frame": cues[c], "num_frames": n} for c, n, name in regions if c in cues and cues[c] < frames and cues[c] + n <= frames],
    }
    return (record if any(record.values()) else None), info, warnings


def sub_chunks(body: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    at = 4
    while at + 8 <= len(body):
        size = int.from_bytes(body[at + 4 : at + 8], "little")
        yield bytes(body[at : at + 4]), body[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def form_of(fmt: bytes | memoryview, size: int) -> dict:
    """tag, sample_rate, num_channels, bits_per_sample, block, num_frames from a fmt chunk's body and the bytes of samples. What no reader could use is a ValueError."""
    tag, channels, rate, _, block, bits = struct.unpack("<HHIIHH", fmt[:16])
    if tag == 0xFFFE:
        tag = int.from_bytes(fmt[24:26], "little")
    if tag not in (1, 3) or bits not in DEPTHS or (tag == 3 and bits not in FLOATS) or (tag == 1 and bits == 64) or not rate or not channels or block != channels * bits // 8 or size % block:
        raise ValueError(f"format {tag} of {bits} bits, {channels} channels at {rate} frames a second in blocks of {block}, {size} bytes of samples")
    return {"tag": tag, "sample_rate": rate, "num_channels": channels, "bits_per_sample": bits, "block": block, "num_frames": size // block}


def parsed(content: bytes, with_samples: bool) -> dict:
    """One file's fields. What can't be read gives a problem and nulls; metadata that can't be read gives warnings."""
    try:
        found = list(chunks(content))
        by_id = dict(reversed(found))
        data = by_id[b"data"]
        form = form_of(by_id[b"fmt "], len(data))
        record, info, warnings = metadata_of(found, form["num_frames"])
        out = form | {"metadata": record, "info": list(info.items()), "problem": None, "warnings": warnings}
        return out | ({"samples": decoded(data, form["bits_per_sample"], form["tag"] == 3)} if with_samples else {})
    except KeyError as e:
        return {"problem": f"no {e.args[0].decode().strip()} chunk"}
    except (ValueError, struct.error) as e:
        return {"problem": str(e)}


def read(files: DataFrame, with_samples: bool = True) -> DataFrame:
    """The rows of found(): a file that can't be read has a problem, and nulls."""
    kind = T.StructType([*READ, T.StructField("samples", T.ArrayType(T.DoubleType()))]) if with_samples else READ
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = parsed(content.as_py(), with_samples) | {"path": path}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in arrow], schema=arrow)

    return files.select("path", "content").mapInArrow(run, kind)


def signals(rows: DataFrame) -> DataFrame:
    """The long form of readable rows: path, frame, channel, value, num_frames, num_channels, sample_rate."""
    points = rows.filter("problem IS NULL").select("path", F.posexplode("samples").alias("at", "value"), "num_frames", *[F.col(c).cast("long") for c in ("num_channels", "sample_rate")])
    n = F.col("num_channels")
    return points.select("path", F.floor(F.col("at") / n).alias("frame"), (F.col("at") % n).alias("channel"), "value", "num_frames", "num_channels", "sample_rate")


# Writing
def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def metadata_chunks(record: dict | None, info: dict[str, str] | None, rate: int) -> bytes:
    """A record as chunks: INFO texts, acid, inst, smpl, and cues, which loops, regions and markers take in this order."""
    record, out, cues, adtl = record or {}, b"", [], b""
    mapping, timing, loops = record.get("midi_mapping"), record.get("timing_info"), record.get("loops") or []
    clamp = lambda x, low, high: max(low, min(high, x))
    take = lambda name, at: cues.append((name, at)) or len(cues) - 1
    if info:
        out += chunk(b"LIST", b"INFO" + b"".join(chunk(k.encode("latin-1"), v.encode() + b"\0") for k, v in info.items() if v))
    if timing:
        flags = (ONE_SHOT if timing["playback_type"] == 0 else 0) | (ROOT_SET if mapping else 0)
        note = clamp(mapping["root_midi_note"], 0, 127) if mapping else 0
        out += chunk(b"acid", struct.pack("<IHHfIHHf", flags, note, 0, 0, timing["num_beats"], timing["time_signature_denominator"], timing["time_signature_numerator"], timing["tempo"]))
    if mapping and (s := mapping["sampler_mapping"]):
        values = clamp(mapping["root_midi_note"], 0, 127), clamp(s["fine_tune_cents"], -50, 50), clamp(s["gain_db"], -64, 64), *(clamp(s[k], 0, 127) for k in ("low_note", "high_note")), *(clamp(s[k], 1, 127) for k in ("low_velocity", "high_velocity"))
        out += chunk(b"inst", struct.pack("<7b", *values))
    if loops or (mapping and not timing and not mapping["sampler_mapping"]):
        head = struct.pack("<9I", 0, 0, int(1 / rate * 1e9), mapping["root_midi_note"] if mapping else 60, 0, 0, 0, len(loops), 0)
        out += chunk(b"smpl", head + b"".join(struct.pack("<6I", take(x["name"], x["start_frame"]), SMPL_TYPES[x["type"] or 0], x["start_frame"], x["start_frame"] + x["num_frames"] - 1, 0, x["num_times_to_loop"] or 0) for x in loops))
    for x in record.get("regions") or []:
        text = x["name"].encode() + b"\0" if x["name"] else b""
        adtl += chunk(b"ltxt", struct.pack("<2I4s4H", take(x["initial_marker_name"], x["start_frame"]), x["num_frames"], b"beat", 0, 0, 0, 0) + text)
    for x in record.get("markers") or []:
        take(x["name"], x["start_frame"])
    if cues:
        out += chunk(b"cue ", struct.pack("<I", len(cues)) + b"".join(struct.pack("<2I4s3I", k, 0, b"data", 0, 0, at) for k, (_, at) in enumerate(cues)))
        adtl = b"".join(chunk(b"labl", struct.pack("<I", k) + name.encode() + b"\0") for k, (name, _) in enumerate(cues) if name) + adtl
    return out + (chunk(b"LIST", b"adtl" + adtl) if adtl else b"")


def head_of(frames: int, channels: int, rate: int, bits: int, record: dict | None = None, info: dict[str, str] | None = None) -> bytes:
    """A WAV file's bytes up to its samples, of which an odd number ends with a byte of 0."""
    block = channels * bits // 8
    size = frames * block
    if bits not in DEPTHS or rate <= 0 or channels <= 0:
        raise ValueError(f"no WAV file has {channels} channels of {bits} bits at {rate} frames a second")
    fmt = struct.pack("<HHIIHH", 3 if bits in FLOATS else 1, channels, rate, rate * block, block, bits)
    body = b"WAVE" + chunk(b"fmt ", fmt) + metadata_chunks(record, info, rate)
    total = len(body) + 8 + size + size % 2
    if total >= 1 << 32:
        raise ValueError(f"{size} bytes of samples are too many for a WAV file")
    return b"RIFF" + struct.pack("<I", total) + body + b"data" + struct.pack("<I", size)


def file_of(samples: np.ndarray, channels: int, rate: int, bits: int, record: dict | None = None, info: dict[str, str] | None = None) -> bytes:
    """A WAV file's bytes."""
    body = encoded(samples, bits)
    return head_of(len(samples) // channels, channels, rate, bits, record, info) + body + b"\0" * (len(body) % 2)


def with_content(rows: DataFrame, bits: Column | None = None) -> DataFrame:
    """path, content: a WAV file for each row (samples, num_channels, sample_rate, and bits_per_sample, metadata and info if there), ready for a store."""
    has = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    depth = bits if bits is not None else F.coalesce(has("bits_per_sample", "int"), F.lit(24))
    some = rows.select(F.col("path").cast("string"), "samples", F.col("num_channels").cast("int"), F.col("sample_rate").cast("int"), depth.cast("int").alias("bits"), has("metadata", METADATA).alias("metadata"), has("info", "map<string, string>").alias("info"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, samples, *rest = batch.columns
            for k, (path, channels, rate, depth, record, info) in enumerate(zip(paths.to_pylist(), *(c.to_pylist() for c in rest))):
                if depth not in DEPTHS:
                    raise ValueError(f"{path}: no WAV file has {depth} bits")
                content = file_of(samples[k].values.to_numpy(zero_copy_only=False), channels, rate, depth, record, dict(info or ()))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])

    return some.mapInArrow(run, "path string, content binary")
