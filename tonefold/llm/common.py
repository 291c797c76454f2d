"""Pieces that several corpus operators share: tables, shared folders, word and byte helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset and all runs on one machine (tests), a temporary folder is made, once a
    context; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir")
    if where is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = getattr(context, "_tonefold_dir", None) or tempfile.mkdtemp(prefix="tonefold-")
        context._tonefold_dir = where
    return where


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, which outlives any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, records: int = 2000, size: int = 8 << 20) -> None:
    """Sets the session's Arrow batches to `records` rows and `size` bytes at most.

    Texts differ a thousandfold in length; by rows alone, a batch of long ones takes a worker's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Returns a worker's unused memory to the system: workers live on, idle, beside the executor's other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def unused(df: DataFrame, stem: str) -> str:
    """A prefix that no column of df begins with, for columns that go again."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem = f"_{stem}"
    return stem


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def fold_remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id's text modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def held_out(doc_id: str, parts: int, part: int = 2) -> Column:
    return fold_remainder(doc_id, parts) == part


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of at most `most` bytes, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = to


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place of each word of all texts in a row, the distinct words, number of words of each text)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate(([0], np.cumsum(real)))
    offsets = lists.offsets.to_numpy()
    found = flat.filter(pa.array(real)).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary, np.diff(before[offsets - offsets[0]])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that no value of the first column, by which the rows are sorted, crosses."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def runs_inside(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number by text) of the runs of bytes that are inside; none crosses the end of a text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


LOWERED_BYTES = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
CRC = _crc_table()
#: The registers of a crc32 before any byte; the checksum is the register with all bits turned.
CRC_START = np.uint32(0xFFFFFFFF)
#: Bytes of a run that are taken a column at a time; the few longer runs' other bytes go through zlib.
CRC_COLUMNS = 64


def crc_after(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 registers after data[start:end], from a register for each run: the runs' first bytes together, then their second."""
    order = np.argsort(start - end, kind="stable")
    at, size, c = start[order], (end - start)[order], state[order]
    for k in range(min(int(size[0]), CRC_COLUMNS) if len(size) else 0):
        m = int(np.searchsorted(-size, -k))
        c[:m] = CRC[(c[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    for j in range(int(np.searchsorted(-size, -CRC_COLUMNS))):
        rest = data[at[j] + CRC_COLUMNS : at[j] + size[j]].tobytes()
        c[j] = zlib.crc32(rest, int(c[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(c)
    out[order] = c
    return out


#: Keys that hold more than this share of all rows are looked up by broadcast: there are at most so many.
HEAVY = 4096


def looked_up(rows: DataFrame, answers: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with answers(key, count, ...), where each key has one row that says how many of the `total` rows have it.

    The rows of keys that hold more than a HEAVY-th of all, at most HEAVY keys, stay where they are and
    get theirs by broadcast; only the others are shuffled. Rows whose key has no answer go.
    """
    heavy = F.broadcast(answers.filter(F.col(count) * HEAVY > total).drop(count))
    light = answers.filter(F.col(count) * HEAVY <= total).drop(count)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))
