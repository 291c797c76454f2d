"""Chat formatting by columnar byte assembly, and reading it back.

A turn is its role's header, its text and the end mark. Control strings inside a text are
written as two-character escapes, so that a formatted text holds each control string only
where the template put it, and the escapes lead back to the text.

Turns arrive sorted by conversation. For a batch of them the lengths of all segments give
cumulative offsets, the offsets give the place of every byte, and headers and texts are
copied into one buffer that becomes the Arrow column as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonefold.llm.common import bounded_batches, byte_column, unused

OPEN, CLOSE, AFTER_ROLE = "### ", "</turn>\n", ": "
#: What may not stand inside a text as it is, and its escape. The backslash comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = ((":", "\\c"), ("\n", "\\n"))
ROLE_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
TRAINED = "assistant"

FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<start: int, length: int>>"


def escaped(col: Column, more: tuple = ()) -> Column:
    for plain, code in (*ESCAPES, *more):
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def header(role: Column) -> Column:
    """The three usual roles by name; any other behind an equals sign, escaped."""
    name = F.concat(F.lit("="), escaped(role, ROLE_ESCAPES))
    for k, v in ROLE_NAMES.items():
        name = F.when(role == k, F.lit(v)).otherwise(name)
    return F.concat(F.lit(OPEN), name, F.lit(AFTER_ROLE))


def assemble(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the parts' rows one after another: (bytes, offsets). A part: (bytes, offsets)."""
    sizes = np.stack([np.diff(at) for _, at in parts], 1)
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for k, (data, at) in enumerate(parts):
        if len(data):
            out[np.repeat(ends[:, k] - sizes[:, k] - at[:-1], sizes[:, k]) + np.arange(len(data))] = data
    return out, np.concatenate(([0], ends[:, -1])) if len(ends) else np.zeros(1, np.int64)


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss (byte spans of trained texts, as escaped).

    Rows run by turn, null turns first; rows of one turn by role and text, repeats kept. A null role
    or text is empty. An empty table gives no rows; a conversation is one value of up to 2 GB.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(0)
            n = len(ids)
            if not n:
                continue
            values, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((values[1:] != values[:-1]) | (valid[1:] != valid[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            if held and held[-1].column(0)[-1] != ids[0]:
                yield whole(held)
                held = []
            if last:
                yield whole([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield whole(held)

    def whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids = rows["conv_id"].combine_chunks() if rows.num_rows else rows["conv_id"]
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        values, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (valid[1:] != valid[:-1]))))
        heads, texts = byte_column(rows["header"]), byte_column(rows["text"])
        close = np.frombuffer(CLOSE.encode(), np.uint8)
        tails = np.tile(close, len(ids)), np.arange(len(ids) + 1) * len(close)
        data, at = assemble([heads, texts, tails])
        edges = np.append(first, len(ids))
        conv_at = at[edges]
        text_start = at[:-1] + np.diff(heads[1])
        trained = np.flatnonzero(rows["trained"].to_numpy())
        conv_of = np.searchsorted(first, trained, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array((text_start[trained] - conv_at[conv_of]).astype(np.int32)), pa.array(np.diff(texts[1])[trained].astype(np.int32))], ["start", "length"])
        loss_at = np.searchsorted(conv_of, np.arange(len(edges)), side="left").astype(np.int32)
        wide = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(conv_at.astype(np.int64)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.diff(edges)), wide.cast(pa.string()), pa.ListArray.from_arrays(pa.array(loss_at), spans)], ["conv_id", "n_turns", "formatted", "loss"])

    bounded_batches(turns.sparkSession)
    plain_role, plain_text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), plain_role.alias("role"), plain_text.alias("plain"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "plain")
    return rows.select("conv_id", header(F.col("role")).alias("header"), escaped(F.col("plain")).alias("text"), (F.col("role") == TRAINED).alias("trained")).mapInArrow(build, FORMATTED)


def unescaped(text: str, more: tuple = ()) -> str:
    codes = {code[1]: plain for plain, code in (*ESCAPES, *more)}
    if "\\" not in text:
        return text
    out, at = [], 0
    while (cut := text.find("\\", at)) >= 0:
        out += [text[at:cut], codes[text[cut + 1]]]
        at = cut + 2
    return "".join([*out, text[at:]])


TURNS = T.StructType([T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("trained", T.ArrayType(T.StringType()))])


def read_back(chats: DataFrame) -> DataFrame:
    """chats with turns array<struct<role, text>> and trained array<string> (texts under the loss mask), read from formatted and loss."""

    @F.arrow_udf(TURNS)
    def parse(texts: pa.Array, loss: pa.Array) -> pa.Array:
        names = {v: k for k, v in ROLE_NAMES.items()}
        out = []
        for text, spans in zip(texts.to_pylist(), loss.to_pylist()):
            turns = []
            for part in text.split(CLOSE)[:-1]:
                name, _, said = part.removeprefix(OPEN).partition(AFTER_ROLE)
                turns.append({"role": names.get(name) or unescaped(name[1:], ROLE_ESCAPES), "text": unescaped(said)})
            raw = text.encode()
            out.append({"turns": turns, "trained": [unescaped(raw[s["start"] : s["start"] + s["length"]].decode()) for s in spans]})
        return pa.array(out, pa.struct([("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("trained", pa.list_(pa.string()))]))

    own = unused(chats, "_read")
    names = [F.col(f"`{c}`") for c in chats.columns if c not in ("turns", "trained")]
    return chats.withColumn(own, parse("formatted", "loss")).select(*names, f"{own}.turns", f"{own}.trained")


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, and hashes and lengths of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
