"""Spelling variants: words one edit apart, grouped under the commonest spelling.

A word's polynomial hash is a sum over its code points, so the hash of the word without its i-th
code point is the prefix's sum plus the suffix's, one power lower: all deletions of a batch of words
are a few NumPy operations on integers, and no deleted string is made. The keys are radix-partitioned
by their leading bits and sorted. Rows that share key and place of the deletion differ in that one
code point; a word that is itself some longer word's deletion shares its key with it. What met is
verified on strings: rows are grouped again by the deletion's own text.

No pairs are made: a group says how many near words its members have, and the commonest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonefold.llm.common import LOWERED_BYTES, bounded_batches, byte_column, crc_after, give_back, row_blocks, runs_inside, whole_groups, written

BLOCK = 1 << 20
LEAST_LENGTH, LEAST_COUNT, MODULUS, TIMES = 5, 3, 97, 2
#: The lead byte of U+00C0 to U+00FF in UTF-8; letters of the words are A-Z, a-z and these.
LEAD = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), LEAD]] = True


def occurrences(data: np.ndarray, offsets: np.ndarray, ids: list[int | None], modulus: int, least_length: int) -> Iterator[pa.Array]:
    """The words of texts that lie in a row, repeats included, after deletions: a run of letters whose checksum, with its document's id, modulus divides loses a code point."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == LEAD
    data = LOWERED_BYTES[data]
    start, end, words = runs_inside(inside, offsets)
    if not len(start):
        return
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) ^ 0xFFFFFFFF for i in ids], np.uint32)
    h = ~crc_after(np.repeat(heads, words), data, start, end)
    before = np.concatenate(([0], np.cumsum(data == LEAD)))
    length = end - start - (before[end] - before[start])
    spelt = h % np.uint32(modulus) != 0
    whole = spelt & (length >= least_length)
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start[whole]] += 1
    mark[end[whole]] -= 1
    kept = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    ends = np.concatenate(([0], np.cumsum((end - start)[whole]))).astype(np.int32)
    yield pa.StringArray.from_buffers(int(whole.sum()), pa.py_buffer(ends), pa.py_buffer(kept))
    cut = []
    for k in np.flatnonzero(~spelt & (length > least_length)):
        word, at = data[start[k] : end[k]].tobytes().decode(), int(h[k]) % int(length[k])
        cut.append(word[:at] + word[at + 1 :])
    yield pa.array(cut, pa.string())


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = MODULUS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all texts' words of enough code points and occurrences; each batch's words are counted before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            data, offsets = byte_column(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK):
                found += occurrences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], modulus, least_length)
            counted = pc.value_counts(pa.chunked_array(found, pa.string()))
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "n"])
        give_back()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


_DRAWN = np.random.default_rng(20_240_113).integers(0, 1 << 63, 259, np.uint64) * np.uint64(2) + np.uint64(1)
#: An odd number for each code point, the base, and two multipliers that spread a hash over its bits.
VALUE, BASE, SPREAD = _DRAWN[:256], _DRAWN[256], _DRAWN[257:]
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, word) of the words' own texts (place -1) and of each deletion; first marks one place of those that give the same text."""
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(code)) - start[of]
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(int(size.max(initial=1)) - 1, 0), BASE))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(VALUE[code] * powers[at])))
    total = sums[start + size] - sums[start]
    prefix = sums[:-1] - sums[start[of]]
    suffix = sums[(start + size)[of]] - sums[1:]
    first = np.concatenate(([True], code[1:] != code[:-1]))[: len(code)] | (at == 0)
    hashed = np.concatenate((total, prefix + suffix * INVERSE)) * SPREAD[0]
    key = (hashed ^ (hashed >> np.uint64(29))) * SPREAD[1]
    one = np.ones(len(words), bool)
    return key.view(np.int64), np.concatenate((np.full(len(words), -1), at)), np.concatenate((one, first)), np.concatenate((np.arange(len(words)), of))


def keyed(words: DataFrame) -> DataFrame:
    """key, place, first, wid for words(wid, word)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, place, first, row = deletion_keys(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place.astype(np.int32)), pa.array(first), batch.column(0).take(pa.array(row))], ["key", "place", "first", "wid"])

    return words.select("wid", "word").mapInArrow(keys, "key long, place int, first boolean, wid long")


def meetings(keys: DataFrame) -> DataFrame:
    """key, kind, place, wid of rows that share their key: by place (kind: the place), and words with what they are deletions of (kind -1)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            key, place, first, wid = (rows.column(k).to_numpy() for k in range(4))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(new) - 1
            same = np.cumsum(new | np.concatenate(([True], place[1:] != place[:-1]))) - 1
            replaced = np.flatnonzero((place >= 0) & (np.bincount(same)[same] > 1))
            own = np.bincount(group, place < 0) > 0
            longer = np.bincount(group, (place >= 0) & first) > 0
            shorter = np.flatnonzero((own & longer)[group] & first)
            at = np.concatenate((replaced, shorter))
            kind = np.concatenate((place[replaced], np.full(len(shorter), -1, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(kind.astype(np.int32)), pa.array(place[at]), pa.array(wid[at])], ["key", "kind", "place", "wid"])
        give_back()

    dealt = keys.repartition(F.shiftrightunsigned("key", 44)).sortWithinPartitions("key", "place")
    return dealt.mapInArrow(meet, "key long, kind int, place int, wid long")


def neighbours(words: DataFrame) -> DataFrame:
    """wid, n_near, best (of the near words' struct of -n and word, the least) of words(wid, word, n) that have near words.

    A group is at most as large as the code points that can stand in one place, or as the insertions into one word.
    """
    met = meetings(keyed(words)).join(words, "wid")
    left = F.when(F.col("place") < 0, F.col("word")).otherwise(F.expr("concat(left(word, place), substr(word, place + 2))"))
    member = F.struct((-F.col("n")).alias("less"), "word", "wid", (F.col("place") < 0).alias("own"))
    groups = met.groupBy("key", "kind", left.alias("left")).agg(F.sort_array(F.collect_list(member)).alias("all")).filter(F.size("all") > 1)
    one = groups.select("kind", "all", F.filter("all", lambda m: m["own"]).alias("own"), F.explode("all").alias("m"))
    longer = F.filter("all", lambda m: ~m["own"])
    case = F.col("kind") < 0
    near = F.when(~case, F.filter("all", lambda m: m["wid"] != F.col("m.wid"))).when(F.col("m.own"), longer).otherwise(F.col("own"))
    found = one.select(F.col("m.wid").alias("wid"), F.size(near).cast("long").alias("n"), F.get(near, 0).alias("best")).filter("n > 0")
    return found.groupBy("wid").agg(F.sum("n").alias("n_near"), F.min(F.struct("best.less", "best.word")).alias("best"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = TIMES, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs' vocabulary (options: see there).

    form is the commonest near word (ties: the smallest), if it occurs `times` times as often; root is where forms
    lead to. Counts at least double along the way, so it ends. Null and empty texts have no words, an empty table no
    rows; a null id counts as the empty text; repeated rows count again; other columns play no part.
    """
    words = written(vocabulary(docs, doc_id, text, **options).withColumn("wid", F.monotonically_increasing_id()), "words")
    near = words.join(neighbours(words), "wid", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    rows = near.select(
        "word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    rows = written(rows, "forms")
    return rows.join(roots(rows.filter("form IS NOT NULL").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for forms(word, form): each round doubles the steps that are behind."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        new = written(up.join(over, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        up = new.drop("moved")
        if new.filter("moved").isEmpty():
            return up
