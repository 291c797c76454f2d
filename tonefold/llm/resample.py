"""Importance resampling towards a target's distribution of hashed word features.

Features of one and two words are counted in BUCKETS buckets over all documents and over the
target's texts; a bucket's gain is its scaled log ratio. The counts and gains are arrays of fixed
size, which travel with the tasks. A document's score is its mean gain plus noise that its id alone
fixes, so the highest scores are a draw without replacement and reruns agree.

The draw is an external merge. Scoring leaves each partition's eligible rows as a sorted run in the
shared folder. The scores are counted (they are few: whole thousandths of a logarithm), which gives
the lowest score that is drawn; only rows from it upwards are dealt to ranges of the order, and each
range merges the runs' shares by a tournament tree. The ranges' sizes number them through, and a
tree stops as soon as the draw is full.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonefold.llm.common import CRC, CRC_START, LOWERED_BYTES, bounded_batches, byte_column, crc_after, give_back, row_blocks, runs_inside, whole_groups, written

BUCKETS, SEED, LEAST_WORDS, PER_CENT = 10_000, 7, 20, 25
BLOCK = 1 << 20
#: Bytes of words, once A-Z are lowered: digits, a-z and all of other characters' bytes.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text, words of each text) of texts that lie in a row."""
    data = LOWERED_BYTES[data]
    start, end, words = runs_inside(_WORD[data], offsets)
    text = np.repeat(np.arange(len(words)), words)
    one = crc_after(np.full(len(start), CRC_START), data, start, end)
    pair = np.flatnonzero(text[1:] == text[:-1])
    # The second word's bytes go on from the first word's register and a space.
    space = CRC[(one[pair] ^ np.uint32(32)) & np.uint32(255)] ^ (one[pair] >> np.uint32(8))
    two = crc_after(space, data, start[pair + 1], end[pair + 1])
    return ~np.concatenate((one, two)) % np.uint32(BUCKETS), np.concatenate((text, text[pair])), words


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of a text column's rows."""
    data, offsets = byte_column(column)
    for a, b in row_blocks(offsets, BLOCK):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts of df; a null text has no words. BUCKETS sums come to the driver, whatever df's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                total += np.bincount(features(data, offsets)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
        give_back()

    bounded_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's add-one shares, floored."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(source, target)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variate that seed and id fix, floored. A null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of docs; a text without words weighs 0."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in blocks(batch.column(1)):
                bucket, of, words = features(data, offsets)
                total = np.zeros(b - a, np.int64)
                np.add.at(total, of, gain[bucket])
                n = np.bincount(of, minlength=b - a)
                weight = total // np.maximum(n, 1)
                plus = np.array([noise(i, seed) for i in ids[a:b]], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, (words, n, weight, weight + plus))], ["doc_id", "n_words", "n_features", "weight", "score"])
        give_back()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


class TournamentTree:
    """Merges sorted runs of indices: a node holds the better of the heads below it, and only the winner's path is played again."""

    def __init__(self, heads: list[int], ends: list[int], before) -> None:
        """heads, ends: the places of each run's first row and behind its last; before(p, q) says that row p comes first."""
        self.at, self.ends, self.before, self.k = list(heads), ends, before, len(heads)
        self.node = [0] * self.k + list(range(self.k))
        for n in range(self.k - 1, 0, -1):
            self.play(n)

    def play(self, n: int) -> None:
        one, two = self.node[2 * n], self.node[2 * n + 1]
        done = self.at[one] >= self.ends[one]
        self.node[n] = two if done or (self.at[two] < self.ends[two] and self.before(self.at[two], self.at[one])) else one

    def __iter__(self) -> Iterator[int]:
        while self.k:
            run = self.node[1]
            if self.at[run] >= self.ends[run]:
                return
            yield self.at[run]
            self.at[run] += 1
            n = (run + self.k) // 2
            while n:
                self.play(n)
                n //= 2


#: Rows of a range, about: what a task of the merge holds, 32 bytes a row.
RANGE_ROWS = 20_000


def order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("rid")]


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs: rank numbers the per_cent of the eligible rows with the highest scores.

    Eligible are texts of least_words words or more. Ties go to the smaller doc_id, a null id first; rows that repeat an id
    are candidates of their own, in no stated order. Null and empty texts have no features and weigh 0; an empty docs gives
    no rows, an empty target compares with equal shares. Other columns play no part.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    rows = scored(docs, gain, doc_id, text, seed).withColumns({"rid": F.monotonically_increasing_id(), "run": F.spark_partition_id()})
    runs = written(rows.sortWithinPartitions(*order()), "runs")
    eligible = F.col("n_words") >= least_words
    # One row a score: scores are sums of a mean gain and a floored variate of 32 bits, less than 200,000 values for any corpus.
    counts = sorted(((r["score"], r["n"]) for r in runs.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted, upto, cut = per_cent * sum(n for _, n in counts) // 100, 0, None
    for score, n in counts:
        if upto >= wanted:
            break
        upto, cut = upto + n, score
    plain = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return runs.select(*plain, F.lit(None).cast("long").alias("rank"))
    chosen = eligible & (F.col("score") >= cut)
    ranges = -(-upto // range_rows)
    dealt = written(runs.filter(chosen).repartitionByRange(ranges, *order()).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dict(dealt.groupBy("range").count().collect())
    before, at = {}, 0
    for k in sorted(sizes):
        before[k] = at
        at += sizes[k]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            part, run, score, rid = (table.column(k).to_numpy() for k in range(4))
            # A null id is below any other.
            known = table["doc_id"].is_valid().to_numpy().tolist()
            ids = table["doc_id"].fill_null(0).to_numpy().tolist()
            key = list(zip((-score).tolist(), known, ids, rid.tolist()))
            edges = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True]))).tolist()
            left = wanted - before[int(part[0])]
            rank = np.zeros(len(key), np.int64)
            for n, row in enumerate(TournamentTree(edges[:-1], edges[1:], lambda p, q: key[p] < key[q])):
                if n >= left:
                    break
                rank[row] = before[int(part[0])] + n + 1
            out = table.select(plain).append_column("rank", pa.array(rank, mask=rank == 0))
            yield from out.to_batches()

    ready = dealt.select("range", "run", "score", "rid", "doc_id", "n_features", "weight").repartition("range").sortWithinPartitions("range", "run", *order())
    ranked = ready.mapInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")
    return ranked.unionByName(runs.filter(~chosen).select(*plain, F.lit(None).cast("long").alias("rank")))
