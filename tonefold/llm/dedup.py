"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct five-word shingles. Two small collections of band hashes are
made, `halves` in each and ROWS minhashes to a band; a table's key joins one band of the first
with one of the second, so 2 * halves * ROWS minhashes give halves ** 2 tables. A pair of
similarity s meets in a table with chance (1 - (1 - s ** ROWS) ** halves) ** 2: 0.9998 at 0.85
with 10 halves. A lower limit has as many halves as keep that chance at the limit: 14 at 0.80.

Exact copies (equal sets) are one class from the start, and only classes are banded. What
meets is confirmed on full sets. No bucket is multiplied out: in a round, each class is
compared with the one bucket leader that it meets most, and what links is one component. Only
members of different components still need comparing; the last round does all of these pairs
that could link, each in one table only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonefold.llm.common import bounded_batches, byte_column, give_back, row_blocks, unused, written

SHINGLE = 5
ROWS, MOST_HALVES = 3, 32
PER_CENT = 85
#: A pair at the limit meets no band of a collection with at most this chance.
MISSED = 8e-5
BLOCK = 1 << 18
#: One bit for each of so many further minhashes, for classes that meet others: the share of bits that
#: differ estimates half the distance, with a deviation of 0.0165 in similarity at a limit of 0.85 (0.019 at 0.80).
BITS = 1024


@dataclass(frozen=True)
class Limit:
    """What follows from the similarity that links: bands, the distance of a link, and bits that may differ.

    alike is as many bits as a pair at the limit has on average, least_alike 4.2 deviations more
    (one such pair in 75,000 has more).
    """

    per_cent: int
    halves: int
    far: float
    alike: int
    least_alike: int

    @staticmethod
    def of(per_cent: int) -> Limit:
        s, bit = per_cent / 100, (1 - per_cent / 100) / 2
        halves = min(MOST_HALVES, math.ceil(math.log(MISSED) / math.log(1 - s**ROWS))) if s < 1 else 1
        return Limit(per_cent, halves, 1 - s + 1e-9, math.ceil(BITS * bit), int(BITS * bit + 4.2 * math.sqrt(BITS * bit * (1 - bit))))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Odd multipliers drawn from a fixed seed; the first is the base of the words' polynomial.
_ODD = np.random.default_rng(20_240_101).integers(0, 1 << 63, 2 * MOST_HALVES * ROWS + 2, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in a row, number of words of each text). A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~space
    start = np.flatnonzero(inside & (np.concatenate(([True], space[:-1])) | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
    power = np.cumprod(np.full(len(data), _ODD[0]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power)))
    inverse = np.uint64(pow(int(_ODD[0]), -1, 1 << 64))
    h = (sums[end] - sums[start]) * np.cumprod(np.full(len(data), inverse))[start]
    return mixed(h), np.diff(np.searchsorted(start, offsets))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in order, their number by text). A shorter text's whole sequence is its one shingle."""
    h, words = word_hashes(data, offsets)
    first = np.cumsum(words) - words
    n = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    ends = np.cumsum(n)
    at = np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    long = np.repeat(np.minimum(words, size), n)
    tail = np.concatenate((h, np.zeros(size, np.uint64)))
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total = mixed(total + np.where(k < long, tail[at + k], np.uint64(0))) + np.uint64(k)
    parts = [np.unique(total[a:b]) for a, b in zip(ends - n, ends)]
    return (np.concatenate(parts) if parts else total), np.fromiter(map(len, parts), np.int64, len(parts))


def half_bands(sets: np.ndarray, sizes: np.ndarray, halves: int) -> np.ndarray:
    """(texts, 2 * halves) band hashes; sizes are all over 0."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), 2 * halves), np.uint64)
    for band in range(2 * halves):
        key = np.full(len(sizes), band + 1, np.uint64)
        for row in range(ROWS):
            key = mixed(key ^ np.minimum.reduceat(sets * _ODD[2 + band * ROWS + row], starts))
        out[:, band] = key
    return out


def bit_sketches(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, BITS / 64): a bit of each of BITS minhashes; sizes are all over 0."""
    starts = np.cumsum(sizes) - sizes
    odd = np.random.default_rng(20_240_102).integers(0, 1 << 63, BITS, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sizes), BITS // 64), np.uint64)
    for k in range(BITS):
        out[:, k // 64] |= (mixed(np.minimum.reduceat(sets * odd[k], starts)) & np.uint64(1)) << np.uint64(k % 64)
    return out


SKETCH = "doc_id long, text_hash long, n long, f1 long, f2 long, halves array<long>"


def sketches(docs: DataFrame, halves: int) -> DataFrame:
    """doc_id, text_hash, size of the set, two hashes of the set (null if empty), its half bands, for docs(doc_id, text, text_hash)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK):
                sets, n = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = n > 0
                bands = np.zeros((b - a, 2 * halves), np.int64)
                f = np.zeros((2, b - a), np.int64)
                if some.any():
                    starts = (np.cumsum(n) - n)[some]
                    bands[some] = half_bands(sets, n[some], halves).view(np.int64)
                    f[0, some] = np.add.reduceat(mixed(sets), starts).view(np.int64)
                    f[1, some] = np.add.reduceat(mixed(sets ^ _ODD[5]), starts).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * (2 * halves)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), pa.array(f[0], mask=~some), pa.array(f[1], mask=~some), flat], ["doc_id", "text_hash", "n", "f1", "f2", "halves"])
        give_back()

    return docs.mapInArrow(sketch, SKETCH)


def confirmed(pairs: DataFrame, texts: DataFrame, per_cent: int) -> DataFrame:
    """a, b, linked, distance for pairs(a, b), on the full sets of texts(cid, text)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> list[np.ndarray]:
            data, offsets = byte_column(column)
            out = []
            for x, y in row_blocks(offsets, BLOCK):
                s, n = shingles(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                out += np.split(s, np.cumsum(n)[:-1])
            return out

        for batch in batches:
            both, either = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            # Pairs of long texts: a few at a time.
            for a, b in row_blocks(byte_column(batch.column(2))[1] + byte_column(batch.column(3))[1], 4 * BLOCK):
                left, right = (sets(batch.column(c).slice(a, b - a)) for c in (2, 3))
                both[a:b] = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
                either[a:b] = [len(x) + len(y) for x, y in zip(left, right)]
            either -= both
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(100 * both >= per_cent * either), pa.array(1 - both / np.maximum(either, 1))], ["a", "b", "linked", "distance"])
        give_back()

    of = lambda side: texts.select(F.col("cid").alias(side), F.col("text").alias(f"text_{side}"))
    rows = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(compare, "a long, b long, linked boolean, distance double")


def components(edges: DataFrame) -> DataFrame:
    """cid, comp (one id a component) of all ends of edges(a, b). Contracts until no edge is left."""
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = e.select(F.col("a").alias("cid")).union(e.select("b")).distinct().select("cid", F.col("cid").alias("comp"))
    while not e.isEmpty():
        near = e.union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        near = written(near, "parents")
        over = near.select(F.col("a").alias("up"), F.col("up").alias("top"))
        parents = written(near.join(over, "up").select("a", "top"), "parents")
        labels = written(labels.join(parents.withColumnRenamed("a", "comp"), "comp", "left").select("cid", F.coalesce("top", "comp").alias("comp")), "labels")
        e = e.join(parents.withColumnRenamed("top", "x"), "a").join(parents.select(F.col("a").alias("b"), F.col("top").alias("y")), "b")
        e = written(e.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels


def relabelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes(cid, comp) with comp exchanged by labels(cid, comp) of components."""
    new = labels.select(F.col("cid").alias("comp"), F.col("comp").alias("top"))
    return written(nodes.join(new, "comp", "left").withColumn("comp", F.coalesce("top", "comp")).drop("top"), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, leader: one row for each row of docs.

    component_id is the smallest doc_id that links lead to; kept marks the document of that id, and
    leader one row of each component. Sets link at a Jaccard similarity of per_cent or more. Texts without words link with nothing, nor do rows without an
    id (component_id null, kept true). Rows that share an id are documents of their own, which
    text_hash (of the text as it is, null as empty) tells apart.
    """
    limit = Limit.of(per_cent)
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = written(sketches(source.withColumn("text_hash", F.xxhash64("text")), limit.halves).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    linkable = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("n", "f1", "f2").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("doc_id"), F.first("halves").alias("halves"))
    classes = written(classes, "classes")
    table = F.sequence(F.lit(0), F.lit(limit.halves**2 - 1))
    key = F.transform(table, lambda t: F.xxhash64(t, F.get("halves", F.floor(t / limit.halves).cast("int")), F.get("halves", limit.halves + t % limit.halves)))
    keys = classes.select("cid", F.posexplode(key).alias("t", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members = written(keys.join(shared, "key"), "members")
    met = members.select("cid").distinct()
    nodes = written(classes.join(met, "cid", "left_semi").select("cid", "n", "doc_id", "f1", F.col("cid").alias("comp")), "classes")
    texts = written(_texts_of(nodes, source), "texts")

    pivots = None
    for order in (F.col("cid"), F.xxhash64("cid")):
        pairs = _leader_pairs(members, nodes, order)
        found = written(confirmed(pairs, texts, per_cent), "links")
        if pivots is None:
            pivots = found.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), "distance")
        nodes = _joined(nodes, found)
    for differ in (limit.alike, limit.least_alike):
        rest = written(_open_pairs(members, nodes, classes, pivots, texts, limit, differ), "pairs")
        nodes = _joined(nodes, written(confirmed(rest, texts, per_cent), "links"))

    own = classes.join(nodes.select("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    smallest = own.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min_by("cid", F.struct("doc_id", "cid")).alias("leader"))
    answer = own.select("n", "f1", "f2", "comp").join(smallest, "comp").drop("comp")
    out = rows.drop("halves").join(answer, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"),
        (alone | (F.col("doc_id") == component)).alias("kept"), (alone | (F.col("rid") == F.col("leader"))).alias("leader"),
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_cent: int = PER_CENT) -> DataFrame:
    """One row of docs for each group of near duplicates: its leader.

    Of rows that share their id and text, that with the least other values stays (columns that can't be
    compared, as maps, don't count). Rows without an id, or without words, stay, repeats of one text once.
    """
    own = unused(docs, "_same")
    leaders = near_duplicates(docs, doc_id, text, per_cent).filter("leader").select(F.col("doc_id").alias(f"{own}_id"), F.col("text_hash").alias(f"{own}_text")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    kept = rows.join(leaders, rows["id"].eqNullSafe(leaders[f"{own}_id"]) & (rows["hash"] == leaders[f"{own}_text"]), "left_semi")
    order = F.struct(*[F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    return kept.groupBy("id", "hash").agg(F.min_by("row", order).alias("row")).select("row.*")


def _texts_of(nodes: DataFrame, source: DataFrame) -> DataFrame:
    """cid, text, bits: for each class a text that has its set, found by the class's smallest doc_id, and the set's bit sketch."""
    wanted = nodes.select("doc_id", "cid", "f1")
    rows = _likely(source, wanted).join(wanted, "doc_id")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(2))
            for a, b in row_blocks(offsets, BLOCK):
                sets, n = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                f = np.array([mixed(x).sum() for x in np.split(sets, np.cumsum(n)[:-1])], np.uint64).view(np.int64)
                here = batch.slice(a, b - a)
                bits = np.zeros((b - a, BITS // 64), np.int64)
                if (n > 0).any():
                    bits[n > 0] = bit_sketches(sets, n[n > 0]).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(2), flat], ["cid", "text", "bits"]).filter(pa.array(f == here.column(1).to_numpy()))
        give_back()

    return rows.select("cid", "f1", "text").mapInArrow(same, "cid long, text string, bits array<long>").dropDuplicates(["cid"])


#: The bits of a map of ids, in words of 64: it takes 4 MB, whatever the number of ids.
MAP_WORDS = 1 << 18


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows(doc_id, ...) without most of those whose doc_id is not among wanted's, so that a join shuffles few others.

    A map with a bit for each hashed id is broadcast: it has a fixed size, so that with very many ids it only lets more through.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_WORDS * 64))
    word, bit = F.shiftright(spot, 6), F.pmod(spot, F.lit(64)).cast("int")
    bits = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = rows.withColumn("word", word).join(F.broadcast(bits), "word")
    return marked.filter(F.getbit("bits", bit) == 1).drop("word", "bits")


def _leader_pairs(members: DataFrame, nodes: DataFrame, order) -> DataFrame:
    """a, b: for each class the leader of another component that it meets in most buckets."""
    m = members.join(nodes.select("cid", "comp"), "cid")
    leaders = m.groupBy("key").agg(F.min(F.struct(order.alias("o"), "cid", "comp")).alias("lead"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    leaders = leaders.select("key", F.col("lead.cid").alias("b"), F.col("lead.comp").alias("b_comp"))
    meets = m.join(leaders, "key").filter("comp <> b_comp").groupBy(F.col("cid").alias("a"), "b").agg(F.count(F.lit(1)).alias("times"))
    return meets.groupBy("a").agg(F.max_by("b", F.struct("times", -F.col("b"))).alias("b"))


#: Members of a bucket that one task compares with as many others at a time.
SIDE = 512
#: Pairs looked at together.
AT_ONCE = 200_000


def _open_pairs(members: DataFrame, nodes: DataFrame, classes: DataFrame, pivots: DataFrame, texts: DataFrame, limit: Limit, differ: int) -> DataFrame:
    """a, b: all pairs that meet, lie in different components and could be similar enough, each once.

    A bucket's members are dealt into blocks of about SIDE, and each two blocks are compared apart,
    so that no task holds more than two blocks. Only pairs that pass leave it: a pair counts in the
    first table where it meets; set sizes alone rule out many; so does a common pivot, as Jaccard
    distance is a metric: distances to it that differ by more than a link allows; and so do bit
    sketches with more than `differ` bits that differ.
    """
    info = nodes.select("cid", "comp", "n").join(classes.select("cid", F.transform("halves", lambda x: F.shiftright(x, 32).cast("int")).alias("halves")), "cid")
    info = info.join(texts.select("cid", "bits"), "cid").join(pivots, "cid", "left")
    m = members.join(nodes.select("cid", "comp"), "cid")
    open_ = m.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("blocks")).filter("low <> high")
    m = members.join(open_.select("key", "blocks"), "key").join(info, "cid")
    m = m.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "t", "cid", "comp", "n", F.coalesce("pivot", F.lit(-1)).alias("pivot"), F.coalesce("distance", F.lit(0.0)).alias("distance"), "halves", "bits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _group_starts(batch)
            last = int(new[-1])
            if held and not _same_group(held[-1], batch):
                yield from _passing(held, limit, differ)
                held = []
            if last:
                yield from _passing([*held, batch.slice(0, last)], limit, differ)
                held = []
            held.append(batch.slice(last))
        if held:
            yield from _passing(held, limit, differ)
        give_back()

    return m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")


def _group_starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    key, i, j = (rows.column(k).to_numpy() for k in range(3))
    return np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))


def _same_group(one: pa.RecordBatch, two: pa.RecordBatch) -> bool:
    return all(one.column(k)[-1] == two.column(k)[0] for k in range(3))


def _passing(batches: list[pa.RecordBatch], limit: Limit, differ: int) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups that may be links."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    starts = np.append(_group_starts(rows), rows.num_rows)
    i, j, block, t, cid, comp, n, pivot, distance = (rows.column(k).to_numpy() for k in range(1, 10))
    halves = rows["halves"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * limit.halves)
    bits = rows["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)

    def passing(p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        ok = (comp[p] != comp[q]) & (np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * limit.per_cent)
        ok &= (pivot[p] != pivot[q]) | (pivot[p] < 0) | (np.abs(distance[p] - distance[q]) <= limit.far)
        p, q = p[ok], q[ok]
        ok = np.bitwise_count(bits[p] ^ bits[q]).sum(1) <= differ
        p, q = p[ok], q[ok]
        hit = halves[p] == halves[q]
        ok = hit[:, : limit.halves].argmax(1) * limit.halves + hit[:, limit.halves :].argmax(1) == t[p]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[p], cid[q])[ok]), pa.array(np.maximum(cid[p], cid[q])[ok])], ["a", "b"])

    held, size = [], 0
    for a, b in zip(starts[:-1], starts[1:]):
        if i[a] == j[a]:
            x, y = np.triu_indices(b - a, 1)
        else:
            x, y = np.flatnonzero(block[a:b] == i[a]), np.flatnonzero(block[a:b] == j[a])
            x, y = np.repeat(x, len(y)), np.tile(y, len(x))
        held.append((x + a, y + a))
        size += len(x)
        if size >= AT_ONCE:
            yield passing(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield passing(*map(np.concatenate, zip(*held)))


def _joined(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with the components that found's links join made one."""
    of = lambda side: nodes.select(F.col("cid").alias(side), F.col("comp").alias(f"c_{side}"))
    edges = found.filter("linked").join(of("a"), "a").join(of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    return relabelled(nodes, components(edges))
