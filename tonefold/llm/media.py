"""Local image descriptors: cropped and edited copies among grey images.

Corners of several scales are turned upright by their intensity centroid and described by 256
comparisons of pixels. Images that share 48 aligned bits of a description meet in a bucket of one of
five Hamming tables. A pair is a link if enough of its descriptions agree under one move, turn and
scaling. Mirrored copies are not sought.

Equal images are one class first. Classes are compared with a leader of their buckets and, as far
as they still lie apart, in blocks of a bucket, so that a bucket is never expanded into pairs: only
links leave a task (and pairs with an image of very many corners, which are compared apart).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonefold.llm.common import bounded_batches, give_back, written
from tonefold.llm.dedup import SIDE, _group_starts, _joined, _leader_pairs, _same_group, mixed

#: Tests stay so near their corner; corners stay that far from an edge, and are the strongest among pixels so near.
RADIUS, SPACING = 8, 3
SCALES = (1.0, 2**0.5, 2.0, 2**1.5, 4.0)
#: A corner's response against the image's strongest.
QUALITY = 0.02
#: Turns that the tests are prepared for.
TURNS = 32
WORDS = 4
#: Bytes of a description that a table's key takes, and tables.
KEY_BYTES, TABLES = 6, 5
#: Bits of 256 that may differ in two descriptions of one place.
MATCH_BITS = 60
#: Corners that must agree under one movement; how far off they may be at first (pixels and a part of the distance), and after the movement is fitted to them.
LEAST_AGREEING, OFF_PIXELS, OFF_PART, FITTED_PIXELS = 8, 2.0, 0.2, 2.5
#: An image of more descriptions does not bring the others where one of them meets another image's.
CARRIED = 64
#: Rounds in which classes meet a leader of their buckets, at most; a round without a link is the last.
ROUNDS = 12
#: Image bytes described together, entries of a matrix, and entries of those of several small images.
BLOCK, AT_ONCE, TOGETHER = 1 << 20, 1 << 20, 1 << 16
#: Pairs of descriptions looked at together.
PAIRS = 1 << 16


def _tests() -> np.ndarray:
    """(turn, 256, 2, (y, x)): the tests' pixels, for each turn."""
    rng = np.random.default_rng(7)
    angle, r = rng.uniform(0, 2 * np.pi, (256, 2)), (RADIUS - 1) * np.sqrt(rng.uniform(0, 1, (256, 2)))
    a = angle + 2 * np.pi * np.arange(TURNS)[:, None, None] / TURNS
    return np.rint(np.stack((r * np.sin(a), r * np.cos(a)), -1)).astype(np.int64)


TESTS = _tests()
DISC = np.array([(y, x) for y in range(-RADIUS + 1, RADIUS) for x in range(-RADIUS + 1, RADIUS) if y * y + x * x < RADIUS * RADIUS])


def _boxed(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1 pixels, edges repeated."""
    for axis in (1, 2):
        wide = np.pad(x, [(0, 0) if k != axis else (r + 1, r) for k in range(3)], mode="edge").cumsum(axis)
        n = x.shape[axis]
        x = (np.take(wide, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(wide, np.arange(n), axis)) / (2 * r + 1)
    return x


def _reduced(x: np.ndarray, scale: float) -> np.ndarray:
    """Images `scale` times smaller: means over squares of that side, parts of pixels counting as such."""
    for axis in (1, 2):
        at = np.arange(int(x.shape[axis] / scale) + 1) * scale
        low = np.minimum(at.astype(np.int64), x.shape[axis] - 1)
        sums = np.pad(x, [(0, 0) if k != axis else (1, 0) for k in range(3)]).cumsum(axis)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        x = np.diff(np.take(sums, low, axis) + part * np.take(x, low, axis), axis=axis) / scale
    return x


def _corners(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the places where the image varies most in every direction, the strongest around."""
    gy, gx = np.gradient(images, axis=(1, 2))
    a, b, c = (_boxed(g, 2) for g in (gy * gy, gx * gx, gy * gx))
    least = (a + b) / 2 - np.sqrt(((a - b) / 2) ** 2 + c * c)
    top = np.pad(least, ((0, 0), (SPACING, SPACING), (SPACING, SPACING)), mode="edge")
    for axis in (1, 2):
        top = np.lib.stride_tricks.sliding_window_view(top, 2 * SPACING + 1, axis).max(-1)
    found = (least >= top) & (least > np.maximum(QUALITY * least.max((1, 2), keepdims=True), 1.0))
    found[:, :RADIUS], found[:, -RADIUS:], found[:, :, :RADIUS], found[:, :, -RADIUS:] = False, False, False, False
    return np.nonzero(found)


def described(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, places, bits) of images of one size: a place is x, y, angle, scale; bits are four 64-bit words."""
    which, places, bits = [], [], []
    for scale in SCALES:
        if min(images.shape[1:]) / scale <= 2 * RADIUS + 1:
            break
        smooth = _boxed(_reduced(images.astype(np.float64), scale) if scale > 1 else images.astype(np.float64), 1)
        n, y, x = _corners(smooth)
        disc = smooth[n[:, None], y[:, None] + DISC[:, 0], x[:, None] + DISC[:, 1]]
        angle = np.arctan2(disc @ DISC[:, 0], disc @ DISC[:, 1])
        turn = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
        at = TESTS[turn]
        smoother = _boxed(smooth, 1)
        seen = smoother[n[:, None, None], y[:, None, None] + at[..., 0], x[:, None, None] + at[..., 1]]
        which.append(n)
        places.append(np.stack(((x + 0.5) * scale, (y + 0.5) * scale, angle, np.full(len(n), scale)), 1).astype(np.float32))
        bits.append(np.packbits(seen[..., 0] < seen[..., 1], axis=1).view(np.uint64).reshape(-1, WORDS))
    if not which:
        return np.zeros(0, np.int64), np.zeros((0, 4), np.float32), np.zeros((0, WORDS), np.uint64)
    which, places, bits = map(np.concatenate, (which, places, bits))
    order = np.argsort(which, kind="stable")
    return which[order], places[order], bits[order]


def _nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each description of a the nearest of b, bits that differ), a block of rows at a time."""
    best, least = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    each = max(1, AT_ONCE // len(b))
    for k in range(0, len(a), each):
        differ = sum(np.bitwise_count(a[k : k + each, None, w] ^ b[None, :, w]).astype(np.int16) for w in range(WORDS))
        best[k : k + each] = differ.argmin(1)
        least[k : k + each] = differ[np.arange(len(differ)), best[k : k + each]]
    return best, least


def agreeing(places_a: np.ndarray, bits_a: np.ndarray, places_b: np.ndarray, bits_b: np.ndarray) -> int:
    """How many of b's places the best single movement brings a's to, among descriptions that are nearest to each other.

    Each match proposes the movement of its angles and scales; the matches that roughly follow it give the
    movement that fits them best, under which they are counted. Places within a pixel count once.
    """
    if not len(places_a) or not len(places_b):
        return 0
    best, least = _nearest(bits_a, bits_b)
    back, _ = _nearest(bits_b, bits_a)
    near = np.flatnonzero((least <= MATCH_BITS) & (back[best] == np.arange(len(best))))
    if len(near) < LEAST_AGREEING:
        return 0
    p, q = places_a[near].astype(np.float64), places_b[best[near]].astype(np.float64)
    z, w = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    move = q[:, 3] / p[:, 3] * np.exp(1j * (q[:, 2] - p[:, 2]))
    spot = np.unique(np.rint(np.column_stack((p[:, :2], q[:, :2])) / 2), axis=0, return_inverse=True)[1].ravel()
    most, each = 0, max(1, AT_ONCE // len(near))
    for a in range(0, len(near), each):
        s = slice(a, a + each)
        d, e = z[None] - z[s, None], w[None] - w[s, None]
        inside = (np.abs(move[s, None] * d - e) <= OFF_PIXELS + OFF_PART * np.abs(e)) & (np.abs(np.log(np.abs(move[None] / move[s, None]))) < 0.5)
        for _ in range(3):
            n = np.maximum(inside.sum(1), 1)
            mz, mw = inside @ z / n, inside @ w / n
            zz = inside @ (np.abs(z) ** 2) - n * np.abs(mz) ** 2
            turn = (inside @ (np.conj(z) * w) - n * np.conj(mz) * mw) / np.maximum(zz, 1e-9)
            off = np.abs(turn[:, None] * (z[None] - mz[:, None]) + mw[:, None] - w[None])
            inside = off <= FITTED_PIXELS * np.maximum(p[:, 3] * np.clip(np.abs(turn), 0.2, 5)[:, None], q[:, 3][None]) ** 0.5
        inside[(np.abs(turn) < 0.2) | (np.abs(turn) > 5)] = False
        for row in np.flatnonzero(inside.sum(1) > most):
            most = max(most, len(np.unique(spot[inside[row]])))
    return most


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.ravel()))


def with_descriptions(images: DataFrame) -> DataFrame:
    """image_id, digest, n_points, places, bits for images(image_id, digest, height, width, pixels); unreadable ones have no points."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes: dict[tuple, list[int]] = {}
            height, width = (batch.column(k).to_pylist() for k in (2, 3))
            pixels = batch.column(4)
            for k, shape in enumerate(zip(height, width)):
                if None not in shape and min(shape) > 2 * RADIUS and pixels[k].is_valid and len(pixels[k].as_buffer()) == shape[0] * shape[1]:
                    shapes.setdefault(shape, []).append(k)
            parts = []
            for (h, w), rows in shapes.items():
                each = max(1, BLOCK // (h * w))
                for a in range(0, len(rows), each):
                    own = np.array(rows[a : a + each])
                    which, places, bits = described(np.stack([np.frombuffer(pixels[int(k)].as_buffer(), np.uint8).reshape(h, w) for k in own]))
                    parts.append((own[which], places, bits))
            row = np.concatenate([x[0] for x in parts] or [np.zeros(0, np.int64)])
            order = np.argsort(row, kind="stable")
            places = np.concatenate([x[1] for x in parts] or [np.zeros((0, 4), np.float32)])[order]
            bits = np.concatenate([x[2] for x in parts] or [np.zeros((0, WORDS), np.uint64)])[order].view(np.int64)
            n = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), _lists(places, 4 * n), _lists(bits, WORDS * n)], ["image_id", "digest", "n_points", "places", "bits"])
        give_back()

    return images.select("image_id", "digest", "height", "width", "pixels").mapInArrow(describe, "image_id long, digest string, n_points long, places array<float>, bits array<long>")


def _confirmed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, linked for pairs(a, b)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa_, ba, pb, bb = (batch.column(k) for k in range(2, 6))
            place = lambda c, k: c[k].values.to_numpy().reshape(-1, 4)
            bit = lambda c, k: c[k].values.to_numpy().view(np.uint64).reshape(-1, WORDS)
            linked = [agreeing(place(pa_, k), bit(ba, k), place(pb, k), bit(bb, k)) >= LEAST_AGREEING for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    of = lambda s: classes.select(F.col("cid").alias(s), F.col("places").alias(f"p_{s}"), F.col("bits").alias(f"b_{s}"))
    rows = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "p_a", "b_a", "p_b", "b_b")
    return rows.mapInArrow(compare, "a long, b long, linked boolean")


def _keys(classes: DataFrame) -> DataFrame:
    """cid, at, key: of each description its key in each table; at is the description's place times TABLES, plus the table."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(1)
            sizes = np.diff(bits.offsets.to_numpy()) // WORDS
            rows = bits.flatten().to_numpy().view(np.uint8).reshape(-1, 8 * WORDS)[:, : KEY_BYTES * TABLES].reshape(-1, TABLES, KEY_BYTES)
            wide = np.zeros((*rows.shape[:2], 8), np.uint8)
            wide[..., :KEY_BYTES], wide[..., -1] = rows, np.arange(TABLES)
            ends = np.cumsum(sizes)
            at = (np.arange(len(rows)) - np.repeat(ends - sizes, sizes))[:, None] * TABLES + np.arange(TABLES)
            cid = np.repeat(batch.column(0).to_numpy(), sizes * TABLES)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(at.ravel().astype(np.int32)), pa.array(mixed(wide.view(np.uint64).ravel()).view(np.int64))], ["cid", "at", "key"])

    return classes.select("cid", "bits").mapInArrow(cut, "cid long, at int, key long")


@lru_cache(64)
def _each_two(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _may_agree(bits: np.ndarray, start: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of images x, y: do LEAST_AGREEING of their descriptions match as agreeing() asks, whatever the movement?

    Image k has the descriptions bits[start[k] : start[k] + size[k]].
    """
    out = np.zeros(len(x), bool)
    order = np.argsort(np.maximum(size[x], size[y]), kind="stable")
    order = order[np.minimum(size[x], size[y])[order] >= LEAST_AGREEING]
    a = 0
    while a < len(order):
        # Pairs of about one size; the last of a run is its largest.
        each = max(1, TOGETHER // int(max(size[x[order[a]]], size[y[order[a]]])) ** 2)
        own = order[a : a + each]
        most = int(max(size[x[own[-1]]], size[y[own[-1]]]))
        own = own[: max(1, TOGETHER // most**2)]
        a += len(own)
        place = np.arange(most)
        p, q = ((start[k][:, None] + place, place < size[k][:, None]) for k in (x[own], y[own]))
        left, right = (bits[np.where(ok, at, 0)] for at, ok in (p, q))
        differ = np.zeros((len(own), most, most), np.uint16)
        for w in range(WORDS):
            differ += np.bitwise_count(left[:, :, None, w] ^ right[:, None, :, w])
        differ[~p[1]] = 1 << 10
        differ.swapaxes(1, 2)[~q[1]] = 1 << 10
        some = np.flatnonzero((differ.min(2) <= MATCH_BITS).sum(1) >= LEAST_AGREEING)
        differ = differ[some]
        best, back = differ.argmin(2), differ.argmin(1)
        near = (differ.min(2) <= MATCH_BITS) & (np.take_along_axis(back, best, 1) == place)
        out[own[some]] = near.sum(1) >= LEAST_AGREEING
    return out


def _open_pairs(members: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes of different components with two near descriptions in a bucket that link, each pair once.

    Unrelated images share a near description by chance, in a number that grows with the square of theirs, so a
    pair is compared where it meets: each member brings all descriptions of its image, if there are no more
    than CARRIED. Pairs with an image of more pass, linked or not.
    """
    m = members.join(nodes.select("cid", "comp"), "cid")
    open_ = m.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("blocks")).filter("low <> high")
    m = m.join(open_.select("key", "blocks"), "key").join(classes.select("cid", "places", "bits"), "cid")
    place, whole = F.floor(F.col("at") / TABLES).cast("int"), F.size("bits") <= CARRIED * WORDS
    m = m.withColumn("block", F.pmod(F.xxhash64("cid", "at"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "comp", (F.col("at") % TABLES).alias("t"),
        F.when(whole, place).otherwise(-1).alias("place"), F.when(whole, F.col("bits")).otherwise(F.slice("bits", place * WORDS + 1, WORDS)).alias("bits"),
        F.when(whole, F.col("places")).otherwise(F.slice("places", place * 4 + 1, 4)).alias("places"),
    )

    def near(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        starts = np.append(_group_starts(rows), rows.num_rows)
        i, j, block, cid, comp, t, place = (rows.column(k).to_numpy() for k in range(1, 8))
        places = rows["places"].combine_chunks().flatten().to_numpy().reshape(-1, 4)
        lists = rows["bits"].combine_chunks()
        bits = lists.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        size = lists.value_lengths().to_numpy() // WORDS
        start = np.cumsum(size) - size
        own = bits[start + np.maximum(place, 0)]

        def passing(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            ok = comp[x] != comp[y]
            x, y = x[ok], y[ok]
            other = own[x] ^ own[y]
            ok = np.bitwise_count(other).sum(1) <= MATCH_BITS
            cut = other.view(np.uint8).reshape(-1, 8 * WORDS)[:, : KEY_BYTES * TABLES].reshape(-1, TABLES, KEY_BYTES)
            ok &= ~(~cut.any(2) & (np.arange(TABLES) < t[x][:, None])).any(1)
            x, y = x[ok], y[ok]
            pairs, first = np.unique(np.sort(np.stack((cid[x], cid[y]), 1), 1), axis=0, return_index=True)
            x, y = x[first], y[first]
            x, y = np.where(cid[x] < cid[y], (x, y), (y, x))
            ok = (place[x] < 0) | (place[y] < 0)
            whole = np.flatnonzero(~ok)
            whole = whole[_may_agree(bits, start, size, x[whole], y[whole])]
            of = lambda k: (places[start[k] : start[k] + size[k]], bits[start[k] : start[k] + size[k]])
            ok[whole] = [agreeing(*of(p), *of(q)) >= LEAST_AGREEING for p, q in zip(x[whole], y[whole])]
            return pa.RecordBatch.from_arrays([pa.array(pairs[ok, 0]), pa.array(pairs[ok, 1])], ["a", "b"])

        found, n = [], 0
        for a, b in zip(starts[:-1], starts[1:]):
            if i[a] == j[a]:
                x, y = _each_two(b - a)
            else:
                x, y = np.flatnonzero(block[a:b] == i[a]), np.flatnonzero(block[a:b] == j[a])
                x, y = np.repeat(x, len(y)), np.tile(y, len(x))
            found.append((x + a, y + a))
            n += len(x)
            if n >= PAIRS:
                yield passing(*map(np.concatenate, zip(*found)))
                found, n = [], 0
        if found:
            yield passing(*map(np.concatenate, zip(*found)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and not _same_group(held[-1], batch):
                yield from near(held)
                held = []
            if last := int(_group_starts(batch)[-1]):
                yield from near([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from near(held)

    return m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def edited_copies(images: DataFrame, image_id: str = "image_id", pixels: str = "pixels", height: str = "height", width: str = "width") -> DataFrame:
    """image_id, n_points, component_id, kept: one row for each row of images, whose pixels are grey bytes row by row.

    component_id is the smallest image_id that links lead to, and kept marks the image of that id.
    Equal images link. A null image, one whose size is not height times width, and one without corners link
    with none but its equals (a null with nothing), nor do images of under LEAST_AGREEING corners; a row without an id has a null component_id and is kept.
    """
    bounded_batches(images.sparkSession)
    source = images.select(
        F.col(image_id).cast("long").alias("image_id"), F.col(height).cast("int").alias("height"), F.col(width).cast("int").alias("width"), F.col(pixels).cast("binary").alias("pixels"),
    ).withColumn("digest", F.sha2(F.concat(F.encode(F.concat_ws("x", F.col("height"), F.col("width"), F.lit("")), "utf-8"), F.col("pixels")), 256))
    rows = written(with_descriptions(source), "described")
    linkable = rows.filter("image_id IS NOT NULL AND digest IS NOT NULL")
    classes = linkable.groupBy("digest").agg(F.min("image_id").alias("cid"), F.min("n_points").alias("n_points"), F.first("places").alias("places"), F.first("bits").alias("bits"))
    # Rows that share an id may differ; a class's own number keeps them apart.
    classes = written(classes.withColumnRenamed("cid", "image_id").withColumn("cid", F.monotonically_increasing_id()), "classes")
    keys = _keys(classes)
    shared = keys.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).filter("low <> high").select("key")
    members = written(keys.join(shared, "key"), "members")
    nodes = written(members.select("cid").distinct().select("cid", F.col("cid").alias("comp")), "nodes")
    for k in range(ROUNDS):
        order = F.xxhash64("cid", F.lit(k)) if k else F.col("cid")
        found = written(_confirmed(_leader_pairs(members, nodes, order), classes), "links")
        nodes = _joined(nodes, found)
        if k and found.filter("linked").isEmpty():
            break
    rest = written(_open_pairs(members, nodes, classes), "pairs")
    nodes = _joined(nodes, written(_confirmed(rest, classes), "links"))

    own = classes.select("digest", "image_id", "cid").join(nodes, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    smallest = own.groupBy("comp").agg(F.min("image_id").alias("component_id"))
    out = rows.select("image_id", "digest", "n_points").join(own.join(smallest, "comp").select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("image_id").isNotNull(), F.coalesce("component_id", "image_id"))
    return out.select("image_id", "n_points", component.alias("component_id"), (F.col("image_id").isNull() | (F.col("image_id") == component)).alias("kept"))


#: Side of a drawn picture, and how far its greys deviate from mid grey.
SIDE_PIXELS, CONTRAST = 56, 45


def fields(n: int) -> np.ndarray:
    """n fixed random pictures, a row each: noise that is the mean of 3 by 3 pixels, twice, so that neighbours are alike and no patch comes again."""
    x = np.random.default_rng(11).normal(size=(n, SIDE_PIXELS, SIDE_PIXELS))
    for _ in range(2):
        for axis in (1, 2):
            x = (np.roll(x, 1, axis) + x + np.roll(x, -1, axis)) / 3
    # Both passes are 1, 2, 3, 2, 1 ninths along either axis, which leaves 19 / 81 of the deviation, whatever n is.
    return (x * (81 / 19)).reshape(n, -1)


def drawn(rows: DataFrame, image_id: str, vector: str) -> DataFrame:
    """image_id, height, width, pixels: each vector as a picture, the sum of fixed random pictures by its numbers.

    A vector of zeros (or of no number) is plain mid grey; a null has no picture. Values that are no numbers count as 0.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = batch.column(1), batch.num_rows
            sizes = np.nan_to_num(v.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            values = np.zeros((n, max(1, sizes.max(initial=0))))
            values[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.nan_to_num(v.flatten().to_numpy(zero_copy_only=False), posinf=0, neginf=0)
            length = np.sqrt((values**2).sum(1, keepdims=True))
            grey = values / np.where(length > 0, length, 1) @ fields(values.shape[1])
            grey = np.clip(np.rint(128 + CONTRAST * grey), 0, 255).astype(np.uint8)
            side = pa.array(np.full(n, SIDE_PIXELS, np.int32), mask=v.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), side, side, pa.array([x.tobytes() if ok else None for x, ok in zip(grey, v.is_valid().to_pylist())], pa.binary())], ["image_id", "height", "width", "pixels"])

    return rows.select(F.col(image_id).cast("long").alias("image_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(draw, "image_id long, height int, width int, pixels binary")


#: Images that edits are made of: those whose id it divides. Ids of edits: PLANTED, then four for each image.
EACH, PLANTED = 50, 1_000_000_000_000
EDITS = {
    "cropped": lambda x, rng: x[x.shape[0] // 16 : x.shape[0] - x.shape[0] // 16, x.shape[1] // 16 : x.shape[1] - x.shape[1] // 16],
    "noisy": lambda x, rng: np.clip(np.rint(x + rng.normal(0, 10, x.shape)), 0, 255),
    "turned": lambda x, rng: np.rot90(x),
    "darker": lambda x, rng: np.rint(x * 0.7 + 20),
}


def with_edits(images: DataFrame, each: int = EACH) -> DataFrame:
    """images(image_id, height, width, pixels) and, of those whose id `each` divides, EDITS as images of their own: PLANTED + 4 * id and the edit's place. Images without a picture have no edits."""

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, height, width, pixels in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(pixels, np.uint8).reshape(height, width)
                for k, change in enumerate(EDITS.values()):
                    y = change(x.astype(np.float64), np.random.default_rng([image & 0xFFFFFFFF, k])).astype(np.uint8)
                    rows.append((PLANTED + 4 * image + k, *y.shape, y.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], batch.schema.names)

    chosen = images.filter((F.col("image_id") % each == 0) & (F.length("pixels") == F.col("height") * F.col("width")))
    return images.unionByName(chosen.mapInArrow(edit, images.schema))
