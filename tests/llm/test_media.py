"""Edited copies among small images, against all pairs, and recall by kind of edit."""

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from tonefold.llm import media
from tonefold.llm.queries import QUERIES

IMAGES = "image_id long, height int, width int, pixels binary, digest string, comp string, bits string"


def to_bytes(x):
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def scene(seed, side=128):
    """Discs, bars and slow shading: no tiles, on which no limit was picked."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side]
    image = 128 + 40 * np.sin(x / rng.uniform(10, 40)) + 30 * np.cos(y / rng.uniform(10, 40))
    for _ in range(60):
        at, half, turn = rng.uniform(0, side, 2), rng.uniform(3, 16, 2), rng.uniform(0, np.pi)
        u = (x - at[0]) * np.cos(turn) + (y - at[1]) * np.sin(turn)
        v = (y - at[1]) * np.cos(turn) - (x - at[0]) * np.sin(turn)
        inside = np.maximum(np.abs(u / half[0]), np.abs(v / half[1])) < 1 if rng.random() < 0.5 else (u / half[0]) ** 2 + (v / half[1]) ** 2 < 1
        image = np.where(inside, rng.uniform(0, 255), image)
    return to_bytes(image + rng.normal(0, 2, image.shape)).astype(np.float64)


def warped(image, turn, scale):
    h, w = image.shape
    y, x = np.mgrid[: int(h * scale), : int(w * scale)]
    x, y = (x + 0.5) / scale - w / 2, (y + 0.5) / scale - h / 2
    u, v = np.cos(turn) * x - np.sin(turn) * y + w / 2 - 0.5, np.sin(turn) * x + np.cos(turn) * y + h / 2 - 0.5
    a, b = np.clip(u.astype(int), 0, w - 2), np.clip(v.astype(int), 0, h - 2)
    p, q = np.clip(u - a, 0, 1), np.clip(v - b, 0, 1)
    return (image[b, a] * (1 - p) + image[b, a + 1] * p) * (1 - q) + (image[b + 1, a] * (1 - p) + image[b + 1, a + 1] * p) * q


RNG = np.random.default_rng(0)
EDITS = {
    "crop to 71 %": lambda x: x[10:118, 14:122], "crop to 50 %": lambda x: x[20:111, 24:115], "darker": lambda x: x * 0.7 + 20, "gamma": lambda x: 255 * (x / 255) ** 1.5,
    "noise 4": lambda x: x + RNG.normal(0, 4, x.shape), "noise 10": lambda x: x + RNG.normal(0, 10, x.shape), "16 greys": lambda x: np.floor(x / 16) * 16 + 8,
    "quarter turn": np.rot90, "turn by 15 degrees": lambda x: warped(x, 0.26, 1), "turn by 45 degrees": lambda x: warped(x, 0.785, 1),
    "scaled by 0.9": lambda x: warped(x, 0, 0.9), "scaled by 0.8": lambda x: warped(x, 0, 0.8), "scaled by 0.7": lambda x: warped(x, 0, 0.7), "scaled by 0.6": lambda x: warped(x, 0, 0.6), "scaled by 0.5": lambda x: warped(x, 0, 0.5),
    "mirrored": lambda x: x[:, ::-1],
}


def test_recall_by_kind_of_edit(spark):
    """At least 0.9 of the edited copies link with their scene alone, through the tables; mirrored ones, which are not sought, with nothing."""
    scenes, images = [scene(k) for k in range(12)], []
    for k, x in enumerate(scenes):
        images += [(1000 * k + j, to_bytes(f(x))) for j, f in enumerate([lambda x: x, *EDITS.values()])]
    got = {r.image_id: r.component_id for r in media.edited_copies(spark.createDataFrame(rows_of(images), IMAGES)).collect()}
    assert all(c // 1000 == i // 1000 for i, c in got.items())
    found = {name: np.mean([got[1000 * k + j + 1] == 1000 * k for k in range(len(scenes))]) for j, name in enumerate(EDITS)}
    assert found.pop("mirrored") == 0 and min(found.values()) >= 0.9, found


def texture(seed, side=96):
    rng = np.random.default_rng(seed)
    return to_bytes(rng.integers(0, 255, (side // 6, side // 6)).repeat(6, 0).repeat(6, 1) * 0.9 + 10)


def planted():
    one, two = texture(1), texture(2)
    noise = np.random.default_rng(3).integers(-3, 4, one.shape)
    images = [
        (10, one), (11, one), (12, one[8:80, 6:90]), (13, to_bytes(one * 0.8 + 20)), (14, to_bytes(one + noise.astype(int))),
        (15, np.rot90(one).copy()), (20, two), (21, two[:72]), (30, texture(4)), (31, texture(5)), (40, np.full((96, 96), 7, np.uint8)),
    ]
    return images


def rows_of(images):
    return [(i, *x.shape, np.ascontiguousarray(x).tobytes(), "a", "b", "c") for i, x in images]


def test_planted_copies_and_odd_rows(spark):
    odd = [(None, 96, 96, texture(1).tobytes(), "", "", ""), (50, None, 96, b"x", "", "", ""), (51, 9, 9, b"short", "", "", ""), (52, 0, 0, b"", "", "", ""), (53, 4, 4, None, "", "", ""), (10, 96, 96, texture(1).tobytes(), "", "", "")]
    got = media.edited_copies(spark.createDataFrame(rows_of(planted()) + odd, IMAGES)).collect()
    want = {10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 15: 10, 20: 20, 21: 20} | {i: i for i in (30, 31, 40, 50, 51, 52, 53)} | {None: None}
    assert {r.image_id: r.component_id for r in got} == want
    assert len(got) == len(planted()) + len(odd)
    assert all(r.kept == (r.image_id is None or r.image_id == r.component_id) for r in got)
    assert media.edited_copies(spark.createDataFrame([], IMAGES)).count() == 0


def test_a_group_of_copies_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = [texture(100 + k) for k in range(6)]
    images = []
    for k in range(40):
        x = base[k % 6]
        top, left = rng.integers(0, 20, 2)
        images.append((k, np.clip(x[top : top + 72, left : left + 72] * rng.uniform(0.8, 1), 0, 255).astype(np.uint8)))
    parts = [media.described(x[None])[1:] for _, x in images]
    up = list(range(40))
    for a in range(40):
        for b in range(a):
            if media.agreeing(*parts[a], *parts[b]) >= media.LEAST_AGREEING:
                low, high = sorted((up[a], up[b]))
                up = [low if u == high else u for u in up]
    got = {r.image_id: r.component_id for r in media.edited_copies(spark.createDataFrame(rows_of(images), IMAGES)).collect()}
    assert got == dict(enumerate(up))
    assert up == [k % 6 for k in range(40)]


def test_drawing_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [0.0, None]), (5, [float("nan"), 1.0]), (None, [1.0] * 64), (7, [2.0, 4.0])]
    got = {r.image_id: r for r in media.drawn(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v").collect()}
    assert got[2].pixels is None and got[2].height is None and set(got[3].pixels) == set(got[4].pixels) == {128}
    assert got[1].pixels == got[7].pixels != got[5].pixels and len(got[None].pixels) == got[None].height ** 2


def test_query_links_planted_edits_with_their_pictures_alone(spark):
    """Through the tables: at least 0.9 of the edits of each kind, and nothing else."""
    rows = {r.vec_id: r for r in QUERIES["op7_media_copies"](spark, SF).collect()}
    edits = {i: (i - media.PLANTED) for i in rows if i >= media.PLANTED}
    assert len(rows) - len(edits) == 500 and len(edits) == 4 * sum(i % media.EACH == 0 for i in rows if i < media.PLANTED)
    for k, kind in enumerate(media.EDITS):
        assert np.mean([rows[i].component_id == n // 4 for i, n in edits.items() if n % 4 == k]) >= 0.9, kind
    assert all(r.component_id == i for i, r in rows.items() if i < media.PLANTED)
    assert all(r.component_id in (i, edits[i] // 4) for i, r in rows.items() if i in edits)


def test_edits_of_odd_rows(spark):
    images = spark.createDataFrame([(0, 4, 4, bytes(16)), (50, None, None, None), (100, 4, 4, b"x"), (None, 4, 4, bytes(16)), (-50, 2, 3, bytes(6)), (7, 4, 4, bytes(16))], "image_id long, height int, width int, pixels binary")
    more = [(r.image_id, r.height, r.width) for r in media.with_edits(images).filter(f"image_id > {media.PLANTED // 2}").collect()]
    assert sorted(more) == sorted((media.PLANTED + 4 * i + k, *size) for i, sizes in ((0, [(4, 4)] * 4), (-50, [(2, 3), (2, 3), (3, 2), (2, 3)])) for k, size in enumerate(sizes))


def test_only_links_leave_a_bucket(spark, monkeypatch):
    """Unrelated pictures share near descriptions by chance, in a number that grows with the square of theirs: no task passes them on, and none of the links is lost."""
    drawn = media.drawn(spark.createDataFrame([(i, np.random.default_rng(i).normal(size=64).tolist()) for i in range(300)], "vec_id long, v array<double>"), "vec_id", "v")
    images = media.with_edits(drawn).withColumn("digest", F.lit("")).cache()
    classes = media.with_descriptions(images).withColumnRenamed("image_id", "cid").cache()
    members = media._keys(classes).cache()
    nodes = classes.select("cid", F.col("cid").alias("comp"))
    parts = {r.cid: (np.array(r.places, np.float32).reshape(-1, 4), np.array(r.bits, np.int64).view(np.uint64).reshape(-1, media.WORDS)) for r in classes.collect()}
    links = lambda pairs: {(a, b) for a, b in pairs if media.agreeing(*parts[a], *parts[b]) >= media.LEAST_AGREEING}
    got = {(r.a, r.b) for r in media._open_pairs(members, nodes, classes).collect()}
    monkeypatch.setattr(media, "CARRIED", 0)  # every picture has more descriptions: all that meet pass
    met = {(r.a, r.b) for r in media._open_pairs(members, nodes, classes).collect()}
    assert got == links(met) and len(got) >= 20 and len(met - got) >= 20


def test_matches_counted_together_equal_those_of_each_pair():
    rng = np.random.default_rng(5)
    size = np.array([0, 1, 7, 8, 12, 30, 64])
    start = np.cumsum(size) - size
    bits = rng.integers(0, 1 << 63, (size.sum(), media.WORDS)).astype(np.uint64)
    for k in (3, 4, 5, 6):  # the first descriptions of each are near those of the others
        bits[start[k] : start[k] + 8] = bits[start[6] : start[6] + 8] ^ np.uint64(k)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(7), np.arange(7)))

    def matches(a, b):
        one, two = (bits[start[k] : start[k] + size[k]] for k in (a, b))
        if not len(one) or not len(two):
            return 0
        (best, least), (back, _) = media._nearest(one, two), media._nearest(two, one)
        return ((least <= media.MATCH_BITS) & (back[best] == np.arange(len(one)))).sum()

    want = [matches(a, b) >= media.LEAST_AGREEING for a, b in zip(x, y)]
    assert media._may_agree(bits, start, size, x, y).tolist() == want and 16 <= sum(want) < len(want)
