"""SimHash, importance resampling and spelling variants against plain Python, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tonefold.llm import resample, simhash, variants
from tonefold.llm.common import CRC_START, crc_after
from tonefold.llm.resample import TournamentTree

DOCS = "doc_id long, text string, fp long, cell string, n string, rid string, word string, score string, `run` string"
ODD = [
    (1, "One two THREE four"), (1, "one two three four"), (1, "one two three four"), (2, None), (3, ""), (4, " \n\x0b "), (None, "one two three four"), (None, None), (5, "a"),
    (6, "é" * 200_000), (7, "café naïve 中文 x1 " * 9000), (8, "hello world w\x00x"), (9, "hallo hello hullo hella jello " * 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "a", "b", "c", "d", "e", "f") for i, t in ODD], DOCS)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(rows):
    """Ids by row, from all pairs."""
    up = list(range(len(rows)))

    def top(x):
        return x if up[x] == x else top(up[x])

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                up[top(a)] = top(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(k)].append(i)
    return [min(ids[top(k)], default=None) for k in range(len(rows))]


def test_fingerprints_and_components_of_odd_rows(spark, odd):
    rows = [(i, plain_fingerprint(t)) for i, t in ODD]
    want = collections.Counter((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, plain_components(rows)))
    assert collections.Counter(map(tuple, simhash.near_duplicates(odd).collect())) == want
    assert simhash.near_duplicates(odd.limit(0)).collect() == []
    assert simhash.near_duplicates(spark.createDataFrame([(None, None)] * 2, "doc_id long, text string")).collect() == [(None, "0" * 16, None)] * 2


def test_pieces_of_a_long_text_give_all_its_shingles(monkeypatch):
    text = " ".join(f"w{k}" for k in range(500)).encode()
    whole = [x for part in simhash.shingles(text) for x in part]
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [x for part in simhash.shingles(text) for x in part] == whole
        assert list(simhash.shingles(b" a  b ")) == [[b"a b"]] and list(simhash.shingles(b"  ")) == []


@pytest.mark.parametrize("side", [3, 2048])
def test_links_against_all_pairs(spark, side):
    rng = random.Random(3)
    fps = [0, (1 << 64) - 1, 1 << 63, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA]
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            fps.append(fp)
            for _ in range(rng.randrange(1, 5)):
                fp ^= 1 << rng.randrange(64)
    fps += [fps[9] ^ (1 << k) for k in range(64)]
    fps = sorted(set(fps))
    signed = [x - (x >> 63 << 64) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), side).collect()
    linked = simhash.components(spark.createDataFrame(edges or [(0, 0)], "a long, b long"))
    got = {r["cid"]: r["comp"] for r in linked.collect()}
    want = plain_components(list(enumerate(fps)))
    groups = collections.defaultdict(set)
    for k, x in enumerate(signed):
        groups[got.get(x, x)].add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))
    assert len(edges) <= 6 * 34 * len(fps)


def test_checksums_of_runs():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, np.uint8)
    start = np.array([0, 5, 5, 100, 900, 4999, 5000])
    end = np.array([5, 5, 80, 900, 4000, 5000, 5000])
    got = ~crc_after(np.full(len(start), CRC_START), data, start, end)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


def test_tournament_tree():
    rng = random.Random(2)
    for k in range(7):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        flat, heads = [x for r in runs for x in r], np.cumsum([0, *map(len, runs)]).tolist()
        assert [flat[p] for p in TournamentTree(heads[:-1], heads[1:], lambda p, q: flat[p] < flat[q])] == sorted(flat)


def plain_draw(docs, target, per_cent=25, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]
    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    count = lambda texts: collections.Counter(bucket(x) for t in texts for x in grams(words(t)))
    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        f = grams(words(text))
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, f)]
        weight = math.floor(sum(gain) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text)) >= least])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(order[: per_cent * len(order) // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("range_rows", [7, 20_000])
def test_draw_against_plain_python(spark, range_rows):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(50)] + ["été", "中", "A1"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(400)] + [(None, " ".join(words)), (None, None)]
    target = [" ".join(rng.choice(words[:9]) for _ in range(40)), None, ""]
    got = resample.drawn(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), range_rows=range_rows)
    assert collections.Counter(map(tuple, got.collect())) == plain_draw(docs, target)


def test_draw_of_odd_rows(spark, odd):
    none = odd.limit(0)
    assert resample.drawn(none, odd).count() == 0
    assert collections.Counter(map(tuple, resample.drawn(odd, none).collect())) == plain_draw(ODD, [])
    # Repeated rows are candidates of their own: all of these tie.
    same = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u")] * 30, "doc_id long, text string")
    assert sorted(r["rank"] for r in resample.drawn(same, odd, range_rows=4).collect() if r["rank"]) == list(range(1, 8))


def plain_variants(docs, least=3, modulus=97):
    seen = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(c, key=lambda x: (-n[x], x)) for w, c in close.items() if c}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(close[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("modulus", [97, 3, 1])
def test_variants_against_all_pairs(spark, modulus):
    rng = random.Random(modulus)
    bases = ["letter", "aaaaaaa", "étérnal", "banana"]
    docs = []
    for k in range(300):
        out = []
        for _ in range(40):
            w = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(("", "a", "e", "ÿ", "aa"))
            out.append("".join(w) if rng.random() < 0.9 else "".join(w).upper())
        docs.append((k if k % 9 else None, "-".join(out)))
    got = variants.variants(spark.createDataFrame(docs, "doc_id long, text string"), modulus=modulus)
    assert {r[0]: tuple(r)[1:] for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(docs, modulus=modulus)


def test_variants_of_odd_rows(spark, odd):
    got = {r["word"]: tuple(r)[1:] for r in variants.variants(odd).collect()}
    assert got == plain_variants(ODD) and variants.variants(odd.limit(0)).collect() == []
    assert got["hello"][3] == 4  # hallo, hullo, hella, jello


def test_words_that_share_a_key_are_told_apart_by_their_text(spark, monkeypatch):
    """With a key that is the same for all, every row meets: only the strings decide."""
    words = spark.createDataFrame([(k, w, 3) for k, w in enumerate(("letter", "lette", "fetter", "banana", "bananas"))], "wid long, word string, n long")

    keys = variants.keyed(words).withColumn("key", variants.F.lit(7).cast("long"))
    monkeypatch.setattr(variants, "keyed", lambda _: keys)
    got = {r["wid"]: r["n_near"] for r in variants.neighbours(words).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1}


def test_long_words_keys_are_those_of_their_deletions():
    word = "éa" * 3000 + "b"
    key, place, first, _ = variants.deletion_keys([word])
    for k in (0, 1, 2999, 6000):
        assert variants.deletion_keys([word[:k] + word[k + 1 :]])[0][0] == key[place == k][0]
    assert first.all() and not variants.deletion_keys(["aab"])[2][2]
