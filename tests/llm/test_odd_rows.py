"""Clashing column names, nulls, repeats, ties and empty tables, and brute-force versions of small operators."""

import collections
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tonefold.llm import chat, dedup, language, lm, media, mixing, packing, quality, urls, warc
from tonefold.llm.common import word_count
from tonefold.llm.queries import QUERIES, tokenizer_path

OWN = "_q string, _q_words string, _lang string, _kept string, row string, rank string, start string, src string, band string, salt string, tie string, whole string, words string, size string, copies string, _id string, _text string"
COLUMNS = f"doc_id long, text string, lang string, source string, n_chars long, {OWN}"
GOOD = "this is a plain english sentence with enough words in it to be kept by every rule of the ledger"
ROWS = [(1, GOOD, "en", "a"), (1, GOOD, "en", "a"), (2, GOOD + " twice", "en", None), (None, GOOD, None, "a"), (None, None, "en", "b"), (3, "", "en", "b"), (4, "the cat " * 20_000, "en", "b"), (1, "other text", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [f"own {k}" for k in range(len(OWN.split(",")))]
    return spark.createDataFrame([(i, t, g, s, 7, *extra) for i, t, g, s in ROWS], COLUMNS)


def own_values(df):
    names = [c.split()[0] for c in OWN.split(", ")]
    return {c: {r[0] for r in df.select(f"`{c}`").distinct().collect()} for c in names if c in df.columns}


def test_columns_of_any_name_stay(spark, docs):
    model = language.fit(docs)
    for got, replaced in (
        (quality.with_ledger(docs), set()), (quality.keep_good(docs), set()), (language.with_language(docs, model), set()),
        (mixing.mixed(docs, word_count(F.col("text"))), set()), (mixing.with_copies(docs, word_count(F.col("text"))), {"size", "copies"}),
    ):
        assert set(docs.columns) <= set(got.columns)
        assert all(v == {f"own {k}"} for k, (c, v) in enumerate(own_values(got).items()) if c not in replaced)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html"), F.lit("x").alias("_last"), F.lit("y").alias("_last_n"), F.lit("z").alias("payload"))
    got = warc.with_revisits(pages)
    assert {(r._last, r._last_n, r.payload) for r in got.collect()} == {("x", "y", "z")} and got.count() == len(ROWS)
    chats = chat.formatted(docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text")).withColumn("_read", F.lit("x"))
    assert {r._read for r in chat.read_back(chats).collect()} == {"x"}


def test_repeats_and_nulls_keep_their_rows(spark, docs):
    assert dedup.near_duplicates(docs).count() == quality.with_ledger(docs).count() == len(ROWS)
    scorer, counts = lm.train(docs, head_size=8, dims=4)
    assert lm.scored(docs, scorer, counts).count() == len(ROWS)
    words = mixing.with_copies(docs, word_count(F.col("text"))).select("doc_id", "text", "size").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in words) == sorted((i or 0, t or "") for i, t, _, _ in ROWS)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    model = language.fit(none)
    pages = none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    labels = spark.createDataFrame([], "page_id long, verdict string")
    for got in (
        dedup.near_duplicates(none), urls.judged(pages, labels, []), language.with_language(none, model), chat.formatted(none.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text")),
        warc.with_revisits(pages), packing.packed(none, tokenizer_path()), mixing.mixed(none, word_count(F.col("text"))), quality.keep_good(none),
        media.edited_copies(media.drawn(spark.createDataFrame([], "v long, e array<float>"), "v", "e")),
    ):
        assert got.count() == 0


def test_archives_of_odd_pages(spark, tmp_path):
    rows = [(None, "http://a/b", "x"), (5, None, "x"), (5, "http://a/b", "x"), (5, "http://a/b", "other"), (4, "http://a/b", "x"), (4, "http://a/b", "x"), (6, "", None)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, file int, place int")
    path = str(tmp_path / "odd")
    warc.write_archives(pages, path)
    runs = warc.resolved(warc.read_runs(spark.read.format("binaryFile").load(path)))
    got = warc.merged_index(runs, range_rows=2).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, len(h or ""), "revisit" if (i, h) == (4, "x") else "response", 5 if (i, h) == (4, "x") else None) for i, _, h in rows)
    assert collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want
    keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    empty = str(tmp_path / "none")
    warc.write_archives(pages.limit(0), empty)
    assert warc.merged_index(warc.read_runs(spark.read.format("binaryFile").load(empty))).count() == 0


def test_a_changed_payload_is_found(spark):
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:AAAA\r\nX-Payload-Length: 1\r\nContent-Length: 5\r\n\r\n\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError, match="does not hold the payload"):
        import gzip

        warc.run_of("f", gzip.compress(record.encode()), False)


def test_mixing_against_a_plain_systematic_sampler(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 300)), " ".join(["w"] * int(rng.integers(0, 200))), rng.choice(["a", "b", "c", "d"])) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, None if s == "d" else str(s)) for i, t, s in rows], "doc_id long, text string, source string").repartition(5)
    md5 = lambda x, n: int(hashlib.md5(x.encode()).hexdigest()[:n], 16)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    weights, cap = {"a": 5, "b": 2, "c": 1, "d": 5}, {s: 2 * n for s, n in sizes.items()}
    target, left, over = {}, dict(weights), 1.5 * sum(sizes.values())
    while left:
        level = over / sum(left.values())
        full = [s for s in left if level * left[s] > cap[s]]
        for s in full or list(left):
            target[s] = cap[s] if full else level * left[s]
            over -= target[s]
            left.pop(s)
    want = collections.Counter()
    for s in "abcd":
        rate, at = target[s] / sizes[s], md5("1|" + ("n" if s == "d" else "s" + s), 5) / 2**20
        own = sorted((math.floor(math.log2(len(t.split()) + 1.5) * 16), md5(f"{i}|{len(t.split())}", 4) % 64, i, len(t.split())) for i, t, x in rows if x == s)
        for _, _, i, n in own:
            want[s, i, n, math.floor(at + rate) - math.floor(at)] += 1
            at += rate
    got = mixing.with_copies(docs, word_count(F.col("text"))).collect()
    assert collections.Counter((r.source or "d", r.doc_id, r.size, r.copies) for r in got) == want
    taken = collections.Counter()
    for r in got:
        taken[r.source or "d"] += r.copies * r.size
        assert abs(r.target - target[r.source or "d"]) < 1e-6
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in target)


def test_code_lengths_are_exact_over_all_bytes(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(chr(int(c)) for c in rng.choice([*range(97, 123), *range(0x430, 0x450), *range(0x4E00, 0x4E60)], 300)) for _ in range(60)]
    rows = [(k, t, "x" if k % 2 else "y") for k, t in enumerate(texts)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    shared = np.flatnonzero(model.symbol == language.ALPHABET - 1)
    assert len(shared) > 100
    for history in rng.integers(0, language.ALPHABET**language.ORDER, 200):
        cells = model.node[history] * language.ALPHABET + model.symbol.astype(np.int64)
        assert np.allclose(np.exp2(-model.bits[cells] - model.own).sum(0), 1, atol=1e-3)
    data = texts[0].encode()
    bits, sizes = model.code_lengths(np.frombuffer(b"   " + data, np.uint8), np.array([0, len(data) + 3]))
    history, want = [model.symbol[32]] * 3, np.zeros(2)
    for b in data:
        x = model.symbol[b]
        node = model.node[(int(history[-3]) * language.ALPHABET + int(history[-2])) * language.ALPHABET + int(history[-1])]
        want += model.bits[node * language.ALPHABET + x] + model.own[b]
        history.append(x)
    assert np.allclose(bits[0], want, atol=1e-2) and sizes[0] == len(data)


def test_rule_mining_and_matching_against_all_subsets(spark):
    rng = np.random.default_rng(6)
    baskets = []
    for _ in range(120):
        items = sorted({f"t{x}" for x in rng.integers(0, 8, rng.integers(1, 6))})
        baskets.append((items, "block" if ("t1" in items and "t2" in items) or rng.random() < 0.2 else "allow"))
    got = urls.mine(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), confidence=0.8, support=0.03, least=4)
    every = sorted({t for b, _ in baskets for t in b})
    found = {}
    for n in range(1, len(every) + 1):
        for subset in itertools.combinations(every, n):
            inside = [v for b, v in baskets if set(subset) <= set(b)]
            for v in ("block", "allow"):
                hits = inside.count(v)
                if hits >= max(0.03 * len(baskets), 4) and hits / len(inside) >= 0.8:
                    found[subset, v] = hits / len(inside), hits / len(baskets)
    want = {k: x for k, x in found.items() if not any(v == k[1] and set(s) < set(k[0]) for s, v in found)}
    rules = got.collect()
    assert {(tuple(r.antecedent), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in rules} == {k: (round(c, 9), round(s, 9)) for k, (c, s) in want.items()}
    asked = [(str(k), sorted(set(rng.choice(every, 4)))) for k in range(40)] + [("none", []), ("other", ["zz"])]
    told = {r.url: r.mined for r in urls.matched(spark.createDataFrame(asked, "url string, tokens array<string>"), got).collect()}
    for url, items in asked:
        fits = [(*want[k], k[1] == "block", k[1]) for k in want if set(k[0]) <= set(items)]
        assert told.get(url) == (max(fits)[3] if fits else None)


def test_url_filter_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "http://a.com/x", "y"), (2, "", "z")], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(1, "block"), (1, "allow"), (None, "block")], "page_id long, verdict string")
    got = urls.judged(pages, labels, [("com", "/", "allow")]).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got) == [(0, "a.com", "allow"), (1, "", "allow"), (1, "", "allow"), (2, "", "allow")]


def test_pipeline_stages_keep_columns_and_bear_empty_tables(spark, docs):
    import corpus_pipeline

    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for some in (docs, docs.limit(0)):
            got = stage(spark, some, SF)
            assert k == 4 or got.columns == docs.columns
            assert some is docs or got.count() == 0
    kept = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 3, 4]


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op2_url_filter", "op4_score_texts", "op5_format_chats", "op6_warc_archive", "op9_mix_sources"])
def test_queries_return_a_row_for_each(spark, name):
    table, key = {"op2": ("pages", "page_id"), "op6": ("pages", "page_id"), "op5": ("conversations", "conv_id")}.get(name[:3], ("documents", "doc_id"))
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()} | ({-7} if name[:3] == "op5" else set())
    got = QUERIES[name](spark, SF).select(key).collect()
    assert {r[0] for r in got} == want and len(got) == len(want)
