"""The corpus operators on small tables with odd rows, against plain Python."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tonefold.llm import chat, dedup, language, lm, mixing, packing, quality, urls, warc
from tonefold.llm.common import word_count
from tonefold.llm.queries import QUERIES, tokenizer_path

BASE = "the cat sat on the mat and then the dog came in to see what all of the noise was about today"
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE + " again"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE  two"), (9, "ein langer text " * 5000),
    (10, "x # $ % & | < > *" * 3), (None, BASE), (None, None), (11, "dup line here now yes\ndup line here now yes\n\nother line"), (12, "é" * 200_000), (13, "123 456 789"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words long, word string, size string, component_id string, n string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else None, None if k % 3 == 0 else f"s{k % 2}", None, 1, "a", "b", "c", "d", "e") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(spark, docs):
    got = {r.doc_id: r for r in dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert {i: got[i].component_id for i in got} == {i: {2: 1, 3: 1, 8: 7}.get(i, i) for i in got}
    assert all(got[i].n_shingles == len(shingle_set(t)) for i, t in TEXTS if i)
    assert dedup.near_duplicates(docs).count() == len(TEXTS) and dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_group_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(120):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            w[at] = f"x{rng.integers(0, 10**6)}"
        texts.append((k, " ".join(w)))
    sets, up = [shingle_set(t) for _, t in texts], list(range(120))

    def top(x):
        return x if up[x] == x else top(up[x])

    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {k: top(k) for k in range(120)}


def test_pipeline_links_pairs_between_80_and_85_per_cent(spark):
    import corpus_pipeline

    assert dedup.Limit.of(85) == dedup.Limit(85, 10, 0.15000000000000002 + 1e-9, 77, 112) and dedup.Limit.of(80).halves == 14
    rng, texts, least = np.random.default_rng(9), [], []
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 204)]
        changed = [w if at not in (40, 90, 140, 170)[: k % 2 + 3] else "new" for at, w in enumerate(words)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        a, b = shingle_set(texts[-2][1]), shingle_set(texts[-1][1])
        least.append(100 * len(a & b) / len(a | b))
    assert 80 <= min(least) < 85 < max(least)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {p: {r.doc_id: r.component_id for r in dedup.near_duplicates(docs, per_cent=p).collect()} for p in (80, 85)}
    assert got[80] == {i: i // 2 * 2 for i, _ in texts}
    assert got[85] == {i: i // 2 * 2 if least[i // 2] >= 85 else i for i, _ in texts}
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect()) == list(range(0, 600, 2))


def test_url_lists_and_rules(spark):
    rows = [(1, "http://A.example.com/en/1?x#y"), (2, "https://www.example.com/en/2"), (3, "x://b.net/es/"), (4, None), (5, "no scheme"), (6, "http://net"), (7, "http://notcom/"), (8, ""), (8, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, verdict string")
    lists = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, labels, lists).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == ("b.net", "/es/", "net/es/", "block") and got[4] == got[5] == ("", "", None, "allow") and got[6][:3] == ("net", "", None) and got[7][2] is None
    taught = spark.createDataFrame([(["h:bad", f"p:{k}"], "block") for k in range(40)] + [(["h:good", f"p:{k}"], "allow") for k in range(40)], "tokens array<string>, verdict string")
    rules = urls.mine(taught)
    assert sorted((r.antecedent, r.verdict) for r in rules.collect()) == [(["h:bad"], "block"), (["h:good"], "allow")]
    assert urls.matched(spark.createDataFrame([("u", ["h:bad", "h:x"]), ("v", ["h:x"])], "url string, tokens array<string>"), rules).collect() == [("u", "block")]


def test_language(spark, docs):
    rows = [(k, t * 5, g) for k, (t, g) in enumerate([("der hund und die katze ", "de"), ("the dog and the cat ", "en")] * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    some = spark.createDataFrame([(1, "die katze und"), (2, "the cat and"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.with_language(some, model).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["de", "en", "und", "und", "und"] and all(0 <= r.score <= 1 for r in got.values())
    shares = np.exp2(-model.bits.reshape(-1, language.ALPHABET, 2)).sum(1)
    assert np.allclose(shares, 1, atol=1e-3)
    assert language.with_language(docs, model).count() == len(TEXTS) and not language.fit(docs.limit(0)).languages


def test_scores(spark, docs):
    scorer, counts = lm.train(docs, head_size=8, classes=16, dims=4, copies=2)
    seen = collections.Counter(w for _, t in TEXTS for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(seen.values()), len(seen)
    got = lm.scored(docs, scorer, counts).collect()
    want = sorted((len(w), sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)) for _, t in TEXTS for w in [[*(t or "").encode().lower().split(), b""]])
    assert np.allclose(sorted((r.n_tokens, r.base_score) for r in got), want) and all(r.n_known == r.n_tokens and r.train_tokens == n for r in got)
    v = len(scorer.layout.kind)
    assert np.isclose(np.exp(scorer.model.log_shares(scorer.layout, np.full(v, 3), np.full(v, 5), np.arange(v))).sum(), 1, atol=1e-4)
    empty, none = lm.train(docs.limit(0), classes=16, dims=4)
    assert lm.scored(docs, empty, none).count() == len(TEXTS)


def test_scores_give_every_head_token_its_own_context(spark):
    words = [f"w{k}" for k in range(40)]
    texts = [(k, f"{words[k % 40]} {words[(k + 1) % 40]} " * 12) for k in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    scorer, counts = lm.train(docs, head_size=41, classes=10, dims=8, copies=2)
    v = len(scorer.layout.kind)
    assert v == 42 and len(scorer.layout.size) == 10 and len(scorer.model.context) == len(scorer.model.inner) == v
    for one, two in ((0, 0), (30, 31), (41, 1)):
        assert np.isclose(np.exp(scorer.model.log_shares(scorer.layout, np.full(v, one), np.full(v, two), np.arange(v))).sum(), 1, atol=1e-4)
    ask = spark.createDataFrame([(2 * k + j, f"{words[k]} {words[(k + d) % 40]}") for k in range(40) for j, d in enumerate((1, 20))], "doc_id long, text string")
    got = [r.score for r in lm.scored(ask, scorer, counts).orderBy("doc_id").collect()]
    assert sum(right > wrong + 0.1 for right, wrong in zip(got[::2], got[1::2])) >= 30


def test_model_scores_against_plain_python(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(rng.choice(words, rng.integers(0, 30), p=np.arange(60, 0, -1) / 1830))) for k in range(300)]
    texts += [(300, "rare1 rare2 w0 " + "x" * 100), (301, None), (302, "W0 w1 unseen")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    scorer, counts = lm.train(docs.filter("doc_id < 302"), head_size=40, classes=12, dims=4)
    seen = collections.Counter(w for i, t in texts if i < 302 for w in [*(t or "").lower().split(), ""])
    s, m, head = scorer, scorer.model, [t.decode() for t in scorer.head.tokens.to_pylist()]
    assert len(head) <= 40 and set(head) == {w for w in seen if 0 < len(w) <= 64 and seen[w] >= seen[head[-1]]}
    number = {w: k + lm.FIRST for k, w in enumerate(head)} | {"": lm.END_CLASS}
    outside = [w for w in seen if w not in number]

    def soft(x):
        return np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def log_probability(two, one, word):
        w = number.get(word, lm.OTHER_CLASS)
        p = np.append(m.context[one] * m.weight[0] + m.context[two] * m.weight[1], 1)
        k = s.layout.kind[w]
        out = np.log10(soft(m.top @ p)[k])
        if s.layout.size[k] > 1:
            out += np.log10(soft(m.inner[s.layout.start[k] : s.layout.start[k] + s.layout.size[k]] @ p)[w - s.layout.start[k]])
        return out + (np.log10((seen[word] + 1) / (sum(seen[x] for x in outside) + len(outside) + 1)) if w == lm.OTHER_CLASS else 0)

    got = {r.doc_id: r.score for r in lm.scored(docs, scorer, counts).collect()}
    for i, t in texts:
        row = [lm.END_CLASS] * 2
        want = 0.0
        for word in [*(t or "").lower().split(), ""]:
            want += log_probability(row[-2], row[-1], word)
            row.append(number.get(word, lm.OTHER_CLASS))
        assert np.isclose(got[i], want, atol=1e-3), i


def test_training_draws_a_share_of_the_tokens():
    layout = lm.Layout.of(np.array([1.0, 1, 5, 5]), 16)
    trainer = lm.Trainer(lm.Bilinear.start(layout, 2), layout, [1])
    for n in (1_000, 100_000):
        before = trainer.drawn
        trainer.feed(np.full(n, 2), np.full(n, 3), np.zeros(n, np.int64), 0.3)
        assert abs(trainer.drawn - before - 0.3 * n) < 0.05 * n


def test_chats(spark):
    said = r"\### Assistant: </turn> ok \h \e : é"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "odd: role\n", None), (3, 0, None, "#"), (3, None, "assistant", ""), (None, 0, "user", "x"), (1, 1, "assistant", said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.formatted(turns)
    back = {r.conv_id: r for r in chat.read_back(chats).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", said), ("assistant", said), ("assistant", said)] and back[1].trained == [said, said]
    assert [tuple(t) for t in back[2].turns] == [("odd: role\n", "")] and back[None].n_turns == 1 and back[3].trained == [""]
    d = {r.conv_id: r for r in chat.digests(chat.read_back(chats)).collect()}
    assert d[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{said}\n" for r in ("user", "assistant", "assistant")).encode()).hexdigest()
    assert d[1].loss_sha256 == hashlib.sha256((said * 2).encode()).hexdigest() and chat.formatted(turns.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    rows = [(1, "http://b.com/x", "same"), (2, "http://a.com/y\r\nz", "same"), (3, None, None), (4, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nü"), (5, "http://a.com/y", "long " * 50_000), (6, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, most_records=2)
    found = warc.merged_index(warc.read_runs(spark.read.format("binaryFile").load(path), with_payload=True)).collect()
    got = {r.page_id: r for r in found}
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert got[i].record_type == "revisit" or got[i].payload == (html or "")
    assert [got[k].refers_to for k in range(1, 7)] == [2, None, 6, None, None, None]
    keys = [(r.url_key, r.captured, r.page_id) for r in found]
    assert keys == sorted(keys)


def test_loser_tree():
    rng = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 20)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pieces = packing.packed(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), tokenizer_path()).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t in dict((i, t) for i, t in TEXTS if i).items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.packed(docs.limit(0), tokenizer_path()).count() == 0


def test_best_fill_against_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(50):
        counts = np.zeros(64, np.int64)
        for x in rng.integers(1, 40, 8):
            counts[x] += 1
        items, room = np.repeat(np.arange(64), counts), int(rng.integers(1, 64))
        best = max(s for s in ({sum(int(x) for k, x in enumerate(items) if m >> k & 1) for m in range(1 << len(items))}) if s <= room)
        got = packing.best_fill(counts, room)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_mixing(spark, docs):
    rows = mixing.with_copies(docs, word_count(F.col("text"))).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.copies <= 2 for r in rows) and {r.target <= 2 * r.source_size for r in rows} == {True}
    total = sum(len((t or "").encode().split()) for _, t in TEXTS)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * total) < 1e-6
    again = mixing.with_copies(docs.repartition(3), word_count(F.col("text"))).collect()
    assert sorted((r.doc_id or 0, r.size, r.copies) for r in rows) == sorted((r.doc_id or 0, r.size, r.copies) for r in again)
    assert mixing.mixed(docs, word_count(F.col("text"))).columns == docs.columns and mixing.with_copies(docs.limit(0), word_count(F.col("text"))).count() == 0


def test_quality(spark, docs):
    def repeats(words):
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = collections.Counter(grams)
        return len({k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)})

    rows = quality.with_ledger(docs).collect()
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    want = []
    for _, t in TEXTS:
        words = [w.decode() for w in (t or "").encode().split()]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want.append((len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeats(words)))
    assert got == sorted(want)
    assert quality.keep_good(docs).columns == docs.columns and quality.with_ledger(docs.limit(0)).count() == 0
    counts = {r.rule: (r.failed, r.failed_alone) for r in quality.ablations(quality.with_ledger(docs)).collect()}
    assert counts["too_few_words"][0] == sum(w[0] < 10 for w in want)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, SF)
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    tokens = {r.doc_id: r.doc_tokens for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()}
    assert set(tokens) == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name", ["op3_language_id", "op10_quality_rules"])
def test_queries_cover_whole_tables(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
