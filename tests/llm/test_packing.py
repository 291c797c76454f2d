"""Word-wise ids against the tokenizer's own, and packing of odd rows."""

import collections
import zlib

import numpy as np
import pyarrow as pa

from tests.conftest import SF
from tonefold.llm import packing
from tonefold.llm.queries import QUERIES, tokenizer_path

PARTS = [
    "cat", "Cat.", "naïve", "don't", "it's.", "x,,", "end...", "a***", "b'", "c'?", "<|endoftext|>", "<|EndOfText|>", "<|", "ß", "ŉ", "İstanbul", "éte", "́", "a≮", "42", "x9.", "9x!",
    "#$%", ".", ",", "'", " ", "a b", "\x1c", "日本", "привет", "ªº", "ǅ", "straße.", "\x00", "�", "we'll,", "🙂", "ﬁ", "CAFÉ", "café,",
]


def test_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(3)
    texts = [" ".join(PARTS), *PARTS, "".join(PARTS), "", " \n\t\x0b\x0c\r "]
    for _ in range(600):
        seps = rng.choice([" ", "  ", "\n", "", "\t "], 12)
        texts.append("".join(p + s for p, s in zip(rng.choice(PARTS, 12), seps)))
    want = [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    words_of = packing.WordIds(tokenizer_path())
    few = packing.WordIds(tokenizer_path(), most=300)
    for held in (words_of, few):
        for _ in range(2):
            got = [ids[a:b].tolist() for _, ids, at in packing.encoded(pa.array(texts), held) for a, b in zip(at, at[1:])]
            assert got == want


def test_null_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = [(None, "one two"), (None, None), (5, "same text here"), (5, "same text here"), (5, None), (6, "word " * 5000), (6, "word " * 5000), (7, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids_crc32 string, sequence_id long").repartition(3)
    pieces = packing.packed(docs, tokenizer_path()).collect()
    by_seq = collections.defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
    for s in by_seq.values():
        ends = sorted((p.offset, p.offset + p.length) for p in s)
        assert ends[0][0] == 0 and all(x[1] == y[0] for x, y in zip(ends, ends[1:])) and ends[-1][1] in {1 << k for k in range(12)}
    want = collections.Counter()
    for i, t in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
    long = np.array([*tok.encode("word " * 5000, add_special_tokens=False).ids, 1], np.uint32)
    assert {(p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == 6} == {(p.start, p.length, zlib.crc32(long[p.start : p.start + p.length].tobytes())) for p in pieces if p.doc_id == 6}


def test_query(spark):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = QUERIES["op8_pack_sequences"](spark, SF).collect()
    assert {r.doc_id for r in rows} == docs and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
