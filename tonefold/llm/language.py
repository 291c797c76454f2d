"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to three bytes with frozen counts. A byte's code
length comes from the longest context that the tree holds: a byte seen there has its share
of (count / (total + distinct)); the escape share distinct / (total + distinct) goes to the
bytes not seen, in proportion to what the next shorter context gives them. Rare bytes share one symbol
of the trees, and a byte that has it pays for its own share among them too. So the shares of all
bytes in a context add up to one, the code lengths are exact, and the language with the shortest
code for the whole text is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonefold.llm.common import bounded_batches, byte_column, give_back, row_blocks, unused

ORDER = 3
#: Symbols of the trees: the commonest bytes of the training texts; all others share the last one.
ALPHABET = 64
BLOCK = 1 << 19
UNKNOWN = "und"

#: A-Z become a-z, and every other ASCII character that is no letter becomes a space.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that begin with ORDER spaces, folded, runs of spaces after those shortened to one."""
    s = FOLD[data]
    keep = s != 32
    keep[1:] |= s[:-1] != 32
    for k in range(ORDER):
        keep[offsets[:-1] + k] = True
    if len(s):
        first = offsets[:-1] + ORDER
        first = first[first < offsets[1:]]
        keep[first] = s[first] != 32
    return s[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def contexts(s: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of each byte after its text's first ORDER, number of them for each text)."""
    inside = np.ones(len(s), bool)
    for k in range(ORDER):
        inside[offsets[:-1] + k] = False
    return np.flatnonzero(inside), np.diff(offsets) - ORDER


@dataclass
class Model:
    """languages; symbol of each byte; context node of each ORDER symbols; bits[node * ALPHABET + symbol, language].

    own[byte, language] is what a byte pays among those that share the last symbol; others pay 0.
    """

    languages: list[str]
    symbol: np.ndarray
    node: np.ndarray
    bits: np.ndarray
    own: np.ndarray

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits for each text and language, number of coded bytes)."""
        out, sizes = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1, np.int64)
        for a, b in row_blocks(offsets, BLOCK):
            s, at = folded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            where, n = contexts(s, at)
            x = self.symbol[s].astype(np.int32)
            history = (x[where - 3] * ALPHABET + x[where - 2]) * ALPHABET + x[where - 1]
            cell = self.node[history] * ALPHABET + x[where]
            owner = np.repeat(np.arange(b - a), n)
            rare = np.flatnonzero(x[where] == ALPHABET - 1)
            for k in range(len(self.languages)):
                out[a:b, k] = np.bincount(owner, self.bits[cell, k], minlength=b - a)
                out[a:b, k] += np.bincount(owner[rare], self.own[s[where[rare]], k], minlength=b - a)
            sizes[a:b] = n
        return out, sizes


def padded(text: str) -> Column:
    return F.concat(F.lit(" " * ORDER), F.coalesce(F.col(text), F.lit("")))


def gram_counts(rows: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, gram (ORDER + 1 folded bytes as a number), n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            names, codes = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for a, b in row_blocks(offsets, BLOCK):
                s, at = folded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                where, n = contexts(s, at)
                w = s.astype(np.uint32)
                gram = (w[where - 3] << 24) | (w[where - 2] << 16) | (w[where - 1] << 8) | w[where]
                of = np.repeat(codes[a:b], n)
                for k, name in enumerate(names):
                    held.setdefault(name, []).append(np.unique(gram[of == k], return_counts=True))
        for name, parts in held.items():
            grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([p[1] for p in parts]), minlength=len(grams)).astype(np.int64)
            if len(grams):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()
        give_back()

    bounded_batches(rows.sparkSession)
    some = rows.select(F.col(lang).alias("lang"), padded(text).alias("text"))
    return some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", most_texts: int = 4000, least: int = 12) -> Model:
    """Learns from about `most_texts` texts of each language at most, drawn by a hash of their ids.

    The bound keeps the trees' statistics at one size however large the corpus; fewer texts are
    all used. Rows with a null text or lang teach nothing. Contexts seen under `least` times in
    every language are left to the shorter ones. Without any row the model knows no language.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return Model([], np.zeros(256, np.uint8), np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros((256, 0), np.float32))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most_texts / n))]), F.col(lang))
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit("language")), F.lit(1 << 24)) < rate * (1 << 24)
    counted = gram_counts(rows.filter(draw), lang, text).toArrow()
    languages = sorted(sizes)
    index = {k: i for i, k in enumerate(languages)}
    which = np.array([index[x] for x in counted["lang"].to_pylist()], np.int64)
    gram, n = counted["gram"].to_numpy().astype(np.int64), counted["n"].to_numpy().astype(np.float64)
    return compiled(languages, which, gram, n, least)


def compiled(languages: list[str], which: np.ndarray, gram: np.ndarray, n: np.ndarray, least: int) -> Model:
    a = ALPHABET
    common = np.argsort(-np.bincount(gram & 255, n, minlength=256), kind="stable")[: a - 1]
    symbol = np.full(256, a - 1, np.uint8)
    symbol[common] = np.arange(len(common))
    parts = [symbol[(gram >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0)]
    full = ((parts[0] * a + parts[1]) * a + parts[2]) * a + parts[3]
    node, bits = np.zeros(a**ORDER, np.int32), []
    # order 0: one node, below it the uniform code
    below = np.full((len(languages), 1, a), 1 / a)
    parent_of = np.zeros(1, np.int64)
    kept, first = np.zeros(1, np.int64), 0
    for order in range(ORDER + 1):
        context = (full // a) % a**order
        if order:
            seen = np.zeros(a**order)
            for k in range(len(languages)):
                seen = np.maximum(seen, np.bincount(context[which == k], n[which == k], minlength=a**order))
            kept = np.flatnonzero(seen >= least)
            parent_of = slot[kept % a ** (order - 1)]
        row = np.full(a**order, -1)
        row[kept] = np.arange(len(kept))
        shares = np.empty((len(languages), len(kept), a))
        for k in range(len(languages)):
            mine = (which == k) & (row[context] >= 0)
            c = np.bincount(row[context[mine]] * a + full[mine] % a, n[mine], minlength=len(kept) * a).reshape(-1, a)
            shares[k] = escaped(c, below[k][parent_of])
        bits.append(shares)
        # the node of every context of this order: its own, or that of its shorter one
        inherited = slot_global[np.arange(a**order) % a ** (order - 1)] if order else np.zeros(1, np.int64)
        slot_global = np.where(row >= 0, first + row, inherited)
        first += len(kept)
        # what the next order builds on: this order's kept contexts, and what they fall back to
        everything = np.concatenate(bits, axis=1)
        below, slot = everything, slot_global
    node = slot_global.astype(np.int32)
    table = -np.log2(np.concatenate(bits, axis=1)).transpose(1, 2, 0).reshape(-1, len(languages))
    own = np.zeros((256, len(languages)), np.float32)
    shared = np.flatnonzero(symbol == a - 1)
    for k in range(len(languages)):
        seen = np.bincount(gram[which == k] & 255, n[which == k], minlength=256)[shared] + 1
        own[shared, k] = -np.log2(seen / seen.sum())
    return Model(languages, symbol, node, np.ascontiguousarray(table, np.float32), own)


def escaped(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Shares of each symbol in each context: seen ones by count, the escape's share over the others as below."""
    total, seen = counts.sum(1, keepdims=True), counts > 0
    distinct = seen.sum(1, keepdims=True)
    rest = np.where(seen, 0, below)
    left = rest.sum(1, keepdims=True)
    full = left <= 0
    shares = counts / np.maximum(total + np.where(full, 0, distinct), 1)
    escape = np.where(full, 0, distinct / np.maximum(total + distinct, 1)) * rest / np.where(full, 1, left)
    return np.where(total > 0, np.where(seen, shares, escape), below)


def with_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred string, score double and bits_per_byte double (columns of those names are replaced).

    score is the answer's share of 2 ** -bits over all languages, which short texts make small.
    A text that is null or has no letter, or a model without languages, gives `und` and 0. Ties go
    to the first language by name. Texts are scored whole, whatever their length.
    """
    if not model.languages:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rate", T.DoubleType())])

    @F.arrow_udf(kind)
    def identify(texts: pa.Array) -> pa.Array:
        m = shared.value
        data, offsets = byte_column(texts)
        bits, sizes = m.code_lengths(data, offsets)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        give_back()
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        return pa.StructArray.from_arrays([pa.array(m.languages, pa.string()).take(pa.array(best)), pa.array(score), pa.array(least / np.maximum(sizes, 1))], ["lang", "score", "rate"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own = unused(df, "_lang")
    out = df.withColumn(own, F.struct(identify(padded(text)).alias("found"), lettered.alias("ok")))
    ok, found = F.col(own)["ok"], F.col(own)["found"]
    return out.withColumns({
        "lang_pred": F.when(ok, found["lang"]).otherwise(F.lit(UNKNOWN)),
        "score": F.when(ok, found["score"]).otherwise(F.lit(0.0)),
        "bits_per_byte": F.when(ok, found["rate"]),
    }).drop(own)
