"""Scoring texts with a log-bilinear language model.

Token counts come from every training text. The model predicts a token from the two before it:
their vectors, weighted by place, add up to a predicted vector. A token's probability is that of
its class times its own inside the class, both from products of the predicted vector with output
vectors: every head token has a vector as context and one as prediction. The commonest tokens
are classes of their own, the others lie in about sqrt(head) classes of neighbours by count.
Scores are normalised exactly, by a matrix product over the classes and one over the members of
each class.

Training is noise-contrastive estimation in numpy. Copies of the model each read their own part
of the texts as a stream and train on all of its tokens, so that steps, and copies, grow with
the corpus; after each round the copies are averaged, by slices and in a tree.

Tokens outside the head share one class, inside which a token has its add-one share of the
counts. Tokens are bytes; the end of a text is the empty token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonefold.llm.common import bounded_batches, byte_column, give_back, row_blocks, split_words, written

END = b""
#: Words of the model: the end of a text (also what comes before its start), any token outside the head, then the head's.
END_CLASS, OTHER_CLASS, FIRST = 0, 1, 2
#: Bytes of the head's tokens at most: longer ones count as outside it, so that head_size bounds what is broadcast.
LONGEST = 64
#: Training tokens that one copy of the model reads.
PART = 4_000_000
#: Rows of class logits held at once, tokens scored together, slices in which copies are averaged, and copies averaged in one group.
AT_ONCE, TOGETHER, SLICES, FAN = 1024, 1 << 17, 32, 32
#: Distinct tokens that counting holds before it passes them on.
MOST_HELD = 400_000
BLOCK = 1 << 22


def split_texts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """(first row, place of each token, the distinct tokens, number of tokens of each text) for blocks of texts; A-Z in lower case, without END."""
    _, offsets = byte_column(texts)
    for a, b in row_blocks(offsets, BLOCK):
        code, words, sizes = split_words(pc.ascii_lower(texts.slice(a, b - a)))
        yield a, code, words.cast(pa.binary()), sizes


def _summed(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).select(["token", "n_sum"]).rename_columns(["token", "n"])


def token_counts(texts: DataFrame) -> DataFrame:
    """token binary, n long over the text column of all rows (no nulls)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for batch in batches:
            for _, code, words, sizes in split_texts(batch.column(0)):
                held.append(pa.table({"token": words, "n": np.bincount(code, minlength=len(words))}))
                size, ends = size + len(words), ends + len(sizes)
                if size > MOST_HELD:
                    held = [_summed(held)]
                    size = len(held[0])
                if size > MOST_HELD // 2:
                    yield from held.pop().to_batches()
                    size = 0
        if ends:
            yield from _summed([*held, pa.table({"token": pa.array([END], pa.binary()), "n": np.array([ends])})]).to_batches()
        give_back()

    return texts.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The commonest tokens, commonest first, their counts, and the totals."""

    tokens: pa.Array
    n: np.ndarray
    total: int
    distinct: int

    def stream(self, code: np.ndarray, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in the head of each token or -1, END -2; word; word one and two before) of a block's tokens in a row, each text's END included."""
        place = pc.fill_null(pc.index_in(words, value_set=self.tokens), -1).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes + 1) - 1
        at = np.full(len(code) + len(sizes), -2)
        at[np.arange(len(code)) + np.repeat(np.arange(len(sizes)), sizes)] = place[code]
        w = np.where(at >= 0, at + FIRST, OTHER_CLASS)
        w[ends] = END_CLASS
        one, two = np.roll(w, 1), np.roll(w, 2)
        starts = ends - sizes
        one[starts] = END_CLASS
        two[starts] = END_CLASS
        two[np.minimum(starts + 1, len(w) - 1)] = END_CLASS
        return at, w, one, two


@dataclass
class Layout:
    """kind: class of each word; start, size: the words of each class, which are neighbours; edges: summed counts of words."""

    kind: np.ndarray
    start: np.ndarray
    size: np.ndarray
    edges: np.ndarray

    @staticmethod
    def of(n: np.ndarray, classes: int) -> Layout:
        """For words with counts n, END and OTHER first: classes of one word as far as `classes` goes, the rest in classes of many.

        Sizes grow as the root of the rank, as what a word costs is its share of tokens times its class's size, and shares fall as ranks rise.
        """
        v = len(n)
        many = 0 if v <= classes else max(1, min(int(np.ceil(np.sqrt(v))), (classes - FIRST) * 3 // 4))
        single = v if not many else max(FIRST, classes - many)
        roots = np.linspace(np.sqrt(single), np.sqrt(v), many + 1) if many else np.array([np.sqrt(v)])
        edges = np.unique(np.concatenate((np.arange(single), np.round(roots**2).astype(np.int64))))
        size = np.diff(edges)
        return Layout(np.repeat(np.arange(len(size)), size), edges[:-1], size, np.concatenate(([0.0], np.cumsum(np.maximum(n, 1.0)))))

    @property
    def totals(self) -> np.ndarray:
        return self.edges[self.start + self.size] - self.edges[self.start]


def head_of(counts: DataFrame, most: int) -> Head:
    """The tokens of at most LONGEST bytes with at least so high a count that no more than `most` have it: `most` bounds the size."""
    short = counts.filter(F.length("token").between(1, LONGEST))
    by_count = short.groupBy("n").agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.desc("n")).limit(most + 1)
    least, held = None, 0
    for n, tokens in by_count.toLocalIterator():
        held += tokens
        if held > most:
            break
        least = n
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    found = short.filter(F.col("n") >= (least if least is not None else 1 << 62)).toArrow().combine_chunks().sort_by([("n", "descending"), ("token", "ascending")])
    tokens = found["token"].combine_chunks() if len(found) else pa.array([], pa.binary())
    return Head(tokens, found["n"].to_numpy().astype(np.int64), totals[0] or 0, totals[1])


def stepped(value: np.ndarray, total: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """An AdaGrad step of the named rows; gradients of one row add up: sorted by row, they are differences of running sums."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    last = np.flatnonzero(np.concatenate((rows[1:] != rows[:-1], [True])))
    added = g[order]
    np.cumsum(added, axis=0, out=added)
    added, ids = added[last], rows[last]
    added[1:] -= added[:-1].copy()
    sums = total[ids] + added * added
    total[ids] = sums
    added *= rate
    added /= np.sqrt(sums, out=sums)
    value[ids] -= added


@dataclass
class Bilinear:
    """context: vectors of context words; weight: by place and dimension; top, inner: of predicted classes and words, a bias last."""

    context: np.ndarray
    weight: np.ndarray
    top: np.ndarray
    inner: np.ndarray

    @staticmethod
    def start(layout: Layout, dims: int, seed: int = 7) -> Bilinear:
        rng, totals = np.random.default_rng(seed), layout.totals
        small = lambda v: rng.normal(0, 0.1, (v, dims)).astype(np.float32)
        with_bias = lambda x, share: np.column_stack((x, np.log(share))).astype(np.float32)
        words, v = np.diff(layout.edges), len(layout.kind)
        return Bilinear(small(v), np.ones((2, dims), np.float32), with_bias(small(len(totals)), totals / totals.sum()), with_bias(small(v), words / totals[layout.kind]))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.weight, self.top, self.inner

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The predicted vectors, with a 1 for the bias."""
        p = np.empty((len(one), self.context.shape[1] + 1), np.float32)
        np.multiply(self.context[one], self.weight[0], out=p[:, :-1])
        p[:, :-1] += self.context[two] * self.weight[1]
        p[:, -1] = 1
        return p

    def log_shares(self, layout: Layout, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of words w after words two and one."""
        parts = [self._log_shares(layout, one[a : a + TOGETHER], two[a : a + TOGETHER], w[a : a + TOGETHER]) for a in range(0, len(w), TOGETHER)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _log_shares(self, layout: Layout, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        p, kind = self.predicted(one, two), layout.kind[w]
        out, long = np.empty(len(w)), largest(p)
        top, within = np.ascontiguousarray(self.top.T), long * largest(self.top)
        for a in range(0, len(w), AT_ONCE):
            logits = p[a : a + AT_ONCE] @ top
            out[a : a + AT_ONCE] = logits[np.arange(len(logits)), kind[a : a + AT_ONCE]]
            out[a : a + AT_ONCE] -= log_sum(logits, within)
        inside, within = np.flatnonzero(layout.size[kind] > 1), long * largest(self.inner)
        inside = inside[np.argsort(kind[inside], kind="stable")]
        for rows in np.split(inside, np.flatnonzero(np.diff(kind[inside])) + 1):
            for a in range(0, len(rows), AT_ONCE):
                at = rows[a : a + AT_ONCE]
                first = layout.start[kind[at[0]]]
                logits = p[at] @ self.inner[first : first + layout.size[kind[at[0]]]].T
                out[at] += logits[np.arange(len(at)), w[at] - first] - log_sum(logits, within)
        return out


def log_sum(logits: np.ndarray, within: float) -> np.ndarray:
    """Logarithms of the rows' summed exponentials; logits, no further from 0 than `within`, are used up."""
    if within < 60:
        return np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))
    each = logits.max(1)
    return np.log(np.exp(logits - each[:, None]).sum(1)) + each


def largest(x: np.ndarray) -> float:
    """The length of the longest row."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))


#: Tokens that follow one another in a batch.
RUN = 64


class Trainer:
    """Noise-contrastive estimation by AdaGrad on one copy of the model.

    A batch is many runs of RUN tokens from all over a block. Within a run, the vector of a word serves the next token as
    that of the word before and the one after that as that of the word two before, so it is fetched, and moved, once.
    """

    def __init__(self, start: Bilinear, layout: Layout, seed: list[int], batch: int = 8192, noise: int = 64, inner_noise: int = 16, rate: float = 0.15):
        self.rng, self.layout, self.totals = np.random.default_rng(seed), layout, layout.totals
        self.m = Bilinear(*(x.copy() for x in start.parts()))
        self.sums = [np.full_like(x, 1e-2) for x in self.m.parts()]
        self.runs, self.noise, self.inner_noise, self.rate = max(1, batch // RUN), noise, inner_noise, rate
        self.kind, self.many = layout.kind.astype(np.int32), layout.size[layout.kind] > 1
        share = self.totals / self.totals.sum()
        self.noise_edges = np.cumsum(share)
        self.log_noise = np.log(noise * share).astype(np.float32)
        self.log_inner = np.log(inner_noise * np.diff(layout.edges) / self.totals[layout.kind]).astype(np.float32)
        self.drawn = 0

    def feed(self, w: np.ndarray, begins: np.ndarray) -> None:
        """Trains on all words of a block, each once, its runs in any order; begins marks the first word of each text."""
        n = len(w)
        runs = -(-n // RUN)
        words, first = np.full(runs * RUN + 2, END_CLASS, np.int32), np.zeros(runs * RUN, bool)
        words[2 : n + 2], first[:n] = w, begins
        order = self.rng.permutation(runs)
        for a in range(0, runs, self.runs):
            at = order[a : a + self.runs, None] * RUN
            self.step(words[at + np.arange(RUN + 2)], first[at + np.arange(RUN)], (at + np.arange(RUN) < n).ravel())
        self.drawn += n

    def step(self, words: np.ndarray, begins: np.ndarray, real: np.ndarray) -> None:
        """words: two words before a run and its own, a row each. The end of the text before stands for what precedes a text; real marks words that aren't padding."""
        m, dims = self.m, self.m.context.shape[1]
        vectors, begin = m.context[words], begins.nonzero()
        one, two = vectors[:, 1:-1], vectors[:, :-2].copy()
        two[begin] = m.context[END_CLASS]
        p = np.empty((*begins.shape, dims + 1), np.float32)
        np.multiply(one, m.weight[0], out=p[:, :, :-1])
        p[:, :, :-1] += two * m.weight[1]
        p[:, :, -1] = 1
        p, w = p.reshape(-1, dims + 1), words[:, 2:].ravel()

        gp = self.classes(p, w, real)
        inside = np.flatnonzero(self.many[w] & real)
        if len(inside):
            inside = inside[np.argsort(self.kind[w[inside]], kind="stable")]
            gp[inside] += self.members(p[inside], w[inside])

        gp = gp[:, :-1].reshape(*begins.shape, dims)
        g_weight = np.stack([np.einsum("rtd,rtd->d", gp, x) for x in (one, two)])
        g = np.zeros_like(vectors)
        np.multiply(gp, m.weight[0], out=g[:, 1:-1])
        further = gp * m.weight[1]
        before_all = further[begin].sum(0)
        further[begin] = 0
        g[:, :-2] += further
        stepped(m.context, self.sums[0], np.append(words.ravel(), np.int32(END_CLASS)), np.concatenate((g.reshape(-1, dims), before_all[None])), self.rate)
        self.sums[1] += g_weight**2
        m.weight -= (self.rate / 10) * g_weight / np.sqrt(self.sums[1])

    def classes(self, p: np.ndarray, w: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Moves the classes of words w with predicted vectors p, against noise that the batch shares; the gradient of p."""
        m, kind = self.m, self.kind[w]
        bad = np.minimum(np.searchsorted(self.noise_edges, self.rng.random(self.noise) * self.noise_edges[-1], side="right"), len(self.totals) - 1).astype(np.int32)
        q, qn = m.top[kind], m.top[bad]
        good = sigmoid(np.einsum("ij,ij->i", p, q) - self.log_noise[kind]) - 1
        false = p @ qn.T
        false = sigmoid(np.subtract(false, self.log_noise[bad], out=false))
        if not real.all():
            good[~real], false[~real] = 0, 0
        q *= good[:, None]
        stepped(m.top, self.sums[2], np.concatenate((kind, bad)), np.concatenate((good[:, None] * p, false.T @ p)), self.rate)
        q += false @ qn
        return q

    def members(self, p: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Moves words w, sorted by class, inside their classes, against noise that a class shares; the gradient of p."""
        m, layout, noise, kind = self.m, self.layout, self.inner_noise, self.kind[w]
        starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        first, total = layout.start[kind[starts]], self.totals[kind[starts]]
        bad = np.searchsorted(layout.edges, layout.edges[first][:, None] + self.rng.random((len(starts), noise)) * total[:, None], side="right") - 1
        bad = np.clip(bad, first[:, None], (first + layout.size[kind[starts]] - 1)[:, None]).astype(np.int32)
        q, qn, log_bad = m.inner[w], m.inner[bad], self.log_inner[bad]
        good = sigmoid(np.einsum("ij,ij->i", p, q) - self.log_inner[w]) - 1
        q *= good[:, None]
        g_bad = np.empty_like(qn)
        for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(w)])):
            false = p[a:b] @ qn[k].T
            false = sigmoid(np.subtract(false, log_bad[k], out=false))
            q[a:b] += false @ qn[k]
            g_bad[k] = false.T @ p[a:b]
        stepped(m.inner, self.sums[3], np.concatenate((w, bad.ravel())), np.concatenate((good[:, None] * p, g_bad.reshape(-1, p.shape[1]))), self.rate)
        return q


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of float32 values, which are used up."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Scorer:
    """What scoring needs: the head, the neural model, tokens and types outside the head."""

    head: Head
    layout: Layout
    model: Bilinear
    end_count: int
    other_total: int
    other_types: int


def train(texts: DataFrame, head_size: int = 65_536, classes: int = 192, dims: int = 24, rounds: int = 2, copies: int | None = None, **steps) -> tuple[Scorer, DataFrame]:
    """(the scorer, counts of all tokens) from every row of texts(text); null texts count as empty.

    Counts cover every text, and every token of every text trains, once: a text in one of the rounds. Memory is bounded by
    head_size, whatever the corpus. There is a copy of the model for each PART tokens; steps are the Trainer's options.
    """
    bounded_batches(texts.sparkSession)
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = written(token_counts(texts), "lm-counts")
    head = head_of(counts, head_size)
    end_count = sum(r["n"] for r in counts.filter(F.length("token") == 0).collect())
    other = head.total - end_count - int(head.n.sum())
    layout = Layout.of(np.concatenate(([end_count, other], head.n)).astype(np.float64), classes)
    copies = copies or max(1, -(-head.total // PART))
    model = Bilinear.start(layout, dims)
    for k in range(rounds):
        own = texts.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        model = averaged(own.coalesce(copies), copies, head, model, layout, k, steps)
    return Scorer(head, layout, model, end_count, other, head.distinct - len(head.tokens) - (end_count > 0)), counts


def averaged(texts: DataFrame, copies: int, head: Head, model: Bilinear, layout: Layout, round_: int, steps: dict) -> Bilinear:
    """One round: each partition of the texts trains a copy; the copies' mean, weighted by draws, taken slice by slice."""
    shared = texts.sparkSession.sparkContext.broadcast((head, model, layout))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, start, words = shared.value
        part = TaskContext.get().partitionId()
        trainer = Trainer(start, words, [round_, part], **steps)
        for batch in batches:
            for _, code, distinct, sizes in split_texts(batch.column(0)):
                _, w, _, _ = words_of.stream(code, distinct, sizes)
                begins = np.zeros(len(w), bool)
                begins[np.cumsum(sizes + 1) - 1 - sizes] = True
                trainer.feed(w, begins)
        if trainer.drawn:
            moved = np.concatenate([(x - y).ravel() for x, y in zip(trainer.m.parts(), start.parts())]).astype(np.float16)
            pieces = pa.array([x.tobytes() for x in np.array_split(moved, SLICES)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([trainer.drawn] * SLICES), pieces], ["slice", "part", "size", "moved"])
        del trainer
        give_back()

    def mean(key: tuple, rows: pa.Table) -> pa.Table:
        total, out = sum(rows["size"].to_pylist()), 0.0
        for _, size, moved in sorted(zip(*(rows[c].to_pylist() for c in ("part", "size", "moved")))):
            out = out + np.frombuffer(moved, np.float16).astype(np.float64) * (size / total)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "size": pa.array([total]), "moved": pa.array([out.astype(np.float16).tobytes()], pa.binary())})

    schema = "slice int, part int, size long, moved binary"
    parts = texts.mapInArrow(one, schema)
    while True:
        group = F.floor(F.col("part") / FAN).cast("int").alias("group")
        parts = parts.groupBy("slice", group).applyInArrow(mean, schema)
        copies = -(-copies // FAN)
        if copies <= 1:
            break
    slices = sorted(parts.select("slice", "moved").collect())
    if not slices:
        return model
    moved, out, at = np.concatenate([np.frombuffer(bytes(r["moved"]), np.float16) for r in slices]).astype(np.float32), [], 0
    for x in model.parts():
        out.append(x + moved[at : at + x.size].reshape(x.shape))
        at += x.size
    return Bilinear(*out)


def scored(df: DataFrame, scorer: Scorer, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row for each row of df.

    A null text counts as empty and scores its end alone. Texts are scored whole. Tokens outside
    the head meet their counts in a join on the token; commoner ones never take part in it.
    """
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        logs, end_log = np.log10(np.append(s.head.n, (0, 0)) + 1.0), np.log10(s.end_count + 1.0)
        for batch in batches:
            for a, code, words, sizes in split_texts(batch.column(1)):
                at, w, one, two = s.head.stream(code, words, sizes)
                n = len(sizes)
                owner = np.repeat(np.arange(n), sizes + 1)
                count_log = np.where(at >= 0, logs[at], np.where(at == -2, end_log, 0.0))
                neural = s.model.log_shares(s.layout, one, two, w) / np.log(10)
                total = lambda x: np.bincount(owner, x, minlength=n)  # noqa: E731, B023
                rare = np.flatnonzero(at == -1)
                bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=n)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), words.take(pa.array(code[rare - owner[rare]])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(sizes + 1), pa.array((total(at >= 0) + (s.end_count > 0)).astype(np.int64)), pa.array(total(count_log)), pa.array(total(neural)), pa.array(total(at == -1).astype(np.int64)), lists],
                    ["doc_id", "n_tokens", "known", "logs", "neural", "others", "rare"],
                )
        give_back()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, known long, logs double, neural double, others long, rare array<binary>"
    rows = written(rows.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tail = rows.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    known = tail.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    both = rows.drop("rare").join(known, "row", "left").na.fill(0, ["more", "more_logs"])
    s = scorer
    return both.select(
        "doc_id", "n_tokens", (F.col("known") + F.col("more")).cast("long").alias("n_known"), F.lit(s.head.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * float(np.log10(s.head.total + s.head.distinct + 1.0))).alias("base_score"),
        (F.col("neural") + F.col("more_logs") - F.col("others") * float(np.log10(s.other_total + s.other_types + 1.0))).alias("score"),
    )
