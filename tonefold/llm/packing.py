"""Packing documents into training sequences by minimum bin slack.

A document's ids fill whole sequences as far as they go; the remainders of many documents
wait in a window. A bin starts with the longest remainder, and a subset-sum over a bitset of
reachable fills finds the remainders that bring it closest to the capacity; walking back
through the bitsets tells how many of each length go in. What no bin can fill exactly at a
partition's end is cut so that its sequences hold a power of two of ids and need no padding.

Every partition packs its own rows in one pass: nothing is shuffled, memory holds one window
of remainders and one block of texts, and a lost task is run again alone, with one outcome.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonefold.llm.common import bounded_batches, byte_column, give_back, row_blocks, split_words

CAPACITY = 2048
END_ID = 1
WINDOW = 4096
BLOCK = 1 << 23
#: Words whose ids a task remembers at most.
WORDS_HELD = 1_000_000
#: Words given to the tokenizer in one call, which bounds what its results take.
LEARNT_AT_ONCE = 2_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: ASCII marks but the apostrophe. A run of them after letters is a piece of its own to the tokenizer.
MARKS = r"[!-&(-/:-@\[-`{-~]+"
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class WordIds:
    """Ids of words by a tokenizer that lower-cases and drops white space, each word encoded once while it is remembered."""

    def __init__(self, path: str, most: int = WORDS_HELD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.known = pa.array([], pa.string())
        self.pool, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keeps the half that was met first, in which the common words are."""
        self.known = pa.concat_arrays([self.known.slice(0, self.most // 2)])
        self.starts = self.starts[: len(self.known) + 1].copy()
        self.pool = self.pool[: self.starts[-1]].copy()

    def learn(self, words: list[str]) -> None:
        plain, others = [], []
        for w in words:
            (plain if w.isalpha() and w == w.lower() and (w.isascii() or max(w) < "\u0180") else others).append(w)
        found = [self._letters(plain)] + [self._encoded(others[k : k + LEARNT_AT_ONCE]) for k in range(0, len(others), LEARNT_AT_ONCE)]
        self.known = pa.concat_arrays([self.known, pa.array(plain, pa.string()), pa.array(others, pa.string())])
        self.pool = np.concatenate([self.pool, *(ids for _, ids in found)])
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.concatenate([n for n, _ in found]))))

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lower-case Latin letters alone are one piece to the tokenizer, which its model takes as it is."""
        sizes, ids, tokenize = [], [], self.model.tokenize
        for w in words:
            found = tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS))
            sizes.append(len(found))
            ids += [t.id for t in found]
        return np.array(sizes, np.int64), np.array(ids, np.uint32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes the words as one text; where an id begins in it tells its word."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
        return np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(words)), np.array(found.ids, np.uint32)

    def places(self, words: pa.Array) -> np.ndarray:
        """The number of each of the distinct words, from which starts and pool have its ids."""
        at = pc.index_in(words, value_set=self.known)
        if new := at.null_count:
            if len(self.known) + new > self.most:
                self.forget()
                at = pc.index_in(words, value_set=self.known)
            self.learn(words.filter(at.is_null()).to_pylist())
            at = pc.index_in(words, value_set=self.known)
        return at.to_numpy().astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encoded(texts: pa.Array, words_of: WordIds) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids of a block of texts with END_ID after each, their offsets).

    The tokenizer lower-cases and takes a run of marks after letters as a word of its own; so A-Z become
    a-z, and the marks after an ASCII letter at a word's end are looked up apart. Texts that may hold a
    special token, whose case counts, stay as they are.
    """
    _, offsets = byte_column(texts)
    for a, b in row_blocks(offsets, BLOCK):
        block = texts.slice(a, b - a)
        block = pc.if_else(pc.match_substring(block, "<|"), block, pc.ascii_lower(block))
        code, words, counts = split_words(block)
        marked = pc.and_not(pc.match_substring_regex(words, f"[a-z]{MARKS}$"), pc.match_substring(words, "<|"))
        bare = pc.if_else(marked, pc.replace_substring_regex(words, f"{MARKS}$", ""), words)
        mark = pc.if_else(marked, pc.replace_substring_regex(words, "^.*[a-z]", ""), pa.scalar(""))
        both = pa.concat_arrays([bare, mark]).dictionary_encode()
        place = words_of.places(both.dictionary)
        # The ids of each distinct word, its mark's after its own, and at last END_ID.
        row = place[both.indices.to_numpy()].reshape(2, -1).T
        sizes = words_of.starts[row + 1] - words_of.starts[row]
        pool = np.append(words_of.pool[_ranges(words_of.starts[row].ravel(), sizes.ravel())], np.uint32(END_ID))
        sizes = np.append(sizes.sum(1), 1)
        starts = np.cumsum(sizes) - sizes
        unit = np.full(len(code) + len(counts), len(words))
        unit[np.arange(len(code)) + np.repeat(np.arange(len(counts)), counts)] = code
        total = np.concatenate(([0], np.cumsum(sizes[unit])))
        yield a, pool[_ranges(starts[unit], sizes[unit])], total[np.concatenate(([0], np.cumsum(counts + 1)))]


def best_fill(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, at most counts[length] of each, whose sum is the largest up to room."""
    reach, trail, full = 1, [], (1 << (room + 1)) - 1
    for size in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        for _ in range(min(int(counts[size]), room // size)):
            more = reach | (reach << size) & full
            if more == reach:
                break
            trail.append((reach, size))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, []
    for before, size in reversed(trail):
        if not before >> at & 1:
            taken.append(size)
            at -= size
    return taken


class Packer:
    """The pieces of one partition. A waiting piece: (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, first_id
        self.waiting: list[list[tuple]] = [[] for _ in range(capacity)]
        self.counts = np.zeros(capacity, np.int64)
        self.rows: list[tuple] = []

    def put(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        c = self.capacity
        for start in range(0, len(ids) - c + 1, c):
            self.put([(doc_id, start, ids[start : start + c], len(ids))])
        if rest := len(ids) % c:
            self.waiting[rest].append((doc_id, len(ids) - rest, ids[len(ids) - rest :].copy(), len(ids)))
            self.counts[rest] += 1

    def pack(self, until: int, exact: bool) -> None:
        """Fills bins until so many pieces wait; with exact, stops at the first that can't be filled."""
        waiting = int(self.counts.sum())
        while waiting > until:
            longest = int(np.flatnonzero(self.counts)[-1])
            self.counts[longest] -= 1
            sizes = [longest, *best_fill(self.counts, self.capacity - longest)]
            if exact and sum(sizes) < self.capacity:
                self.counts[longest] += 1
                return
            for size in sizes[1:]:
                self.counts[size] -= 1
            self.put([self.waiting[size].pop() for size in sizes])
            waiting -= len(sizes)

    def finish(self) -> None:
        self.pack(0, exact=True)
        rest = [x for size in range(self.capacity - 1, 0, -1) for x in self.waiting[size]]
        self.waiting, self.counts[:] = [[] for _ in range(self.capacity)], 0
        left = sum(len(x[2]) for x in rest)
        room, own = 0, []
        while rest:
            if not room:
                room = min(self.capacity, 1 << (left.bit_length() - 1))
                left -= room
            doc_id, start, ids, total = rest.pop(0)
            own.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                rest.insert(0, (doc_id, start + room, ids[room:], total))
            room -= len(own[-1][2])
            if not room:
                self.put(own)
                own = []

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def packed(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids by `tokenizer` (a file that the executors have) and END_ID; a
    null or empty text is END_ID alone, and a repeated row is a document of its own. Each id is in
    one piece. Sequences hold `capacity` ids, or at a partition's end a lower power of two, or a
    sum short of capacity where capacity is no power of two. Nothing stays in a worker between tasks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words_of = Packer(TaskContext.get().partitionId() << 33, capacity), WordIds(tokenizer)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, at in encoded(batch.column(1), words_of):
                at = at.tolist()
                for i in range(len(at) - 1):
                    packer.add(names[first + i], ids[at[i] : at[i + 1]])
                if packer.counts.sum() > WINDOW:
                    packer.pack(WINDOW // 4, exact=False)
                if len(packer.rows) > 10_000:
                    yield packer.taken()
        packer.finish()
        yield packer.taken()
        del words_of
        give_back()

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(pack, SCHEMA)
