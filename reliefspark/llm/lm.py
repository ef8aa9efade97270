"""Language-model scoring by stupid backoff: n-gram counts in tables dealt by hash, joined to the n-grams of the documents,
summed per document.

Counts are over all documents, and each document is scored against the others: its own n-grams are taken off every count.

The relation is (order, n-gram hash, block, count). Its rows travel packed, all of one block and hash range in one, so that a
frequent n-gram is one entry per block however many documents hold it. One order is counted after the other: an n-gram can
occur in another block only if both n-grams of one word less do, so only those are asked for, and no shared count is lost.
ngram_counts gives the whole count table, a row for each n-gram."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, keyed_table, materialize, release, small_batches, values
from .packed import pack_ints, pack_sorted, slices, unpack_ints, unpack_sorted

#: Longest n-gram: three words.
ORDER = 3
#: Factor of a score for each shorter n-gram it falls back on.
ALPHA = 0.4
#: A word that no other document has counts as this often.
UNSEEN = 0.5
#: Words of a block, as long as no single document has more.
BLOCK_WORDS = 1_500_000
#: Entries of one part of the count table on average.
PART_ENTRIES = 1_500_000
#: Bits of an n-gram's hash, at every size. Among n distinct n-grams, some two share a hash with a chance below n * n / 2**65.
HASH_BITS = 64
BEGIN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def longer(shorter: np.ndarray, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at the places `at`: of the (n-1)-gram one place before, and the word there."""
    return _mix(shorter[at - 1] * np.uint64(0x9FB21C651E98DF25) ^ (words[at] + np.uint64(n)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: ids, words per document, hashes of the distinct words, their numbers, and the words as numbers."""
    memo = WordHashes()
    part, k = TaskContext.get().partitionId(), 0

    def out(ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        vocabulary, words, often = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        # frequent words get small numbers, which pack better
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(vocabulary))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        values = [[(part << 32) + k], [ids], [pack_ints(sizes)], [pack_sorted(vocabulary)], [pack_ints(rank)], [pack_ints(rank[words])], [int(sizes.sum())]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["block", "ids", "sizes", "vocabulary", "rank", "words", "n"])

    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(values(b.column(0)), values(b.column(1)), strict=True):
            w = (t or b"").lower().split()
            h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
            if texts and n + len(h) > BLOCK_WORDS:
                yield out(ids, texts)
                ids, texts, n, k = [], [], 0, k + 1
            ids.append(i)
            texts.append(h)
            n += len(h)
    if texts:
        yield out(ids, texts)
    memo.clear()
    release()


BLOCK = ["block", "sizes", "vocabulary", "rank", "words"]
#: What the parts of the count table answer: for each n-gram asked, ascending, its count in all blocks less that in this one.
REPLY = "block long, order int, part long, more binary"


class _Block:
    """The words of a block's documents, one begin mark before each."""

    def __init__(self, sizes: bytes, vocabulary: bytes, rank: bytes, words: bytes):
        self.sizes = unpack_ints(sizes)
        total = int(self.sizes.sum()) + len(self.sizes)
        self.starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.inner = np.ones(total, bool)
        self.inner[self.starts] = False
        self.words = np.empty(total, np.uint64)
        self.words[self.starts] = BEGIN
        by_rank = np.empty(len(r := unpack_ints(rank)), np.uint64)
        by_rank[r] = unpack_sorted(vocabulary)
        self.words[self.inner] = by_rank[unpack_ints(words)]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        self.place = np.arange(total) - self.starts[self.doc]

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the single words and begin marks, and the hash at each place."""
        return np.arange(len(self.words)), _mix(self.words + np.uint64(1))

    def next(self, shorter: np.ndarray, n: int, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the n-grams that don't reach over a begin mark - of those only where `may` holds at the place and the one
        before - and the hash at each place (0 elsewhere)."""
        ok = self.place >= n - 1
        if may is not None:
            ok &= may
            ok[1:] &= may[:-1]
        at = np.flatnonzero(ok)
        h = np.zeros(len(self.words), np.uint64)
        h[at] = longer(shorter, self.words, at, n)
        return at, h


@dataclass
class _Level:
    """The n-grams of one order in a block, found by one sort."""

    at: np.ndarray  # places, by hash and then by document
    keys: np.ndarray  # distinct hashes, ascending
    begin: np.ndarray  # where each begins in `at`, and the end
    counts: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, h: np.ndarray) -> _Level:
        own = h[at]
        order = np.argsort(own, kind="stable")  # places ascend within a hash, and so do documents
        own = own[order]
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        begin = np.append(head, len(own))
        return cls(at[order], own[head], begin, np.diff(begin))

    def spread(self, of_keys: np.ndarray, n: int) -> np.ndarray:
        """A value of each key at its places, 0 at others."""
        out = np.zeros(n, of_keys.dtype)
        out[self.at] = np.repeat(of_keys, self.counts)
        return out

    def own(self, doc: np.ndarray, n: int) -> np.ndarray:
        """At each place, how often its document holds the n-gram."""
        d = doc[self.at]
        new = np.append(True, d[1:] != d[:-1]) if len(d) else np.zeros(0, bool)
        new[self.begin[:-1]] = True
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(d)))
        out = np.zeros(n, np.int64)
        out[self.at] = np.repeat(size, size)
        return out


def _levels(block: _Block, replies: dict[int, dict[int, np.ndarray]], lead: int, top: int) -> Iterator[tuple[int, _Level, np.ndarray, np.ndarray]]:
    """Orders 1, 2 ... top: the level of the n-grams asked for, their hashes by place, and counts in other blocks by key.

    replies: by order and part. Of order 2 all are asked for, of longer ones those whose two shorter ones other blocks hold.
    An order without replies gives None for the counts."""
    may, h = None, None
    for n in range(1, top + 1):
        at, h = block.first() if n == 1 else block.next(h, n, may)
        level = _Level.of(at, h)
        got = replies.get(n)
        more = None
        if got is not None:
            more = np.zeros(len(level.keys), np.int64)
            for part, a, e in slices(level.keys, HASH_BITS, lead):
                if part in got:  # parts without a shared n-gram don't answer
                    more[a:e] = got[part]
        yield n, level, h, more
        if more is not None and n > 1:
            # shared within the block is as good as in another one: other documents of the block count too
            many = more + level.counts > 1
            may = level.spread(many, len(block.words)) if n >= 2 else None


def _read(replies: pa.Table) -> dict[int, dict[int, np.ndarray]]:
    out: dict[int, dict[int, np.ndarray]] = {}
    for n, part, more in zip(replies["order"].to_pylist(), replies["part"].to_pylist(), replies["more"].to_pylist(), strict=True):
        out.setdefault(n, {})
        if part is not None:
            out[n][part] = unpack_ints(more)
    return out


ASKED = "block long, order int, part long, grams binary, counts binary"


def _asked(block: int, n: int, level: _Level, lead: int) -> pa.RecordBatch:
    ranges = slices(level.keys, HASH_BITS, lead)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(ranges), pa.int64()), pa.array([n] * len(ranges), pa.int32()), pa.array([p for p, _, _ in ranges], pa.int64()), pa.array([pack_sorted(level.keys[a:e]) for _, a, e in ranges], pa.binary()), pa.array([pack_ints(level.counts[a:e]) for _, a, e in ranges], pa.binary())],
        ["block", "order", "part", "grams", "counts"],
    )


def _summed(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one part: keys and counts of each, the distinct keys, their totals, and which of them each entry is."""
    keys, counts = [unpack_sorted(x) for x in table["grams"].to_pylist()], [unpack_ints(x) for x in table["counts"].to_pylist()]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    sorted_ = every[order]
    head = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    totals = np.add.reduceat(np.concatenate(counts)[order], head)
    which = np.empty(len(every), np.int64)
    which[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(every))))
    return keys, counts, sorted_[head], totals, which


def _answer(table: pa.Table) -> pa.Table:
    """One part of the count table: for each block, how often other blocks hold each n-gram it asked for."""
    keys, counts, _, totals, which = _summed(table)
    rows, at = [], 0
    for block, n, part, k, c in zip(table["block"].to_pylist(), table["order"].to_pylist(), table["part"].to_pylist(), keys, counts, strict=True):
        more = totals[which[at : at + len(k)]] - c
        at += len(k)
        if more.any():
            rows.append((block, n, part, pack_ints(more)))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["block", "order", "part", "more"])


def _stored(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Documents in blocks, kept by block, and the number of words."""
    src = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    blocks = keyed_table(src.mapInArrow(_blocks, "block long, ids array<long>, sizes binary, vocabulary binary, rank binary, words binary, n long"), "block", "blocks")
    return blocks, blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _lead(n_words: int) -> int:
    """Leading bits of a hash that name its part of the count table: parts follow the words."""
    return min(48, max(1, math.ceil(math.log2(max(2, n_words / PART_ENTRIES)))))


def _ask_all(lead: int, top: int):
    """Asks for every n-gram of orders 1 to top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for n, level, _, _ in _levels(_Block(*(row[c] for c in BLOCK[1:])), {}, lead, top):
                    yield _asked(row["block"], n, level, lead)
        release()

    return run


def ngram_counts(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The count table: (order, gram, count), gram being the 64-bit hash of an n-gram as a signed number, of every distinct n-gram
    of 1 to `order` words. A begin mark before each document is a word of its own. Null texts are empty."""
    blocks, n_words = _stored(docs, id_col, text_col)

    def count(table: pa.Table) -> pa.Table:
        _, _, keys, totals, _ = _summed(table)
        return pa.table([pa.array(np.full(len(keys), table["order"][0].as_py(), np.int32)), pa.array(keys.view(np.int64)), pa.array(totals)], ["order", "gram", "count"])

    return blocks.select(*BLOCK).mapInArrow(_ask_all(_lead(n_words), order), ASKED).groupBy("order", "part").applyInArrow(count, "order int, gram long, count long")


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, log10_score (summed over words), mean_log10 (per word, null without words).

    Words are what stands between ASCII white space, A-Z lower-cased. A word's score is c(n-gram) / c(its context) for the
    longest n-gram that another document holds, times alpha for each order given up; at order 1, c(word) over all words of
    the other documents, where an unseen word counts UNSEEN times. Null and empty texts score 0 with no words. Rows that
    repeat an id are documents of their own and score each other; null ids are scored. Other columns are not looked at.
    An empty table gives no rows. N-grams are told apart by hashes of 64 bits."""
    blocks, n_words = _stored(docs, id_col, text_col)
    lead = _lead(n_words)

    def ask_longer(n: int):
        def run(mine: pa.Table, replies: pa.Table) -> pa.Table:
            out = pa.RecordBatch.from_pylist([], pa.schema([("block", pa.int64()), ("order", pa.int32()), ("part", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())]))
            for row in mine.to_pylist():
                got = {k: {} for k in range(1, n)} | _read(replies)
                for k, level, _, _ in _levels(_Block(*(row[c] for c in BLOCK[1:])), got, lead, n):
                    if k == n:
                        out = _asked(row["block"], n, level, lead)
            release()
            return pa.Table.from_batches([out])

        return run

    def score(mine: pa.Table, replies: pa.Table) -> pa.Table:
        parts = [pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log10_score": pa.array([], pa.float64())})]
        for row in mine.to_pylist():
            block = _Block(*(row[c] for c in BLOCK[1:]))
            here = np.flatnonzero(block.inner)
            place, doc = block.place[here], block.doc[here]
            rest = np.maximum(n_words - block.sizes[doc], 1)
            value, found, context = np.zeros(len(here)), np.ones(len(here), np.int64), None
            got = {k: {} for k in range(1, order + 1)} | _read(replies)
            for n, level, _, more in _levels(block, got, lead, order):
                # at each place: how often other documents hold the n-gram
                others = level.spread(more + level.counts, len(block.words)) - level.own(block.doc, len(block.words))
                if n == 1:
                    value = np.log10(np.maximum(others[here], UNSEEN) / rest)
                else:
                    up = (others[here] > 0) & (place >= n - 1)
                    value[up] = np.log10(others[here][up] / np.maximum(context[here - 1][up], 1))
                    found[up] = n
                context = others
            value += math.log10(alpha) * (np.minimum(order, place + 1) - found)
            sums = np.bincount(doc, value, len(block.sizes))
            parts.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_words": pa.array(block.sizes), "log10_score": pa.array(sums)}))
        release()
        return pa.concat_tables(parts)

    each = blocks.select(*BLOCK)
    asked = each.mapInArrow(_ask_all(lead, min(2, order)), ASKED)
    replies = None
    for n in range(2, order + 1) if order > 1 else (1,):
        if n > 2:
            asked = each.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(ask_longer(n), ASKED)
        got = materialize(asked.groupBy("order", "part").applyInArrow(_answer, REPLY), "replies")
        replies = got if replies is None else replies.unionByName(got)
    scored = blocks.select("ids", *BLOCK).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log10_score double")
    return scored.withColumn("mean_log10", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")))
