"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a bin costs besides its length.
OVERHEAD = 16
#: Rows of one shard on average; a shard is packed by one task, and leaves a few bins unfilled.
SHARD_ROWS = 100_000


class _Left:
    """Lengths still to be placed, with a bit for each that is left."""

    def __init__(self, lengths: np.ndarray):
        self.counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        self.bits = 0
        for n in self.counts:
            self.bits |= 1 << n

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            self.bits &= ~(1 << n)

    def fill(self, first: int, room: int) -> int:
        """What a bin with `room` would hold if it took `first` and then the longest of the others that fit, again and again."""
        held, top, used = first, room - first, 1
        limit = min(top, first)
        while limit > 0 and (bits := self.bits & ((2 << limit) - 1)):
            n = bits.bit_length() - 1
            spare = self.counts[n] - (used if n == first else 0)
            if spare <= 0:
                limit = n - 1
                continue
            m = min(spare, (room - held) // n)
            held += m * n
            limit = min(room - held, n - 1)
        return held


def _plan(lengths: np.ndarray, order: np.ndarray, sizes: list[int], overhead: float, look: bool) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing over bins of `sizes`: cost after downsizing, bin and offset of each length, downsized bins.

    look: the size of a new bin is the one of least cost for each unit that it would hold, as _Left.fill foresees it; else it
    is the largest."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []
    room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set if some open bin has room for just r more
    left = _Left(lengths) if look else None
    for i in order.tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = sizes[-1], len(used)
            if left:
                held = {c: left.fill(n, c) for c in sizes if c >= n}
                r = min(held, key=lambda c: ((next(x for x in sizes if x >= held[c]) + overhead) / held[c], c))
            used.append(0)
        if left:
            left.take(n)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if r > n:
            room.setdefault(r - n, []).append(b)
            open_rooms |= 1 << (r - n)
    final = np.asarray(sizes, np.int64)[np.searchsorted(sizes, used)] if used else np.zeros(0, np.int64)
    return float(final.sum() + overhead * len(final)), bins, offsets, final


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to the largest capacity), and each bin's capacity after downsizing.

    Best fit decreasing: a piece goes to the open bin that it leaves the least room in. Where none fits, a bin is opened of
    the permitted size that costs least for what it would hold: for each size, the pieces still to be placed are laid into it,
    longest first, and its cost - of the size it could then be downsized to, plus the overhead - is divided by their sum. So
    all sizes compete for every bin. At the end each bin gets the smallest size that holds its contents. As lookahead is
    a guess, plans with every prefix of the sizes, with and without it, are made, and the least total cost wins."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes = sorted(set(capacities))
    plans = [(sizes[: top + 1], look) for top in range(len(sizes)) if sizes[top] >= lengths[order[0]] for look in (True, False)]
    return min((_plan(lengths, order, allowed, overhead, look) for allowed, look in plans), key=lambda p: p[0])[1:]


def word_count(text_col: str = "text") -> F.Column:
    """Words between ASCII white space; null and empty texts have none."""
    words = F.size(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x09-\x0D]", " ")), " +"))
    return F.when(F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), words).otherwise(0).cast("long")


def pack(items: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs items (doc_id long, length long). One row per piece: doc_id, piece, piece_start, length, bin_id, bin_offset,
    bin_capacity, bin_used.

    A document longer than the largest capacity is cut into pieces of that length and a rest. Shards are dealt by hash of
    doc_id and each is packed alone; their number follows the rows. Null or non-positive lengths give one row of
    length 0 without a bin. Ties go to the smaller doc_id. Rows that repeat a doc_id are packed each; a null doc_id
    is packed like any other. Other columns are not looked at. bin_id is 'shard-number', the same in every run."""
    items = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0)).alias("length"))
    shards = max(1, math.ceil(items.count() / shard_rows))
    largest = max(capacities)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        group = group.sort_values(["doc_id", "length"], kind="stable")
        n, ids = group["length"].to_numpy(), group["doc_id"].to_numpy(dtype=object)
        pieces = np.maximum(1, -(-n // largest))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(n[row] - piece * largest, largest)
        some = length > 0
        bins, offsets, sizes = best_fit(length[some], capacities, overhead)
        used = np.bincount(bins, length[some], len(sizes)).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
        out = pd.DataFrame({"doc_id": pd.array(ids[row], "Int64"), "piece": piece, "piece_start": piece * largest, "length": length})
        for name, value in (("bin_offset", offsets), ("bin_capacity", sizes[bins]), ("bin_used", used[bins])):
            column = np.zeros(len(row), np.int64)
            column[some] = value
            out[name] = pd.array(column, "Int64")
            out.loc[~some, name] = pd.NA
        names = np.full(len(row), None, object)
        names[some] = [f"{shard}-{b}" for b in bins.tolist()]
        out["bin_id"] = names
        return out

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    names = "doc_id long, piece long, piece_start long, length long, bin_offset long, bin_capacity long, bin_used long, bin_id string"
    return dealt.groupBy("shard").applyInPandas(run, names).select("doc_id", "piece", "piece_start", "length", "bin_id", "bin_offset", "bin_capacity", "bin_used")


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD) -> DataFrame:
    """pack() with the words of docs.text as lengths. The lengths are written once, before shards are counted."""
    return pack(materialize(docs.select("doc_id", word_count().alias("length")), "lengths"), capacities, overhead)


def pack_tokens(docs: DataFrame, path: str | None = None, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD) -> DataFrame:
    """pack() with the tokens of docs.text as lengths, begin and end ids too, by the piece encoder with the model at path."""
    from .piece_bpe import tokenize

    return pack(materialize(tokenize(docs, path, with_ids=False).select("doc_id", F.col("n_tokens").alias("length")), "lengths"), capacities, overhead)
