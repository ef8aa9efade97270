"""Exact dedup: counting quotient filters, one or more per partition, merged by sorted remainders;
fingerprints with a count above one go on to a comparison of the whole texts."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, materialize, small

#: Fingerprints that one filter takes before it is given out and another begun; also the mean load of a merged segment.
FILTER_ENTRIES = 1 << 20


class CountingQuotientFilter:
    """Multiset of whole `bits`-bit fingerprints, without loss: quotient by slot, remainder in the slot.

    Three bit vectors say which quotients occur, where runs end, and which slots hold a counter. A remainder that
    occurs once takes one slot; one that occurs c times is followed by c - 1 in digits of the remainder's width.
    Made in bulk from sorted fingerprints, so runs and remainders are in order and two filters merge like lists."""

    def __init__(self, bits: int, q: int, occupied: np.ndarray, runend: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.bits, self.q, self.occupied, self.runend, self.counter, self.slots = bits, q, occupied, runend, counter, slots

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """keys: distinct, ascending, below 2**bits."""
        q = max(1, min(bits - 8, math.ceil(math.log2(max(2, len(keys) / 0.9)))))
        r = bits - q
        keys, extra = keys.astype(np.uint64), counts.astype(np.uint64) - np.uint64(1)
        digits, rest = np.zeros(len(keys), np.int64), extra.copy()
        while rest.any():
            digits += rest > 0
            rest = rest >> np.uint64(r) if r < 64 else rest * np.uint64(0)
        quotient = (keys >> np.uint64(r)).astype(np.int64)
        before = np.cumsum(1 + digits) - (1 + digits)
        start = before + (np.maximum.accumulate(quotient - before) if len(keys) else before)
        n = max(1 << q, int(start[-1] + 1 + digits[-1]) if len(keys) else 0)
        occupied, runend, counter, slots = np.zeros(1 << q, bool), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.uint64)
        occupied[quotient] = True
        mask = np.uint64((1 << r) - 1)
        slots[start] = keys & mask
        last = np.append(quotient[1:] != quotient[:-1], True) if len(keys) else np.zeros(0, bool)
        runend[(start + digits)[last]] = True
        for d in range(int(digits.max(initial=0))):
            at = start[digits > d] + 1 + d
            counter[at] = True
            slots[at] = (extra[digits > d] >> np.uint64(r * d)) & mask
        return cls(bits, q, occupied, runend, counter, slots)

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> CountingQuotientFilter:
        keys, counts = np.unique(values.astype(np.uint64), return_counts=True)
        return cls.build(keys, counts, bits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, ascending, and their counts."""
        r = self.bits - self.q
        quotient, end = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        start = np.maximum(np.append(-1, end[:-1]) + 1, quotient)
        length = end - start + 1
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        value, is_count = self.slots[at], self.counter[at]
        head = np.flatnonzero(~is_count)
        keys = (np.repeat(quotient, length)[head].astype(np.uint64) << np.uint64(r)) | value[head]
        counts = np.ones(len(head), np.uint64)
        if is_count.any():
            owner = np.cumsum(~is_count) - 1
            digit = np.arange(len(at)) - head[owner] - 1
            np.add.at(counts, owner[is_count], value[is_count] << (digit[is_count] * r).astype(np.uint64))
        return keys, counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Counts of equal fingerprints add up; nothing is lost."""
        parts = [f.items() for f in filters]
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return cls.build(keys[new], np.add.reduceat(counts, new) if len(new) else counts, filters[0].bits)

    def to_bytes(self) -> bytes:
        width = -(-(self.bits - self.q) // 8)
        body = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        return struct.pack("<BBQ", self.bits, self.q, len(self.slots)) + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.counter)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n = struct.unpack_from("<BBQ", data)
        at, vectors = struct.calcsize("<BBQ"), []
        for size in (1 << q, n, n):
            vectors.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        width = -(-(bits - q) // 8)
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        return cls(bits, q, *vectors, slots.view("<u8").reshape(-1))


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """(fp long, n long) of the 64-bit fingerprints in fps.fp that occur more than once; n is the exact count.

    A segment is the fingerprints with the same leading bits; the number of segments follows the rows, so that one
    task merges about FILTER_ENTRIES entries. A fingerprint that fills a third of the rows is one entry per filter."""
    lead = min(48, max(0, math.ceil(math.log2(max(1, rows / FILTER_ENTRIES)))))
    bits = 64 - lead

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(values: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(values), return_counts=True)
            segment = (keys >> np.uint64(bits)).astype(np.int64) if lead else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            ends = np.append(cuts[1:], len(keys))
            low = keys & np.uint64((1 << bits) - 1)
            blobs = [CountingQuotientFilter.build(low[a:b], counts[a:b], bits).to_bytes() for a, b in zip(cuts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(segment[cuts]), pa.array(blobs, pa.binary())], ["segment", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= FILTER_ENTRIES:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in group["filter"]]).items()
        many = counts > 1
        whole = keys[many] | np.uint64(int(group["segment"].iloc[0]) << bits) if lead else keys[many]
        return pd.DataFrame({"fp": whole.view(np.int64), "n": counts[many].astype(np.int64)})

    return fps.select("fp").mapInArrow(filters, "segment long, filter binary").groupBy("segment").applyInPandas(merged, "fp long, n long")


def _normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), WHITE, " ")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_sha256) of every row, and the groups of two rows or more with equal texts: fp, text_sha256, keep_id, group_size."""
    norm = _normalised(text_col)
    keyed = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "keyed")
    repeated = materialize(repeated_fingerprints(keyed, keyed.count()), "repeated").select("fp")
    many = small(repeated, repeated.count())
    # byte verification: the whole texts behind repeated fingerprints, grouped by fingerprint and text
    suspects = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", F.xxhash64("norm").alias("fp")).join(many, "fp", "left_semi")
    groups = suspects.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return keyed, materialize(groups.select("fp", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"), "groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal if they are the same after each run of ASCII white space is replaced by one space. Null counts as
    the empty text. Of equal texts the smallest doc_id stays, and of several rows with that id and text just one. A null
    doc_id never stays before a number; where a group has no other ids, one of its rows stays. A doc_id may come with
    several texts: each is judged by its own text. An empty table gives no rows. Other columns are not looked at."""
    keyed, groups = _groups(docs, id_col, text_col)
    out = keyed.join(small(groups, groups.count(), 200_000), ["fp", "text_sha256"], "left")
    heads = F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    one = Window.partitionBy("fp", "text_sha256").orderBy("doc_id")  # over the rows that may stay only: as a rule one of each group
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    stays = out.where(heads).withColumn("kept", F.row_number().over(one) == 1).select(*names)
    rest = out.where(~heads).select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("group_size").isNull().alias("kept"), "text_sha256")
    return rest.unionByName(stays)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with only the row of each group of equal texts that exact_duplicates keeps.

    Rows go by their own text, so a text without copies stays whatever its doc_id. Of rows that share doc_id and text
    one stays, whichever; of a group without ids too. Null texts are empty texts. An empty table stays empty."""
    keyed, groups = _groups(docs, id_col, text_col)
    mark = groups.select(F.col("fp").alias("__fp"), F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"))
    mark = small(mark, groups.count(), 200_000)
    heads = keyed.join(small(groups, groups.count(), 200_000), ["fp", "text_sha256"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    several = materialize(heads.groupBy("fp", "text_sha256").count().where("count > 1").select(F.col("fp").alias("__fp"), F.col("text_sha256").alias("__sha")), "several")
    rows = docs.withColumns({"__fp": F.xxhash64(_normalised(text_col)), "__sha": F.sha2(_normalised(text_col).cast("binary"), 256)}).join(mark, ["__fp", "__sha"], "left")
    rows = rows.withColumn("__group", F.col("__keep").isNotNull())
    own = F.col(id_col).cast("long")
    if groups.where("keep_id is null").isEmpty():
        stay = rows.where(~F.col("__group") | own.eqNullSafe(F.col("__keep")))
    else:  # groups without any id have a null keep_id, which the outer join can't tell from no group
        known = materialize(groups.where("keep_id is null").select(F.col("fp").alias("__fp"), F.col("text_sha256").alias("__sha"), F.lit(True).alias("__none")), "no-ids")
        rows = rows.join(small(known, known.count(), 200_000), ["__fp", "__sha"], "left")
        stay = rows.where(~F.col("__group") | F.coalesce("__none", F.lit(False)) | own.eqNullSafe(F.col("__keep")))
    n = several.count()
    if n:
        key = ["__fp", "__sha"]
        stay = stay.join(small(several, n, 200_000), key, "left_anti").unionByName(stay.join(small(several, n, 200_000), key, "left_semi").dropDuplicates(key))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
