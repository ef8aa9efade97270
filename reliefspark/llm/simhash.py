"""SimHash near-dedup: fingerprints become counts of set bits by segment; a grid join finds those whose counts are near
under Manhattan distance, which never exceeds the Hamming distance; the exact distance then decides."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, connected_components, materialize, release, small, small_batches, values, without_ids

#: Fingerprints in one cell of the grid up to which the cell is joined with itself; fuller cells go by shared neighbours.
CELL_MAX = 128
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
SEED = 42
#: Every other bit: the low bit of each of 32 two-bit segments.
LOW = 0x5555555555555555


def fingerprint(data: bytes | None, words: int = 3) -> int:
    """SimHash of UTF-8 bytes: A-Z lower-cased, words between ASCII white space, shingles with repeats, XXH64 seed 42."""
    w = (data or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.append(0, end[: len(w) - words] + 1).tolist()
    ends = end[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], "<u8")
        lanes = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(len(h), 8)
        counts += np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long: the 64 bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x, words) for x in values(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
        release()

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_counts(fp: Column) -> Column:
    """Set bits of each of the 32 two-bit segments, as 32 two-bit fields: 00, 01 or 10."""
    next_bit = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW)
    return F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(next_bit).bitwiseAND(low))


def manhattan(a: Column, b: Column) -> Column:
    """Distance between two vectors of segment_counts: fields that differ by one, plus twice those 00 against 10."""
    x = a.bitwiseXOR(b)
    by_one = F.bit_count(x.bitwiseAND(F.lit(LOW)))
    by_two = F.bit_count(F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW)).bitwiseAND(F.bitwise_not(x)))
    return by_one + 2 * by_two


def links(classes: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): edges between the ids of classes (fp long, id long; fp distinct) that keep every chain of fingerprints
    within `distance` (1 or 2) differing bits.

    The 32 counts are cut in two halves, so near fingerprints are within 1 in one half at least: its cell, or one of up
    to 16 cells above it. A cell with more than CELL_MAX fingerprints is not joined with itself: its fingerprints and
    those that probe it give all their one-bit neighbours; each neighbour has 64 fingerprints at most and links them to the first."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    halves = [_signed(((1 << 32) - 1) << 32), (1 << 32) - 1]
    base = classes.select("fp", "id", segment_counts(F.col("fp")).alias("e"))
    parts = F.array(*[F.struct(F.lit(k).alias("half"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(halves)])
    cells = base.select("fp", "id", "e", F.inline(parts))
    above = [
        F.struct(F.lit(0 if i >= 16 else 1).alias("half"), F.when(F.col("e").bitwiseAND(F.lit(_signed(3 << 2 * i))) == 0, F.lit(_signed(1 << 2 * i))).when(F.col("e").bitwiseAND(F.lit(_signed(1 << 2 * i))) != 0, F.lit(_signed(3 << 2 * i))).alias("step"))
        for i in range(32)
    ]
    probes = base.select("fp", "id", "e", F.inline(F.array(*above))).where("step is not null")
    of_half = F.when(F.col("half") == 0, F.lit(halves[0])).otherwise(F.lit(halves[1]))
    probes = probes.select("fp", "id", "e", "half", F.col("e").bitwiseAND(of_half).bitwiseXOR(F.col("step")).alias("cell"))
    full = materialize(cells.groupBy("half", "cell").count().where(f"count > {CELL_MAX}").select("half", "cell"), "full")
    n_full = full.count()
    key = ["half", "cell"]
    if n_full:
        mark = small(full, n_full)
        crowd = cells.join(mark, key, "left_semi").select("fp", "id").union(probes.join(mark, key, "left_semi").select("fp", "id")).distinct()
        cells, probes = cells.join(mark, key, "left_anti"), probes.join(mark, key, "left_anti")
    right = cells.select("half", "cell", F.col("fp").alias("fp2"), F.col("id").alias("b"), F.col("e").alias("e2"))
    left = cells.select("half", "cell", F.lit(True).alias("same"), "fp", F.col("id").alias("a"), "e").union(probes.select("half", "cell", F.lit(False), "fp", "id", "e"))
    pairs = left.join(right, key).where("not same or fp < fp2").where(manhattan(F.col("e"), F.col("e2")) <= distance)
    found = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance).select("a", "b")
    if n_full:
        flips = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)], *([F.col("fp")] if distance > 0 else [])))
        if distance == 1:
            near = crowd.select("fp", "id", flips.alias("hub")).join(crowd.select(F.col("fp").alias("hub"), F.col("id").alias("b")), "hub").select(F.col("id").alias("a"), "b").where("a <> b")
        else:
            hubs = crowd.select("id", flips.alias("hub"))
            near = hubs.join(hubs.groupBy("hub").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1"), "hub").where("id <> b").select(F.col("id").alias("a"), "b")
        found = found.union(near)
    return found


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null text counts as empty; a text without words has fingerprint zero and is linked like any other. Copies meet in
    one class by fingerprint before any pair is made. Rows with a null doc_id get a fingerprint and, if no row with an
    id shares it, a null component. Rows that repeat a doc_id are returned each. Other columns are not looked at."""
    each = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    edges = materialize(links(classes.where("id is not null"), distance), "links")
    found = connected_components(edges)
    named = classes.join(found, classes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Documents (by hash of id) whose shingles say which are frequent, how often one must be seen there, and how many are kept:
#: these come last in the order of shingles. Any order finds every pair; this one keeps frequent shingles from the prefixes.
SAMPLE_DOCS, SEEN, FREQUENT = 10_000, 3, 200_000
#: Documents in one cell from which its documents are first tried with one of them, in up to STAR_TURNS turns, before every
#: pair still apart is tried; and rows of a cell that one task tries against as many others.
PAIRS_MAX, STAR_TURNS, BLOCK_ROWS = 32, 2, 1000
#: Least bits of a document's parity sketch: bit k is set if an odd number of its distinct shingles hash to k. Two sketches differ
#: in no more bits than there are shingles in one document alone. Longer texts have the next power of two to their
#: shingles, as a sketch that is much shorter rules nothing out. Folded to CELL_BITS it travels with the cells.
SKETCH_BITS, CELL_BITS = 1024, 128


#: What a row of the cells carries besides its cell: id, place of the cell's shingle in the order, parity sketch, shingles; and
#: what is added where every pair is tried: the three shingles before the cell's in the order, as far as there are any.
WITH, BEFORE = ("id", "i", "o", "p", "s"), ("b1", "b2", "b3")


def shingle_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text with these word hashes; fewer words make one shingle."""
    k = min(len(h), words)
    if not k:
        return h
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """A power of two of bits, at least SKETCH_BITS and as many as hashes, as words of 64."""
    bits = max(SKETCH_BITS, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    """The sketch of the same hashes with fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, bits // 64), axis=0)


def sketches_apart(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches, the longer one folded to the shorter."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    bits = 64 * min(len(x), len(y))
    return int(np.bitwise_count(folded(x, bits) ^ folded(y, bits)).sum())


def most_alone(similarity: float) -> float:
    """Shingles in one of two documents alone, as a share of the sum of their counts, at a Jaccard similarity: the bound
    that the differing bits of two parity sketches must keep."""
    return (1 - similarity) / (1 + similarity)


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of distinct shingles the first in an order that all documents share: rare ones by hash, then `frequent` ones (hashes,
    ascending, and their ranks). Of two sets alike by `similarity`, at least that share of the larger is common, so
    with all but so many less one in the prefix, the first common shingle is in the prefix of both."""
    if not len(hashes):
        return hashes
    rank = np.zeros(len(hashes), np.int64)
    if len(frequent[0]):
        at = np.searchsorted(frequent[0], hashes).clip(max=len(frequent[0]) - 1)
        rank = np.where(frequent[0][at] == hashes, frequent[1][at] + 1, 0)
    n = len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1
    return hashes[np.lexsort((hashes, rank))[: min(n, len(hashes))]]


def _hashed(texts: pa.Array, words: int, memo: WordHashes) -> Iterator[np.ndarray]:
    for t in values(texts):
        text = (t or b"").lower().split()
        yield shingle_hashes(np.fromiter(map(memo.__getitem__, text), np.uint64, len(text)), words)


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are frequent in a bounded sample, ascending, and their ranks: the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            for h in _hashed(b.column(1), words, memo):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["cell"])
        memo.clear()
        release()

    chosen = materialize(texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS), "sample")
    seen = texts.join(F.broadcast(chosen), "id", "left_semi").mapInArrow(run, "cell long").groupBy("cell").count().where(F.col("count") >= SEEN)
    top = seen.orderBy(F.desc("count"), "cell").limit(FREQUENT).toArrow()["cell"].to_numpy().view(np.uint64)
    order = np.argsort(top)
    return top[order], (len(top) - order).astype(np.int64)


def _signatures(words: int, similarity: float, frequent: Broadcast):
    """(id, sig, sketch, o, p, shingles, prefix): sig names the set of shingles; o and p are the sketch folded to CELL_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            sigs, sketches, counts, prefixes = [], [], [], []
            for s in _hashed(b.column(1), words, memo):
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketches.append(parity_sketch(s))
                counts.append(len(s))
                prefixes.append(prefix(s, frequent.value, similarity).tobytes())
            if b.num_rows:
                o, p = np.stack([folded(x, CELL_BITS) for x in sketches]).view(np.int64).T
                columns = [pa.array(sigs, pa.binary()), pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array(np.ascontiguousarray(o)), pa.array(np.ascontiguousarray(p)), pa.array(counts, pa.int32()), pa.array(prefixes, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "sig", "sketch", "o", "p", "shingles", "prefix"])
        memo.clear()
        release()

    return run


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, id, i): each shingle of a document's prefix is a cell; i: its place."""
    for b in batches:
        for lo in range(0, b.num_rows, 200):
            part = b.slice(lo, 200)
            rows = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            n = np.fromiter(map(len, rows), np.int64, len(rows))
            place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            ids = np.repeat(part.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(ids), pa.array(place)], ["cell", "id", "i"])


def _near(similarity: float) -> Column:
    """Of two rows of cells, the second's columns ending in 2: what the first common shingle and those after it can have in
    common, and their parity sketches, leave a Jaccard similarity of `similarity` possible."""
    both = F.col("s") + F.col("s2")
    after = F.least(F.col("s") - F.col("i"), F.col("s2") - F.col("i2"))
    alone = F.bit_count(F.col("o").bitwiseXOR(F.col("o2"))) + F.bit_count(F.col("p").bitwiseXOR(F.col("p2")))
    return (after >= both * (similarity / (1 + similarity)) - 1e-6) & (alone <= both * most_alone(similarity) + 1e-6)


def _stars(rows: DataFrame, similarity: float, turn: int = 0) -> DataFrame:
    """Each id with one row of its cell, another in each turn, if of another component and if they may be similar."""
    lead = rows.groupBy("cell").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.col("id").alias("at"), *WITH, "component")).alias("first"), F.count("*").alias("n")).where("n > 1")
    lead = lead.select("cell", *[F.col(f"first.{c}").alias(f"{c}2") for c in (*WITH, "component")])
    return rows.join(lead, "cell").where("component <> component2").where(_near(similarity)).select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()


def _apart(rows: DataFrame, more_than: int = 1) -> DataFrame:
    """The rows of cells that hold more than one component and more than `more_than` rows, and the rows of their cell, n."""
    n = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").where(F.col("n") > more_than)
    n = materialize(n.select("cell", "n"), "apart-cells")
    return rows.join(small(n, n.count()), "cell")


def _with_before(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """The rows with BEFORE, read from their documents' prefixes: eight bytes for each shingle, in the order."""
    ids = materialize(rows.select("id").distinct(), "apart-ids")
    prefixes = sigs.join(small(ids, ids.count()), "id", "left_semi").select("id", "prefix").dropDuplicates(["id"])
    before = [F.when(F.col("i") >= k, F.substring("prefix", (F.col("i") - k) * 8 + 1, F.lit(8))).alias(b) for k, b in enumerate(BEFORE, 1)]
    return rows.join(prefixes, "id").select(*rows.columns, *before)


def _every_pair(rows: DataFrame, similarity: float, sigs: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b) of a cell that are of different components and may be similar. Where one of the shingles BEFORE the cell's
    is among the other document's too, the pair is left to the cell of that one: both places are earlier there, so what _near
    lets pass here passes there, and the first cell that a pair shares always has it. A cell of more than BLOCK_ROWS rows is dealt into blocks by id, and each two blocks are tried by
    themselves. Rows without BEFORE get it from sigs."""
    earlier = reduce(or_, [F.coalesce(F.col(a) == F.col(f"{b}_2"), F.lit(False)) for a in BEFORE for b in BEFORE])
    apart = _apart(rows)
    if sigs is not None:
        apart = _with_before(materialize(apart, "apart"), sigs)
    counted = apart.withColumn("k", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).withColumn("r", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    left = counted.select("cell", F.col("r").alias("x"), F.explode(F.sequence("r", F.col("k") - 1)).alias("y"), "component", *WITH, *BEFORE)
    right = counted.select("cell", F.explode(F.sequence(F.lit(0), "r")).alias("x"), F.col("r").alias("y"), F.col("component").alias("component2"), *[F.col(c).alias(f"{c}_2" if c in BEFORE else f"{c}2") for c in (*WITH, *BEFORE)])
    pairs = left.join(right, ["cell", "x", "y"]).where("component <> component2 and (x < y or id < id2)").where(~earlier & _near(similarity))
    return pairs.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()


def shingles(data: bytes | None, words: int) -> set[bytes]:
    w = (data or b"").lower().split()
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def _alike(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs that may be similar by their parity sketches, and are by the exact Jaccard similarity of their shingles."""
    share = most_alone(similarity)

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = np.fromiter(map(sketches_apart, values(b.column(2)), values(b.column(3))), np.int64, b.num_rows)
                keep = apart <= b.column(4).to_numpy() * share + 1e-6
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, set[bytes]] = (None, set())
        for b in batches:
            keep = []
            for i, x, y in zip(values(b.column(1)), values(b.column(2)), values(b.column(3)), strict=True):
                if last[0] != i:
                    last = (i, shingles(y, words))
                mine, other = shingles(x, words), last[1]
                both = len(mine & other)
                union = len(mine) + len(other) - both
                keep.append(not union or both / union >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    sa, sb = (sigs.select(F.col("id").alias(k), F.col("sketch").alias(x), F.col("shingles").cast("long").alias(f"n{x}")) for k, x in (("a", "x"), ("b", "y")))
    near = materialize(pairs.join(sa, "a").join(sb, "b").select("a", "b", "x", "y", F.col("nx") + F.col("ny")).mapInArrow(by_bits, "a long, b long"), "near")
    ids = materialize(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "near-ids")
    used = texts.join(small(ids, ids.count()), "id", "left_semi")
    ta, tb = used.select(F.col("id").alias("a"), F.col("t").alias("x")), used.select(F.col("id").alias("b"), F.col("t").alias("y"))
    return near.join(ta, "a").join(tb, "b").select("a", "b", "x", "y").mapInArrow(by_text, "a long, b long")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of the documents that are in one component with another: chains of texts whose sets of word
    shingles have a Jaccard similarity of `similarity` or more; component_id is the smallest doc_id.

    Candidates are the pairs with a shingle in common in their prefixes (see prefix), among which are all pairs that are
    alike, less those whose places or parity sketches rule the similarity out. Each document is first tried with the first
    of each of its cells - the documents with one shingle in their prefix. Then, in cells of more than PAIRS_MAX documents,
    each is tried with others of its cell in turn, and at last every pair of every cell that is not yet in one component.
    A pair is joined only after its whole texts are compared. Rows with a null id take no part; a doc_id names one text
    (drop_near_duplicates tells rows apart where it may not). Texts without words are all alike. Repeated rows count once."""
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")).where("id is not null")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts, words))
    sigs = materialize(texts.mapInArrow(_signatures(words, similarity, frequent), "id long, sig binary, sketch binary, o long, p long, shingles int, prefix binary"), "signatures")
    heads = sigs.groupBy("sig").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    same = materialize(sigs.select("sig", "id").join(heads, "sig").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "same")
    rest = sigs.join(small(same.select(F.col("a").alias("id")), same.count()), "id", "left_anti").select("id", "prefix")
    cells = rest.mapInArrow(_cell_rows, "cell long, id long, i int")
    shared = cells.groupBy("cell").count().where("count > 1").select("cell")
    # only what names a row moves by cell; what its document has is added to the shared ones
    rows = materialize(cells.join(shared, "cell").join(sigs.select("id", "o", "p", F.col("shingles").alias("s")).dropDuplicates(["id"]), "id").select("cell", *WITH), "cells")
    # first each document with the first of its cells: whole groups of copies join here, at a few pairs a document
    pairs = _stars(rows.withColumn("component", F.col("id")), similarity).union(same).distinct()
    links = materialize(_alike(pairs, sigs, texts, words, similarity), "alike")

    def named() -> DataFrame:
        head = found.select(F.col("node").alias("id"), F.col("component").alias("now"))
        return rows.join(head, "id", "left").select("cell", *WITH, F.coalesce("now", "id").alias("component"))

    found = materialize(connected_components(links), "components")
    for turn in range(1, STAR_TURNS + 1):
        # then those of full cells with others, as long as this joins any
        full = materialize(_apart(named(), PAIRS_MAX).drop("n"), "full")
        more = materialize(_alike(_stars(full, similarity, turn), sigs, texts, words, similarity), "alike")
        if more.isEmpty():
            break
        links = links.union(more)
        found = materialize(connected_components(links), "components")
    # at last every pair of a cell that is still apart
    more = materialize(_alike(_every_pair(named(), similarity, sigs), sigs, texts, words, similarity), "alike")
    found = materialize(connected_components(links.union(more)), "components")
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


KEY = "__near_key"


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs and KEY, a long that tells rows apart by doc_id and text: a doc_id that stands once is its own key; small ones lead
    groups, as originals come before their copies."""
    own = F.col(id_col).cast("long")
    several = docs.select(own.alias("__id")).groupBy("__id").count().where("count > 1 or __id is null")
    several = materialize(several.select(F.col("__id").alias("__repeated")), "several")
    n = several.count()
    by_text = F.lit(False)
    keyed = docs
    if n:
        keyed = docs.join(small(several.withColumn("__several", F.lit(True)), n), own.eqNullSafe(F.col("__repeated")), "left")
        by_text = F.coalesce(F.col("__several"), F.lit(False))
    return keyed.withColumn(KEY, F.when(by_text, F.xxhash64(own, F.col(text_col).cast("string"))).otherwise(own)).drop("__repeated", "__several")


def _one_of_each(keyed: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """keyed without KEY, with one key of each component of found (doc_id: a key, component_id): that of the smallest doc_id."""
    members = found.select(F.col("doc_id").alias(KEY), "component_id")
    ids = keyed.select(KEY, F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id")).distinct().join(members, KEY)
    heads = ids.groupBy("component_id").agg(F.min_by(KEY, F.struct("id", KEY)).alias(KEY))
    return without_ids(keyed, members.join(heads, [KEY], "left_anti").select(KEY), KEY).drop(KEY)


def drop_simhash_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component of near_duplicates (SimHash fingerprints within `distance` bits): the
    one with the smallest doc_id. Null and repeated doc_ids, null and empty texts are taken as by drop_near_duplicates."""
    keyed = _with_key(docs, id_col, text_col)
    each = materialize(near_duplicates(keyed, words, distance, KEY, text_col).select("doc_id", "component_id").distinct(), "simhash-components")
    several = each.groupBy("component_id").count().where("count > 1").select("component_id")
    return _one_of_each(keyed, materialize(each.join(several, "component_id"), "simhash-members"), id_col)


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component of similar_documents: the one with the smallest doc_id.

    Rows are told apart by doc_id and text, so a doc_id may come with several texts, and a null doc_id takes part after all
    numbers. Rows that share doc_id and text stay or go together. Null texts count as empty, and texts without words are
    all alike. An empty table stays empty."""
    keyed = _with_key(docs, id_col, text_col)
    found = materialize(similar_documents(keyed, words, similarity, KEY, text_col), "near-components")
    return docs if found.isEmpty() else _one_of_each(keyed, found, id_col)
