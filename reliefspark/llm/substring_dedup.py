"""Substring dedup: content-defined chunks by a gear rolling hash. A window is a run of whole chunks with a least number of
words; windows are compared by digest, and chunks in windows that stood as one piece in an earlier text are cut out.

Documents travel in blocks of whole rows. A block sends its distinct digests with the smallest doc_id that has them to the
part of the digest table that owns them, and gets back those that a smaller doc_id of another block has; so a passage
that a third of all documents share is one entry per block, and texts move once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import keyed_table, release, small_batches
from .packed import pack_ints, pack_sorted, slices, unpack_ints, unpack_sorted

#: Mean words of a chunk within a line.
MEAN_WORDS = 3
#: Most words of a chunk: longer ones are cut again, counted from where they begin.
MAX_WORDS = 8
#: Least words of a window. A passage of 50 words loses the three words or so that the rolling hash looks back on, and the
#: chunks it begins and ends in, so this must stay well below 50.
MIN_WORDS = 24
#: Bytes without white space after which a chunk may also end within a word; half as many count as a word.
LONG_WORD = 64
#: Bytes of text in a block, unless one row has more.
BLOCK_BYTES = 4 << 20
#: Digests that one part of the digest table takes on average.
PART_ENTRIES = 1_000_000
#: Rows without a doc_id count as one document after all others.
LAST = np.iinfo(np.int64).max


def _gear() -> np.ndarray:
    """256 pseudo-random 16-bit numbers: the top of XXH64 of each byte, seed 0."""
    return np.array([xxhash.xxh64_intdigest(bytes([i]), 0) >> 48 for i in range(256)], np.uint16)


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[byte i] modulo 2**16 at every byte, so h[i] depends on the last 16 bytes only.

    By doubling: sums over windows of 1, 2, 4, 8 and 16 bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            more = h[:-k] << np.uint16(k)
            h = h.copy()
            h[k:] += more
    return h


def chunk_ends(data: bytes, mean_words: int = MEAN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) of the chunks of UTF-8 bytes, and words that begin before each end.

    A chunk ends after white space where the gear hash is below 2**16 / mean_words, after every line feed, and within a
    word of over LONG_WORD bytes where its top 8 bits are zero; never inside a character. What then has over MAX_WORDS words
    is cut after each MAX_WORDS of them."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = (a == 32) | ((a >= 9) & (a <= 13))
    begins = np.append(False, white[:-1]) & ~white
    begins[0] = not white[0]
    h = gear_hash(a)
    stop = begins[1:] & ((h[:-1] < np.uint16((1 << 16) // mean_words - 1)) | (a[:-1] == 10))
    word = np.flatnonzero(begins)
    if len(word):
        head = np.append(True, stop[word[1:] - 1])
        run = np.arange(len(word)) - np.maximum.accumulate(np.where(head, np.arange(len(word)), 0))
        stop[word[(run > 0) & (run % MAX_WORDS == 0)] - 1] = True
    edges = np.flatnonzero(white)
    if np.diff(edges, prepend=-1, append=len(a)).max() > LONG_WORD:
        last = np.maximum.accumulate(np.where(white, np.arange(len(a)), -1))
        far = (np.arange(len(a)) - last > LONG_WORD)[:-1]
        stop |= far & (h[:-1] < np.uint16(1 << 8)) & ((a[1:] & 0xC0) != 0x80)
    ends = np.append(np.flatnonzero(stop) + 1, len(a))
    return ends, np.cumsum(begins)[ends - 1]


def digests(data: bytes, ends: np.ndarray) -> np.ndarray:
    """64-bit XXH3 of each chunk without the white space at its end."""
    digest = xxhash.xxh3_64_intdigest
    starts = [0, *ends[:-1].tolist()]
    return np.array([digest(data[s:e].rstrip()) for s, e in zip(starts, ends.tolist(), strict=True)], np.uint64)


#: Odd, so that every power has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of BASE modulo 2**64 and their inverses."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def windows(keys: np.ndarray, units: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the chunks of one text, with their digests and words: first and end chunk of each window - from each chunk on the
    fewest chunks with `least` words together, and the fewest that end the text - and its digest, which is of the sequence of the chunks' digests alone."""
    total = np.append(0, np.cumsum(units))
    end = np.searchsorted(total, total[:-1] + least)
    begin = np.flatnonzero(end < len(total))
    if not len(begin):
        return begin, begin, np.zeros(0, np.uint64)
    end = end[begin]
    tail = np.searchsorted(total, total[-1] - least, side="right") - 1  # the shortest window that ends the text
    if end[tail] < len(keys):
        begin, end = np.append(begin, tail), np.append(end, len(keys))
    power, inverse = _powers(len(keys))
    sums = np.append(np.uint64(0), np.cumsum(keys * power, dtype=np.uint64))
    h = (sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return begin, end, h ^ (h >> np.uint64(31))


def _read(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _texts(table: pa.Table, text_col: str) -> list[bytes]:
    return [x or b"" for x in table.column(text_col).cast(pa.binary()).to_pylist()]


def _ids(table: pa.Table, id_col: str) -> np.ndarray:
    return np.array([LAST if x is None else int(x) for x in table.column(id_col).to_pylist()], np.int64)


class _Chunks:
    """The chunks of a block's texts and their windows, and the distinct digests of these with the smallest doc_id of each."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, mean_words: int, min_words: int):
        self.texts, self.ids = _texts(table, text_col), _ids(table, id_col)
        ends, words, begin, end, keys = [], [], [], [], []
        at = 0
        for t in self.texts:
            e, w = chunk_ends(t, mean_words)
            w = np.diff(w, prepend=0)
            ends.append(e)
            words.append(w)
            long = np.diff(e, prepend=0) // (LONG_WORD // 2)
            if np.maximum(w, long).sum() < min_words:
                x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            else:
                x = windows(digests(t, e), np.maximum(w, long), min_words)
            for held, new in zip((begin, end, keys), (x[0] + at, x[1] + at, x[2]), strict=True):
                held.append(new)
            at += len(e)
        none = np.zeros(0, np.int64)
        self.sizes = np.fromiter(map(len, ends), np.int64, len(ends))
        self.ends, self.words = np.concatenate([*ends, none]), np.concatenate([*words, none])
        self.begin, self.end = np.concatenate([*begin, none]), np.concatenate([*end, none])  # chunks of each window, in the block
        self.doc = np.repeat(np.arange(len(keys)), np.fromiter(map(len, keys), np.int64, len(keys)))  # of each window
        self.keys, self.which = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_inverse=True)
        self.first = np.full(len(self.keys), LAST)
        np.minimum.at(self.first, self.which, self.ids[self.doc])


def _spans(c: _Chunks) -> list[list[tuple[int, int, int, int]]]:
    """(start, end, words, first_doc_id) of the repeated runs of each text; ends and starts in bytes."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in c.texts]
    if not len(c.keys):
        return out
    first = c.first[c.which]
    again = first < c.ids[c.doc]
    # a window of which this document is the first holder is repeated where it stands again after its first place here
    own = np.flatnonzero(~again)
    if len(own):
        _, place, pair = np.unique(c.doc[own] * len(c.keys) + c.which[own], return_index=True, return_inverse=True)
        again[own] = c.begin[own] >= c.end[own[place]][pair]
    n = len(c.ends)
    hit = np.flatnonzero(again)
    if not len(hit):
        return out
    steps = np.bincount(c.begin[hit], minlength=n + 1) - np.bincount(c.end[hit], minlength=n + 1)
    cut = np.cumsum(steps)[:n] > 0  # chunks in a repeated window
    of = np.repeat(np.arange(len(c.texts)), c.sizes)
    edge = cut & np.append(True, ~cut[:-1] | (of[1:] != of[:-1]))
    starts = np.append(0, c.ends[:-1])
    heads = np.cumsum(c.sizes) - c.sizes
    starts[heads[c.sizes > 0]] = 0
    run = np.cumsum(edge) - 1
    least = np.full(run[-1] + 1, LAST)
    np.minimum.at(least, run[c.begin[hit]], first[hit])
    at = np.flatnonzero(cut)
    begin = np.flatnonzero(np.append(True, run[at][1:] != run[at][:-1]))
    words = np.add.reduceat(c.words[at], begin)
    last = np.append(begin[1:], len(at)) - 1
    for k in range(len(begin)):
        a, e = at[begin[k]], at[last[k]]
        out[of[a]].append((int(starts[a]), int(c.ends[e]), int(words[k]), int(least[k])))
    return out


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, mean_words: int = MEAN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, text without its repeated spans, and these as column repeated_spans: byte ranges of the text as it
    was. A span is whole chunks, each in a window of min_words words or more that stands as one piece in a text of a smaller
    doc_id, or earlier in the same text; first_doc_id is the smallest doc_id of its windows. White space at the end of a
    chunk makes no difference. Windows are told apart by 64-bit digests.

    Of equal passages the smallest doc_id keeps its own. Rows that repeat a doc_id count as one document and are cut
    alike. Rows with a null doc_id count as one document after all others; first_doc_id is null for it. Null and empty
    texts stay as they are, with no spans. A column repeated_spans of docs is replaced. Other columns are carried along.
    An empty table stays empty."""
    docs = small_batches(docs).drop("repeated_spans")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([size])], ["block", "rows", "size"])

        for b in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(b.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
            lo, own = 0, 0
            for r, n in enumerate(lengths.tolist()):
                if size + own and size + own + n > BLOCK_BYTES:
                    if r > lo:
                        held.append(b.slice(lo, r - lo))
                    size += own
                    yield out()
                    held, size, k, lo, own = [], 0, k + 1, r, 0
                own += n
            if b.num_rows > lo:
                held.append(b.slice(lo))
                size += own
        if held:
            yield out()

    stored = keyed_table(docs.mapInArrow(blocks, "block long, rows binary, size long"), "block", "text-blocks")
    size = stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    lead = min(48, max(1, math.ceil(math.log2(max(2, size / (6 * mean_words) / PART_ENTRIES)))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = _Chunks(_read(rows), id_col, text_col, mean_words, min_words)
                cuts = slices(c.keys, 64, lead)
                columns = [pa.array([block] * len(cuts), pa.int64()), pa.array([p for p, _, _ in cuts], pa.int64()), pa.array([pack_sorted(c.keys[a:e]) for _, a, e in cuts], pa.binary()), pa.array([pack_ints(c.first[a:e]) for _, a, e in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "part", "keys", "docs"])
        release()

    def answer(table: pa.Table) -> pa.Table:
        """For each block those of its digests that a smaller doc_id has elsewhere."""
        keys, first = [unpack_sorted(x) for x in table["keys"].to_pylist()], [unpack_ints(x) for x in table["docs"].to_pylist()]
        every, least = np.concatenate(keys), np.concatenate(first)
        order = np.argsort(every, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(every[order]) != 0))
        group = np.empty(len(every), np.int64)
        group[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(every))))
        lowest = np.minimum.reduceat(least[order], new)[group]
        rows, at = [], 0
        for block, k, f in zip(table["block"].to_pylist(), keys, first, strict=True):
            low = lowest[at : at + len(k)]
            at += len(k)
            less = np.flatnonzero(low < f)
            if len(less):
                rows.append((block, pack_sorted(less), pack_ints(low[less])))
        part = pa.array([table["part"][0].as_py()] * len(rows), pa.int64())
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), part, pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["block", "part", "places", "docs"])

    span = StructType([StructField(n, LongType()) for n in ("start", "end", "words", "first_doc_id")])
    schema = StructType([*docs.schema.fields, StructField("repeated_spans", ArrayType(span))])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in span.names]))

    def cut(mine: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for rows in mine["rows"]:
            table = _read(rows.as_py())
            c = _Chunks(table, id_col, text_col, mean_words, min_words)
            begin = {p: a for p, a, _ in slices(c.keys, 64, lead)}
            for p, k, d in zip(replies["part"].to_pylist(), replies["places"].to_pylist(), replies["docs"].to_pylist(), strict=True):
                c.first[begin[p] + unpack_sorted(k).astype(np.int64)] = unpack_ints(d)
            spans = _spans(c)
            texts = []
            for old, t, ranges in zip(table.column(text_col).to_pylist(), c.texts, spans, strict=True):
                if not ranges:
                    texts.append(old)
                    continue
                edges = [0, *(x for r in ranges for x in r[:2]), len(t)]
                texts.append(b"".join(t[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True)).decode())
            names = table.column_names
            table = table.set_column(names.index(text_col), names[names.index(text_col)], pa.array(texts, pa.string()))
            found = [[dict(zip(span.names, (*r[:3], None if r[3] == LAST else r[3]), strict=True)) for r in s] or None for s in spans]
            out.append(table.append_column("repeated_spans", pa.array(found, kind)))
            del c
        release()
        return pa.concat_tables(out)

    asked = stored.select("block", "rows").mapInArrow(ask, "block long, part long, keys binary, docs binary")
    replies = asked.groupBy("part").applyInArrow(answer, "block long, part long, places binary, docs binary")
    return stored.select("block", "rows").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(cut, schema)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, mean_words: int = MEAN_WORDS) -> DataFrame:
    """(doc_id, start, end, words, first_doc_id) of every span that substring_dedup cuts out."""
    return substring_dedup(docs, min_words, mean_words).select("doc_id", F.inline("repeated_spans"))
