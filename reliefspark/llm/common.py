"""Helpers that the training-data operators share: tables in the shared folder, checked broadcasts,
distributed connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, shared_dir

__all__ = ["BROADCAST_ROWS", "WHITE", "WordHashes", "connected_components", "keyed_table", "materialize", "release", "shared_dir", "small", "small_batches", "values", "without_ids"]

#: ASCII white space as one Java regular expression.
WHITE = r"[\x20\x09-\x0D]+"

#: Rows of at most two longs that may be sent to every executor (about 64 MB as a hash table).
BROADCAST_ROWS = 1_000_000


#: Bytes of rows that go to a Python worker at once, unless one row has more.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session is set to send its rows to Python workers in batches of at most BATCH_BYTES: a batch of whole
    texts may else hold 64 MB, several times over in the JVM and the worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


#: Words whose hashes a worker remembers.
MEMO_WORDS = 150_000


class WordHashes(dict):
    """64-bit XXH3 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def values(column: pa.Array, rows: int = 256) -> Iterator[Any]:
    """The values of an Arrow column, few at a time in memory."""
    for lo in range(0, len(column), rows):
        yield from column.slice(lo, rows).to_pylist()


def release() -> None:
    """Gives a Python worker's free memory back at the end of a task; workers live on to serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def keyed_table(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table in the shared folder, in buckets by key: joins and cogroups by key read it without another shuffle.

    Made for few, large rows, as each task writes a file for each bucket it has rows of. The files go when the driver's JVM
    ends, the table's name when Python does."""
    spark = df.sparkSession
    table = f"work_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)

    def forget() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            spark.sql(f"DROP TABLE IF EXISTS {table}")

    atexit.register(forget)
    return spark.table(table)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= bound else df


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key is not in ids (one column); rows with a null key stay."""
    gone = materialize(ids.select(F.col(ids.columns[0]).alias("__gone")).where("__gone is not null").distinct(), "gone")
    gone = small(gone, gone.count())
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star steps, each an aggregation and a join, until the edges stay the same;
    hubs are left to adaptive skew joins. Self-loops and repeated edges are allowed; null ends are left out."""
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    loops = both.where("a = b").select("a").distinct()
    now = materialize(both.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    nodes = None
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        if not mark[0]:
            break
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        around = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its smaller neighbours go to the smallest of these
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(first, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(moved.union(first.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
    alone = loops.join(nodes, loops["a"] == nodes["node"], "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return nodes.union(alone)
