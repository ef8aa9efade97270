"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Each of several tables cuts the space by Gaussian (2-stable) projections into slots; a bucket is one slot per projection.
A query visits its own and perturbed buckets in the order of their estimated success - how likely a neighbour is there
against how full the bucket should be - until the chance of a neighbour in the buckets visited reaches a target.
Candidates of all tables are merged and ranked by exact scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small

#: Tables, projections of each, width of a slot in standard deviations of a projection.
TABLES, PROJECTIONS, WIDTH = 6, 6, 1.5
#: Chance of a neighbour in the buckets that one table's probes visit.
SUCCESS = 0.4
#: Most vectors, and most queries, that one task compares with each other.
BLOCK_ROWS, ASK_ROWS = 8_192, 4_096
#: Vectors (by hash of vec_id) from which spread and likeness of neighbours are estimated.
SAMPLE_ROWS = 4_000
#: Pairs of a query and an area whose finds are merged by one task.
LOT_ROWS = 10_000
#: Queries scored against a block at once.
CHUNK = 64


_erf = np.frompyfunc(math.erf, 1, 1)


def _phi(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(z / math.sqrt(2)).astype(float))


@dataclass
class ProbeIndex:
    """Slots are counted from `low` and end at `slots`; what lies beyond goes to the outermost."""

    a: np.ndarray  # (tables, dim, projections)
    shift: np.ndarray  # (tables, projections)
    width: float
    sigma: float  # of a projection of any vector
    beta: float  # a neighbour's projection is beta times the query's
    rest: float  # and spreads by this much
    slots: int

    @classmethod
    def fit(cls, sample: np.ndarray, near: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 5) -> ProbeIndex:
        """sample: vectors, of which up to 200 are taken as queries. Neighbours of a sample are farther than those among
        all rows, so the estimate of success errs to more probes."""
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        a, shift = rng.normal(size=(tables, dim, projections)), rng.random((tables, projections))
        norm2 = (sample**2).sum(axis=1)
        sigma = math.sqrt(float(norm2.mean())) or 1.0
        q = sample[:200]
        scores = q @ sample.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(near, len(sample) - 1)
        beta, rest = 0.0, sigma
        if k > 0:
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            dots = np.take_along_axis(scores, top, axis=1)
            beta = float(np.median(dots) / np.median(norm2[: len(q)]))
            beta = min(max(beta, 0.0), 0.98)
            rest = math.sqrt(max(float(norm2[top].mean()) - beta**2 * float(norm2[: len(q)].mean()), (0.05 * sigma) ** 2))
        slots = 2 * math.ceil(2.5 / width) + 1
        return cls(a, shift, width * sigma, sigma, beta, rest, slots)

    def _slot(self, x: np.ndarray, t: int) -> np.ndarray:
        at = np.floor(x @ self.a[t] / self.width + self.shift[t]).astype(np.int64) + self.slots // 2
        return np.clip(at, 0, self.slots - 1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector in each table."""
        powers = self.slots ** np.arange(self.a.shape[2])
        return np.stack([(self._slot(x, t) * powers).sum(axis=1) for t in range(len(self.a))], axis=1)

    def slot_gains(self, q: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots, projections): log chance that a neighbour of q is in a slot of table t, and that less the log share of all
        vectors there."""
        edge = (np.arange(self.slots + 1) - self.slots // 2)[:, None] - self.shift[t][None, :]
        edge = edge * self.width
        edge[0], edge[-1] = -np.inf, np.inf
        here = np.log(np.diff(_phi((edge - self.beta * (q @ self.a[t])) / self.rest), axis=0) + 1e-12)
        return here, here - np.log(np.diff(_phi(edge / self.sigma), axis=0) + 1e-12)

    def stop(self, here: np.ndarray, gains: np.ndarray, success: float) -> float:
        """Of all buckets of a table in order of estimated success: the gain of the last that is visited."""
        chance, gain = np.zeros(1), np.zeros(1)
        for j in range(here.shape[1]):
            chance = (chance[:, None] + here[None, :, j]).reshape(-1)
            gain = (gain[:, None] + gains[None, :, j]).reshape(-1)
        order = np.argsort(-gain, kind="stable")
        reached = np.cumsum(np.exp(chance[order]))
        return float(gain[order[min(len(order) - 1, int(np.searchsorted(reached, success)))]])

    def digits(self, buckets: np.ndarray, n: int) -> np.ndarray:
        """(buckets, n): slots of the first n projections."""
        return np.stack([buckets // self.slots**j % self.slots for j in range(n)], axis=1) if n else np.zeros((len(buckets), 0), np.int64)

    def areas(self, gains: np.ndarray, last: float, lead: int) -> np.ndarray:
        """Numbers of the areas - buckets with the same slots in the first `lead` projections - that hold a bucket to visit."""
        best = np.zeros(1)
        for j in range(lead):
            best = (best[None, :] + gains[:, j, None]).reshape(-1)
        return np.flatnonzero(best + gains[:, lead:].max(axis=0).sum() >= last - 1e-9)

    def visits(self, gains: np.ndarray, last: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """(queries, buckets): whether each query visits each bucket. gains: (queries, slots, projections)."""
        total = np.zeros((len(gains), len(buckets)))
        for j, d in enumerate(self.digits(buckets, self.a.shape[2]).T):
            total += gains[:, d, j]
        return total >= last[:, None] - 1e-9


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Vectors that take part, shorter ones filled up with zeros, which change no inner product."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    v = v.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)")
    sizes = v.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        v = v.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(sizes["most"]) - F.size("v"))))
    return v.distinct()


def _search(index: ProbeIndex | None, near: int):
    """For a cogroup of vectors (bucket, v, members) and queries (qid, v, gains, last), both of one area of one table: a row for each
    query with the nearest in the buckets that it visits; without an index in all."""

    def run(base: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, list[int], list[float]]] = []
        if len(base) and len(asks):
            names, which = np.unique(base["bucket"].to_numpy(), return_inverse=True)
            v, members = np.stack(base["v"].to_numpy()), base["members"].tolist()
            # queries with the same best bucket visit much the same: they are looked at together
            asks = asks.sort_values(["home", "qid"], kind="stable")
            for lo in range(0, len(asks), CHUNK):
                part = asks.iloc[lo : lo + CHUNK]
                q = np.stack(part["v"].to_numpy())
                if index is None:
                    visits = np.ones((len(q), len(names)), bool)
                else:
                    visits = index.visits(np.stack(part["gains"].to_numpy()).reshape(len(part), index.slots, -1), part["last"].to_numpy(), names)
                some = np.flatnonzero(visits.any(axis=0)[which])
                if not len(some):
                    continue
                scores = q @ v[some].T
                scores[~visits[:, which[some]]] = -np.inf
                k = min(near, len(some))
                floor = np.partition(scores, len(some) - k, axis=1)[:, len(some) - k]
                for r, qid in enumerate(part["qid"].tolist()):
                    got = np.flatnonzero((scores[r] >= floor[r]) & (scores[r] > -np.inf))
                    flat = sorted((-s, int(m)) for s, g in zip(scores[r, got].tolist(), some[got].tolist(), strict=True) for m in members[g])[:near]
                    if flat:
                        out.append((qid, [m for _, m in flat], [-s for s, _ in flat]))
        return pd.DataFrame(out, columns=["qid", "ids", "scores"])

    return run


def _merged(near: int):
    """For rows (qid, ids, scores), all of a query in one group: the nearest of each query, each vector once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["ids"].map(len).to_numpy()
        qid, ids, scores = np.repeat(rows["qid"].to_numpy(), n), np.concatenate(rows["ids"].to_numpy()), np.concatenate(rows["scores"].to_numpy())
        order = np.lexsort((-scores, ids, qid))
        qid, ids, scores = qid[order], ids[order], scores[order]
        once = np.append(True, (qid[1:] != qid[:-1]) | (ids[1:] != ids[:-1]))
        qid, ids, scores = qid[once], ids[once], scores[once]
        order = np.lexsort((ids, -scores, qid))
        qid, ids, scores = qid[order], ids[order], scores[order]
        head = np.append(True, qid[1:] != qid[:-1])
        place = np.arange(len(qid)) - np.maximum.accumulate(np.where(head, np.arange(len(qid)), 0))
        return pd.DataFrame({"qid": qid, "vec_id": ids, "score": scores})[place < near]

    return run


def _met(base: DataFrame, asks: DataFrame, key: list[str], index: ProbeIndex | None, near: int) -> DataFrame:
    """(qid, vec_id, score): the nearest of each query among the vectors with the same key. Keys with many of either are dealt into
    parts by id, and each part of the one meets each part of the other, so no task holds more than about BLOCK_ROWS and
    ASK_ROWS. What a query found in each travels as one row, and is merged in lots of queries."""
    counts = base.groupBy(*key).agg(F.count("*").alias("n")).join(asks.groupBy(*key).agg(F.count("*").alias("m")), key)
    parts = materialize(counts.select(*key, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("rows"), F.ceil(F.col("m") / ASK_ROWS).cast("int").alias("lots")), "areas")
    mark = small(parts, parts.count(), 200_000)
    left = base.join(mark, key).withColumn("x", F.pmod(F.xxhash64("id"), F.col("rows"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).drop("rows", "lots")
    right = asks.join(mark, key).withColumn("y", F.pmod(F.xxhash64("qid"), F.col("lots"))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).drop("rows", "lots")
    cell = [*key, "x", "y"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_search(index, near), "qid long, ids array<long>, scores array<double>")
    lots = max(1, math.ceil(asks.count() / LOT_ROWS))
    return found.groupBy(F.pmod(F.xxhash64("qid"), F.lit(lots)).alias("lot")).applyInPandas(_merged(near), "qid long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", success: float = SUCCESS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest found by inner product.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id; a vector
    shorter than others counts as filled up with zeros. Rows repeated whole count once; a query is never its own candidate.
    Equal vectors are searched once: a class keeps its k + 1 smallest ids, which is all that a list of k can hold. Ties go to
    the smaller id. Buckets are dealt by areas: a query goes to the areas that hold a bucket it visits, and to no others. A
    query whose probes found fewer than k (or than all) is searched in every bucket. An empty table gives no rows."""
    near = k + 1
    v = materialize(_valid(vectors, id_col, vec_col), "vectors")
    n = v.count()
    if not n:
        return v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    first = Window.partitionBy("v").orderBy("vec_id")
    least = v.withColumn("r", F.row_number().over(first)).where(F.col("r") <= near)
    classes = materialize(least.groupBy("v").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("members")), "classes")
    asked = v.where(F.col("vec_id") % every == 0).join(classes.select("v", F.col("id").alias("qid")), "v").select(F.col("vec_id").alias("query_id"), "qid")
    asked = materialize(asked, "asked")
    n_classes = classes.count()
    sample = np.array([r["v"] for r in classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").collect()])
    index = ProbeIndex.fit(sample, k)
    # areas of about BLOCK_ROWS vectors
    lead = min(index.a.shape[2], max(0, math.ceil(math.log(max(1, n_classes / BLOCK_ROWS), index.slots))))
    areas = index.slots**lead

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            got = index.buckets(np.stack(b["v"].to_numpy()))
            for t in range(TABLES):
                yield pd.DataFrame({"table": t, "area": got[:, t] % areas, "bucket": got[:, t], "id": b["id"], "v": b["v"], "members": b["members"]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for qid, x in zip(b["qid"].tolist(), b["v"], strict=True):
                for t in range(TABLES):
                    here, gains = index.slot_gains(np.asarray(x), t)
                    last = index.stop(here, gains, success)
                    home = int((gains.argmax(axis=0) * index.slots ** np.arange(gains.shape[1])).sum())
                    rows += [(t, a, qid, x, gains.reshape(-1), last, home) for a in index.areas(gains, last, lead).tolist()]
            if rows:
                yield pd.DataFrame(rows, columns=["table", "area", "qid", "v", "gains", "last", "home"])

    placed = classes.mapInPandas(place, "table int, area long, bucket long, id long, v array<double>, members array<long>")
    queries = asked.select("qid").distinct().join(classes.select(F.col("id").alias("qid"), "v"), "qid")
    asks = materialize(queries.mapInPandas(probe, "table int, area long, qid long, v array<double>, gains array<double>, last double, home long"), "asks")
    found = _met(placed, asks, ["table", "area"], index, near)
    top = materialize(found, "top")
    full = min(near, n)
    short = materialize(queries.join(top.groupBy("qid").count().where(F.col("count") >= full), "qid", "left_anti"), "short")
    if not short.isEmpty():
        whole = classes.select(F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket"), "id", "v", "members")
        more = _met(whole, short.select(F.lit(0).alias("table"), "qid", "v", F.lit(0).alias("home")), ["table"], None, near)
        top = top.join(short.select("qid"), "qid", "left_anti").unionByName(more)
    answers = asked.join(top, "qid").where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
