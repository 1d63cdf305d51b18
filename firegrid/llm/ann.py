"""Approximate nearest neighbours by largest inner product: multi-index hashing of learned binary codes.

Vectors get one more coordinate that makes all norms equal, so inner product orders like angle. Codes of ``BITS`` bits are signs
after a learned rotation (principal axes, then iterative quantisation). A code is split into
``PARTS`` substrings, each with an inverted index. Codes within Hamming distance r of a query agree with it in some substring
up to r // PARTS bits (one less from the (r mod PARTS + 1)-th part on), so probing those values returns every code within r, and no others survive
the full comparison. The retrieved vectors are reranked by exact inner products of the original vectors.

The radius is fitted: it holds ``COVER`` of the true neighbours of sample queries. A block that finds fewer than
k codes widens its radius until it has k, so every query gets its k neighbours.

Fitted on at most ``SAMPLE`` vectors (smallest hashes of their ids); every vector is indexed. Recall is held against brute force in tests.

Defined cases: vectors that are null, zero, hold null or non-finite components, have a null id or another length than
the most common one (ties: the shorter) take no part. Repeated ids count once (the smallest vector). Equal scores go to the smaller id. With one valid vector there are no rows.

Scale: base vectors are dealt into ``LEAST`` blocks by hash of their id, into more once a block would pass ``BLOCK`` rows, the stated queries into
blocks as well; a task holds one pair of blocks. Equal or hot vectors so spread over all blocks. A query takes at most k rows from each block,
so blocks are as large as memory allows: fewer rows leave them, and fewer indexes are probed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.session import written

BITS, PARTS, SAMPLE, COVER, K = 64, 8, 10_000, 0.975, 20
BLOCK, LEAST, QUERIES = 1 << 16, 8, 4096
WIDTH = BITS // PARTS
#: All substring values by their number of one bits: flipping by these visits neighbours in order of distance.
_FLIPS = np.array(sorted(range(1 << WIDTH), key=lambda x: (x.bit_count(), x)), dtype=np.int64)
_BALL = np.searchsorted(np.array([int(x).bit_count() for x in _FLIPS]), np.arange(WIDTH + 1), side="right")


class Codes:
    """The learned map from vectors to codes, and the fitted radius."""

    def __init__(self, sample: np.ndarray, norm: float, k: int, seed: int = 3, steps: int = 25):
        self.norm = norm
        x = self._lift(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        self.axes = axes[:, ::-1][:, :BITS]
        y = self._padded(x @ self.axes)
        rng = np.random.default_rng(seed)
        r = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
            r = (u @ v).T
        self.rotation = r
        self.radius = BITS
        self._fit_radius(sample, k)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    @staticmethod
    def _padded(y: np.ndarray) -> np.ndarray:
        return np.pad(y, ((0, 0), (0, BITS - y.shape[1])))

    def _sign(self, lifted: np.ndarray) -> np.ndarray:
        return np.packbits(self._padded((lifted - self.mean) @ self.axes) @ self.rotation > 0, axis=1)

    def base(self, x: np.ndarray) -> np.ndarray:
        """(rows, BITS // 8) bytes."""
        return self._sign(self._lift(x))

    def query(self, q: np.ndarray) -> np.ndarray:
        """Queries only matter by direction, so they are scaled to the common norm."""
        q = q * (self.norm / np.sqrt((q * q).sum(axis=1)))[:, None]
        return self._sign(np.concatenate([q, np.zeros((len(q), 1))], axis=1))

    def _fit_radius(self, sample: np.ndarray, k: int) -> None:
        q = sample[:min(400, len(sample))]
        near = min(k, len(sample) - 1)
        if near < 1:
            return
        scores = q @ sample.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        top = np.argpartition(-scores, near - 1, axis=1)[:, :near]
        a, b = self.query(q), self.base(sample)
        far = np.bitwise_count(a[:, None, :] ^ b[top]).sum(axis=2)
        self.radius = int(np.quantile(far, COVER, method="higher"))


class Index:
    """Inverted indexes of the substrings of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes).view(np.uint64).reshape(-1)
        self.order = [np.argsort(codes[:, p], kind="stable") for p in range(PARTS)]
        self.first = [np.searchsorted(codes[:, p][o], np.arange((1 << WIDTH) + 1)) for p, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within ``radius``, by the pigeonhole principle."""
        found = np.zeros(len(self.codes), bool)
        each, more = divmod(radius, PARTS)
        for p in range(PARTS):
            reach = min(each if p <= more else each - 1, WIDTH)
            if reach < 0:
                continue
            values = int(code[p]) ^ _FLIPS[:_BALL[reach]]
            a, n = self.first[p][values], self.first[p][values + 1] - self.first[p][values]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found[self.order[p][at]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code.view(np.uint64)[0]) <= radius]


def search_block(codes: Codes, base_ids, base, query_ids, queries, k: int):
    """(query id, id, score) of up to k nearest of one block for each query."""
    index, coded = Index(codes.base(base)), codes.query(queries)
    for q, (qid, vec) in enumerate(zip(query_ids, queries)):
        radius, want = codes.radius, min(k, len(base_ids) - int(np.count_nonzero(base_ids == qid)))
        while True:
            rows = index.within(coded[q], radius)
            rows = rows[base_ids[rows] != qid]
            if len(rows) >= want or radius >= BITS:
                break
            radius = min(BITS, radius + PARTS)
        scores = (base[rows] * vec).sum(axis=1)
        top = np.lexsort((base_ids[rows], -scores))[:k]
        yield qid, base_ids[rows][top], scores[top]


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = written(_usable(vectors), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"),
                                                      F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))
    best = sizes.orderBy(F.desc("n"), "d").first()
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == best["d"])
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    codes = Codes(np.stack(picked["v"].to_numpy()).astype(float), float(best["norm"]), k)
    shared = spark.sparkContext.broadcast(codes)
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(LEAST, -(-best["n"] // BLOCK))
    lots = max(1, -(-queries.count() // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    base = rows.select(deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(lots).alias("lot"), "vec_id", "v")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            for qid, ids, scores in search_block(shared.value, left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()),
                                                 right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()), k):
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                                                        "score": pd.Series(dtype="float64")})

    found = base.groupBy("block", "lot").cogroup(asked.groupBy("block", "lot")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
