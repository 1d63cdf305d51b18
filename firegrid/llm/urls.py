"""URL filter: host and path rules, and a character language-model ratio for what no rule decides.

Two smoothed variable-order Markov models (accepted and rejected URLs, Witten-Bell mixing over contexts
of 0 to ``ORDER`` bytes) give each URL a log-likelihood difference per byte. A logistic curve
fitted on a fold of rule-decided URLs, which the models did not see, turns it into P(block).

A context of two bytes or more is used only if seen ``MIN_CONTEXT`` times: that is what makes the order
variable. Counts are exact per 64-bit context hash; for broadcasting they are folded into ``SLOTS`` slots an order, so
a model has a fixed size.

Defined cases: null urls and urls without ``://`` have empty host and path and fit no rule; the models then
judge their bytes (none: the models' prior, the share of blocked URLs). If rules accept (or reject) nothing, every
other URL gets the verdict of the class that exists, without both ``allow``. Repeated URLs count as often as they occur.

Scale: rules are column expressions; counting is pre-aggregated per task, and no step groups by host.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import ascii_lower, cut, groups, mix, records_per_batch

#: (verdict, host, path), fixed by the contract of the query.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
ORDER, SLOTS, MIN_CONTEXT = 4, 1 << 17, 2
PIECE = 1 << 18
START = 256


def host_path(url: str = "url") -> tuple[Column, Column]:
    c = F.coalesce(F.col(url), F.lit(""))
    return (ascii_lower(F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1)),
            F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def contexts(urls: list[bytes]):
    """owner of each byte, its symbol, and for each order the hash of the bytes before it."""
    owner, syms, fresh = [], [], []
    for i, piece, first, _ in cut(urls, PIECE, ORDER):
        lead = np.full(ORDER, START, np.uint64) if first else np.empty(0, np.uint64)
        syms.append(np.concatenate([lead, np.frombuffer(piece, np.uint8).astype(np.uint64)]))
        owner.append(np.full(len(syms[-1]), i))
        fresh.append(np.arange(len(syms[-1])) >= ORDER)
    sym, owner, fresh = np.concatenate(syms), np.concatenate(owner), np.concatenate(fresh)
    at = np.flatnonzero(fresh)
    hashes, h = [], np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        hashes.append(mix(h + np.uint64(k + 1)))
        if k < ORDER:
            h = mix(h ^ (sym[at - k - 1] + np.uint64(1)))
    return owner[at], sym[at], hashes


def _slot(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return (mix(context + np.uint64(0x9E3779B97F4A7C15) * symbol) % np.uint64(SLOTS)).astype(np.int64)


def _count(batches):
    """(model, order, context, symbol) counts of a task's labelled URLs."""
    found = {}

    def merged(lists):
        rows = np.concatenate([r for r, _ in lists])
        uniq, where = np.unique(rows, return_inverse=True)
        return uniq, np.bincount(where.reshape(-1), weights=np.concatenate([n for _, n in lists])).astype(np.int64)

    kind = np.dtype([("context", np.uint64), ("symbol", np.uint64)])
    for b in batches:
        blocked = np.array(b.column("blocked").to_pylist(), bool)
        urls = [u.encode("utf-8", "surrogatepass") for u in b.column("url").to_pylist()]
        for a, z in groups([len(u) for u in urls], PIECE):
            owner, sym, hashes = contexts(urls[a:z])
            for c in (False, True):
                mine = blocked[a:z][owner] == c
                for k in range(ORDER + 1):
                    rows = np.empty(int(mine.sum()), kind)
                    rows["context"], rows["symbol"] = hashes[k][mine], sym[mine]
                    lists = found.setdefault((c, k), [])
                    uniq, n = np.unique(rows, return_counts=True)
                    lists.append((uniq, n))
                    if len(lists) > 16:
                        found[c, k] = [merged(lists)]
    for (c, k), lists in found.items():
        rows, n = merged(lists)
        for i in range(0, len(rows), 50_000):
            r = rows[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(r)), pa.array([k] * len(r), pa.int32()), pa.array(r["context"].astype(np.uint64).view(np.int64)),
                 pa.array(r["symbol"].astype(np.int32)), pa.array(n[i:i + 50_000])], names=["blocked", "k", "context", "symbol", "n"])


def _slotted(table: DataFrame, what: str) -> np.ndarray:
    """Sum of ``what`` by (model, order, slot) as an array; at most 2 * (ORDER + 1) * SLOTS numbers."""
    def slots(batches):
        for b in batches:
            context = b.column("context").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            symbol = b.column("symbol").to_numpy(zero_copy_only=False).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("blocked"), b.column("k"), pa.array(_slot(context, symbol)), b.column("n")],
                                             names=["blocked", "k", "slot", "n"])
    got = table.select("blocked", "k", "context", "symbol", F.col(what).cast("long").alias("n")).mapInArrow(
        slots, "blocked boolean, k int, slot long, n long").groupBy("blocked", "k", "slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, ORDER + 1, SLOTS), np.float32)
    out[got["blocked"].to_numpy().astype(int), got["k"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


class Ratio:
    def __init__(self, seen, total, kinds, scale: float = 1.0, offset: float = 0.0):
        self.seen, self.total, self.kinds, self.scale, self.offset = seen, total, kinds, scale, offset

    def difference(self, urls: list[bytes]) -> np.ndarray:
        """Mean log-likelihood per byte under the rejected model less that under the accepted one."""
        out = np.zeros(len(urls))
        for a, z in groups([len(u) for u in urls], PIECE):
            owner, sym, hashes = contexts(urls[a:z])
            log = []
            for c in (0, 1):
                p = np.full(len(sym), 1 / 257)
                for k in range(ORDER + 1):
                    n, t = (x[c, k][_slot(hashes[k], np.zeros(1, np.uint64))] for x in (self.total, self.kinds))
                    use = n > 0
                    hit = np.minimum(self.seen[c, k][_slot(hashes[k], sym + np.uint64(1))], n)
                    p = np.where(use, (hit + t * p) / np.where(use, n + t, 1), p)
                log.append(np.log(np.maximum(p, 1e-12)))
            sums = np.bincount(owner, weights=log[1] - log[0], minlength=z - a)
            out[a:z] = sums / np.maximum([len(u) for u in urls[a:z]], 1)
        return out

    def blocked(self, urls: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.difference(urls) + self.offset, -50, 50)))


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic curve through the weighted points of a histogram, by Newton steps with a small ridge."""
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([(w * (y - p) * x).sum() - 1e-3 * a, (w * (y - p)).sum() - 1e-3 * b])
        v = w * p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(labelled: DataFrame) -> Ratio | None:
    """Fit on (url, blocked): models on four fifths of the distinct URLs, the curve on the rest."""
    fold = F.crc32(F.col("url")) % 5
    counts = labelled.where(fold != 0).mapInArrow(_count, "blocked boolean, k int, context long, symbol int, n long").groupBy(
        "blocked", "k", "context", "symbol").agg(F.sum("n").alias("n"))
    by_context = counts.groupBy("blocked", "k", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where(
        f"k < 2 OR total >= {MIN_CONTEXT}").withColumn("symbol", F.lit(0))
    model = Ratio(_slotted(counts.withColumn("symbol", F.col("symbol") + 1), "n"),
                  _slotted(by_context, "total"), _slotted(by_context, "kinds"))
    if not (model.total[:, 0].sum(axis=-1) > 0).all():
        return None
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def differences(batches):
        for b in batches:
            d = shared.value.difference([u.encode("utf-8", "surrogatepass") for u in b.column("url").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("blocked"), pa.array(np.round(np.clip(d, -8, 8) * 128).astype(np.int64))],
                                             names=["blocked", "d"])

    bins = labelled.where(fold == 0).mapInArrow(differences, "blocked boolean, d long").groupBy("blocked", "d").count().toArrow()
    x, y, w = bins["d"].to_numpy() / 128.0, bins["blocked"].to_numpy().astype(float), bins["count"].to_numpy().astype(float)
    if len(set(y)) == 2:
        model.scale, model.offset = _calibrate(x, y, w)
    return model


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (null where a rule decides) for each row of ``pages``."""
    spark = pages.sparkSession
    records_per_batch(pages, 5000)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    host, path = host_path()
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    labelled = rows.where("ruled IS NOT NULL").select("url", (F.col("ruled") == "block").alias("blocked"))
    model = train(labelled)
    if model is None:
        kinds = {r["blocked"] for r in labelled.select("blocked").distinct().collect()}
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("block" if kinds == {True} else "allow")).alias("verdict"),
                           F.lit(None).cast("double").alias("p_block"))
    shared = spark.sparkContext.broadcast(model)

    def decide(batches):
        for b in batches:
            ruled, urls = b.column("ruled").to_pylist(), b.column("url").to_pylist()
            free = [i for i, r in enumerate(ruled) if r is None]
            p = shared.value.blocked([(urls[i] or "").encode("utf-8", "surrogatepass") for i in free])
            score = [None] * len(ruled)
            for i, x in zip(free, p):
                ruled[i], score[i] = "block" if x > 0.5 else "allow", float(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(ruled, pa.string()),
                                              pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "p_block"])

    return rows.mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string, p_block double")
