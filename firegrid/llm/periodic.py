"""Periodic runs of words: maximal stretches that repeat a root of q words at least four times over.

1. Each document is exploded into overlapping tiles per period octave. For periods in [P, 2P) a tile is anchored at every
   2P-th word and reaches from 2P words before its anchor to 6P after it. A run of at least 4q words holds, at some
   anchor c, both copies of a square (words [c, c + q) equal [c + q, c + 2q)), and the tiles of its anchors overlap by 6P.
2. A tile is solved alone. Rolling hashes drop the periods whose square cannot start at the anchor; for the others the
   Z-functions at the boundary, forward from (c, c + q) and backward from (c - 1, c + q - 1), are read by comparing
   words, which also makes the result exact. Roots that repeat a shorter root are left to that one's period, so that the
   period is the smallest of the stretch. What is found is a fragment (start, end, period).
3. Fragments are shuffled by (document, period) and stitched where they share q words or more.

Documents up to ``LONG`` words are tiled and solved in the task that read them, many in one numpy pass, and give whole runs.
A longer one is exploded into rows, each with the tiles of one part of it for one range of octaves (of all octaves up to
``LONG`` / 16 together), and these rows are solved where a shuffle puts them.

Defined cases: a null or blank text has no words and no runs. Rows are kept apart by their place, not by their id, so repeated and null ids give a
row each. Other columns are ignored. An empty table gives an empty one. The only text that is moved is that of documents with runs.

Scale: work is about n log n word comparisons of numpy a document. A part of a long document holds 1.5 ``LONG`` words, or 24 P
for larger octaves. Rows that move are bounded by the runs (and parts) of documents. All stages restart from written tables.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.llm.common import let, mix, slices, word_array
from firegrid.session import written

LONG, PACK, EXPONENT, LEAST = 1 << 17, 4 << 20, 4, 6
BASE = np.uint64(0x9E3779B97F4A7C15)
SHARED = "kind int, key long, doc_id long, n_words long, words binary, collapsed_sha256 string, period long, start long, end long, lo long, hi long, tile binary"
_powers = [np.ones(1, np.uint64)]


def _power(n: int) -> np.ndarray:
    """BASE ** 0 .. n - 1, modulo 2 ** 64."""
    one = np.array([BASE])  # arrays wrap around silently
    while len(_powers[0]) < n:
        last = _powers[0]
        _powers[0] = np.concatenate([last, last * (last[-1:] * one)])
    return _powers[0][:n]


def _alike(x: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """Z values: how many words x[a], x[a + step], .. equal x[b], x[b + step], .. before the first difference or ``limit``."""
    out, live, width = np.zeros(len(a), np.int64), np.arange(len(a)), 8
    while len(live):
        for lot in np.array_split(live, len(live) * width // (1 << 21) + 1):
            steps = out[lot, None] + np.arange(width)
            same = x[a[lot, None] + step * steps] == x[b[lot, None] + step * steps]
            found = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[lot] += found
        full = out[live] < limit[live]
        full &= x[(a[live] + step * np.minimum(out[live], limit[live] - 1))] == x[(b[live] + step * np.minimum(out[live], limit[live] - 1))]
        live, width = live[full], 2 * width
    return np.minimum(out, limit)


def _squares(x: np.ndarray, P: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, period) of the squares, as far as hashes tell, of the octave at the anchors; x is padded."""
    tiles = len(x) // (2 * P) - 4
    power = _power(len(x) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.astype(np.uint64)) * power[:len(x)])])
    blocks = (total[P:] - total[:-P])[:tiles * 2 * P].reshape(tiles, 2 * P)
    tile, j = np.nonzero(blocks[:, P:] == blocks[:, :1] * power[P:2 * P])
    c, q = tile * 2 * P, j + P
    whole = (total[c + q] - total[c]) * power[q] == total[c + 2 * q] - total[c + q]
    return c[whole], q[whole]


@cache
def _primes(q: int) -> list[int]:
    """The prime divisors of q."""
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + [q] if q > 1 else out


def _primitive(x: np.ndarray, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the root x[c:c + q] of a square is no repetition of a shorter root."""
    divisors = [_primes(n) for n in q.tolist()]
    row = np.repeat(np.arange(len(q)), [len(d) for d in divisors])
    shorter = q[row] // np.array([r for d in divisors for r in d], np.int64)
    whole = _alike(x, c[row], c[row] + shorter, q[row] - shorter, 1) == q[row] - shorter
    return np.bincount(row[whole], minlength=len(q)) == 0


def fragments(x: np.ndarray, P: int) -> np.ndarray:
    """Rows (start, end, period) for periods in [P, 2P) in an array of word ids, solved tile by tile."""
    pad = 10 * P - len(x) % (2 * P)
    x = np.concatenate([x, np.arange(-1 << 60, (-1 << 60) + pad)])
    c, q = _squares(x, P)
    if len(c) > 1:  # multiples of the distance of two periods at one anchor, where that distance is a period itself
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        gap = np.r_[q[1:] - q[:-1], 1 << 40]
        gap[np.r_[first[1:] - 1, len(c) - 1]] = 1 << 40
        gap = np.minimum.reduceat(gap, first)
        several = gap < 1 << 40
        at, gap = c[first][several], gap[several]
        reach = np.zeros(len(first), np.int64)
        gaps = np.ones(len(first), np.int64)
        reach[several], gaps[several] = gap + _alike(x, at, at + gap, 4 * P - gap, 1), gap
        tile = np.cumsum(np.r_[False, c[1:] != c[:-1]])
        own = (q % gaps[tile] != 0) | (2 * q > reach[tile])
        c, q = c[own], q[own]
    if not len(c):
        return np.zeros((0, 3), np.int64)
    ahead = _alike(x, c, c + q, 6 * P - q, 1)
    own = ahead >= q
    own[own] = _primitive(x, c[own], q[own])
    c, q, ahead = c[own], q[own], ahead[own]
    behind = _alike(x, c - 1, c + q - 1, np.full(len(c), 2 * P), -1)
    return np.stack([c - behind, c + q + ahead, q], axis=1)


def stitch(rows: np.ndarray) -> np.ndarray:
    """Fragments of one period that share at least that many words become one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
    shift = rows[:, 2] << 40  # a later period starts above every end of an earlier one
    most = np.maximum.accumulate(rows[:, 1] + shift)
    new = np.r_[True, rows[1:, 0] + shift[1:] > most[:-1] - rows[1:, 2]]
    first = np.flatnonzero(new)
    return np.stack([rows[first, 0], np.maximum.reduceat(rows[:, 1], first), rows[first, 2]], axis=1)


def _long_enough(rows: np.ndarray) -> np.ndarray:
    return rows[rows[:, 1] - rows[:, 0] >= np.maximum(EXPONENT * rows[:, 2], LEAST)]


def pack_runs(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, (start, end, period)) of the runs of whole documents given as word ids from 0."""
    order = sorted((i for i in range(len(docs)) if len(docs[i]) >= LEAST), key=lambda i: -len(docs[i]))
    if not order:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    sizes = np.array([len(docs[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    x = np.concatenate([np.r_[docs[i], -1 - k] for k, i in enumerate(order)])
    found, P = [], 1
    while P * EXPONENT <= sizes[0]:
        found.append(fragments(x[:starts[np.searchsorted(-sizes, -P * EXPONENT, "right")]], P))
        P *= 2
    rows = _long_enough(stitch(np.concatenate(found)))
    k = np.searchsorted(starts, rows[:, 0], "right") - 1
    return np.array(order)[k], rows - np.stack([starts[k], starts[k], np.zeros(len(k), np.int64)], axis=1)


def parts(x: np.ndarray, long: int):
    """(first word, least octave, greatest octave, ids) of the rows that a long document is exploded into."""
    P = long // 16
    stride, lo = long, 1
    while True:
        for at in range(0, len(x), stride):
            yield max(at - 2 * P, 0), lo, P, x[max(at - 2 * P, 0):at + stride + 6 * P]
        lo, P, stride = 2 * P, 2 * P, 32 * P
        if P * EXPONENT > len(x):
            return


def _explode(long: int):
    """Documents to kind 0 (document), 1 (whole run of a short one) and 2 (part of a long one)."""
    def explode(batches):
        key = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text", PACK):
            ids, table, joined, found = [], {}, [], [[] for _ in range(b.num_rows)]
            for text in b.column("text"):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                ids.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
                joined.append(b" ".join(words))
            for d, run in zip(*pack_runs([x if len(x) <= long else x[:0] for x in ids])):
                found[d].append(run)
            rows = []
            for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                n, whole = len(ids[i]), not found[i] and len(ids[i]) <= long
                rows.append((0, key, doc_id, n, None if whole else joined[i], hashlib.sha256(joined[i]).hexdigest() if whole else None, *[None] * 6))
                rows += [(1, key, None, None, None, None, int(q), int(s), int(e), None, None, None) for s, e, q in found[i]]
                if n > long:
                    for at, lo, hi, x in parts(np.unique(ids[i], return_inverse=True)[1], long):
                        rows.append((2, key, None, None, None, None, None, at, None, lo, hi, x.astype("<i4").tobytes()))
                        if len(rows) > 64:
                            yield _table(rows)
                            rows = []
                key += 1
            yield _table(rows)
    return explode


_TYPES = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()),
                    ("collapsed_sha256", pa.string()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                    ("lo", pa.int64()), ("hi", pa.int64()), ("tile", pa.binary())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPES)], schema=_TYPES)


def _solve(batches):
    """Parts of long documents to fragments."""
    for b in batches:
        for r in b.to_pylist():
            x = np.frombuffer(r["tile"], "<i4").astype(np.int64)
            found, P = [], r["lo"]
            while P <= r["hi"]:
                found.append(fragments(x, P))
                P *= 2
            s, e, q = stitch(np.concatenate(found)).T
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), r["key"])), pa.array(q), pa.array(s + r["start"]), pa.array(e + r["start"])],
                                             names=["key", "period", "start", "end"])


def _stitched(rows: DataFrame) -> DataFrame:
    """Fragments (key, period, start, end) to the runs they are part of."""
    group = Window.partitionBy("key", "period").orderBy("start", "end")
    upto = F.max("end").over(group.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.coalesce((F.col("start") > upto - F.col("period")).cast("int"), F.lit(1)))
    marked = marked.withColumn("run", F.sum("new").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.where(F.col("end") - F.col("start") >= F.greatest(EXPONENT * F.col("period"), F.lit(LEAST)))


def _collapse(batches):
    """The words outside every run, or inside the first period of each run that holds them, joined by a blank."""
    for b in batches:
        shas = []
        for words, known, runs in zip(b.column("words"), b.column("collapsed_sha256").to_pylist(), b.column("runs").to_pylist()):
            if words.is_valid:
                ws = words.as_buffer().to_pybytes().split(b" ")
                steps = np.zeros(len(ws) + 1, np.int64)
                for r in runs or ():
                    steps[r["start"] + r["period"]] += 1
                    steps[r["start"] + r["length"]] -= 1
                dropped = np.cumsum(steps[:-1])
                known = hashlib.sha256(b" ".join([w for w, d in zip(ws, dropped.tolist()) if not d])).hexdigest()
            shas.append(known)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "n_words", "runs")] + [pa.array(shas, pa.string())],
                                         names=["doc_id", "n_words", "runs", "collapsed_sha256"])


RUNS = "runs array<struct<start: long, period: long, length: long>>"


def find_runs(docs: DataFrame, long: int = LONG) -> DataFrame:
    """doc_id, n_words, runs (start, period, length; by start, then period) and collapsed_sha256 of each row (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(own.mapInArrow(_explode(long), SHARED), "period-tiles")
    tiles = rows.where("kind = 2").select("key", "start", "lo", "hi", "tile").repartition("key", "start", "lo")
    pieces = rows.where("kind = 1").select("key", "period", "start", "end").union(
        tiles.mapInArrow(_solve, "key long, period long, start long, end long"))
    runs = _stitched(pieces).groupBy("key").agg(F.sort_array(F.collect_list(
        F.struct("start", "period", (F.col("end") - F.col("start")).alias("length")))).alias("runs"))  # bounded by one document
    table = rows.where("kind = 0").select("key", "doc_id", "n_words", "words", "collapsed_sha256")
    bare = table.where("words IS NULL").select("doc_id", "n_words", "words", "collapsed_sha256", F.lit(None).cast(RUNS[5:]).alias("runs"))
    full = table.where("words IS NOT NULL").join(runs, "key", "left").select("doc_id", "n_words", "words", "collapsed_sha256", "runs")
    full = full.mapInArrow(_collapse, f"doc_id long, n_words long, {RUNS}, collapsed_sha256 string")
    return bare.select(*full.columns).union(full).withColumn("runs", F.coalesce("runs", F.array().cast(RUNS[5:])))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and the digests of ``find_runs``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256", "n_words")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by hash repeats a stretch of its own words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.concat_ws(" ", F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)))

    text = F.col("text").cast("string")
    return docs.select("doc_id", F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(word_array(text), repeated)).otherwise(text).alias("text"))


def collapse_digest(docs: DataFrame) -> DataFrame:
    return digest(find_runs(planted(docs)))
