"""Exact self-join of documents by Jaccard similarity of word shingles, with skips from set relations.

1. Texts become sets of 64-bit shingle hashes. Equal sets collapse to one node. A global order puts common shingles last
   (any order is right; the order of a shingle's level, read from a fixed-size table, keeps lists short), and a
   node keeps its prefix: two sets that reach the threshold share a shingle of their prefixes.
2. Highly similar nodes are gathered into stars: a node attaches to a centre it was compared with. Only stars meet in the
   index, so a group of thousands of near copies is one entry of each list, not thousands.
3. Index lists hold (position, size) of each star and are cut into blocks by size; a block pair whose sizes or
   positions cannot reach the threshold is skipped whole, the rest entry by entry.
4. Centres of candidate stars are compared exactly. Answers of the other members follow from the centre's: a member x of a and a
   member y of b share at most |a & b| + |x - a| + |y - b| shingles. Star pairs for which that is too little are closed.
   In an open one the members of both are told by their differences from the centre of the larger star. A linked pair
   shares about half of x's differences at least (see ``member_links``), so an index of a prefix of the differences finds it, and
   the shared differences give the exact overlap: no pair of members is listed for being in two stars.
5. Many stars can be near without a link, as copies of one text with edits of their own. ``CLOUD`` stars or more around one hub are a cloud:
   pairs inside it are not listed as candidates, they are found like those of 4, by the differences of all its nodes from the hub.
6. Links become components.

Defined cases: null, empty and blank texts have empty sets and link with nothing; fewer than ``K`` words give one shingle of the whole sequence.
Repeated rows are equal sets. Rows with a null id count as documents, but the component's id is its least non-null id (null if none).
Very long texts are whole sets. Other columns are ignored.

Scale: no pair within a star is listed, all hot keys are pre-aggregated or joined by plain equi-joins that the adaptive planner splits,
and the level table has ``SLOTS`` bytes at any size.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.llm.common import forgetting, groups, mix, records_per_batch, words
from firegrid.llm.graph import components
from firegrid.session import written

K, PART, WHOLE = 4, 85, 100  # a link: WHOLE * |intersection| >= PART * |union|
SLOTS, COMMON, CHUNK, PIECE = 1 << 21, 4, 1 << 22, 1 << 20
BANDS, ROWS, HEADS = 4, 3, 3
LIST = 128
NEAR, CLOUD, STEPS = 70, 16, 3  # near: WHOLE * |intersection| >= NEAR * |union|
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(BANDS * ROWS)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_KNOWN = _Hashes()


def forget() -> None:
    _KNOWN.clear()


def flat_sets(texts: list[str | None], k: int = K):
    """The sorted distinct shingle hashes of each text, joined, and their numbers; in groups of texts."""
    known = _KNOWN.__getitem__
    for a, z in groups([len(t or "") for t in texts], PIECE):
        split = [words(t) for t in texts[a:z]]
        length = np.fromiter(map(len, split), np.int64, z - a)
        h = np.fromiter(map(known, chain.from_iterable(split)), np.uint64, length.sum())
        n = max(len(h) - k + 1, 0)
        run = np.zeros(n + 1, np.uint64)
        for i in range(k):
            run[:n] = mix(run[:n] + h[i:i + n] + np.uint64(i + 1))
        size = np.where(length >= k, length - k + 1, np.minimum(length, 1))
        at, start = np.cumsum(length) - length, np.cumsum(size) - size
        flat = run[np.minimum(np.arange(size.sum()) + np.repeat(at - start, size), n)]
        for i in np.flatnonzero((length > 0) & (length < k)):
            own = np.uint64(length[i])
            for x in h[at[i]:at[i] + length[i]]:
                own = mix(np.array([own]) + x)[0]
            flat[start[i]] = own
        for i, j in zip(start.tolist(), size.tolist()):
            flat[i:i + j].sort()
        new = np.ones(len(flat), bool)
        np.not_equal(flat[1:], flat[:-1], out=new[1:])
        new[start[size > 0]] = True
        yield flat[new], np.bincount(np.repeat(np.arange(z - a), size)[new], minlength=z - a)


def shingle_sets(texts: list[str | None], k: int = K):
    """The sorted distinct shingle hashes of each text."""
    for flat, size in flat_sets(texts, k):
        ends = np.cumsum(size)
        for i, j in zip((ends - size).tolist(), ends.tolist()):
            yield flat[i:j]


def _repeated(batches):
    """Shingles that occur in several texts of a stretch of a task, with their counts."""
    held, size = [], 0

    def flush():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        keys, n = keys[n > 1], n[n > 1]
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 100_000].view(np.int64)), pa.array(n[i:i + 100_000].astype(np.int64))], names=["shingle", "n"])

    for b in batches:
        for flat, _ in flat_sets(b.column("text").to_pylist()):
            held.append(flat)
            size += len(flat)
            if size > CHUNK:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def levels(docs: DataFrame) -> np.ndarray:
    """log2 of how many texts repeat a shingle, by slot (0: few)."""
    counts = docs.select("text").mapInArrow(forgetting(_repeated, forget), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    slots = counts.groupBy(F.col("shingle").bitwiseAND(SLOTS - 1).cast("int").alias("slot")).agg(F.max(F.log2("n")).cast("int").alias("level")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[slots["slot"].to_numpy()] = slots["level"].to_numpy()
    return out


def _sids(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for each of the joined sets, none of them empty."""
    m = mix(flat + np.uint64(0x632BE59BD9B4E019))
    h = mix(np.add.reduceat(m, start) + size.astype(np.uint64))
    return mix(h + np.bitwise_xor.reduceat(mix(m + np.uint64(1)), start)).view(np.int64)


def _sid(s: np.ndarray) -> int:
    return int(_sids(s, np.zeros(1, np.int64), np.array([len(s)]))[0])


def prefix_length(n):
    return n - -(-PART * n // WHOLE) + 1


def _bands(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes of ``ROWS`` minima each of the joined sets."""
    least = np.stack([np.minimum.reduceat(flat * o, start) for o in _ODD]).reshape(BANDS, ROWS, len(start))
    out = least[:, 0] + np.arange(0, BANDS * ROWS, ROWS, dtype=np.uint64)[:, None]
    for i in range(1, ROWS):
        out = mix(out) + least[:, i]
    return mix(out).T


def _sketch(table):
    def run(batches):
        level = table.value
        for b in batches:
            ids, texts, done = b.column("doc_id"), b.column("text").to_pylist(), 0
            for flat, size in flat_sets(texts):
                n, full = len(size), size > 0
                sid, bands, first = np.zeros(n, np.int64), [[]] * n, np.zeros(0, np.int64)
                lv = level[(flat & np.uint64(SLOTS - 1)).astype(np.int64)]
                prefix = np.where(full, prefix_length(size), 0)
                if len(flat):
                    start = (np.cumsum(size) - size)[full]
                    sid[full] = _sids(flat, start, size[full])
                    for i, row, m in zip(np.flatnonzero(full).tolist(), _bands(flat, start).view(np.int64).tolist(), size[full].tolist()):
                        if m > 5:
                            bands[i] = row
                    # sets are sorted: a stable order by level is one by (level, shingle)
                    first = np.concatenate([np.argsort(lv[i:i + m], kind="stable")[:p] + i
                                            for i, m, p in zip(start.tolist(), size[full].tolist(), prefix[full].tolist())])
                ends = pa.array(np.concatenate([[0], np.cumsum(prefix)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(done, n), pa.array(size, pa.int64()), pa.array(sid, mask=~full), pa.array(bands, pa.list_(pa.int64())),
                     pa.ListArray.from_arrays(ends, pa.array(flat[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(lv[first].view(np.int8)))],
                    names=["doc_id", "n", "sid", "bands", "prefix", "level"])
                done += n
    return run


def _named_sets():
    """A function that gives the set ``sid`` of a text, and None if the text is another."""
    kept: dict[int, np.ndarray] = {}

    def get(sid, text):
        if sid not in kept:
            s = next(shingle_sets([text]))
            if not len(s) or _sid(s) != sid:
                return None
            if len(kept) >= 64:
                kept.clear()
            kept[sid] = s
        return kept[sid]
    return get


def _overlaps(batches):
    """Exact overlap of the two texts of a row; rows whose texts are not the named sets are left out."""
    get = _named_sets()
    for b in batches:
        out = [[], [], [], []]
        for a, z, ta, tz in zip(*(b.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
            x, y = get(a, ta), get(z, tz)
            if x is not None and y is not None:
                both = len(np.intersect1d(x, y, assume_unique=True))
                for c, v in zip(out, (a, z, both, len(x) + len(y) - both)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "inter", "whole"])


def _differences(batches):
    """The shingles that only one of the two sets of a row has, and the size of the second; rows whose texts are not the named sets are left out."""
    get = _named_sets()
    for b in batches:
        out = [[], [], [], []]
        for a, z, ta, tz in zip(*(b.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
            x, y = get(a, ta), get(z, tz)
            if x is not None and y is not None:
                for c, v in zip(out, (a, z, len(y), np.setxor1d(x, y, assume_unique=True).view(np.int64))):
                    c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["a", "b", "n", "apart"])


def _with_texts(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b and a text of each (ta, tb) for pairs of nodes (a, b)."""
    ids = nodes.select("sid", "id")
    named = pairs.select("a", "b").join(ids.toDF("a", "ida"), "a").join(ids.toDF("b", "idb"), "b")
    text = docs.select("doc_id", "text")
    named = written(named, "pairs")  # its size is known before texts move: few pairs are broadcast
    return named.join(text.toDF("ida", "ta"), "ida").join(text.toDF("idb", "tb"), "idb").select("a", "b", "ta", "tb")


def compare(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, inter, whole (sizes of intersection and union) of each pair of nodes (a, b), from the whole texts."""
    both = _with_texts(pairs, docs, nodes)
    return both.mapInArrow(forgetting(_overlaps, forget), "a long, b long, inter long, whole long").groupBy("a", "b").agg(
        F.max("inter").alias("inter"), F.max("whole").alias("whole"))


LINKED = f"{WHOLE} * inter >= {PART} * whole"


def hubs(near: DataFrame) -> DataFrame:
    """star, hub: for the nodes of the pairs ``near`` (a, b), the node with most near ones within ``STEPS`` steps."""
    both = near.select("a", "b").union(near.select("b", "a"))
    best = both.groupBy("a").agg(F.struct(F.count(F.lit(1)).alias("near"), (-F.col("a")).alias("id")).alias("best"))
    both = both.union(best.select("a", F.col("a").alias("b")))
    for _ in range(STEPS):
        best = both.join(best.toDF("b", "best"), "b").groupBy("a").agg(F.max("best").alias("best"))
    return best.select(F.col("a").alias("star"), (-F.col("best.id")).alias("hub"))


def stars(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sid, star, extra, n, hub) of every node, extra the number of its shingles that the star's centre lacks; and the linked pairs (a, b) found on the way."""
    banded = nodes.select("sid", F.posexplode("bands").alias("k", "band"))
    heads = banded.groupBy("k", "band").agg(
        F.count(F.lit(1)).alias("c"), F.array(F.min("sid"), *(F.min_by("sid", F.xxhash64(F.lit(i), "sid")) for i in range(1, HEADS))).alias("heads"))
    heads = heads.where("c > 1").select("k", "band", F.explode(F.array_distinct("heads")).alias("head"))
    pairs = banded.join(heads, ["k", "band"]).where("sid <> head").select(
        F.least("sid", "head").alias("a"), F.greatest("sid", "head").alias("b")).distinct()
    near = compare(pairs, docs, nodes).where(f"{WHOLE} * inter >= {NEAR} * whole").select("a", "b", "inter", F.expr(LINKED).alias("linked"))
    near = written(near, "near")
    seen = near.where("linked").drop("linked")
    both = seen.union(seen.select("b", "a", "inter"))
    # a centre has more links than every node it is linked with; the smaller id wins a tie
    rank = both.groupBy("a").agg(F.struct(F.count(F.lit(1)).alias("links"), (-F.col("a")).alias("id")).alias("rank"))
    ranked = both.join(rank.select(F.col("a").alias("b"), F.col("rank").alias("theirs")), "b")
    best = ranked.groupBy("a").agg(F.max("theirs").alias("best")).join(rank, "a")
    centres = best.where("rank > best").select(F.col("a").alias("b"))
    first = ranked.join(centres, "b").groupBy("a").agg(F.max(F.struct("theirs", "b", "inter")).alias("m")).select(
        F.col("a").alias("sid"), "m.b", "m.inter")
    out = nodes.select("sid", "n").join(first, "sid", "left").select(
        "sid", F.coalesce("b", "sid").alias("star"), (F.col("n") - F.coalesce("inter", "n")).alias("extra"), "n")
    return written(out.join(hubs(near), "star", "left").select(*out.columns, "hub"), "stars"), seen.select("a", "b")


def _pair_up(batches):
    """Star pairs of two blocks of a list (or one block with itself), after skipping by size and position."""
    found: set[tuple[int, int]] = set()

    def flush():
        x, y = zip(*found) if found else ((), ())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    for b in batches:
        for left, right in zip(b.column("left").to_pylist(), b.column("right").to_pylist()):
            l, r = ({k: np.array([e[k] for e in x]) for k in ("star", "label", "cloud", "pos", "lo", "hi")} for x in (left, right or left))
            ok = (WHOLE * r["hi"][None, :] >= PART * l["lo"][:, None]) & (WHOLE * l["hi"][:, None] >= PART * r["lo"][None, :])
            need = PART * (l["lo"][:, None] + r["lo"][None, :])  # (PART + WHOLE) times the least overlap
            ok &= (PART + WHOLE) * np.minimum((l["hi"] - l["pos"])[:, None], (r["hi"] - r["pos"])[None, :]) >= need
            ok &= l["label"][:, None] < r["label"][None, :] if right is None else l["label"][:, None] != r["label"][None, :]
            ok &= (l["cloud"][:, None] != r["cloud"][None, :]) | (l["cloud"] == 0)[:, None]
            i, j = np.nonzero(ok)
            x, y = l["star"][i], r["star"][j]
            found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
            if len(found) > 200_000:
                yield flush()
    yield flush()


def candidates(members: DataFrame) -> DataFrame:
    """a < b: stars of different labels, and not of one cloud (0: none), of which some members' prefixes share a shingle."""
    if "cloud" not in members.columns:
        members = members.withColumn("cloud", F.lit(0).cast("long"))
    entry = members.select("star", "label", "cloud", "n", F.posexplode(F.arrays_zip("prefix", "level")).alias("pos", "e"))
    split = F.when(F.col("e.level") > 7, F.pow(F.lit(2.0), F.col("e.level") - 7)).otherwise(1).cast("int")  # LIST = 2 ** 7
    entry = entry.select(F.col("e.prefix").alias("shingle"), split.alias("split"), "star", "label", "cloud", F.col("n").alias("lo"), F.col("n").alias("hi"), "pos")
    item = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi", "star", "label", "cloud"))).alias("list")
    several = "array_min(list.label) < array_max(list.label) AND (array_min(list.cloud) < array_max(list.cloud) OR array_min(list.cloud) = 0)"
    short = entry.where("split = 1").groupBy("shingle").agg(item).where(several)
    per_star = entry.where("split > 1").groupBy("shingle", "split", "star", "label", "cloud").agg(F.min("pos").alias("pos"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    block = F.floor(F.log("lo") / float(np.log(WHOLE / PART))) * 100_000 + F.pmod(F.xxhash64("star"), "split")
    lists = per_star.groupBy("shingle", block.cast("long").alias("block")).agg(item)
    long = written(lists.select("shingle", "block", "list", F.array_min("list.lo").alias("lo"), F.array_max("list.hi").alias("hi"),
                                F.array_max(F.transform("list", lambda e: e["hi"] - e["pos"])).alias("rest")), "long-lists")
    within = short.select("list").union(long.where(several).select("list")).select(
        F.col("list").alias("left"), F.lit(None).cast(short.schema["list"].dataType).alias("right"))
    l, r = (long.toDF("shingle", *(f"{s}_{c}" for c in ("block", "list", "lo", "hi", "rest"))) for s in "lr")
    across = l.join(r, "shingle").where(
        f"l_block < r_block AND (array_min(l_list.label) < array_max(r_list.label) OR array_min(r_list.label) < array_max(l_list.label)) "
        "AND (array_min(l_list.cloud) < array_max(r_list.cloud) OR array_min(r_list.cloud) < array_max(l_list.cloud) OR array_min(l_list.cloud) = 0) "
        f"AND {WHOLE} * r_hi >= {PART} * l_lo AND {WHOLE} * l_hi >= {PART} * r_lo "
        f"AND {PART + WHOLE} * least(l_rest, r_rest) >= {PART} * (l_lo + r_lo)").select(
        F.col("l_list").alias("left"), F.col("r_list").alias("right"))
    return within.union(across).mapInArrow(_pair_up, "a long, b long").distinct()


def member_links(open_: DataFrame, star: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links that show in the differences from a hub: for the star pairs ``open_`` (a, b, inter), of centres a and members b of other stars
    that link with a or a member of a's star; for clouds, of the hub or a node with another node.

    For sets x and y of sizes n with d differences from one hub c, 2 |x & y| = nx + ny - dx - dy + 2 s, s of the differences being shared. So
    with q = (PART + WHOLE) d - (WHOLE - PART) n they link when 2 (PART + WHOLE) s >= qx + qy. Where c does not link with y,
    that sum exceeds 2 PART dx: s is positive, and more than 0.45 of x's differences. Where it links with both, they are in one component.
    """
    size = star.groupBy("star").agg(F.count(F.lit(1)).alias("c"), F.max("extra").alias("e"), F.min("n").alias("n"))
    sides = open_.join(size.toDF("a", "ca", "ea", "na"), "a").join(size.toDF("b", "cb", "eb", "nb"), "b")
    way = [F.struct(F.col(h).alias("hub"), F.col(f"e{h}").alias("e"), F.col(f"n{h}").alias("least"), F.col(o).alias("star"),
                    F.col(f"e{o}").alias("far"), F.col(f"n{o}").alias("n")) for h, o in ("ab", "ba")]
    sides = written(sides.select("inter", F.when(F.col("ca") >= F.col("cb"), way[0]).otherwise(way[1]).alias("w")).select("inter", "w.*"), "sides")
    # members of the smaller star (y), and those of the larger one, the hub (x), as far as the bounds leave them open; nodes of a cloud are both
    role = lambda hub, doc, x, y: (F.col(hub).alias("hub"), F.col(doc).alias("doc"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    spokes = sides.select("hub", "star", "inter", "e", "least").join(star, "star").where(
        f"{PART + WHOLE} * (inter + extra + e) >= {PART} * (n + least)").select(*role("hub", "sid", False, True))
    best = sides.groupBy(F.col("hub").alias("star")).agg(F.max(F.col("inter") + F.col("far")).alias("best"), F.min("n").alias("least"))
    own = best.join(star, "star").where(f"sid <> star AND {PART + WHOLE} * (best + extra) >= {PART} * (n + least)").select(*role("star", "sid", True, False))
    inside = star.where("cloud <> 0 AND cloud <> sid").select(*role("cloud", "sid", True, True))
    told = spokes.union(own).union(inside).groupBy("hub", "doc").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    told = written(told, "told")
    apart = _with_texts(told.select(F.col("hub").alias("a"), F.col("doc").alias("b")), docs, nodes).mapInArrow(
        forgetting(_differences, forget), "a long, b long, n long, apart array<long>")
    apart = apart.groupBy("a", "b").agg(F.max("n").alias("n"), F.max("apart").alias("apart")).toDF("hub", "doc", "n", "apart")
    q = F.expr(f"{PART + WHOLE} * size(apart) - {WHOLE - PART} * n")
    apart = apart.withColumn("q", q).join(told, ["hub", "doc"]).join(star.select(F.col("sid").alias("doc"), "label"), "doc")
    sizes = nodes.select(F.col("sid").alias("hub"), F.col("n").alias("hub_n"))
    apart = written(apart.join(sizes, "hub").withColumn("near", F.expr(f"q <= {WHOLE - PART} * hub_n")), "apart")
    direct = apart.where("near AND y").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    apart = apart.where("x OR NOT near").withColumn("y", F.expr("y AND NOT near"))
    entry = apart.select("hub", "x", "y", "label", "doc", "q", F.explode("apart").alias("shingle"))
    common = entry.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("times"), F.max("x").alias("x"), F.max("y").alias("y"),
                                                 F.min("label").alias("low"), F.max("label").alias("high")).where("x AND y AND low < high")
    least = apart.groupBy("hub").agg(F.min(F.when(F.col("x"), F.col("q"))).alias("qx"), F.min(F.when(F.col("y"), F.col("q"))).alias("qy"))
    # shingles that only one side has can not be shared: they are left out
    kept = entry.join(common.select("hub", "shingle", "times"), ["hub", "shingle"]).groupBy("hub", "x", "y", "label", "doc", "q").agg(
        F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("order"))
    kept = kept.join(least, "hub").select("hub", "x", "y", "label", "doc", "q", "qx", "qy", F.size("order").alias("d"), F.posexplode("order").alias("pos", "e"))
    x, y = (kept.where(f"{mine} AND {2 * (PART + WHOLE)} * (d - pos) >= q + q{other}").select(
        "hub", "e.shingle", F.expr("x AND y").alias(f"either_{mine}"), *(F.col(c).alias(f"{c}_{mine}") for c in ("doc", "label", "q", "d", "pos")))
        for mine, other in ("xy", "yx"))
    met = x.join(y, ["hub", "shingle"]).where(
        "label_x <> label_y AND (doc_x < doc_y OR NOT (either_x AND either_y)) "
        f"AND {2 * (PART + WHOLE)} * least(d_x - pos_x, d_y - pos_y) >= q_x + q_y").select("hub", "doc_x", "doc_y").distinct()
    x, y = (apart.select("hub", F.col("doc").alias(f"doc_{s}"), F.col("near").alias(f"near_{s}"), F.col("q").alias(f"q_{s}"), F.col("apart").alias(f"apart_{s}")) for s in "xy")
    both = met.join(x, ["hub", "doc_x"]).join(y, ["hub", "doc_y"])
    linked = both.where(f"{2 * (PART + WHOLE)} * size(array_intersect(apart_x, apart_y)) >= q_x + q_y")
    linked = linked.select(F.expr("CASE WHEN near_x THEN hub ELSE doc_x END"), "doc_y")  # the hub links with its near ones
    return written(direct.union(linked).distinct(), "member-links")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    records_per_batch(docs, 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(levels(docs))
    sketch = written(docs.mapInArrow(forgetting(_sketch(table), forget), "doc_id long, n long, sid long, bands array<long>, prefix array<long>, level array<tinyint>"), "sketch")
    nodes = sketch.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("id"), F.min(F.struct("n", "bands", "prefix", "level")).alias("s"))
    nodes = written(nodes.select("sid", "id", "s.*"), "nodes")
    star, links = stars(nodes, docs)
    early = written(components(links), "early-labels")  # stars that are linked already need no comparison
    labelled = star.join(early.toDF("star", "label"), "star", "left").withColumn("label", F.coalesce("label", "star"))
    centres = labelled.where("sid = star AND hub IS NOT NULL").select("star", "hub", "label")
    large = centres.groupBy("hub").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where(f"c >= {CLOUD} AND low < high")
    clouds = centres.join(large.select("hub"), "hub").select("star", F.col("hub").alias("cloud"))
    star = written(labelled.join(clouds, "star", "left").select("sid", "star", "extra", "n", "label", F.coalesce("cloud", F.lit(0)).alias("cloud")), "clouds")
    members = nodes.drop("n").join(star, "sid")
    pairs = candidates(members.select("star", "label", "cloud", "n", "prefix", "level"))
    seen = written(compare(pairs, docs, nodes).withColumn("linked", F.expr(LINKED)), "centre-pairs")
    reach = star.groupBy("star").agg(F.max("extra").alias("e"), F.min("n").alias("n"))
    apart, wide = seen.where("NOT linked"), reach.where("e > 0")  # only stars with extra shingles leave a pair open
    apart = apart.join(wide.select(F.col("star").alias("a")), "a", "leftsemi").union(
        apart.join(wide.select(F.col("star").alias("b")), "b", "leftsemi").select(apart.columns)).distinct()
    open_ = apart.join(reach.toDF("a", "ea", "na"), "a").join(reach.toDF("b", "eb", "nb"), "b").where(
        f"ea + eb > 0 AND {PART + WHOLE} * (inter + ea + eb) >= {PART} * (na + nb)").select("a", "b", "inter")
    open_ = written(open_, "open-pairs")
    more = member_links(open_, star, docs, nodes)
    links = links.union(seen.where("linked").select("a", "b")).union(more)
    of = star.select("sid", "star")
    edges = links.join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
    labels = components(edges)
    named = nodes.select("sid", "id").join(of, "sid").join(labels.toDF("star", "label"), "star", "left").select(
        "sid", "id", F.coalesce("label", "star").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(least, "label").select("sid", "component_id")
    return sketch.select("doc_id", "n", "sid").join(named, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first (least id) of their component, with the same columns.

    Rows without an id stay, and so does every row without words; of repeated rows of one id and text one stays. Rows of one id with
    different texts are documents of their own: the row, not the id, is linked.
    """
    known = docs.where("doc_id IS NOT NULL")
    key = F.xxhash64("doc_id", "text")
    parts = link(known.select(key.alias("doc_id"), "text"))
    ids = known.select(key.alias("key"), F.col("doc_id").cast("long").alias("id")).distinct()
    named = parts.select(F.col("doc_id").alias("key"), "n_shingles", "component_id").distinct().join(ids, "key")
    keep = named.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"), F.max("n_shingles").alias("shingles"))
    keep = keep.select(F.col("first.key").alias("keep_key"), F.col("first.id").alias("keep_id"), "shingles")
    rows = known.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.join(keep, (F.col("key") == F.col("keep_key")) & (F.col("id") == F.col("keep_id")))
    nth = F.row_number().over(Window.partitionBy("key", "id").orderBy("row.source"))
    return rows.withColumn("nth", nth).where("nth = 1 OR shingles = 0").select("row.*").unionByName(docs.where("doc_id IS NULL"))


#: Brute force in SQL: every pair that shares a shingle, and reachability.
SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
  ELSE list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, len(g) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, UNNEST(g) AS g FROM s),
o AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS inter FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * inter >= 85 * (p.n_shingles + q.n_shingles - inter)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, m.component_id FROM n JOIN (SELECT x, MIN(y) AS component_id FROM r GROUP BY x) m ON m.x = n.doc_id"""
