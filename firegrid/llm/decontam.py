"""Benchmark decontamination by template canonicalisation.

Texts become templates: words lose outer punctuation and case; numbers, units after a number, and
names (capitalised words inside a sentence) become typed placeholders, the slots. Windows of ``WINDOW`` template
words are joined by hash with the windows of the benchmark items. The windows that a document shares with an item at one
distance (an alignment) must fill the slots consistently: one value of the item stands for one value of the document throughout; windows that
say otherwise do not count. A document is contaminated by an item if consistent windows cover
``SHARE`` of the item's windows, or a run of ``RUN`` words of it.

Defined cases: an item of fewer than ``WINDOW`` words, or without a window that has ``LITERAL`` plain words, matches a document
whose whole template equals its own. Null or empty items and documents match nothing. Rows that share a
document id are judged as one document, a null id included; repeated items (same id) act as one item. Other columns are ignored.

Scale: documents are read once and stay where they are; a fixed-size bit table of the benchmark's windows lets through only rows that can
join. Slots and positions are compared per (document, item), never per item alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import forgetting, groups, mix, records_per_batch

WINDOW, LITERAL, SHARE, RUN = 5, 2, 0.8, 13
BITS = 1 << 22
PIECE = 1 << 20

#: Fixed units of measure; a word is a unit only behind a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre "
    "kilometres g kg mg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces l ml liter liters litre litres "
    "gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year "
    "years usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh hz khz mhz ghz kb mb gb tb v w kw j kj "
    "kcal".split())
NUMBER = re.compile(r"[-+]?[$€£]?\d+(?:[.,:/-]\d+)*%?")
PLAIN, NUM, UNIT, NAME = 0, 1, 2, 3  # kinds; a placeholder's id is its kind, ids of plain words are larger
_EDGE = re.compile(r"^\W+|\W+$")
_CAP, _STOP, _UNIT, _NUM = 1, 2, 4, 8


class Words(dict):
    """Word id and flags (capital, ends a sentence, unit, number) of a raw word, in one integer."""

    def __missing__(self, raw: str) -> int:
        core = _EDGE.sub("", raw)
        flags = _STOP if raw.rstrip("\"')]»”")[-1:] in ".!?" else 0
        if NUMBER.fullmatch(raw.strip(".,;:!?()[]\"'")):
            flags |= _NUM
        low = (core or raw).lower()
        if low in UNITS:
            flags |= _UNIT
        if core[:1].isupper() and core[1:] == core[1:].lower():
            flags |= _CAP
        if len(self) > 500_000:
            self.clear()
        out = self[raw] = (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) >> 8 | 4) << 4 | flags
        return out


KNOWN = Words()


def forget() -> None:
    KNOWN.clear()


def templates(split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template ids, kinds and the text number of all words of some texts."""
    known = KNOWN
    coded = np.fromiter((known[w] for t in split for w in t), np.uint64, sum(map(len, split)))
    doc = np.repeat(np.arange(len(split)), [len(t) for t in split])
    flags, ids = (coded & np.uint64(15)).astype(np.int8), coded >> np.uint64(4)
    first = np.ones(len(ids), bool)  # of a text or a sentence
    first[1:] = (doc[1:] != doc[:-1]) | (flags[:-1] & _STOP > 0)
    number = flags & _NUM > 0
    behind = np.zeros(len(ids), bool)
    behind[1:] = number[:-1] & (doc[1:] == doc[:-1])
    kind = np.select([number, behind & (flags & _UNIT > 0), ~first & (flags & _CAP > 0)], [NUM, UNIT, NAME], PLAIN)
    return np.where(kind > 0, kind.astype(np.uint64), ids), kind, doc


def windows(ids: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window that lies in one text and has enough plain words."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    plain = np.zeros(n, np.int8)
    for i in range(WINDOW):
        h = mix(h ^ ids[i:i + n] + np.uint64(i + 1))
        plain += kind[i:i + n] == PLAIN
    at = np.flatnonzero((doc[:n] == doc[WINDOW - 1:]) & (plain >= LITERAL))
    return at, h[at]


def _whole(ids: np.ndarray) -> np.ndarray:
    h = np.uint64(len(ids))
    for x in ids.tolist():
        h = mix(np.array([h ^ np.uint64(x)]))[0]
    return np.uint64(h) ^ np.uint64(0xA5A5A5A5A5A5A5A5)


SCHEMA = "id long, pos long, hash long, slots array<string>, total long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()]


def _rows(bits, longest: int | None):
    """Mapper from (id, text) to windows; ``bits`` lets through what can join, ``longest`` bounds whole-text keys. Without bits all windows come."""
    def run(batches):
        table = bits.value if bits is not None else None
        for b in batches:
            ids_, texts = b.column("id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for a, z in groups([len(t) for t in texts], PIECE):
                split = [t.split() for t in texts[a:z]]
                ids, kind, doc = templates(split)
                start = np.concatenate([[0], np.cumsum([len(t) for t in split])])
                at, h = windows(ids, kind, doc)
                total = np.bincount(doc[at], minlength=z - a) if len(at) else np.zeros(z - a, int)
                pos = at - start[doc[at]] if len(at) else at
                own, size = doc[at] if len(at) else at, np.full(len(at), WINDOW)
                whole = [i for i, t in enumerate(split) if t and (len(t) <= longest if longest is not None else total[i] == 0)]
                if whole:
                    h = np.concatenate([h, np.array([_whole(ids[start[i]:start[i + 1]]) for i in whole], np.uint64)])
                    pos, own = np.concatenate([pos, np.full(len(whole), -1)]), np.concatenate([own, whole])
                    size = np.concatenate([size, [len(split[i]) for i in whole]])
                if table is not None:
                    hit = np.flatnonzero(table[(h & np.uint64(BITS - 1)).astype(np.int64)])
                    h, pos, own, size = h[hit], pos[hit], own[hit], size[hit]
                out = [[], [], [], [], []]
                for key, p, i, n in zip(h.view(np.int64).tolist() if len(h) else [], pos.tolist(), own.tolist(), size.tolist()):
                    at_ = start[i] + max(p, 0)
                    slots = [f"{k} {_EDGE.sub('', w)}" for k, w in zip(kind[at_:at_ + n].tolist(), split[i][max(p, 0):max(p, 0) + n]) if k]
                    for c, v in zip(out, (ids_[a + i], p, key, slots, max(int(total[i]), 1))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], names=["id", "pos", "hash", "slots", "total"])
    return run


def _judge(batches):
    """Consistent windows of each (document, item)."""
    names = ["doc_id", "item_id", "n_windows", "n_matched", "share", "longest_run", "changed_slots"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    for b in batches:
        out = [[] for _ in names]
        for doc, item, total, hits in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "total", "hits"))):
            alignments: dict[int, list] = {}
            for h in hits:
                alignments.setdefault(h["pos"] - h["at"], []).append(h)
            matched, changed, run = set(), set(), 0
            for group in alignments.values():
                votes: dict[str, Counter] = {}
                for h in group:
                    for theirs, ours in zip(h["own"], h["slots"]):
                        votes.setdefault(theirs, Counter())[ours] += 1
                value = {k: min(v, key=lambda x: (-v[x], x)) for k, v in votes.items()}
                good = {h["at"] for h in group if all(value[t] == o for t, o in zip(h["own"], h["slots"]))}
                changed |= {k for k, v in value.items() if k != v}
                matched |= good
                last = length = None
                for at in sorted(good):
                    length = length + at - last if last is not None and at - last <= WINDOW else WINDOW
                    last, run = at, max(run, length)
            share = len(matched) / total
            if share >= SHARE or run >= RUN:
                for c, v in zip(out, (doc, item, total, len(matched), share, run, len(changed))):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, share, longest_run, changed_slots of each contaminated (document, item)."""
    spark = docs.sparkSession
    records_per_batch(docs, 1000)
    own = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    keys = own.mapInArrow(forgetting(_rows(None, None), forget), SCHEMA).groupBy("id", "pos", "hash", "slots").agg(F.max("total").alias("total")).select(
        F.col("id").alias("item_id"), F.col("pos").alias("at"), "hash", F.col("slots").alias("own"), "total")
    bits = np.zeros(BITS, bool)
    bits[np.array([r[0] for r in keys.select(F.col("hash").bitwiseAND(BITS - 1).cast("int")).distinct().collect()], int)] = True  # at most BITS numbers
    # an upper bound of the mapper's words: it cuts at every white space and at \x1c-\x1f
    longest = own.select(F.max(F.size(F.split("text", r"(?U)[\s\x1c-\x1f]+")))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        forgetting(_rows(spark.sparkContext.broadcast(bits), int(longest)), forget), SCHEMA).drop("total")
    pairs = rows.join(keys, "hash").where("(pos < 0) = (at < 0)").groupBy(F.col("id").alias("doc_id"), "item_id").agg(
        F.max("total").alias("total"), F.collect_list(F.struct("pos", "at", "slots", "own")).alias("hits"))
    return pairs.mapInArrow(forgetting(_judge, forget), "doc_id long, item_id long, n_windows long, n_matched long, share double, longest_run long, changed_slots long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with the same columns."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(bad, F.col("row.doc_id").cast("long").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")
