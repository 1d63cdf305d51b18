"""Language identification with bit-sliced Bloom filters of character trigrams.

The filter has ``slots`` rows of one bit per language. A trigram sets a language's bit in ``hashes``
rows if, in that language's training texts, it occurs ``min_count`` times and at least ``ratio`` times
as often as in the language that uses it most. One look-up (the AND of its rows) so returns all
languages that contain a trigram. A text's hits per language are corrected by the filter's
rate of false positives (fill ** hashes), and the largest corrected share decides.

Trigrams run over lower-cased letters; every other symbol ends a word, and a word is padded by one blank
on both sides, so one letter already gives a trigram.

Defined cases: null texts and texts without a letter give ``und`` and score 0; where no trigram is known, or
shares tie, the language with more trigrams in training is taken, then the smaller name. Without
any labelled text all get ``und``. Repeated rows give repeated results; other columns are ignored.

Scale: trigrams are counted per task before the shuffle; the filter has a fixed size, so what is
gathered and broadcast does not grow with the corpus.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import cut, fold, groups, mix, records_per_batch

SLOTS, HASHES, RATIO, MIN_COUNT = 1 << 18, 3, 0.3, 3
MAX_LANGUAGES = 1024
PIECE = 1 << 19


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (single symbols) of each code point, and whether it is a letter."""
    top = 0x110000
    chars = [chr(i) for i in range(top)]
    lower = np.arange(top, dtype=np.uint32)
    for i, c in enumerate(chars):
        if len(x := c.lower()) == 1 and x != c:
            lower[i] = ord(x)
    return lower, np.fromiter((c.isalpha() for c in chars), bool, top)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (21 bits a symbol) and the text each belongs to."""
    lower, letter = _tables()
    owner, parts = [], []
    for i, piece, first, last in cut(texts, PIECE, 2):
        parts.append(" " * first + piece + " " * last)
        owner.append(i)
    at = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    sym = lower[at]
    sym[~letter[at]] = 32
    keep = np.ones(len(sym), bool)  # runs of blanks shrink to one
    keep[1:] = (sym[1:] != 32) | (sym[:-1] != 32) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep].astype(np.uint64), doc[keep]
    if len(sym) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    good = (doc[2:] == doc[:-2]) & (sym[1:-1] != 32)
    keys = (sym[:-2] | sym[1:-1] << np.uint64(21) | sym[2:] << np.uint64(42))[good]
    return keys, np.asarray(owner, dtype=np.int64)[doc[:-2][good]]


def slots_of(keys: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    return [(mix(keys + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(slots)).astype(np.int64)
            for i in range(hashes)]


def _count(batches):
    """Trigram counts of each language of a task."""
    found: dict[str, list] = {}
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs) if x == lang]
            for a, z in groups([len(t) for t in own], PIECE):
                keys, n = np.unique(trigrams(own[a:z])[0], return_counts=True)
                found.setdefault(lang, []).append((keys, n))
                if len(found[lang]) > 32:
                    found[lang] = [_merge(found[lang])]
    for lang, lists in found.items():
        keys, n = _merge(lists)
        for i in range(0, len(keys), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(n[part].astype(np.int64))],
                names=["lang", "gram", "n"])


def _merge(lists):
    keys, where = np.unique(np.concatenate([k for k, _ in lists]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in lists]), minlength=len(keys)).astype(np.int64)


class Filters:
    """The bit-sliced filter: languages, table (words, slots) of 62 languages a word, false-positive rates."""

    def __init__(self, langs: list[str], table: np.ndarray, hashes: int, order: np.ndarray):
        self.langs, self.table, self.hashes, self.order = langs, table, hashes, order
        fill = np.array([((table[i // 62] >> np.uint64(i % 62)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.false = np.minimum(fill ** hashes, 1 - 1e-9)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected shares (texts, languages) and the number of trigrams of each text."""
        keys, doc = trigrams(texts)
        total = np.bincount(doc, minlength=len(texts))
        at = slots_of(keys, self.table.shape[1], self.hashes)
        out = np.zeros((len(texts), len(self.langs)))
        for w in range(self.table.shape[0]):
            mask = self.table[w][at[0]]
            for x in at[1:]:
                mask &= self.table[w][x]
            for i in range(62 * w, min(62 * w + 62, len(self.langs))):
                hit = (mask >> np.uint64(i - 62 * w)) & np.uint64(1)
                out[:, i] = np.bincount(doc, weights=hit, minlength=len(texts))
        share = out / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false) / (1 - self.false), 0, None), total


def train(docs: DataFrame, slots: int = SLOTS, hashes: int = HASHES, ratio: float = RATIO,
          min_count: int = MIN_COUNT) -> Filters | None:
    """Learn from the rows of ``docs`` that have a text and a lang; None without any."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("uses"))  # at most one entry a language
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return None
    langs = sorted(totals)
    rank = {x: i for i, x in enumerate(langs)}

    def place(batches):
        for b in batches:
            grams, word, bits = [], [], []
            for gram, uses in zip(b.column("gram").to_pylist(), b.column("uses").to_pylist()):
                rate = {u["lang"]: u["n"] / totals[u["lang"]] for u in uses}
                top, masks = max(rate.values()), {}
                for u in uses:
                    if u["n"] >= min_count and rate[u["lang"]] >= ratio * top:
                        i = rank[u["lang"]]
                        masks[i // 62] = masks.get(i // 62, 0) | 1 << i % 62
                for w, m in masks.items():
                    grams.append(gram)
                    word.append(w)
                    bits.append(m)
            keys = np.array(grams, dtype=np.int64).view(np.uint64)
            for at in slots_of(keys, slots, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word, pa.int32()), pa.array(bits, pa.int64())],
                                                 names=["slot", "word", "bits"])

    filled = by_gram.mapInArrow(place, "slot long, word int, bits long").groupBy("slot", "word").agg(F.expr("bit_or(bits)").alias("bits"))
    got = filled.toArrow()  # at most slots rows a word, whatever the corpus
    table = np.zeros(((len(langs) + 61) // 62, slots), dtype=np.uint64)
    table[got["word"].to_numpy(), got["slot"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Filters(langs, table, hashes, np.array(sorted(range(len(langs)), key=lambda i: (-totals[langs[i]], langs[i]))))


def identify(docs: DataFrame, model: Filters | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for a, z in groups([len(t) for t in texts], PIECE) if m else ():
                share, total = m.scores(texts[a:z])
                best = m.order[np.argmax(share[:, m.order], axis=1)]
                for i in np.flatnonzero(total):
                    names[a + i] = m.langs[best[i]]
                    scores[a + i] = share[i, best[i]] / max(share[i].sum(), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))],
                                             names=["doc_id", "lang_pred", "score"])

    records_per_batch(docs, 2000)
    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identify_folds(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2; predict every row from its text alone."""
    records_per_batch(docs, 2000)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = train(known.where(fold("doc_id", 4) != 2))
    return identify(known, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
