"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | words before) = P(class | words before) * P(part | class, words before) * P(word | class, part).

* Classes: the ``HEADS`` most frequent words and the end of a text are classes of their own; all other words, unseen ones too, fall into
  spelling classes (the closest of 16 fixed directions among hashed letter pairs), so the class follows from the word alone and is not
  learned. Five bits of a word's hash name its part of a spelling class.
* First factor: softmax over the classes of summed weights of hashed features: the word before, the word two before (a skip),
  classes of the last three words, and of the third and fourth last words (a skip).
* Second factor: softmax over the parts, its features the class alone, with the word before, and with the word two before.
* Weights of both are trained by mini-batch gradient steps in every task from shared weights, which are then averaged by tokens seen;
  ``ROUNDS`` rounds see disjoint parts of the training texts, all of them together.
* Third factor: softmax over the words of a part with one bias a word, whose maximum-likelihood solution is its count; counts are smoothed by
  adding ``ADD``, and each part keeps the mass of one unseen word. The model so sums to 1 over the known words and one unseen word a part.

Defined cases: null text is empty; an empty text is its end token alone. Without training texts (an empty table, too) counts are 0 and
classes are uniform. Repeated rows count and score each. A null id is in the fold of the empty key. Other columns are ignored, whatever their
names. A very long text is one batch of its own, read whole. Words are told apart by 64-bit hashes.

Scale: texts are split once, into batches of word numbers that are written to the shared folder; later passes are sparse numpy work on
them. Word counts over the whole corpus are made by a shuffle and joined back to the words of each batch, so no vocabulary is broadcast.
Broadcast are the weights (2 x ``BUCKETS`` x 32) and the totals of the parts, of fixed size. Nothing comes from a sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import fold, forgetting, groups, mix, slices
from firegrid.session import written

HEADS, SPELLINGS, PARTS, BUCKETS, FEATURES = 15, 16, 32, 1 << 15, 4
CLASSES = HEADS + 1 + SPELLINGS
ADD, ROUNDS, RATE, STEP = 0.1, 2, 1.0, 1 << 13
BATCH, SLICE, GRID, REACH = 16 << 20, 1 << 17, 1 << 10, 4
END = xxhash.xxh3_64_intdigest(b"")  # no word is empty


def spelling(lot: list[bytes]) -> np.ndarray:
    """Hashed letter-pair frequencies (64) of words, with marks for both ends, scaled to length 1."""
    sizes = np.fromiter(map(len, lot), np.int64, len(lot)) + 2
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in lot), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(lot)) * 64, sizes)
    at = owner[:-1] + ((flat[:-1] * 257 + flat[1:]) * 2654435761 >> 11 & 63)
    inside = np.ones(len(at), bool)
    inside[np.cumsum(sizes)[:-1] - 1] = False
    out = np.bincount(at[inside], minlength=64 * len(lot)).reshape(len(lot), 64).astype(np.float32)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def _directions() -> np.ndarray:
    """Fixed directions; without their means, as all frequencies are positive."""
    d = np.random.default_rng(11).standard_normal((SPELLINGS, 64)).astype(np.float32)
    d -= d.mean(axis=1, keepdims=True)
    return d / np.sqrt(np.einsum("ij,ij->i", d, d))[:, None]


DIRECTIONS = _directions()


def spelling_class(lot: list[bytes]) -> np.ndarray:
    out = [np.argmax(spelling(lot[a:z]) @ DIRECTIONS.T, axis=1) for a, z in groups([len(w) + 2 for w in lot], 1 << 17)]
    return np.concatenate(out).astype(np.uint8) if out else np.zeros(0, np.uint8)


def kinds_of(hashes: np.ndarray, spell: np.ndarray, heads: list[int]) -> np.ndarray:
    """The class of each word: heads in order, the end token, then spellings."""
    out = spell.astype(np.int64) + HEADS + 1
    for i, head in enumerate(heads):
        out[hashes == np.uint64(head)] = i
    out[hashes == np.uint64(END)] = HEADS
    return out


def part_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(5) & np.uint64(PARTS - 1)).astype(np.int64)


# ---- texts as numbers

CODED = "id long, held array<boolean>, doc_ids array<long>, sizes array<int>, hashes binary, spell binary, counts binary, codes binary"


def split_texts(text: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts (the empty one is the end token), the word number of every token, and the tokens of each text.

    Arrow's ASCII white space is the six separators; numbers follow falling frequency, so that they compress.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    coded = lists.flatten().dictionary_encode()
    found, lot = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist()
    end = lot.index(b"") if b"" in lot else len(lot)
    if end == len(lot):
        lot.append(b"")
    doc = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy())[found != end]
    found = found[found != end]
    codes = np.full(len(found) + len(text), end, np.int64)
    codes[np.arange(len(found)) + doc] = found
    order = np.argsort(-np.bincount(codes, minlength=len(lot)), kind="stable")
    rank = np.empty(len(lot), np.int64)
    rank[order] = np.arange(len(lot))
    return [lot[i] for i in order], rank[codes], np.bincount(doc, minlength=len(text)) + 1


def forget() -> None:
    """No cache outlives a task; ``forgetting`` then only gives Arrow's unused memory back."""


def pack(codes: np.ndarray) -> bytes:
    """Word numbers as four planes of bytes; the upper ones are mostly zero."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _encode(batches):
    serial = TaskContext.get().partitionId() << 32
    for b in slices(batches, "text", BATCH):
        held = b.column("held").to_pylist()
        lot, codes, sizes = split_texts(b.column("text"))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lot), np.uint64, len(lot))
        n = np.bincount(codes[np.repeat(~np.array(held, bool), sizes)], minlength=len(lot))
        row = [serial, held, b.column("doc_id").to_pylist(), sizes.tolist(), hashes.tobytes(), spelling_class(lot).tobytes(),
               n.astype(np.uint32).tobytes(), pack(codes)]
        types = [pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                         names=["id", "held", "doc_ids", "sizes", "hashes", "spell", "counts", "codes"])
        serial += 1


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _emit(names: list[str], columns: list[np.ndarray]):
    for a in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[a:a + (1 << 16)]) for c in columns], names=names)


def _training_counts(batches):
    for row in _rows(batches):
        n = np.frombuffer(row["counts"], np.uint32)
        own = n > 0
        yield from _emit(["word", "spell", "n"], [np.frombuffer(row["hashes"], np.int64)[own], np.frombuffer(row["spell"], np.uint8)[own].astype(np.int32),
                                                  n[own].astype(np.int64)])


def _entries(batches):
    for row in _rows(batches):
        hashes = np.frombuffer(row["hashes"], np.int64)
        yield from _emit(["id", "i", "word"], [np.full(len(hashes), row["id"]), np.arange(len(hashes), dtype=np.int32), hashes])


# ---- the two trained factors

def _bucket(keys: np.ndarray, which: int) -> np.ndarray:
    return (mix(keys * np.uint64(16) + np.uint64(which)) >> np.uint64(49)).astype(np.uint16)  # BUCKETS = 2 ** 15


def _history(word_hash: np.ndarray, kind: np.ndarray, doc: np.ndarray):
    """The two words and four classes before each token; histories end at the text's start."""
    def back(x, k, none):
        out = np.full(len(doc), none, np.uint64)
        if k < len(doc):
            np.copyto(out[k:], x[:-k], where=doc[k:] == doc[:-k])
        return out
    c = kind.astype(np.uint64)
    return back(word_hash, 1, 1), back(word_hash, 2, 1), *(back(c, k, CLASSES) for k in range(1, REACH + 1))


def features(word_hash: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(FEATURES, tokens) buckets of the history of each token, for its class."""
    w1, w2, c1, c2, c3, c4 = _history(word_hash, kind, doc)
    base = np.uint64(CLASSES + 1)
    return np.stack([_bucket(k, i) for i, k in enumerate((w1, w2, (c1 * base + c2) * base + c3, c3 * base + c4))])


def part_features(word_hash: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(3, tokens) buckets of the class and history of each token, for its part of the class."""
    w1, w2 = _history(word_hash, kind, doc)[:2]
    own = mix(kind.astype(np.uint64) + np.uint64(1))
    return np.stack([_bucket(own, 8), _bucket(w1 + own, 9), _bucket(w2 + own, 10)])


def _sums(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    s = np.take(weights, f[0], axis=0)
    for row in f[1:]:
        s += np.take(weights, row, axis=0)
    return np.clip(s, -40, 40, out=s)  # part of the model: exponentials stay in range


def log_softmax(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    s = _sums(weights, f)
    return s - np.log(np.exp(s) @ np.ones(s.shape[1], s.dtype))[:, None]


class Learner:
    """Mini-batch gradient ascent from given weights, with rates that fall with the squared gradients of a bucket (Adagrad by rows)."""

    def __init__(self, weights: np.ndarray):
        self.w, self.g2 = weights.copy(), np.full(len(weights), 1e-2, np.float32)

    def step(self, f: np.ndarray, target: np.ndarray) -> None:
        n = len(target)
        grad = _sums(self.w, f)
        np.exp(grad, out=grad)
        grad /= -(grad @ np.ones(grad.shape[1], np.float32))[:, None]
        grad[np.arange(n), target] += 1
        order = np.argsort(f, axis=None, kind="stable")  # a radix sort of 16-bit numbers
        flat = f.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        sums = np.add.reduceat(np.take(grad, order % n, axis=0), first, axis=0)
        rows, share = flat[first], 1 / np.diff(np.append(first, len(flat))).astype(np.float32)
        self.g2[rows] += np.einsum("ij,ij->i", sums, sums) * share
        sums *= (RATE * np.sqrt(share / self.g2[rows]))[:, None]
        self.w[rows] += sums

    def learn(self, f: np.ndarray, target: np.ndarray) -> None:
        for i in range(0, len(target), STEP):
            self.step(np.ascontiguousarray(f[:, i:i + STEP]), target[i:i + STEP])


def _pieces(n: int):
    """(slice with up to ``REACH`` tokens before it, their number) over ``n`` tokens."""
    for a in range(0, n, SLICE):
        lead = min(a, REACH)
        yield slice(a - lead, min(a + SLICE, n)), lead


def _train(shared, turn: int):
    def run(batches):
        heads, weights = shared.value
        kinds_model, parts_model, seen = Learner(weights[:BUCKETS]), Learner(weights[BUCKETS:]), 0
        for row in _rows(batches):
            mine = ~np.array(row["held"], bool) & (np.array([xxhash.xxh32_intdigest(str(d)) for d in row["doc_ids"]]) % ROUNDS == turn)
            doc = np.repeat(np.arange(len(mine)), row["sizes"])
            hashes = np.frombuffer(row["hashes"], np.uint64)
            kinds, parts = kinds_of(hashes, np.frombuffer(row["spell"], np.uint8), heads), part_of(hashes)
            pick = mine[doc]
            codes, doc = unpack(row["codes"])[pick], doc[pick]
            for s, lead in _pieces(len(codes)):
                h, kind = hashes[codes[s]], kinds[codes[s]]
                kinds_model.learn(features(h, kind, doc[s])[:, lead:], kind[lead:])
                spelt = np.flatnonzero(kind > HEADS)
                spelt = spelt[spelt >= lead]
                parts_model.learn(part_features(h, kind, doc[s])[:, spelt], parts[codes[s][spelt]])
            seen += len(codes)
        if seen:
            gain = (np.concatenate([kinds_model.w, parts_model.w]) - weights).astype(np.float16)
            for i in range(0, len(gain), GRID):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // GRID], pa.int32()), pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([seen], pa.int64()),
                     pa.array([gain[i:i + GRID].tobytes()], pa.binary())], names=["block", "salt", "seen", "gain"])
    return run


def _averaged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(GRID * CLASSES)
    for g, seen in zip(pdf["gain"], pdf["seen"]):
        total += np.frombuffer(g, np.float16).astype(np.float64) * seen  # the product passes the range of a half float
    seen = int(pdf["seen"].sum())
    return pd.DataFrame({"block": [key[0]], "seen": [seen], "gain": [(total / seen).astype(np.float16).tobytes()]})


def train(coded: DataFrame, heads: list[int]) -> np.ndarray:
    """Weights of the class model, then of the part model, after ``ROUNDS`` rounds."""
    weights = np.zeros((2 * BUCKETS, CLASSES), np.float32)
    sc = coded.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = sc.broadcast((heads, weights))
        kind = "block int, seen long, gain binary"
        steps = coded.select("held", "doc_ids", "sizes", "hashes", "spell", "codes").mapInArrow(forgetting(_train(shared, turn), forget), "block int, salt int, seen long, gain binary")
        means = steps.groupBy("block", "salt").applyInPandas(_averaged, kind).groupBy("block").applyInPandas(_averaged, kind)
        for r in means.collect():  # 2 x BUCKETS x CLASSES weights
            at = slice(r["block"] * GRID, (r["block"] + 1) * GRID)
            weights[at] = weights[at] + np.frombuffer(r["gain"], np.float16).reshape(GRID, CLASSES)
        shared.unpersist()
    return weights


# ---- scoring

def _score(shared):
    def run(batches):
        heads, weights, n_all, v_all, n_part, v_part = shared.value
        bottom = n_all + ADD * (v_all + 1)
        for b in batches:
            for j in range(b.num_rows):
                one = b.slice(j, 1)
                i, n = (one.column(c).flatten().to_numpy() for c in ("i", "c"))
                row = one.drop_columns(["i", "c"]).to_pylist()[0]
                hashes, codes = np.frombuffer(row["hashes"], np.uint64), unpack(row["codes"])
                kinds, parts = kinds_of(hashes, np.frombuffer(row["spell"], np.uint8), heads), part_of(hashes)
                texts = len(row["sizes"])
                doc = np.repeat(np.arange(texts), row["sizes"])
                c = np.zeros(len(hashes))
                c[i] = n
                base = np.log10((c + ADD) / bottom)
                inside = np.where(kinds > HEADS, np.log10((c + ADD) / (n_part[kinds, parts] + ADD * (v_part[kinds, parts] + 1))), 0)
                score = np.bincount(doc, weights=inside[codes], minlength=texts)
                for s, lead in _pieces(len(codes)):
                    h, kind, d = hashes[codes[s]], kinds[codes[s]], doc[s]
                    f, g = features(h, kind, d), part_features(h, kind, d)
                    for a in range(lead, len(kind), STEP):
                        k, own = kind[a:a + STEP], d[a:a + STEP]
                        log = log_softmax(weights[:BUCKETS], f[:, a:a + STEP])[np.arange(len(k)), k]
                        spelt = np.flatnonzero(k > HEADS)
                        log[spelt] += log_softmax(weights[BUCKETS:], g[:, a + spelt])[np.arange(len(spelt)), parts[codes[s][a + spelt]]]
                        score += np.bincount(own, weights=log / np.log(10), minlength=texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.array(row["sizes"], np.int64)),
                     pa.array(np.bincount(doc, weights=c[codes] > 0, minlength=texts).astype(np.int64)), pa.array([int(n_all)] * texts, pa.int64()),
                     pa.array(np.bincount(doc, weights=base[codes], minlength=texts)), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 10) == 0).alias("held"), F.col("text").cast("string").alias("text"))
    coded = written(rows.mapInArrow(forgetting(_encode, forget), CODED), "coded-texts")
    tallies = coded.select("hashes", "spell", "counts").mapInArrow(_training_counts, "word long, spell int, n long")
    counts = written(tallies.groupBy("word").agg(F.sum("n").alias("c"), F.max("spell").alias("spell")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end = int(np.uint64(END).astype(np.int64))
    signed = [r["word"] for r in counts.where(F.col("word") != end).orderBy(F.desc("c"), "word").limit(HEADS).collect()]
    heads = [w & 0xFFFFFFFFFFFFFFFF for w in signed]
    part = F.shiftrightunsigned("word", 5).bitwiseAND(PARTS - 1)
    spelt = counts.where(~F.col("word").isin([end, *signed])).groupBy((F.col("spell") + HEADS + 1).alias("kind"), part.alias("part"))
    n_part, v_part = np.zeros((2, CLASSES, PARTS))
    for r in spelt.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # SPELLINGS x PARTS rows
        n_part[r["kind"], r["part"]], v_part[r["kind"], r["part"]] = r["n"], r["v"]
    weights = train(coded, heads)
    shared = sc.broadcast((heads, weights, total["n"], total["v"], n_part, v_part))
    entries = coded.select("id", "hashes").mapInArrow(_entries, "id long, i int, word long")
    found = entries.join(counts.select("word", "c"), "word").groupBy("id").agg(F.collect_list("i").alias("i"), F.collect_list("c").alias("c"))  # the words of one batch, both lists in one order
    rows = coded.drop("counts").join(found, "id", "left").withColumns(
        {"i": F.coalesce("i", F.array().cast("array<int>")), "c": F.coalesce("c", F.array().cast("array<bigint>"))})
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
