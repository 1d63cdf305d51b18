"""Token-id output with Elias-Fano document boundaries.

``write_ids`` tokenises texts in ascending document order and writes segments: one concatenated id array
(little-endian, two bytes an id if the vocabulary fits) and the end of each document in Elias-Fano form. Of n
ends below u, the low log2(u/n) bits are packed and the rest is a unary bit vector, about 2 + log2(u/n) bits a
document in place of 64. The position of every ``STEP``-th one bit is kept, so ``Segment.end`` (a select) reads
one sample and at most a few bytes. Segments are rows of a Parquet table, so Spark's commit protocol covers lost executors and any store
that Spark reaches can hold them. ``read_ids`` decodes them.

Defined cases: null text is empty; an empty text is its end id alone. A null id sorts first. Repeated ids keep one entry a row,
in an unspecified order among equal rows. An empty table gives an empty id table. Other columns are ignored.

Scale: one range shuffle of (id, text). A segment closes at ``SEGMENT`` ids; a longer document is a
segment of its own. Offsets come from one sum per shard, so no task sees more than its shard.
"""

from __future__ import annotations

import os
import zlib
from functools import cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firegrid.llm.common import slices
from firegrid.session import scratch_path

END, SEGMENT, STEP, CACHE, BATCH = 1, 1 << 20, 64, 300_000, 8 << 20
SCHEMA = "shard int, seq int, n_docs long, n_ids long, width int, low_bits int, doc_ids array<long>, ids binary, low binary, high binary, samples binary"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Segment:
    """Ends of documents in Elias-Fano form."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, ends: np.ndarray) -> "Segment":
        n, u = len(ends), int(ends[-1]) + 1 if len(ends) else 1
        low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        ends = ends.astype(np.uint64)
        bits = ((ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.reshape(-1), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), ones[::STEP].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at, out = i * self.low_bits, 0
        for b in range(self.low_bits):
            out |= int(self.low[(at + b) >> 3] >> ((at + b) & 7) & 1) << b
        return out

    def end(self, i: int) -> int:
        """The i-th end: select of the i-th one bit from the nearest sample, and its low bits."""
        at, left = int(self.samples[i // STEP]), i % STEP
        byte, bits = at >> 3, int(self.high[at >> 3]) >> (at & 7) << (at & 7)
        while left >= (c := bits.bit_count()):
            left -= c
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        one = 8 * byte + (bits & -bits).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def ends(self) -> np.ndarray:
        """All ends at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        low = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.low_bits) + (low << np.arange(self.low_bits)).sum(axis=1)


@cache
def _loaded(path: str):
    """The tokenizer, whether its ids fit two bytes, and the two generations of its cache."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    return tok, tok.get_vocab_size() <= 1 << 16, [{}, {}]


@cache
def _border(path: str) -> tuple[str, int] | None:
    """A special token, with its id, that parts pieces inside one string; None unless pieces between blanks are tokenised alone.

    The pre-tokenizer must drop white space; the probe compares whole texts, single pieces and pieces joined by the special token.
    """
    tok = _loaded(path)[0]
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    probe = ["a", "it's", "12", "é", "x-y.", "ab", "İ.", "İ", "A\u030a!", "ΑΣ", "ſt|"]
    alone = [i for p in probe for i in ids(p)]
    for i, t in tok.get_added_tokens_decoder().items():
        if t.special and ids("  ".join(probe) + "\n") == alone and [x for x in ids(t.content.join(probe)) if x != i] == alone:
            return t.content, i
    return None


@cache
def _word_ends(path: str) -> np.ndarray:
    """Whether an id ends a word."""
    tok = _loaded(path)[0]
    return np.array([(tok.id_to_token(i) or "").endswith("</w>") for i in range(tok.get_vocab_size())])


def _cut(ids: np.ndarray, starts: list[int], ends: list[int]) -> list[bytes]:
    data, w = ids.tobytes(), ids.itemsize
    return [data[a * w:z * w] for a, z in zip(starts, ends)]


def _encode_pieces(pieces: list[str], path: str) -> list[bytes]:
    """Ids of pieces as bytes, many in one string.

    Words of letters are parted by blanks and give one word-end id each; others by a special token that none of them holds.
    """
    tok, narrow, _ = _loaded(path)
    (mark, mark_id), kind, out = _border(path), "<u2" if narrow else "<u4", {}
    encode = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, kind)
    letters = [p for p in pieces if p.isalpha()]
    others = [p for p in pieces if not p.isalpha()]
    for i in range(0, len(letters), 256):
        lot = letters[i:i + 256]
        ids = encode(" ".join(lot))
        ends = (np.flatnonzero(_word_ends(path)[ids]) + 1).tolist()
        if len(ends) == len(lot):
            out.update(zip(lot, _cut(ids, [0, *ends[:-1]], ends)))
        else:  # marks among the letters, once normalised
            others += lot
    for i in range(0, len(others), 256):
        lot = others[i:i + 256]
        ids = encode(mark.join(lot))
        cuts = np.flatnonzero(ids == mark_id).tolist()
        if len(cuts) == len(lot) - 1:
            out.update(zip(lot, _cut(ids, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)])))
        else:  # a piece holds the special token itself
            out.update((p, encode(p).tobytes()) for p in lot)
    return [out[p] for p in pieces]


def _two(piece: str) -> tuple[str, ...]:
    """A piece, or a word of letters and the full stop, comma, exclamation mark or bar after it, which is a token of its own."""
    low = piece.lower() if piece.isascii() else piece
    word = low[:-1]
    if word and low[-1] in ".,!|" and word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha()):
        return word, low[-1]
    return (low,)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts as bytes, without the end id. Ids of a piece between blanks are looked up, then computed.

    The cache has two generations: what the young one lacks is taken over from the old one, so frequent pieces are never computed again.
    """
    tok, narrow, _ = _loaded(path)
    if not _border(path):
        kind = "<u2" if narrow else "<u4"
        return [np.array(e.ids, kind).tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    kind = np.dtype("<u2" if narrow else "<u4")
    plain = []
    for t in texts:
        for c in "\n\t\r\x0b\x0c":  # other white space is left to the tokenizer
            t = t.replace(c, " ")
        plain.append(t)
    lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    data, starts, sizes = _looked_up(coded.dictionary.to_pylist(), path, kind)
    piece = coded.indices.to_numpy()
    n = sizes[piece]
    ends = np.cumsum(n)
    ids = data[np.repeat(starts[piece] - (ends - n), n) + np.arange(n.sum())].tobytes()
    cuts = (np.concatenate([[0], ends])[lists.offsets.to_numpy()] * kind.itemsize).tolist()
    return [ids[a:z] for a, z in zip(cuts, cuts[1:])]


def _looked_up(pieces: list[str], path: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all pieces in one array, and where those of each piece start and how many they are."""
    generations = _loaded(path)[2]
    if len(generations[0]) > CACHE:
        generations[:] = [{}, generations[0]]
    young, old = generations
    blobs = [young.get(p) for p in pieces]
    missing: dict[str, tuple] = {}
    for p in (p for p, v in zip(pieces, blobs) if v is None):
        if p in old:
            young[p] = old[p]
        else:
            missing[p] = _two(p)
    parts = {x: young.get(x) or old.get(x) for v in missing.values() for x in v}
    todo = [x for x, v in parts.items() if v is None]
    parts.update(zip(todo, _encode_pieces(todo, path)))
    young.update(parts)
    for p, v in missing.items():
        young[p] = b"".join([parts[x] for x in v])
    blobs = [young[p] if v is None else v for p, v in zip(pieces, blobs)]
    sizes = np.array([len(v) for v in blobs], np.int64) // kind.itemsize
    return np.frombuffer(b"".join(blobs), kind), np.cumsum(sizes) - sizes, sizes


def _segments(path: str, end: int):
    def encode(batches):
        shard, seq = TaskContext.get().partitionId(), 0
        docs, blobs, size = [], [], 0
        width = 2 if _loaded(path)[1] else 4
        stop = int(end).to_bytes(width, "little")

        def flush():
            nonlocal seq, docs, blobs, size
            s = Segment.of(np.cumsum([len(b) // width for b in blobs]))
            row = [[shard], [seq], [len(docs)], [size], [width], [s.low_bits], [docs], [b"".join(blobs)], [s.low.tobytes()],
                   [s.high.tobytes()], [s.samples.tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            seq, docs, blobs, size = seq + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)],
                                              names=["shard", "seq", "n_docs", "n_ids", "width", "low_bits", "doc_ids", "ids", "low", "high", "samples"])

        for b in slices(batches, "text", BATCH):
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, blob in zip(b.column("doc_id").to_pylist(), encode_texts(texts, path)):
                n = len(blob) // width + 1
                if docs and size + n > SEGMENT:
                    yield flush()
                docs.append(doc)
                blobs.append(blob + stop)
                size += n
        if docs:
            yield flush()
    return encode


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> str:
    """Write the ids of ``docs`` (doc_id, text) as segments below ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(
        _segments(tokenizer or default_tokenizer(), end), SCHEMA).write.mode("error").parquet(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the segments below ``path``."""
    segments = spark.read.schema(SCHEMA).parquet(path)

    def decode(batches):
        for b in batches:
            for r in (row for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist()):
                ids = np.frombuffer(r["ids"], "<u2" if r["width"] == 2 else "<u4")
                ends = Segment(r["n_docs"], r["low_bits"], r["low"], r["high"], r["samples"]).ends()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["seq"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                     pa.array(starts.astype(np.int64)), pa.array((ends - starts).astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["shard", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = segments.mapInArrow(decode, "shard int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))  # one row a shard
    inside = segments.select("shard", "seq", F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("seq_start"))
    bases = inside.join(shards, "shard").select("shard", "seq", (F.col("shard_start") + F.col("seq_start")).alias("base"))
    return rows.join(bases, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of all rows to the shared folder and read them back."""
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, scratch_path(spark, "token-ids"), tokenizer))
