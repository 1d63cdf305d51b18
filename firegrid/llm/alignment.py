"""Alignment of two tokenizers: token pairs that overlap, counted over the corpus by inverted pair bitmaps.

1. Both tokenizers encode every whole text. A text is cut before blanks that are followed by a letter, digit or mark and not preceded by a blank;
   both tokenizers have a token border there, so a piece is encoded once a task and looked up afterwards.
   Common token ends cut a piece into groups; tokens whose byte ranges overlap are linked.
2. Documents are taken in blocks of about ``BLOCK`` bytes of text. Each block gives, for each pair of ids linked in it, a
   compressed bitmap of its documents: their numbers in the block, two bytes each, or a bit set once that is
   smaller. How often a document links the pair, less one, is kept in further bitmaps, one a binary digit (the
   multiplicity planes). The bitmap of a pair over the corpus is the union (OR) of those of its blocks.
3. Popcounts give a pair's documents, and with the planes its links; their sums over blocks are the corpus counts.
4. Counts return through the postings: each block reads them for its pairs and adds them up per document in its bitmaps.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens. Repeated rows and
ids count once a row. An empty table gives an empty one. Other columns are ignored. A long text may be a block of its own.

Scale: texts are read once and never shuffled. What is shuffled is a row per (pair, block), about two bytes a document and pair
inside it, with counts combined map-side. A pair of every document has one row a block, so no key is
larger than the number of blocks, and a block is bounded by its texts. Every step starts from a written table.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import slices
from firegrid.session import written

BLOCK, CACHE = 12 << 20, 150_000
BLANK = "▁"
_FIELDS = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                     ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()),
                     ("docs_with", pa.int64()), ("links", pa.int64()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary()))])
SHARED = ("block long, size int, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "a int, b int, docs_with long, links long, docs binary, planes array<binary>")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _loaded(path_a: str, path_b: str):
    """Encoders of lists of pieces (with their blank) to ids, the bytes of each id, and the two generations of the cache."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = _byte_letters()
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) if all(c in letters for c in a.id_to_token(i)) else b""
               for i in range(a.get_vocab_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(BLANK, " ").encode()
               for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    encode_a = lambda xs: [e.ids for e in a.encode_batch(xs, add_special_tokens=False)]
    encode_b = lambda xs: b.encode([x[1:] for x in xs], num_threads=1)
    return encode_a, encode_b, bytes_a, bytes_b, [{}, {}]


def pieces(text: str) -> list[str]:
    """The text, after one blank, cut before each blank that no blank precedes and no white space or end follows."""
    parts = text.split(" ")
    if all(parts) and not any(p[0].isspace() for p in parts):
        return parts
    out = [parts[0]]
    for i in range(1, len(parts)):
        p = parts[i]
        # the text before this blank ends in a blank if its part is empty (the first part follows the added blank)
        if p and not p[0].isspace() and parts[i - 1]:
            out.append(p)
        else:
            out[-1] += " " + p
    return out


def align_piece(ids_a: list[int], ids_b: list[int], sizes_a: list[int], sizes_b: list[int]) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Groups ([A ids], [B ids]) between common ends, and the pairs of overlapping tokens, of two tokenizations of the same bytes."""
    groups, links = [], []
    i = j = end_a = end_b = first_a = first_b = 0
    if ids_a:
        end_a, end_b = sizes_a[0], sizes_b[0]
    while i < len(ids_a):
        links.append((ids_a[i], ids_b[j]))
        if end_a == end_b:
            i, j = i + 1, j + 1
            groups.append((ids_a[first_a:i], ids_b[first_b:j]))
            first_a, first_b = i, j
            if i < len(ids_a):
                end_a, end_b = end_a + sizes_a[i], end_b + sizes_b[j]
        elif end_a < end_b:
            i += 1
            end_a += sizes_a[i]
        else:
            j += 1
            end_b += sizes_b[j]
    return groups, links


def _entries(todo: list[str], paths: tuple[str, str]) -> list[tuple | None]:
    """(A tokens, B tokens, groups, pairs, groups as text) of pieces; None if a tokenizer does not give the bytes back."""
    encode_a, encode_b, bytes_a, bytes_b, _ = _loaded(*paths)
    out = []
    for i in range(0, len(todo), 4096):
        lot = [" " + p for p in todo[i:i + 4096]]
        for piece, a, b in zip(lot, encode_a(lot), encode_b(lot)):
            parts_a, parts_b, whole = [bytes_a[x] for x in a], [bytes_b[x] for x in b], piece.encode()
            if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
                out.append(None)
                continue
            groups, links = align_piece(a, b, [len(x) for x in parts_a], [len(x) for x in parts_b])
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            out.append((len(a), len(b), len(groups), np.array([x << 32 | y for x, y in links], np.int64).tobytes(), text))
    return out


def _known(texts: list[str], paths: tuple[str, str]) -> tuple[list[list[int]], list[tuple | None]]:
    """Numbers of the pieces of each text, and the entry of each number."""
    generations = _loaded(*paths)[4]
    number: dict[str, int] = {}
    rows = [[number.setdefault(p, len(number)) for p in pieces(t)] if t else [] for t in texts]
    young, old = generations
    entries = [young.get(p, 0) or old.get(p, 0) for p in number]
    names = list(number)
    missing = [i for i, e in enumerate(entries) if e == 0]
    for i, e in zip(missing, _entries([names[i] for i in missing], paths)):
        entries[i] = e
    if len(young) + len(number) > CACHE:
        generations[:] = [{}, young]
    generations[0].update(zip(names, entries))
    return rows, entries


def containers(group: np.ndarray, place: np.ndarray, n: int, size: int) -> pa.Array:
    """A compressed bitmap for each of ``n`` groups; ``group`` is sorted, ``place`` rises within a group and is below ``size``."""
    count = np.bincount(group, minlength=n)
    bits = (size + 7) // 8 + 1  # longer than any list of numbers, so that a reader can tell them apart
    dense = 2 * count >= bits
    width = np.where(dense, bits, 2 * count)
    offsets = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(offsets[-1], np.uint8)
    first = np.concatenate([[0], np.cumsum(count)])
    sparse = ~dense[group]
    at = offsets[group[sparse]] + 2 * (np.flatnonzero(sparse) - first[group[sparse]])
    out[at], out[at + 1] = place[sparse] & 255, place[sparse] >> 8
    for g in np.flatnonzero(dense):
        flags = np.zeros(8 * bits, np.uint8)
        flags[place[first[g]:first[g + 1]]] = 1
        out[offsets[g]:offsets[g + 1]] = np.packbits(flags, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def members(bitmaps: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap number, place) of every set bit; ``size`` is the number of places of each bitmap's block."""
    offsets = np.frombuffer(bitmaps.buffers()[1], np.int32)[bitmaps.offset:bitmaps.offset + len(bitmaps) + 1].astype(np.int64)
    data = np.frombuffer(bitmaps.buffers()[2] or b"", np.uint8)
    width = np.diff(offsets)
    dense = width > (size + 7) // 8
    n = np.where(dense, 0, width // 2)
    row = np.repeat(np.arange(len(n)), n)
    at = offsets[row] + 2 * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    rows, places = [row], [data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8]
    for i in np.flatnonzero(dense):
        on = np.flatnonzero(np.unpackbits(data[offsets[i]:offsets[i + 1]], bitorder="little"))
        rows.append(np.full(len(on), i))
        places.append(on)
    return np.concatenate(rows), np.concatenate(places)


def _postings(rows: list[list[int]], entries: list[tuple | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, document, links) of a block, sorted; a pair is A id << 32 | B id."""
    D, E = len(rows), len(entries)
    doc = np.repeat(np.arange(D), [len(r) for r in rows])
    seen, times = np.unique(doc * E + np.fromiter((e for r in rows for e in r), np.int64, len(doc)), return_counts=True)
    doc, entry = seen // max(E, 1), seen % max(E, 1)
    n = np.array([len(e[3]) // 8 if e else 0 for e in entries], np.int64)
    flat = np.frombuffer(b"".join(e[3] for e in entries if e), np.int64)
    codes, flat = np.unique(flat, return_inverse=True)
    start = np.cumsum(n) - n
    each = n[entry]
    links = flat[np.repeat(start[entry], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
    key = links * D + np.repeat(doc, each)
    order = np.argsort(key, kind="stable")
    key, times = key[order], np.repeat(times, each)[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return codes[key[first] // D], key[first] % D, np.add.reduceat(times, first) if len(first) else first


def _block(block: int, ids: list, texts: list[str | None], paths: tuple[str, str]):
    """Record batches of one block: its documents, then a row for each pair."""
    rows, entries = _known([t or "" for t in texts], paths)
    whole = [bool(r) and all(entries[e] for e in set(r)) for r in rows]
    rows = [r if w else [] for r, w in zip(rows, whole)]
    sums = np.array([[e[0], e[1], e[2], len(e[3]) // 8] if e else [0, 0, 0, 0] for e in entries] or [[0] * 4], np.int64)
    totals = np.array([sums[r].sum(axis=0) if r else [0] * 4 for r in rows], np.int64).reshape(-1, 4)
    shas = [hashlib.sha256(";".join([entries[e][4] for e in r]).encode()).hexdigest() if r else "" for r in rows]
    D = len(rows)
    columns = {"block": pa.array([block] * D, pa.int64()), "size": pa.array([D] * D, pa.int32()), "place": pa.array(range(D), pa.int32()),
               "doc_id": pa.array(ids, pa.int64()), "groups_sha256": pa.array(shas, pa.string())}
    columns |= {k: pa.array(totals[:, i]) for i, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    yield _batch(columns, D)
    pair, doc, links = _postings(rows, entries)
    codes, row = np.unique(pair, return_inverse=True)
    n = len(codes)
    more, digits = links - 1, np.zeros(n, np.int64)
    if n:
        most = np.maximum.reduceat(more, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
        while (most >> digits).any():
            digits += (most >> digits) > 0
    first = np.concatenate([[0], np.cumsum(digits)])
    held = [(first[row[on]] + k, doc[on]) for k in range(int(digits.max(initial=0))) for on in [np.flatnonzero(more >> k & 1)]]
    plane, at = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
    order = np.argsort(plane, kind="stable")
    planes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), containers(plane[order], at[order], int(first[-1]), D))
    columns = {"block": pa.array(np.full(n, block)), "size": pa.array(np.full(n, D, np.int32)), "a": pa.array((codes >> 32).astype(np.int32)),
               "b": pa.array((codes & 0xFFFFFFFF).astype(np.int32)), "docs_with": pa.array(np.bincount(row, minlength=n)),
               "links": pa.array(np.bincount(row, links, n).astype(np.int64)), "docs": containers(row, doc, n, D), "planes": planes}
    whole_batch = _batch(columns, n)
    for i in range(0, n, 50_000):
        yield whole_batch.slice(i, 50_000)


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _FIELDS], schema=_FIELDS)


def _index(paths: tuple[str, str]):
    def index(batches):
        block = TaskContext.get().partitionId() << 32
        for b in slices(batches, "text", BLOCK):
            yield from _block(block, b.column("doc_id").to_pylist(), b.column("text").to_pylist(), paths)
            block += 1
    return index


def build_index(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """The written index: a row for each document (``a`` null), and for each pair of ids in each block."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(own.mapInArrow(_index(tokenizers or default_tokenizers()), SHARED), "pair-index")


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links over the corpus, and whether no other A id is linked with b more often."""
    counts = index.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("docs_with").alias("n_docs"), F.sum("links").alias("n_links"))
    counts = written(counts, "pair-counts")
    best = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return counts.join(best, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def _scores(table: pa.Table) -> pa.Table:
    """Counts of a block's pairs added up per document."""
    table = table.combine_chunks()
    size = int(table["size"][0].as_py())
    out = np.zeros((size, 2), np.int64)
    value = np.stack([table["n_links"].to_numpy(), table["best"].to_numpy().astype(np.int64)], axis=1)
    row, place = members(table["docs"].chunk(0), np.int64(size))
    np.add.at(out, place, value[row])
    planes = table["planes"].chunk(0)
    depth = np.diff(planes.offsets.to_numpy())
    owner = np.repeat(np.arange(len(depth)), depth)
    digit = np.arange(len(owner)) - np.repeat(np.cumsum(depth) - depth, depth)
    bitmap, place = members(planes.flatten(), np.int64(size))
    np.add.at(out, place, value[owner[bitmap]] << digit[bitmap, None])
    block = table["block"][0].as_py()
    return pa.table({"block": pa.array([block] * size, pa.int64()), "place": pa.array(range(size), pa.int32()),
                     "count_sum": pa.array(out[:, 0]), "n_best": pa.array(out[:, 1])})


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """Token, group and link counts and the corpus scores of each row (doc_id, text)."""
    index = build_index(docs, tokenizers)
    lists = index.where("a IS NOT NULL").select("block", "size", "a", "b", "docs", "planes")
    # the counts grow with the corpus, so both sides are shuffled at every size
    counted = lists.join(pair_counts(index).select("a", "b", "n_links", "best").hint("merge"), ["a", "b"])
    scores = counted.groupBy("block").applyInArrow(_scores, "block long, place int, count_sum long, n_best long")
    own = index.where("a IS NULL").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return own.join(scores, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
