"""Helpers shared by the corpus operators.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; only A-Z is lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\f\r"


def ascii_lower(c) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def fold(key, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text (null: none). ``bytes.split`` cuts at exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """The words of a whole text in order."""
    return F.array_remove(F.split(F.translate(text, SEPARATORS, " " * len(SEPARATORS)), " "), "")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row."""
    return F.transform(F.array(value), then)[0]


def slices(batches, column: str, limit: int):
    """Record batches whose texts in ``column`` add up to about ``limit`` bytes at most, one row at least."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
        for a, z in groups([n + 16 for n in sizes], limit):
            yield b.slice(a, z - a)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive items whose lengths add up to about ``limit`` at most."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def cut(texts: list, limit: int, overlap: int) -> Iterator[tuple[int, object, bool, bool]]:
    """(item, piece, is first, is last): long texts in pieces that share ``overlap`` symbols with the next one."""
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - overlap, 1), limit):
            yield i, t[at:at + limit + overlap], at == 0, at + limit + overlap >= len(t)


def forgetting(task, forget):
    """The mapper ``task``, which at its end calls ``forget`` and gives unused memory back: a Python worker lives on beside later stages.

    ``forget`` is a function of a module, so that it reaches the module's own cache in the worker.
    """
    def run(batches):
        try:
            yield from task(batches)
        finally:
            forget()
            pa.default_memory_pool().release_unused()
    return run


def records_per_batch(df: DataFrame, n: int) -> None:
    """Bound the rows that a Python worker holds at once; texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
