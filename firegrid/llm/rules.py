"""Quality rules with thresholds read from mergeable quantile sketches per language and source.

1. ``measured`` derives counts of each whole text with built-in functions only.
2. Four rates (``RATES``, whole numbers per mille) of each document go to a log-linear histogram: rates below 64 have a
   bucket each, larger ones share a bucket with those of the same six leading bits, so a bucket is at most 1/32 wide. A
   sketch is a set of (bucket, count) rows, and adding counts merges sketches exactly, in any order and with repeatable
   results. Sketches of (language, source) merge to those of a language, and these to one of all documents.
3. A group of at least ``LEAST`` documents uses its own sketch; a smaller one uses its language's, or that of all.
   A rate is an outlier above q75 + ``REACH`` * max(q75 - q25, spread), for word length also below q25 - the same.
4. Statistics meet the fences of their (language, source) in a join, and a document with an outlier is not kept.

Defined cases: a null text is empty; it has zero counts and fails the base rule. Null languages and sources are groups of their
own. Texts without words enter no sketch. Repeated rows give repeated results and count repeatedly. An empty table gives
an empty one. Other columns are ignored by ``judge`` and kept by ``keep``. Windows of words are compared by 64-bit hashes.

Scale: texts are read once and never shuffled; the statistics are written, then aggregated map-side to at most about 1,300 buckets a
group and rate. The join moves numbers only, and its key is salted, so that a hot source is spread over ``SALTS`` tasks
where the planner does not broadcast the fences. Nothing reaches the driver and no Python runs in any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.llm.common import SEPARATORS, let, n_words, word_array
from firegrid.session import written

LEAST, REACH, SALTS = 200, 3, 16
SYMBOLS = "#*$%&|<>"

#: rate: (numerator, denominator, least spread, whether low rates are outliers too)
RATES = {"word_length": ("word_chars", "n_words", 500, True), "symbol_rate": ("n_symbols", "n_words", 50, False),
         "dup_line_rate": ("n_dup_lines", "n_lines", 150, False), "repeat_rate": ("n_repeat_words", "n_words", 100, False)}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _covered(windows: Column) -> Column:
    """Words inside windows of three whose hash occurs twice or more: sort (hash, place), keep places with an equal neighbour."""
    def places(s):
        twin = F.filter(s, lambda x, i: (F.get(s, i - 1)["0"].eqNullSafe(x["0"])) | (F.get(s, i + 1)["0"].eqNullSafe(x["0"])))
        return F.sort_array(F.transform(twin, lambda x: x["1"]))

    def total(p):
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    pairs = F.sort_array(F.arrays_zip(windows.alias("0"), F.sequence(F.lit(0), F.size(windows) - 1).alias("1")))
    return let(let(pairs, places), total)


def repeat_words(text: Column) -> Column:
    """Number of words in 3-word windows that are found twice or more in the text, the first find included."""
    def of_words(w):
        last = F.size(w) - 3
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
        return F.when(last < 1, 0).otherwise(counted)

    return let(word_array(text), of_words)


def measured(text: str = "text") -> dict[str, Column]:
    """Counts of a whole text; null counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0)
    return {
        "n_words": n_words(text), "word_chars": _without(t, SEPARATORS).cast("long"),
        "n_symbols": (F.length(t) - _without(t, SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(t).cast("long"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Whole per mille; null without words."""
    return {k: F.when(F.col(of) > 0, F.expr(f"1000 * {part} div {of}")) for k, (part, of, _, _) in RATES.items()}


def bucket(v: str) -> Column:
    """The least value of the bucket that holds ``v``: its six leading bits are kept."""
    bits = f"greatest(length(bin({v})) - 6, 0)"
    return F.expr(f"shiftleft(shiftright({v}, {bits}), {bits})")


def sketches(stats: DataFrame) -> DataFrame:
    """level, lang, source, rate, at, n: level 2 is a (language, source), 1 a language, 0 all documents."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), c.alias("v")) for k, c in rates().items())))
    rows = stats.select("lang", "source", pairs.alias("p")).select("lang", "source", "p.*").where("v IS NOT NULL")
    own = rows.select("lang", "source", "rate", bucket("v").alias("at")).groupBy("lang", "source", "rate", "at").agg(F.count(F.lit(1)).alias("n"))
    text = F.lit(None).cast("string")
    by_lang = own.groupBy("lang", "rate", "at").agg(F.sum("n").alias("n"))
    everything = by_lang.groupBy("rate", "at").agg(F.sum("n").alias("n"))
    return own.select(F.lit(2).alias("level"), "lang", "source", "rate", "at", "n").union(
        by_lang.select(F.lit(1), "lang", text, "rate", "at", "n")).union(everything.select(F.lit(0), text, text, "rate", "at", "n"))


def fences(sketch: DataFrame) -> DataFrame:
    """level, lang, source, and per rate its lower and upper fence, of every sketch."""
    group = Window.partitionBy("level", "lang", "source", "rate")
    counted = sketch.withColumn("upto", F.sum("n").over(group.orderBy("at"))).withColumn("all", F.sum("n").over(group))
    quantile = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("at")))
    q = counted.groupBy("level", "lang", "source", "rate").agg(quantile(25).alias("q25"), quantile(75).alias("q75"))
    spread = F.create_map(*(F.lit(x) for k, r in RATES.items() for x in (k, r[2])))[F.col("rate")]
    reach = REACH * F.greatest(F.col("q75") - F.col("q25"), spread)
    two_sided = F.col("rate").isin([k for k, r in RATES.items() if r[3]])
    q = q.withColumn("low", F.when(two_sided, F.col("q25") - reach).otherwise(F.lit(0))).withColumn("high", F.col("q75") + reach)
    of = lambda k, c: F.max(F.when(F.col("rate") == k, F.col(c))).alias(f"{k}_{c}")
    return q.groupBy("level", "lang", "source").agg(*(of(k, c) for k in RATES for c in ("low", "high")))


def thresholds(stats: DataFrame) -> DataFrame:
    """lang, source and fences of each group of documents, from the finest sketch of at least ``LEAST`` documents."""
    sketch = written(sketches(stats), "quality-sketches")
    size = sketch.where("rate = 'word_length'").groupBy("level", "lang", "source").agg(F.sum("n").alias("n"))
    langs = size.where("level = 1").select(F.col("lang").alias("l"), F.col("n").alias("lang_n"))
    own = size.where("level = 2").join(langs, F.col("lang").eqNullSafe(F.col("l")), "left")
    level = F.when(F.col("n") >= LEAST, 2).when(F.col("lang_n") >= LEAST, 1).otherwise(0)
    chosen = own.select("lang", "source", level.alias("use")).select(
        "lang", "source", "use", F.when(F.col("use") > 0, F.col("lang")).alias("use_lang"), F.when(F.col("use") > 1, F.col("source")).alias("use_source"))
    f = fences(sketch).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    same = (F.col("use") == F.col("level")) & F.col("use_lang").eqNullSafe(F.col("f_lang")) & F.col("use_source").eqNullSafe(F.col("f_source"))
    return chosen.join(f, same).select("lang", "source", F.col("use").alias("sketch_level"), *(f"{k}_{c}" for k in RATES for c in ("low", "high")))


def _judged(stats: DataFrame) -> DataFrame:
    """The rows of ``stats`` with base_failed and kept."""
    limits = thresholds(stats).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    limits = limits.withColumnsRenamed({"lang": "f_lang", "source": "f_source", "salt": "f_salt"})
    rows = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)).cast("int"))
    same = (F.col("salt") == F.col("f_salt")) & F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    inside = F.lit(True)
    for k, c in rates().items():
        inside = inside & F.coalesce(c.between(F.col(f"{k}_low"), F.col(f"{k}_high")), F.lit(True))
    return rows.join(limits, same, "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and counts of every row, written to the shared folder."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                      F.col("source").cast("string").alias("source"), *(c.alias(k) for k, c in measured().items()))
    return written(own, "quality-counts")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the level of the sketch that decided, for each row of ``docs``."""
    return _judged(statistics(docs)).select("doc_id", *COUNTS, "base_failed", "kept", "n_lines", "sketch_level")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                      F.col("source").cast("string").alias("source"), *(c.alias(k) for k, c in measured().items()))
    return _judged(written(own, "quality-counts")).where("kept").select("row.*")
