"""Chat formatting by cumulative-snapshot collapse, in DataFrame operations only.

A log holds a conversation again each time it grew. A turn's rolling hash stands for all turns
up to it; a conversation whose last hash is the hash of a proper prefix of another one is a
snapshot and is dropped by an anti-join, before anything is rendered.

Defined cases: repeated rows count once. Turns are ordered by turn (nulls first), then role, then
md5 of the text; null role or text count as empty. Rows with a null conversation id form one
conversation. Of equal conversations the smallest id stays (null before all). An empty table gives no rows,
and other columns are ignored.

Scale: no step gathers a conversation. Turns are ranked in blocks of ``BLOCK`` turn numbers, and only
the block totals of a conversation meet; prefixes are made distinct map-side, so a first turn
that many conversations share is one row. A rendered part holds at most ``PART`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
PART = 1024


def _hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "pos", "role", "md5").cast("decimal(20,0)")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    out = left.join(right, cond, how)
    for k in keys if how == "inner" else ():
        out = out.drop(right[k])
    return out


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n_turns, h1, h2 (hashes of the turns up to pos), role, text."""
    rows = turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("md5", F.md5("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK)).groupBy(
        "conv_id", "block", "turn", "role", "md5").agg(F.first("text").alias("text"))
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "md5")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                         F.sum("n").over(whole).alias("n_turns"))
    rows = rows.withColumn("pos", F.row_number().over(in_block))
    rows = _null_safe(rows, sizes, ["conv_id", "block"], "inner").withColumn("pos", F.col("pos") + F.col("first"))
    rows = rows.withColumns({"x1": _hash(1), "x2": _hash(2)})
    sums = rows.groupBy("conv_id", "block").agg(F.sum("x1").alias("s1"), F.sum("x2").alias("s2"))
    sums = sums.select("conv_id", "block", *(F.coalesce(F.sum(s).over(before), F.lit(0)).cast("decimal(38,0)").alias(s)
                                             for s in ("s1", "s2")))
    rows = rows.withColumns({"h1": F.sum("x1").over(upto), "h2": F.sum("x2").over(upto)})
    rows = _null_safe(rows, sums, ["conv_id", "block"], "inner")
    return rows.select("conv_id", "pos", "n_turns", (F.col("h1") + F.col("s1")).cast("decimal(38,0)").alias("h1"),
                       (F.col("h2") + F.col("s2")).cast("decimal(38,0)").alias("h2"), "role", "text")


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: conversations that are no proper prefix of another one."""
    key = ["pos", "h1", "h2"]
    ends = prefixes.where("pos = n_turns").groupBy(*key).agg(
        F.min(F.struct("conv_id")).alias("least"), F.count(F.lit(1)).alias("copies"))
    inner = prefixes.where("pos < n_turns").select(*key).distinct()
    return ends.join(inner, key, "left_anti").select(
        F.col("least.conv_id").alias("conv_id"), F.col("pos").alias("n_turns"), "copies")


def render(prefixes: DataFrame, kept: DataFrame, opening: str = "<|", closing: str = "|>", part: int = PART) -> DataFrame:
    """conv_id, part, n_turns, copies, text: each turn as ``<|role|>\\ntext\\n``; markers inside texts are parted."""
    safe = lambda c: F.replace(F.col(c), F.lit(opening), F.lit(" ".join(opening)))
    piece = F.concat(F.lit(opening), safe("role"), F.lit(closing + "\n"), safe("text"), F.lit("\n"))
    turns = _null_safe(prefixes.select("conv_id", "pos", piece.alias("piece")), kept, ["conv_id"], "inner")
    return turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / part).cast("long").alias("part"), "n_turns", "copies").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("turns")).select(
        "conv_id", "part", F.col("n_turns").cast("long"), "copies", F.array_join("turns.piece", "").alias("text"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """Render the maximal conversations of a log with the columns conv_id, turn, role, text."""
    prefixes = turn_prefixes(turns)
    return render(prefixes, maximal(prefixes))


#: The same rows in SQL: whole prefixes compared as text.
SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations),
p AS (SELECT *, md5(text) AS m, ROW_NUMBER() OVER w AS pos, COUNT(*) OVER (PARTITION BY conv_id) AS n,
  STRING_AGG(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
e AS (SELECT prefix, MIN(conv_id) AS conv_id, MIN(n) AS n, COUNT(*) AS copies FROM p WHERE pos = n GROUP BY prefix),
k AS (SELECT * FROM e WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT p.conv_id, CAST(FLOOR((p.pos - 1) / 1024) AS BIGINT) AS part, CAST(k.n AS BIGINT) AS n_turns, k.copies,
  STRING_AGG('<|' || REPLACE(role, '<|', '< |') || '|>' || chr(10) || REPLACE(text, '<|', '< |') || chr(10), '' ORDER BY pos) AS text
FROM p JOIN k ON p.conv_id = k.conv_id GROUP BY ALL"""
