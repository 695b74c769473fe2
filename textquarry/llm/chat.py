"""Chat formatting: conversations that were logged again and again as they grew collapse to the longest, which are then rendered.

Rolling hashes identify every prefix of turns: the xor of hashes of (position, role, text) over the turns so far, in two 64-bit lanes. A
conversation goes when its whole hash is the prefix hash of a longer one, or of an equal one with a smaller id. Positions and hashes are
accumulated by blocks of turns, so that no window spans more than a block or the list of a conversation's blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

#: Turn numbers to a block, and turns to a rendered part.
BLOCK = 256


def _hashed(rows: DataFrame) -> DataFrame:
    # a null is empty here, one that is not begins with its length
    sized = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit(""))
    h = F.md5(F.concat(sized("role"), F.lit(" "), sized("text")).cast("binary"))
    return rows.withColumn("turn", F.coalesce(F.col("turn").cast("long"), F.lit(-1))).withColumn("h", h)


def _turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, block, h) of each row."""
    return _hashed(rows).select("conv_id", "turn", F.floor(F.col("turn") / BLOCK).alias("block"), "h")


def _key(df: DataFrame) -> DataFrame:
    """A null conv_id is an id of its own, not that of an empty text."""
    return df.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))


def _numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns with their position from 1 in (turn, hash) order."""
    t = _key(turns).distinct()
    blocks = t.groupBy("c", "block").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    inside = F.row_number().over(Window.partitionBy("c", "block").orderBy("turn", "h"))
    return t.withColumn("i", inside).join(blocks.select("c", "block", before.alias("before")), ["c", "block"]).withColumn("pos", F.col("before") + F.col("i")).drop("i", "before")


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that stay."""
    t = _numbered(_turns(conversations)).withColumn("x", F.xxhash64("pos", "h")).withColumn("y", F.xxhash64("h", "pos"))
    blocks = t.groupBy("c", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.count("*").alias("m"))
    upto = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.select("c", "block", F.bit_xor("bx").over(upto).bitwiseXOR(F.col("bx")).alias("px"), F.bit_xor("by").over(upto).bitwiseXOR(F.col("by")).alias("py"))
    inside = Window.partitionBy("c", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = t.select("c", "block", "pos", F.bit_xor("x").over(inside).alias("ix"), F.bit_xor("y").over(inside).alias("iy")).join(summed, ["c", "block"])
    prefixes = prefixes.select("c", "pos", F.col("ix").bitwiseXOR(F.col("px")).alias("x"), F.col("iy").bitwiseXOR(F.col("py")).alias("y"))
    whole = blocks.join(t.groupBy("c").agg(F.first("conv_id").alias("conv_id")), "c").groupBy("c", "conv_id").agg(F.sum("m").alias("pos"), F.bit_xor("bx").alias("x"), F.bit_xor("by").alias("y"))
    sized = prefixes.join(whole.select("c", "conv_id", F.col("pos").alias("n")), "c")
    longest = sized.groupBy("pos", "x", "y").agg(F.max("n").alias("longest"), F.min(F.when(F.col("n") == F.col("pos"), F.struct(F.col("conv_id").isNull(), "conv_id"))).alias("first"))
    own = F.struct(F.col("conv_id").isNull(), F.col("conv_id"))
    covered = whole.join(longest, ["pos", "x", "y"]).where((F.col("longest") > F.col("pos")) | (F.col("first") < own)).select("c")
    return whole.join(covered, "c", "left_anti").select("c", "conv_id", F.col("pos").alias("n_turns"))


def render(conversations: DataFrame) -> DataFrame:
    """The maximal conversations as text: conv_id, n_turns, part (from 0; one for each BLOCK turns), text.

    A turn is `<|role|>`, a line break, its text and `<|end|>` with a line break; the parts of a conversation, joined, are its text. Turns are in the order of (turn, hash of role and text); repeated
    rows count once; a null turn comes first; null role or text is told apart from the empty one in comparisons and rendered as empty; rows
    with a null conv_id are one conversation. An empty table gives no rows. Other columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    stay = maximal(rows)
    kept = _key(_hashed(rows)).join(stay.select("c", "n_turns"), "c")
    placed = kept.join(_numbered(_turns(rows)).select("c", "turn", "h", "pos"), ["c", "turn", "h"]).dropDuplicates(["c", "pos"])
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    parts = placed.withColumn("part", F.floor((F.col("pos") - 1) / BLOCK).cast("int")).groupBy("c", "part").agg(
        F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines")
    )
    return parts.select("conv_id", "n_turns", "part", F.array_join(F.col("lines.line"), "").alias("text"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, role, text, md5(coalesce(length(role) || ':' || role, '') || ' ' || coalesce(length(text) || ':' || text, '')) AS h FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, h) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, pos, n, md5(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS x FROM n),
l AS (SELECT pos, x, max(n) AS longest, min(CASE WHEN n = pos THEN conv_id END) AS first FROM p GROUP BY pos, x),
stay AS (SELECT p.conv_id FROM p JOIN l ON p.pos = l.pos AND p.x = l.x WHERE p.n = p.pos AND l.longest = p.n AND l.first = p.conv_id)
SELECT n.conv_id, max(n.n)::BIGINT AS n_turns, ((n.pos - 1) // 256)::INTEGER AS part,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY n.pos) AS text
FROM n JOIN stay ON n.conv_id = stay.conv_id GROUP BY n.conv_id, (n.pos - 1) // 256
"""
