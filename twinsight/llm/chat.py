"""Chat formatting with cumulative-snapshot collapse.

Chat logs often store a conversation again after every turn. Each turn gets a hash of its place, role and text; rolling
sums of these hashes identify every turn prefix. A conversation whose whole hash is a proper prefix of a longer one,
or that equals one with a smaller id, goes: equal ones are made one by a grouping on the whole hash, prefixes go by an
anti-join with all inner prefixes; the rest are rendered.

Only DataFrame functions are used. Rolling sums run over runs of ``CHUNK`` turns with the totals of earlier runs added,
so one endless conversation does not meet in one task; prefixes are made distinct before they move, so a first turn
that a third of all conversations share costs one row a task. Every kept conversation is rendered as one row, whatever
its turn numbers; that row must fit a cell of 2 GB.

Defined results: a null conv_id is a conversation of its own; turns are ordered by turn (null first), role, text, so
repeated turns all count; null role or text is an empty string; conversations are equal if their turns' roles and
texts are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CHUNK = 1024
LOW = (1 << 31) - 1


def rolling(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn: key, conv_id, run, place (from 1), role, text and the four lanes a, b, c, d of its prefix's hash."""
    t = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.floor(F.col(turn_col) / CHUNK), F.lit(-(1 << 62))).alias("run"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = ["turn", "role", "text"]
    near = Window.partitionBy("key", "run").orderBy(*order)
    t = t.withColumn("at", F.row_number().over(near))
    runs = t.groupBy("key", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = runs.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    t = t.join(first.select("key", "run", "skip"), ["key", "run"]).withColumn("place", F.col("at") + F.col("skip"))
    one, two = F.xxhash64("place", "role", "text"), F.xxhash64(F.lit("second"), "text", "role", "place")
    lanes = {"a": one.bitwiseAND(LOW), "b": F.shiftright(one, 32).bitwiseAND(LOW), "c": two.bitwiseAND(LOW), "d": F.shiftright(two, 32).bitwiseAND(LOW)}
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns(lanes).withColumns({k: F.sum(k).over(upto) for k in lanes})
    totals = t.groupBy("key", "run").agg(*[F.max_by(k, "at").alias(f"{k}0") for k in lanes])
    totals = totals.withColumns({f"{k}0": F.coalesce(F.sum(f"{k}0").over(before), F.lit(0)) for k in lanes})
    return t.join(totals, ["key", "run"]).select("key", "conv_id", "run", "place", "role", "text", *[(F.col(k) + F.col(f"{k}0")).alias(k) for k in lanes])


def collapse(turns: DataFrame) -> DataFrame:
    """Keys, ids and lengths of maximal conversations, from :func:`rolling`'s rows."""
    sign = ["n", "a", "b", "c", "d"]
    whole = turns.groupBy("key").agg(F.max("conv_id").alias("conv_id"), F.max(F.struct(F.col("place").alias("n"), "a", "b", "c", "d")).alias("w")).select("key", "conv_id", "w.*")
    ended = whole.select("key", F.col("n").alias("last"))
    inner = turns.join(ended, "key").filter(F.col("place") < F.col("last")).select(F.col("place").alias("n"), "a", "b", "c", "d").distinct()
    alone = whole.groupBy(*sign).agg(F.min(F.struct(F.col("conv_id").isNull().alias("null"), "conv_id", "key")).alias("m"), F.count("*").alias("copies"))
    return alone.join(inner, sign, "left_anti").select("m.key", "m.conv_id", "n", "copies")


def render(conversations: DataFrame, start: str = "<|{role}|>\n", end: str = "<|end|>\n", **names: str) -> DataFrame:
    """(conv_id, n_turns, copies, text): maximal conversations, a row each.

    ``start`` may name ``{role}``; ``end`` is literal. ``copies`` counts the equal conversations a row stands for.
    """
    with Scratch(conversations.sparkSession, "chat") as s:
        turns = s.table(rolling(conversations, **names), keep=True)
        kept = s.table(collapse(turns), keep=True)
    head, _, tail = start.partition("{role}")
    line = F.concat(F.lit(head), F.col("role"), F.lit(tail), F.col("text"), F.lit(end))
    lines = turns.join(kept.select("key"), "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return lines.join(kept, "key").select("conv_id", F.col("n").cast("long").alias("n_turns"), "copies", F.array_join(F.col("lines.line"), "").alias("text"))
