"""Mixing sources to target weights by entropy balancing.

Every source gets a target in words. Document rates in (0, 2) are those of least (bounded) relative entropy to rate 1
that meet the target: ``rate = 2 / (1 + exp(-dual * size / mean size))``, an exponential tilt. The dual variable of each
source minimises a convex function; Newton steps over the distributed histogram (source, size) find it, kept inside a
bracket. Rates then become whole copies: systematic rounding along sizes, a few corrections of what is left, and a
hash order that says which documents of equal size get the spare copy. Reruns agree.

Only DataFrame functions are used. A source that holds most rows is reduced to its histogram before it moves, and the
order within a (source, size) class is cut into hash slices, so neither a hot source nor a large group of copies
meets in one task.

Defined results: null text has size 0; null source is a source (ordered last); a source without words has target 0 and
takes nothing (copies 1 of size 0, taken 0); equal rows are told apart only as a multiset; an empty table gives an
empty result; other columns travel in ``row`` and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 64
STEPS, STEP = 60, 3.0
CORRECTIONS = 4
LARGEST = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(key, source_size, docs, target) from (key, source, source_size, docs), a row a source.

    The capped shares are those of water filling: ordered by cap over weight, the first level that no later source
    exceeds. One row a source stands in the single partition of these windows, never a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sources.withColumn("weight", w).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0.0))
    level = (share * F.sum("source_size").over(every) - before("cap")) / (F.sum("weight").over(every) - before("weight"))
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(every)["level"])
    return t.select("key", "source_size", "docs", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"), "cap")


def _rate(dual: Column, x: Column, most: float) -> Column:
    return F.when(dual.isNull(), F.lit(float(most))).otherwise(most / (1.0 + F.exp(-dual * x)))


def solve_duals(s: Scratch, hist: DataFrame, aims: DataFrame, most: float, tolerance: float) -> DataFrame:
    """(key, dual): the root of each source's dual gradient; null where the target is the cap (every rate is ``most``)."""
    free = (F.col("source_size") > 0) & (F.col("target") < F.col("cap"))
    state = s.table(aims.filter(free).select("key", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("dual"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(None).cast("double").alias("gap")))
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("dual"), x, most)
        words = F.col("n") * F.col("size")
        step = (
            hist.join(state, "key")
            .groupBy("key", "target", "mean", "dual", "lo", "hi")
            .agg(F.sum(words * r).alias("got"), F.sum(words * x * r * (1 - r / most)).alias("slope"))
            .withColumn("gap", F.col("got") - F.col("target"))
            .withColumn("lo", F.when(F.col("gap") < 0, F.col("dual")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("gap") >= 0, F.col("dual")).otherwise(F.col("hi")))
            .withColumn("move", F.greatest(F.lit(-STEP), F.least(F.lit(STEP), -F.col("gap") / F.greatest(F.col("slope"), F.lit(1e-12)))))
            .withColumn("next", F.col("dual") + F.col("move"))
            .withColumn("next", F.when((F.col("next") <= F.col("lo")) | (F.col("next") >= F.col("hi")), (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("next")))
            .withColumn("done", F.abs("gap") <= F.greatest(F.lit(0.5), tolerance * F.col("target")))
        )
        state = s.table(step.select("key", "target", "mean", F.when(F.col("done"), F.col("dual")).otherwise(F.col("next")).alias("dual"), "lo", "hi", F.when(F.col("done"), 0.0).otherwise(F.abs("gap")).alias("gap")))
        if (state.agg(F.max("gap")).first()[0] or 0.0) == 0.0:
            break
    return state.select("key", "mean", "dual")


def round_classes(s: Scratch, rated: DataFrame, most: int) -> DataFrame:
    """Copies ``k`` of each (key, size) class from its rate.

    The ``LARGEST`` sizes of a source are rounded one after another, largest first, each taking over the error in words
    of those before; further sizes are rounded along their running sum. What is left is corrected by the copies of
    that size that come closest, a few times.
    """
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.col("size").desc()))
    ranked = s.table(rated.withColumn("r", order))
    top = ranked.filter(F.col("r") <= LARGEST).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "size", "n", "rate"))).alias("c"))
    kind = "struct<error:double,done:array<struct<size:bigint,k:bigint>>>"

    def take(acc, x):
        want = acc["error"] + x["n"] * x["rate"] * x["size"]
        k = F.greatest(F.lit(0), F.least(F.when(x["size"] > 0, F.round(want / F.greatest(x["size"], F.lit(1)))).otherwise(x["n"]).cast("long"), most * x["n"]))
        return F.struct((want - k * x["size"]).alias("error"), F.concat(acc["done"], F.array(F.struct(x["size"].alias("size"), k.alias("k")))).alias("done")).cast(kind)

    none = F.struct(F.lit(0.0).alias("error"), F.array().cast("array<struct<size:bigint,k:bigint>>").alias("done")).cast(kind)
    fixed = top.select("key", F.explode(F.aggregate("c", none, take)["done"]).alias("x")).select("key", "x.size", F.col("x.k").alias("fixed"))
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    total = F.floor(F.sum(F.col("n") * F.col("rate")).over(down) + 0.5)
    k = ranked.withColumn("sum", total).withColumn("k", F.col("sum") - F.coalesce(F.lag("sum").over(down), F.lit(0)))
    k = k.join(fixed, ["key", "size"], "left").withColumn("k", F.coalesce("fixed", F.greatest(F.lit(0), F.least(F.col("k"), most * F.col("n"))).cast("long")))
    k = k.select("key", "size", "n", "rate", "target", "k")
    for _ in range(CORRECTIONS):
        k = s.table(k)
        gap = k.groupBy("key").agg((F.max("target") - F.sum(F.col("k") * F.col("size"))).alias("gap"))
        room = F.when(F.col("gap") > 0, most * F.col("n") - F.col("k")).otherwise(F.col("k"))
        times = F.greatest(F.lit(1), F.least(room, F.floor(F.abs("gap") / F.greatest(F.col("size"), F.lit(1)))))
        left = F.abs(F.abs("gap") - times * F.col("size"))
        pick = k.join(gap, "key").filter((F.col("size") > 0) & (room > 0) & (left < F.abs("gap")))
        pick = pick.groupBy("key").agg(F.min(F.struct(left.alias("left"), F.col("size").alias("at"), (F.signum("gap").cast("long") * times).alias("add"))).alias("p"))
        k = k.join(pick.select("key", "p.at", "p.add"), "key", "left").select("key", "size", "n", "rate", "target", F.when(F.col("size") == F.col("at"), F.col("k") + F.col("add")).otherwise(F.col("k")).alias("k"))
    return k


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken), with ``row`` (all input columns) if ``carry``."""
    spark: SparkSession = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    cols = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(8), id_col, text_col).alias("u")]
    with Scratch(spark, "mix") as s:
        sized = s.table(docs.select(*cols, *([F.struct("*").alias("row")] if carry else [])), keep=True)
        sized = sized.withColumn("slice", F.pmod("u", F.lit(SLICES)))
        slices = s.table(sized.groupBy("key", "source", "size", "slice").agg(F.count("*").alias("n")))
        hist = s.table(slices.groupBy("key", "source", "size").agg(F.sum("n").alias("n")))
        sources = hist.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
        aims = s.table(targets(sources, weights, share, most))
        duals = solve_duals(s, hist, aims, most, 1e-4)
        rated = hist.join(aims, "key").join(duals, "key", "left")
        rated = rated.select("key", "size", "n", "target", F.when(F.col("source_size") == 0, 1.0).otherwise(_rate(F.col("dual"), F.col("size") / F.col("mean"), most)).alias("rate"))
        classes = round_classes(s, rated, most)
        below = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        plan = (
            slices.withColumn("offset", F.coalesce(F.sum("n").over(below), F.lit(0)))
            .drop("n", "source")
            .join(classes, ["key", "size"])
            .join(aims.select("key", "source_size"), "key")
            .select("key", "size", "slice", "offset", "rate", "target", "source_size", F.floor(F.col("k") / F.col("n")).alias("whole"), (F.col("k") % F.col("n")).alias("spare"))
        )
        plan = s.table(plan, keep=True)
    rank = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("u", "doc_id")) + F.col("offset")
    copies = (F.col("whole") + F.when(rank <= F.col("spare"), 1).otherwise(0)).cast("long")
    out = sized.join(plan, ["key", "size", "slice"]).withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))
