"""Bench tables as the engine's frames; every mapping is deterministic and expressible in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .items import ITEM


def text_items(documents: DataFrame) -> DataFrame:
    """number, kind, title (first line), body (the rest), author."""
    title = F.substring_index("text", "\n", 1)
    return documents.select(
        F.col("doc_id").alias("number"),
        F.when(F.col("doc_id") % 2 == 0, "ISSUE").otherwise("PR").alias("kind"),
        title.alias("title"),
        F.col("text").substr(F.length(title) + 2, F.length("text")).alias("body"),
        F.col("source").alias("author"),
    )


def order_files(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """(number, files): distinct paths type/brand/part of an order, sorted."""
    path = F.concat_ws("/", "p_type", "p_brand", F.col("l_partkey").cast("string"))
    return lineitem.join(part, lineitem.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("number")).agg(F.array_sort(F.collect_set(path)).alias("files"))


def order_items(orders: DataFrame, files: DataFrame) -> DataFrame:
    """Orders as pull requests with file sets; orders without lines have an empty one."""
    state = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "MERGED").otherwise("CLOSED")
    o = orders.select(F.col("o_orderkey").alias("number"), F.lit("PR").alias("kind"), state.alias("state"), F.col("o_custkey").cast("string").alias("author"), F.col("o_orderdate").alias("createdAt"))
    out = o.join(files, "number", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    return _filled(out.withColumn("merged", F.col("state") == "MERGED"))


def full_items(documents: DataFrame, orders: DataFrame, files: DataFrame) -> DataFrame:
    """Text items with states, times and, for pull requests, files from the order of the same number."""
    o = orders.select(F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").alias("createdAt"))
    t = text_items(documents).join(o, "number", "left").join(files, "number", "left")
    pr = F.col("kind") == "PR"
    state = F.when(F.col("s") == "O", "OPEN").when((F.col("s") == "F") & pr, "MERGED").otherwise("CLOSED")
    new = {"state": state, "merged": F.when(pr, F.coalesce(F.col("s") == "F", F.lit(False))), "files": F.when(pr, F.coalesce("files", F.array().cast("array<string>")))}
    return _filled(t.withColumns(new).drop("s"))


def _filled(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ITEM])


def benchmark_queries(benchmark: DataFrame) -> DataFrame:
    """(qid, kind, title, body, files, exclude): the whole text is the body."""
    return benchmark.select(F.col("item_id").alias("qid"), F.lit("ISSUE").alias("kind"), F.lit("").alias("title"), F.col("text").alias("body"), F.lit(None).cast("array<string>").alias("files"), F.lit(None).cast("long").alias("exclude"))


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("number"), F.col("embedding").alias("vector"))


def claims(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("user_id").alias("caller"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cost"))


def edits(documents: DataFrame, labels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A delta: every labelled document with its lines reversed, and benchmark texts as new items after the last number."""
    turned = F.array_join(F.reverse(F.split("text", "\n")), "\n")
    changed = documents.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", turned.alias("text"), "source")
    last = documents.agg(F.max("doc_id").alias("last"))
    new = benchmark.crossJoin(F.broadcast(last)).select((F.col("item_id") + F.col("last") + 1).alias("doc_id"), "text", F.lit("benchmark").alias("source"))
    return _filled(text_items(changed.unionByName(new)).withColumn("state", F.lit("OPEN")))
