"""Retrieval: lexical, changed-file and vector search for many queries at once, fused by reciprocal rank.

Queries are always a table. Lexical and vector scores are summed by tiles inside tasks; files are joined by an inverted form,
so only matching pairs are made, and the query side is broadcast only after its rows have been counted. Ranks have a total order: score rounded to 9 places
descending, then number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Bm25, Retrieval
from ..functions.paths import signal_files
from . import lexical
from .index import Index, entries
from .nearest import nearest

SMALL_ROWS = 200_000
DIGITS = 9


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marks a side for broadcast if it has been counted to be small; larger sides are shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(hits: DataFrame, name: str, k: int, *extra: str) -> DataFrame:
    """(qid, number, retriever, rnk, raw, ...) of the first k hits of each query."""
    w = Window.partitionBy("qid").orderBy(F.desc("raw"), "number")
    return hits.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k).select("qid", "number", F.lit(name).alias("retriever"), "rnk", "raw", *extra)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, exclude, terms): the distinct terms of title and body."""
    asked = queries.select(F.struct("qid", (F.col("exclude") if "exclude" in queries.columns else F.lit(None).cast("long")).alias("exclude")).alias("number"), "title", "body")
    return entries(asked).select("number.qid", "number.exclude", F.col("terms.term").alias("terms"))


def bm25(index: Index, queries: DataFrame, k: int = Retrieval.per_list, config: Bm25 = Bm25()) -> DataFrame:
    """Ranked BM25 hits with a positive score; the excluded number of a query is left out after statistics."""
    return lexical.scored(index.entries, index.n, index.avg_len, query_terms(queries), k, config, lambda hits: ranked(hits, "bm25", k))


def item_files(items: DataFrame) -> DataFrame:
    """(number, files, n_files): distinct files that are not noise; items without any are left out."""
    return items.select("number", signal_files(F.col("files")).alias("files")).withColumn("n_files", F.size("files")).filter("n_files > 0")


def file_overlap(items: DataFrame, queries: DataFrame, k: int = Retrieval.per_list) -> DataFrame:
    """Ranked hits by Jaccard index of changed files, with the shared files in the query's order."""
    have = item_files(items).select("number", "n_files", F.explode("files").alias("file"))
    exclude = F.col("exclude") if "exclude" in queries.columns else F.lit(None).cast("long")
    q = queries.select("qid", exclude.alias("exclude"), signal_files(F.col("files")).alias("files"))
    q = q.withColumn("n_q", F.size("files")).filter("n_q > 0").select("qid", "exclude", "n_q", F.posexplode("files").alias("pos", "file"))
    hits = have.join(small(q), "file").filter(~F.col("number").eqNullSafe(F.col("exclude")))
    g = hits.groupBy("qid", "number").agg(F.count("*").alias("c"), F.max("n_q").alias("n_q"), F.max("n_files").alias("n_f"), F.array_sort(F.collect_list(F.struct("pos", "file"))).alias("s"))
    raw = F.round(F.col("c") / (F.col("n_q") + F.col("n_f") - F.col("c")), DIGITS)
    return ranked(g.select("qid", "number", raw.alias("raw"), F.col("s.file").alias("shared")), "files", k, "shared")


def vector(vectors: DataFrame, queries: DataFrame, k: int = Retrieval.per_list) -> DataFrame:
    """Ranked hits by cosine of unit vectors: a stated query set against every vector, by tiles."""
    exclude = F.col("exclude") if "exclude" in queries.columns else F.lit(None).cast("long")
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked(nearest(vectors, queries.select("qid", exclude.alias("exclude"), "vector"), k, partitions), "embed", k)


ORDER = ("bm25", "embed", "files")


def fuse(lists: list[DataFrame], limit: int = Retrieval.limit, k: int = Retrieval.rrf_k) -> DataFrame:
    """Reciprocal rank fusion: (qid, number, fused, <retriever>_rank, <retriever>_raw, shared, rnk).

    Equal sums keep the order of first appearance: by retriever, then rank.
    """
    rows = None
    for part in lists:
        part = part if "shared" in part.columns else part.withColumn("shared", F.lit(None).cast("array<string>"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("seen", F.when(F.col("retriever") == "bm25", 0).when(F.col("retriever") == "embed", 1).otherwise(2) * 1_000_000 + F.col("rnk"))
    of = lambda c, r: F.max(F.when(F.col("retriever") == r, F.col(c)))
    fused = rows.groupBy("qid", "number").agg(
        F.round(sum(F.coalesce(1.0 / (k + of("rnk", r)), F.lit(0.0)) for r in ORDER), 12).alias("fused"),
        F.min("seen").alias("seen"),
        F.max_by("shared", F.col("shared").isNotNull()).alias("shared"),
        *[of(c, r).alias(f"{r}_{'rank' if c == 'rnk' else c}") for r in ORDER for c in ("rnk", "raw")],
    )
    w = Window.partitionBy("qid").orderBy(F.desc("fused"), "seen")
    out = fused.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= limit)
    return out.select("qid", "number", "fused", *[f"{r}_{c}" for r in ORDER for c in ("rank", "raw")], "shared", "rnk")


def search(index: Index, items: DataFrame, queries: DataFrame, limit: int = Retrieval.limit, vectors: DataFrame | None = None, config: Retrieval = Retrieval()) -> DataFrame:
    """Hybrid retrieval; retrievers whose input is absent are left out of the plan."""
    lists = [bm25(index, queries, config.per_list)]
    if vectors is not None and "vector" in queries.columns:
        lists.append(vector(vectors, queries, config.per_list))
    if "files" in queries.columns:
        lists.append(file_overlap(items, queries, config.per_list))
    return fuse(lists, limit, config.rrf_k)


def short_circuit(lists: DataFrame, queries: DataFrame, least: float = Retrieval.short_circuit_score) -> DataFrame:
    """(qid, best_raw, answered): queries with no lexical score of ``least`` and no file hit need no verdicts."""
    best = lists.groupBy("qid").agg(F.max(F.when(F.col("retriever") == "bm25", F.col("raw"))).alias("best_raw"), F.count_if(F.col("retriever") == "files").alias("file_hits"))
    out = queries.select("qid").join(best, "qid", "left")
    return out.select("qid", F.coalesce("best_raw", F.lit(0.0)).alias("best_raw"), ((F.coalesce("best_raw", F.lit(0.0)) < least) & (F.coalesce("file_hits", F.lit(0)) == 0)).alias("answered"))
