"""Frames that several queries read, and indexes kept for as long as the session lives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.held import held, own_folder
from ..operators.index import Index
from ..operators.retrieval import small
from ..sources import adapters
from .registry import table

_INDEXES: dict[tuple[str, str], Index] = {}
_FACTS: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.text_items(table(spark, sf_dir, "documents"))


def text_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index over documents: built once a session and input, and written to the shared folder, as an index is meant to be
    (kept in Spark's storage its terms take several times the input)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = Index.build(text_items(spark, sf_dir), path=own_folder(spark, "index"))
    return _INDEXES[key]


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.order_files(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.order_items(table(spark, sf_dir, "orders"), order_files(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and files of the documents' numbers: found once a session and input and written, as every part of a report
    reads them and most orders and lines belong to no document."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        numbers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number")).distinct()
        orders, lines = (table(spark, sf_dir, t) for t in ("orders", "lineitem"))
        orders = orders.select("o_orderkey", "o_orderstatus", "o_orderdate").join(numbers, orders["o_orderkey"] == numbers["number"], "left_semi")
        lines = lines.select("l_orderkey", "l_partkey").join(numbers.filter("number % 2 <> 0"), lines["l_orderkey"] == numbers["number"], "left_semi")
        _FACTS[key] = held(orders, "orders"), held(adapters.order_files(lines, table(spark, sf_dir, "part")), "files")
    return _FACTS[key]


def full_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, files = (small(x) for x in _facts(spark, sf_dir))
    return adapters.full_items(table(spark, sf_dir, "documents"), orders, files)


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.edits(*(table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark")))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.claims(table(spark, sf_dir, "events"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(want, score): labelled documents, scored 0 to 100 by length."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select((F.col("quality") == 1).alias("want"), F.least(F.lit(100.0), F.floor(F.length("text") / 50.0).cast("double")).alias("score"))
