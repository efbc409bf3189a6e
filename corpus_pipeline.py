"""From raw documents to packed training sequences, in stages that each write and reread their documents.

Defined results: null and empty texts, and texts without a letter, go in the first stage; null ids, languages and sources
are values like others; rows with equal id and text are copies of each other, of which the second stage keeps one; ties
go to the least id, then the least hash; extra columns of any name travel through all stages but the last; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsight.llm import jaccard, langid, mixing, packing, suffix
from twinsight.llm.queries import vocabulary
from twinsight.llm.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told (``und``), or that every language codes in more bits than their plain
    bytes and a grace."""
    return langid.keep_known(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near or exact copies the document with the least id stays."""
    return jaccard.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur twice are cut out of the texts; ``n_chars`` follows."""
    cut = suffix.remove_repeats(docs, carry=True)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix_sources(docs, carry=True)
    return mixed.withColumn("again", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, **vocabulary())


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup), ("source_mixing", source_mixing), ("packing", pack)]

#: Newton iterations and tokenisers have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = s.table(docs, keep=True, tidy=True)
    return docs
