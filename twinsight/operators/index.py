"""Building and exactly maintaining weighted term statistics.

Entries hold one row a document with its terms inside, made without a shuffle: a document's tokens are in one row
already. Postings are entries exploded; document frequencies are the only aggregation that moves data, pre-summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Bm25
from ..functions.tokens import counts
from ..sources.items import ITEM, balanced
from .held import written

ROWS, BYTES = 500, 32 << 20  # documents whose words are Python objects at a time, and bytes of their bodies unless it is one


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends, a = np.cumsum(pc.fill_null(pc.binary_length(batch["body"]), 0).to_numpy(), dtype=np.int64), 0
    while a < len(batch):
        b = min(a + ROWS, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES, "right"))))
        yield batch.slice(a, b - a)
        a = b


def entries(items: DataFrame, config: Bm25 = Bm25()) -> DataFrame:
    """(number, len, terms): terms are (term, n) with title tokens counted ``title_weight`` times; len is their sum."""
    weight = config.title_weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                row, terms, n = counts((part["body"], 1), (part["title"], weight))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))])
                each = pa.StructArray.from_arrays([terms, pa.array(n)], ["term", "n"])
                lens = np.bincount(row, n, len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part["number"], pa.array(lens), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["number", "len", "terms"])

    rows = balanced(items.select("number", "title", "body"))
    return rows.mapInArrow(run, f"number {dict(rows.dtypes)['number']}, len long, terms array<struct<term:string,n:bigint>>")


def _rows(entries: DataFrame, what: str, *keep: str) -> DataFrame:
    """One row ``t`` for each element."""
    return entries.select(*keep, F.explode_outer(what).alias("t")).filter("t is not null")


def postings(entries: DataFrame) -> DataFrame:
    """(number, len, term, tf)."""
    return _rows(entries, "terms", "number", "len").select("number", "len", F.col("t.term").alias("term"), F.col("t.n").alias("tf"))


def document_frequency(entries: DataFrame) -> DataFrame:
    return _rows(entries, "terms.term").groupBy(F.col("t").alias("term")).agg(F.count("*").alias("df"))


def statistics(entries: DataFrame) -> DataFrame:
    """One row (n, total_len, avg_len); documents without tokens count."""
    n, total = F.count("*"), F.coalesce(F.sum("len"), F.lit(0))
    return entries.agg(n.alias("n"), total.alias("total_len"), (total / F.greatest(F.lit(1), n)).alias("avg_len"))


def latest(delta: DataFrame) -> DataFrame:
    """One row a number: a listing can repeat an item when pages shift. The latest by ``updatedAt``, if there is one."""
    order = [F.col("updatedAt")] if "updatedAt" in delta.columns else []
    best = F.max_by(F.struct(*ITEM.fieldNames()), F.struct(*order, F.xxhash64("title", "body", "state")))
    return delta.groupBy("number").agg(best.alias("i")).select("i.*")


def fold_entries(base: DataFrame, new: DataFrame) -> DataFrame:
    """Base entries that the delta does not supersede, and the delta's."""
    return base.join(new.select("number"), "number", "left_anti").unionByName(new)


def fold_frequency(base_df: DataFrame, base: DataFrame, new: DataFrame) -> DataFrame:
    """Exact document frequencies after a delta: the base's, minus superseded entries, plus new ones."""
    gone = _rows(base.join(new.select("number"), "number", "left_semi"), "terms.term").select(F.col("t").alias("term"), F.lit(-1).cast("long").alias("df"))
    come = _rows(new, "terms.term").select(F.col("t").alias("term"), F.lit(1).cast("long").alias("df"))
    return base_df.unionByName(gone).unionByName(come).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def fold_statistics(stats: DataFrame, base: DataFrame, new: DataFrame) -> DataFrame:
    """(n, total_len, avg_len) after a delta, from signed sums."""
    gone = base.join(new.select("number"), "number", "left_semi").select((-F.lit(1)).cast("long").alias("n"), (-F.col("len")).alias("total_len"))
    come = new.select(F.lit(1).cast("long").alias("n"), F.col("len").alias("total_len"))
    both = stats.select("n", "total_len").unionByName(gone).unionByName(come).agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"))
    return both.withColumn("avg_len", F.col("total_len") / F.greatest(F.lit(1), F.col("n")))


def upsert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Items after a delta; where the delta has null (unknown), what is known stays."""
    old = base.select("number", F.struct(*[f for f in ITEM.fieldNames() if f != "number"]).alias("o"))
    new = delta.select("number", F.struct(*[f for f in ITEM.fieldNames() if f != "number"]).alias("w"))
    both = old.join(new, "number", "full_outer")
    return both.select("number", *[F.coalesce(f"w.{f}", f"o.{f}").alias(f) for f in ITEM.fieldNames() if f != "number"])


def change_counts(base: DataFrame, delta: DataFrame) -> DataFrame:
    """One row (added, updated)."""
    marked = delta.select("number").distinct().join(base.select("number", F.lit(True).alias("known")), "number", "left")
    return marked.agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if("known").alias("updated"))


def frequency_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Terms whose frequencies differ: (term, left_df, right_df)."""
    both = a.select("term", F.col("df").alias("left_df")).join(b.select("term", F.col("df").alias("right_df")), "term", "full_outer")
    return both.filter(~F.col("left_df").eqNullSafe(F.col("right_df")))


@dataclass
class Index:
    """Entries with the statistics that scoring needs; ``n`` and ``avg_len`` are two numbers, read once."""

    entries: DataFrame
    n: int
    avg_len: float

    @classmethod
    def build(cls, items: DataFrame, config: Bm25 = Bm25(), path: str | None = None) -> Index:
        """Written to ``path`` and read back if given, else persisted."""
        if path:
            written(entries(items, config), f"{path}/entries", "overwrite")
            return cls.load(items.sparkSession, path)
        return cls.of(entries(items, config).persist())

    @classmethod
    def load(cls, spark: Any, path: str) -> Index:
        return cls.of(spark.read.parquet(f"{path}/entries"))

    @classmethod
    def of(cls, e: DataFrame) -> Index:
        s = statistics(e).first()
        return cls(e, s["n"], s["avg_len"])

    def fold(self, delta: DataFrame, config: Bm25 = Bm25()) -> Index:
        return Index.of(fold_entries(self.entries, entries(delta, config)))
