"""The full crawl over an injected page fetcher.

``fetch(kind, cursor)`` returns one page: ``{"nodes": [...], "cursor": next or None}``. Cursors are sequential, so each
kind (issues, pull requests) is one task that yields its pages as they come and holds one of them at a time; the node
text is parsed by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .items import CRAWL_NODE, from_crawl, union_items

Fetch = Callable[[str, str | None], dict]


def crawl_nodes(spark: SparkSession, fetch: Fetch, kind: str) -> DataFrame:
    """Nodes of all pages of a kind. A cursor that comes twice ends in an error instead of a loop."""

    def run(batches):
        for b in batches:
            for _ in range(len(b)):
                cursor, seen = None, set()
                while True:
                    page = fetch(kind, cursor)
                    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(n) for n in page["nodes"]], pa.string())], ["node"])
                    cursor = page.get("cursor")
                    if not cursor:
                        break
                    if cursor in seen:
                        raise ValueError(f"cursor {cursor!r} came twice")
                    seen.add(cursor)

    raw = spark.range(1, numPartitions=1).mapInArrow(run, "node string")
    return raw.select(F.from_json("node", CRAWL_NODE).alias("n")).select("n.*")


def crawl(spark: SparkSession, fetch: Fetch) -> DataFrame:
    """Items of a whole repository of work items. Write them (``write_corpus``) before use: reading again fetches again."""
    return union_items(from_crawl(crawl_nodes(spark, fetch, "ISSUE"), "ISSUE"), from_crawl(crawl_nodes(spark, fetch, "PR"), "PR"))
