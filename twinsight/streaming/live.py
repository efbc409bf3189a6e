"""The live tail: recently changed items as a stream, folded exactly into the index.

Each micro-batch commits a version that holds the items and entries it changed, and no others; after
``Live.compact_after`` such versions the next one holds both tables whole. The version is the batch id, so a batch that
runs again after a failure writes the same thing. Readers take the last committed version: the newest whole tables below
it, with rows of later versions in place of theirs. A slow or failed batch leaves them with the prior snapshot;
``vacuum`` removes versions that only snapshots before the last two whole ones need.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..config import Bm25, Live
from ..operators.index import Index, change_counts, entries, fold_entries, latest, upsert
from ..sources.items import LISTING_NODE, enrich, from_listing


def listing_stream(spark: SparkSession, path: str, files_per_batch: int = Live.pages, since: str | None = None) -> DataFrame:
    """Items from landed pages of the change listing (JSON lines), a bounded number of pages a batch; with ``since`` only
    those changed at that time or later (an unknown time counts as changed)."""
    raw = spark.readStream.schema(LISTING_NODE).option("maxFilesPerTrigger", files_per_batch).json(path)
    if since is not None:
        raw = raw.filter(F.col("updated_at").isNull() | (F.col("updated_at") >= F.lit(since).cast("timestamp")))
    return from_listing(raw)


@dataclass
class LiveStore:
    """Versioned items and entries under ``path``.

    ``lookup`` gives files, references and merge state (number, files, closes, merged) of listed pull requests that lack
    them, newest numbers first, ``live.enriched`` a batch. They are a bonus: if it fails, the batch is folded without
    them and the freshness row tells the error.
    """

    spark: SparkSession
    path: str
    config: Bm25 = Bm25()
    live: Live = Live()
    lookup: Callable[[DataFrame], DataFrame] | None = None

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _found(self, part: str) -> list[int]:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/v=*/{part}/_SUCCESS")) or []
        return sorted(int(str(f.getPath()).split("/v=")[1].split("/")[0]) for f in found)

    def versions(self) -> list[int]:
        """Committed versions; a version is committed once its freshness row is written."""
        return self._found("freshness")

    def whole(self) -> list[int]:
        """Committed versions that hold whole tables."""
        return sorted(set(self.versions()) & set(self._found("items")))

    def start(self, items: DataFrame) -> None:
        """The base snapshot, version -1."""
        self._commit(-1, "", items, entries(items, self.config), pending=True, added=0, updated=0, changed=0)

    def _commit(self, version: int, kind: str, items: DataFrame, ents: DataFrame, error: str | None = None, truncated: bool = False, pending: bool = False, **counts: int) -> None:
        at = f"{self.path}/v={version}"
        items.write.mode("overwrite").parquet(f"{at}/{kind}items")
        ents.write.mode("overwrite").parquet(f"{at}/{kind}entries")
        state = [F.lit(True).alias("enabled"), F.lit(error).cast("string").alias("error"), F.lit(truncated).alias("truncated"), F.lit(pending).alias("pending")]
        row = self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("checkedAt"), *state, *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])
        row.write.mode("overwrite").parquet(f"{at}/freshness")

    def _changed(self, versions: list[int], part: str) -> DataFrame:
        """The newest row of each number in versions of changed rows."""
        rows = None
        for v in versions:
            one = self.spark.read.parquet(f"{self.path}/v={v}/changed_{part}").withColumn("v", F.lit(v))
            rows = one if rows is None else rows.unionByName(one)
        newest = Window.partitionBy("number").orderBy(F.desc("v"))
        return rows.withColumn("r", F.row_number().over(newest)).filter("r = 1").drop("r", "v")

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(items, entries) of a version, the last by default."""
        known = self.versions()
        v = known[-1] if version is None else version
        base = [w for w in self.whole() if w <= v][-1]
        after = [w for w in known if base < w <= v]
        out = []
        for part in ("items", "entries"):
            rows = self.spark.read.parquet(f"{self.path}/v={base}/{part}")
            out.append(fold_entries(rows, self._changed(after, part)) if after else rows)
        return out[0], out[1]

    def vacuum(self) -> list[int]:
        """Removes the versions below the last but one that is whole, and says which."""
        fs, path = self._fs()
        whole = self.whole()
        old = [v for v in self.versions() if len(whole) > 1 and v < whole[-2]]
        for v in old:
            fs.delete(path(f"{self.path}/v={v}"), True)
        return old

    def index(self) -> Index:
        return Index.of(self.read()[1])

    def freshness(self, tail: StreamingQuery | None = None) -> DataFrame:
        """One row (version, checkedAt, enabled, error, truncated, pending, added, updated, changed) of the newest
        version. ``pending``: nothing was folded yet; ``truncated``: the batch was as large as a listing may be, so
        there may be more. With the ``tail``'s query, its failure is the error: readers go on with what is committed."""
        row = self.spark.read.parquet(f"{self.path}/v={self.versions()[-1]}/freshness")
        failed = tail.exception() if tail is not None else None
        return row if failed is None else row.withColumn("error", F.lit(str(failed)))

    def enriched(self, delta: DataFrame) -> tuple[DataFrame, str | None]:
        """The delta with looked-up details, and what went wrong."""
        if self.lookup is None:
            return delta, None
        wanted = delta.filter("kind = 'PR' and files is null").select("number").orderBy(F.desc("number")).limit(self.live.enriched)
        try:
            rows = self.lookup(wanted).select("number", "files", "closes", "merged").limit(self.live.enriched).collect()
        except Exception as e:  # any failure of an injected lookup
            return delta, f"{type(e).__name__}: {e}"[:200]
        return enrich(delta, self.spark.createDataFrame(rows, "number long, files array<string>, closes array<long>, merged boolean").dropDuplicates(["number"])), None

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """Commits a batch on top of the newest version below its id: what it changes, or after ``compact_after`` such
        versions everything."""
        below = [v for v in self.versions() if v < batch_id]
        since_whole = [v for v in below if v > [w for w in self.whole() if w < batch_id][-1]]
        items, ents = self.read(below[-1])
        listed = latest(batch).persist()
        try:
            truncated = batch.count() >= self.live.pages * self.live.page_size
            delta, error = self.enriched(listed)
            before = items.join(delta.select("number"), "number", "left_semi").persist()
            c = change_counts(before, delta).first()
            changed = upsert(before, delta).persist()
            fresh = entries(changed, self.config)
            state = (error, truncated)
            counts = {"added": c["added"], "updated": c["updated"], "changed": c["added"] + c["updated"]}
            if len(since_whole) < self.live.compact_after:
                self._commit(batch_id, "changed_", changed, fresh, *state, **counts)
            else:
                self._commit(batch_id, "", fold_entries(items, changed), fold_entries(ents, fresh), *state, **counts)
            before.unpersist()
            changed.unpersist()
        finally:
            listed.unpersist()

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts folding; the default trigger looks once every ``Live.ttl_seconds``."""
        trigger = trigger or {"processingTime": f"{Live.ttl_seconds} seconds"}
        writer: DataStreamWriter = stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(**trigger)
        return writer.start()
