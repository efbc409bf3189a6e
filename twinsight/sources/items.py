"""The item schema, and reading, normalising and writing items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("number", T.LongType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("merged", T.BooleanType()),
        T.StructField("author", T.StringType()),
        T.StructField("createdAt", T.TimestampType()),
        T.StructField("closedAt", T.TimestampType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("closes", T.ArrayType(T.LongType())),
    ]
)
_NODES = "struct<nodes:array<struct<{}>>>"
#: A node of the full crawl.
CRAWL_NODE = (
    "number long, title string, body string, state string, merged boolean, author struct<login:string>, createdAt timestamp, closedAt timestamp, "
    f"labels {_NODES.format('name:string')}, files {_NODES.format('path:string')}, closingIssuesReferences {_NODES.format('number:bigint')}"
)
#: A node of the listing of recent changes; labels may be text or objects, so they are kept as JSON text.
LISTING_NODE = "number long, title string, body string, state string, user struct<login:string>, created_at timestamp, closed_at timestamp, updated_at timestamp, labels array<string>, pull_request struct<merged_at:string>"
LABELS, FILES, CLOSES = 20, 100, 10


def normal_state(state: Column, merged: Column) -> Column:
    up = F.upper(F.coalesce(state, F.lit("OPEN")))
    return F.when(up == "OPEN", "OPEN").when((up == "MERGED") | F.coalesce(merged, F.lit(False)), "MERGED").otherwise("CLOSED")


def from_crawl(nodes: DataFrame, kind: str) -> DataFrame:
    """Items from crawled nodes of one kind; issues have no files, references or merge state."""
    pr = F.lit(kind == "PR")
    pick = lambda c, f, n: F.slice(F.coalesce(F.transform(F.col(f"{c}.nodes"), lambda x: x[f]), F.array()), 1, n)
    return nodes.select(
        "number",
        F.lit(kind).alias("kind"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        normal_state(F.col("state"), F.col("merged")).alias("state"),
        F.when(pr, F.coalesce("merged", F.lit(False))).alias("merged"),
        F.coalesce("author.login", F.lit("ghost")).alias("author"),
        "createdAt",
        "closedAt",
        pick("labels", "name", LABELS).cast("array<string>").alias("labels"),
        F.when(pr, pick("files", "path", FILES).cast("array<string>")).alias("files"),
        F.when(pr, pick("closingIssuesReferences", "number", CLOSES).cast("array<long>")).alias("closes"),
    )


def from_listing(nodes: DataFrame) -> DataFrame:
    """Items from listed nodes. Files and references are null, which means unknown, until they are looked up."""
    pr = F.col("pull_request").isNotNull()
    label = lambda x: F.coalesce(F.get_json_object(x, "$.name"), x)
    merged = F.when(pr, F.col("pull_request.merged_at").isNotNull())
    return nodes.select(
        "number",
        F.when(pr, "PR").otherwise("ISSUE").alias("kind"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        normal_state(F.col("state"), merged).alias("state"),
        merged.alias("merged"),
        F.coalesce("user.login", F.lit("ghost")).alias("author"),
        F.col("created_at").alias("createdAt"),
        F.col("closed_at").alias("closedAt"),
        F.transform(F.coalesce("labels", F.array().cast("array<string>")), label).alias("labels"),
        F.lit(None).cast("array<string>").alias("files"),
        F.lit(None).cast("array<long>").alias("closes"),
    )


def enrich(delta: DataFrame, details: DataFrame) -> DataFrame:
    """Fills files, references and merge state of listed PRs from a lookup (number, files, closes, merged)."""
    d = details.select("number", F.col("files").alias("f"), F.col("closes").alias("c"), F.col("merged").alias("m"))
    out = delta.join(d, "number", "left")
    new = {"files": F.coalesce("f", "files"), "closes": F.coalesce("c", "closes"), "merged": F.coalesce("m", "merged")}
    return out.select(*[new.get(f.name, F.col(f.name)).alias(f.name) for f in ITEM])


def union_items(issues: DataFrame, prs: DataFrame) -> DataFrame:
    return issues.unionByName(prs, allowMissingColumns=True)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Items of a corpus file: one JSON envelope with an ``items`` array, or a Parquet table of items."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(ITEM).parquet(path)
    envelope = T.StructType([T.StructField("items", T.ArrayType(ITEM))])
    return spark.read.schema(envelope).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.*")


def read_corpus_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("owner string, name string, fetchedAt timestamp").option("multiLine", True).json(path)


def write_corpus(items: DataFrame, path: str) -> None:
    """Sorted by number within files, so that readers can skip row groups by it."""
    items.repartitionByRange("number").sortWithinPartitions("number").write.mode("overwrite").parquet(path)


def read_labelled(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """Rows of one array of a labelled-set JSON file."""
    rows = spark.read.schema(f"{section} array<struct<{schema}>>").option("multiLine", True).json(path)
    return rows.select(F.explode(section).alias("r")).select("r.*")


def parse_report(lines: DataFrame, minimum: int = 50) -> DataFrame:
    """(a, b, rule, evidence) from the table rows of a rendered report's first section; lines: (pos, value).

    Titles that contain a bracketed number would confuse it; pass DataFrames between steps where you can.
    """
    head = lines.filter(F.col("value").startswith("## ")).select("pos", "value")
    first = head.filter(F.col("value").startswith("## Likely duplicates")).agg(F.min("pos").alias("a"))
    last = head.join(F.broadcast(first)).filter(F.col("pos") > F.col("a")).agg(F.min("pos").alias("z"))
    rows = lines.join(F.broadcast(first)).join(F.broadcast(last)).filter((F.col("pos") > F.col("a")) & (F.col("z").isNull() | (F.col("pos") < F.col("z"))))
    rows = rows.filter(F.col("value").startswith("| **"))
    ids = F.regexp_extract_all("value", F.lit(r"\[#(\d+)\]"), F.lit(1))
    cells = F.split(F.regexp_replace("value", r"^\||\|\s*\z", ""), r"\|")
    return rows.select(
        F.get(ids, F.lit(0)).cast("long").alias("a"),
        F.get(ids, F.lit(1)).cast("long").alias("b"),
        F.regexp_extract("value", r"^\| \*\*(\d+)\*\*", 1).cast("int").alias("rule"),
        F.trim(F.get(cells, F.size(cells) - 1)).alias("evidence"),
    ).filter(F.col("b").isNotNull() & (F.col("rule") >= minimum))


SPLIT_BYTES, UNSIZED = 4 << 20, ("InMemoryRelation", "LogicalRDD")


def balanced(df: DataFrame) -> DataFrame:
    """Spreads rows over tasks of a bounded size, all cores at least: their number follows the bytes of the tables read
    (compressed ones, as files are), not the cores that happen to be there; what is kept or streamed, whose size is an
    estimate by joins, counts by the session's shuffle partitions. A table read in enough splits is left alone."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    wanted = -(-sum(int(str(x.stats().sizeInBytes())) for x in leaves if x.nodeName() not in UNSIZED) // SPLIT_BYTES)
    if any(x.nodeName() in UNSIZED for x in leaves):
        wanted = max(wanted, min(200, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    wanted = max(spark.sparkContext.defaultParallelism, wanted)
    return df if len(leaves) == 1 and df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
