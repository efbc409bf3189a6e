"""Queries over scorer replies, limits, spend, evaluation arithmetic and streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..config import Caps
from ..operators import evaluation, judge, limits
from ..operators.held import own_folder
from ..operators.index import document_frequency
from ..sources import adapters
from ..streaming.limits import day_counts, decide
from ..streaming.live import LiveStore
from . import frames
from . import text_queries  # noqa: F401 - registers the twin of stream_fold
from .registry import ORACLE, query, table

CAPS = Caps(per_caller_hour=1, per_caller_day=4, global_day=340, monthly_usd=5000.0)

_COUNTED = """WITH c AS (
  SELECT event_id, user_id AS caller, ts, value AS cost,
    row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS hour_n,
    row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS day_n,
    row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS global_n FROM events
)"""


@query(f"{_COUNTED} SELECT event_id, hour_n, day_n, global_n FROM c")
def rate_fixed_window(spark, sf_dir):
    return limits.fixed_windows(frames.claims(spark, sf_dir)).select("event_id", "hour_n", "day_n", "global_n")


@query(
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS hour_n, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS day_n, "
    "row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS global_n FROM events"
)
def rate_rolling_window(spark, sf_dir):
    return limits.rolling_windows(frames.claims(spark, sf_dir)).select("event_id", "hour_n", "day_n", "global_n")


@query(
    f"""{_COUNTED}, k AS (SELECT *, CASE WHEN hour_n > 1 OR day_n > 4 OR global_n > 340 THEN 0 ELSE cost END AS charged FROM c),
s AS (SELECT *, round(coalesce(sum(charged) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spend_before FROM k)
SELECT event_id, spend_before, NOT (spend_before >= 5000 OR hour_n > 1 OR day_n > 4 OR global_n > 340) AS ok,
  CASE WHEN spend_before >= 5000 THEN 'BUDGET' WHEN hour_n > 1 OR day_n > 4 THEN 'RATE' WHEN global_n > 340 THEN 'BUDGET' END AS code FROM s"""
)
def claim_verdict(spark, sf_dir):
    return limits.verdicts(limits.fixed_windows(frames.claims(spark, sf_dir)), CAPS).select("event_id", "spend_before", "ok", "code")


@query(
    """WITH c AS (
  SELECT event_id, ts, value AS cost, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS hour_n, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS day_n,
    row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS global_n FROM events WHERE user_id % 10 <> 0
), k AS (SELECT *, CASE WHEN hour_n > 1 OR day_n > 4 OR global_n > 340 THEN 0 ELSE cost END AS charged FROM c),
s AS (SELECT *, round(coalesce(sum(charged) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spend_before FROM k)
SELECT event_id, false AS own_key, spend_before, NOT (spend_before >= 5000 OR hour_n > 1 OR day_n > 4 OR global_n > 340) AS ok,
  CASE WHEN spend_before >= 5000 THEN 'BUDGET' WHEN hour_n > 1 OR day_n > 4 THEN 'RATE' WHEN global_n > 340 THEN 'BUDGET' END AS code FROM s
UNION ALL SELECT event_id, true, NULL, true, NULL FROM events WHERE user_id % 10 = 0"""
)
def claim_verdict_own_key(spark, sf_dir):
    """All claims; callers of every tenth number bring their own key."""
    claims = frames.claims(spark, sf_dir)
    return limits.decisions(claims.withColumn("own_key", F.col("caller").cast("long") % 10 == 0), CAPS).select("event_id", "own_key", "spend_before", "ok", "code")


@query("SELECT strftime(ts, '%Y%m') AS month, count(*) AS calls, round(sum(value), 6) AS usd FROM events GROUP BY 1")
def monthly_spend(spark, sf_dir):
    return limits.monthly_spend(frames.claims(spark, sf_dir))


@query("SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS used FROM events GROUP BY 1")
def used_per_day(spark, sf_dir):
    return limits.used_on(frames.claims(spark, sf_dir))


@query(
    "SELECT event_id, round((event_id * 3 * CASE event_type WHEN 'click' THEN 0.14::DOUBLE WHEN 'view' THEN 0.435::DOUBLE WHEN 'signup' THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END "
    "+ user_id * CASE event_type WHEN 'click' THEN 0.28::DOUBLE WHEN 'view' THEN 0.87::DOUBLE WHEN 'signup' THEN 0.08::DOUBLE ELSE 1::DOUBLE END) / 1000000::DOUBLE, 12) AS usd FROM events"
)
def cost_of_usage(spark, sf_dir):
    model = F.when(F.col("event_type") == "click", judge.PRICES[0][0]).when(F.col("event_type") == "view", judge.PRICES[1][0]).when(F.col("event_type") == "signup", judge.PRICES[2][0]).otherwise("another")
    return table(spark, sf_dir, "events").select("event_id", F.round(judge.cost(model, F.col("event_id") * 3, F.col("user_id")), 12).alias("usd"))


@query(
    """WITH r AS (SELECT event_id, user_id, value, CASE event_id % 7 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'subsumes' WHEN 2 THEN 'subsumed_by' WHEN 3 THEN 'series' WHEN 4 THEN 'related' WHEN 5 THEN 'unrelated' ELSE 'sure' END AS verdict FROM events),
f AS (SELECT user_id, verdict, value, event_id, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS k, event_id % 5 AS number FROM r WHERE verdict <> 'sure' AND event_id % 5 <> 4),
d AS (SELECT user_id, count(*) FILTER (verdict = 'sure' OR event_id % 5 = 4) AS dropped FROM r GROUP BY user_id)
SELECT f.user_id AS qid, number, verdict, least(100.0::DOUBLE, value) AS likelihood, 'r' || event_id AS reason, d.dropped FROM f JOIN d USING (user_id) WHERE k = 1"""
)
def judge_validate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("duplicate", "subsumes", "subsumed_by", "series", "related", "unrelated", "sure")]), (F.col("event_id") % 7 + 1).cast("int"))
    row = F.struct("event_id", F.struct((F.col("event_id") % 5).alias("number"), verdict.alias("verdict"), F.col("value").alias("likelihood"), F.concat(F.lit("r"), "event_id").alias("reason")).alias("r"))
    rows = e.groupBy(F.col("user_id").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("results"))
    replies = rows.select("qid", F.to_json(F.struct("results")).alias("reply"), F.lit(None).cast("string").alias("error"))
    cands = rows.select("qid", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")).alias("number"))
    return judge.validate(replies, cands).select("qid", "number", "verdict", "likelihood", "reason", F.col("dropped").cast("long").alias("dropped"))


@query(
    "SELECT event_id, CASE WHEN l >= 90 THEN 'very likely the same work' WHEN l >= 70 THEN 'probably the same work' WHEN l >= 40 THEN 'genuinely uncertain' WHEN l >= 10 THEN 'probably distinct work' ELSE 'clearly distinct' END AS band, "
    "l >= 70 AND event_type = 'click' AS accepted FROM (SELECT *, value / 5 AS l FROM events)"
)
def likelihood_band(spark, sf_dir):
    like = F.col("value") / 5
    verdict = F.when(F.col("event_type") == "click", "duplicate").otherwise("series")
    return table(spark, sf_dir, "events").select("event_id", judge.band(like).alias("band"), judge.accepted(like, verdict).alias("accepted"))


_LABELS = "WITH s AS (SELECT quality = 1 AS want, least(100.0::DOUBLE, floor(length(text) / 50.0)::DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"


@query(f"{_LABELS} SELECT t::DOUBLE AS threshold, count(*) FILTER ((score >= t) = want) AS correct, round(count(*) FILTER ((score >= t) = want)::DOUBLE / count(*), 9) AS accuracy FROM s, (SELECT unnest(range(0, 101, 5)) AS t) GROUP BY t")
def threshold_sweep(spark, sf_dir):
    return evaluation.threshold_sweep(frames.scored_labels(spark, sf_dir), 0.0, 100.0, 5.0).withColumn("accuracy", F.round("accuracy", 9))


@query(f"{_LABELS} SELECT CASE WHEN score < 10 THEN '0-9' WHEN score < 40 THEN '10-39' WHEN score < 70 THEN '40-69' WHEN score < 90 THEN '70-89' ELSE '90-100' END AS band, count(*) AS n, count(*) FILTER (want) AS positives FROM s GROUP BY 1")
def calibration_bands(spark, sf_dir):
    return evaluation.calibration(frames.scored_labels(spark, sf_dir))


@query(
    f"{_LABELS}, a AS (SELECT avg(score) FILTER (want) AS pm, min(score) FILTER (want) AS p0, max(score) FILTER (want) AS p1, avg(score) FILTER (NOT want) AS nm, min(score) FILTER (NOT want) AS n0, max(score) FILTER (NOT want) AS n1 FROM s) "
    "SELECT round(pm, 9) AS pos_mean, p0 AS pos_min, p1 AS pos_max, round(nm, 9) AS neg_mean, n0 AS neg_min, n1 AS neg_max, round(pm - nm, 9) AS separation, p0 > n1 AS disjoint FROM a"
)
def class_separation(spark, sf_dir):
    s = evaluation.separation(frames.scored_labels(spark, sf_dir))
    return s.withColumns({c: F.round(c, 9) for c in ("pos_mean", "neg_mean", "separation")})


@query(
    "WITH s AS (SELECT doc_id, quality = 1 AS want, round(least(1.0::DOUBLE, length(text) / 5000.0), 9) AS rule, CASE WHEN toxic = 0 THEN least(100.0::DOUBLE, floor(length(text) / 50.0)::DOUBLE) END AS likelihood FROM documents JOIN labels USING (doc_id)) "
    "SELECT doc_id, rule >= 0.35::DOUBLE AS rule_says, coalesce(likelihood, 0) >= 70 AS judge_says, (rule >= 0.35::DOUBLE) = want AS rule_right, CASE WHEN likelihood IS NOT NULL THEN (likelihood >= 70) = want END AS judge_right, "
    "(rule >= 0.35::DOUBLE) = (coalesce(likelihood, 0) >= 70) AS agree FROM s"
)
def rules_vs_judge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.length("text")
    cases = d.select("doc_id", (F.col("quality") == 1).alias("want"), F.round(F.least(F.lit(1.0), n / 5000.0), 9).alias("rule"), F.when(F.col("toxic") == 0, F.least(F.lit(100.0), F.floor(n / 50.0).cast("double"))).alias("likelihood"))
    return evaluation.compare(cases).select("doc_id", "rule_says", "judge_says", "rule_right", "judge_right", "agree")


@query("SELECT item_id, sha256('' || chr(31) || text || chr(31) || '' || chr(31) || (SELECT count(*) FROM documents)) AS key FROM benchmark")
def verdict_cache_key(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return table(spark, sf_dir, "benchmark").select("item_id", judge.cache_key(F.lit(""), F.col("text"), F.lit(None).cast("array<string>"), F.lit(n)).alias("key"))


@query(
    "WITH c AS (SELECT CASE event_id % 4 WHEN 0 THEN 'deepseek-v4-flash' WHEN 1 THEN 'deepseek-v4-pro' WHEN 2 THEN 'llama-3.1-8b-instant' ELSE 'other' END AS m, CASE WHEN event_id % 7 > 0 THEN user_id * 10 END AS i, CAST(floor(value) AS BIGINT) AS o FROM events), "
    "u AS (SELECT coalesce(i, 0) AS i, o, (coalesce(i, 0) * CASE m WHEN 'deepseek-v4-flash' THEN 0.14::DOUBLE WHEN 'deepseek-v4-pro' THEN 0.435::DOUBLE WHEN 'llama-3.1-8b-instant' THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END "
    "+ o * CASE m WHEN 'deepseek-v4-flash' THEN 0.28::DOUBLE WHEN 'deepseek-v4-pro' THEN 0.87::DOUBLE WHEN 'llama-3.1-8b-instant' THEN 0.08::DOUBLE ELSE 1.0::DOUBLE END) / 1e6 AS usd FROM c) "
    "SELECT count(*) AS calls, CAST(sum(i) AS BIGINT) AS prompt_tokens, CAST(sum(o) AS BIGINT) AS completion_tokens, round(sum(usd), 6) AS usd, round(sum(usd) / count(*), 9) AS usd_per_call FROM u"
)
def token_totals(spark, sf_dir):
    """Tokens and dollars of all calls, and dollars a call."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    model = F.when(k == 0, "deepseek-v4-flash").when(k == 1, "deepseek-v4-pro").when(k == 2, "llama-3.1-8b-instant").otherwise("other")
    calls = e.select(model.alias("model"), F.when(F.col("event_id") % 7 > 0, F.col("user_id") * 10).alias("prompt_tokens"), F.floor("value").alias("completion_tokens"))
    return judge.totals(calls).withColumns({"usd": F.round("usd", 6), "usd_per_call": F.round("usd_per_call", 9)})


@query("SELECT date_trunc('day', ts) AS day, count(*) AS attempts FROM events GROUP BY 1")
def stream_day_counts(spark, sf_dir):
    """The day's counter of all callers, as a stream."""
    events = table(spark, sf_dir, "events")
    path = f"{sf_dir}/events.parque[t]"  # a pattern, as the table may be one file
    claims = adapters.claims(spark.readStream.schema(events.schema).parquet(path))
    name = f"days_{abs(hash(path))}"
    q = day_counts(claims).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()  # a row a day
    q.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "attempts")


@query(ORACLE["fold_df"])
def stream_fold(spark, sf_dir):
    """Folds the delta through a stream and returns the folded document frequencies."""
    at = tempfile.mkdtemp(prefix="twinsight-stream-") if not spark.conf.get("spark.checkpoint.dir", None) else f"{spark.conf.get('spark.checkpoint.dir')}/stream-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    delta = frames.delta(spark, sf_dir)
    delta.write.mode("overwrite").parquet(f"{at}/delta")
    store = LiveStore(spark, f"{at}/store")
    if not store.versions():
        store.start(frames.full_items(spark, sf_dir))
    stream = spark.readStream.schema(delta.schema).parquet(f"{at}/delta")
    store.follow(stream, f"{at}/checkpoint", availableNow=True).awaitTermination()
    return document_frequency(store.read()[1])


@query(f"{_COUNTED} SELECT event_id, CAST(caller AS VARCHAR) AS caller, hour_n, day_n, NOT (hour_n > 1 OR day_n > 4) AS ok, CASE WHEN hour_n > 1 OR day_n > 4 THEN 'RATE' END AS code FROM c")
def stream_rate_limit(spark, sf_dir):
    """Decides every claim of the event log as a stream."""
    events = table(spark, sf_dir, "events")
    path = f"{sf_dir}/events.parque[t]"  # a pattern, as the table may be one file
    claims = adapters.claims(spark.readStream.schema(events.schema).parquet(path))
    at = own_folder(spark, "decisions")
    out = decide(claims, CAPS)
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows").drop("ts")
