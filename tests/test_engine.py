import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from twinsight.config import Caps, Config, Retrieval
from twinsight.operators import evaluation, index, judge, limits, retrieval, rules
from twinsight.plans import reports
from twinsight.plans.store import Store
from twinsight.sources import items as S
from twinsight.streaming.limits import decide
from twinsight.streaming.live import LiveStore

DAY = dt.datetime(2024, 5, 1)


def item(number, title, body="", kind="ISSUE", state="OPEN", merged=None, author="ann", days=0, files=None, closes=None):
    return (number, kind, title, body, state, merged, author, DAY + dt.timedelta(days=days), None, [], files, closes)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        item(1, "fix: panic in flattenJump when target missing", "stack trace alpha beta gamma"),
        item(2, "fix(ast): Panic in flattenJump when target missing", "stack trace alpha beta", days=3),
        item(3, "add grpc example", "walkthrough grpc server", "PR", "OPEN", False, "bob", 1, ["a.go", "b.go", "go.mod"]),
        item(4, "add http example", "walkthrough http server", "PR", "OPEN", False, "bob", 2, ["a.go", "b.go", "c.go"]),
        item(5, "unify logger", "closes #1 and mentions #2", "PR", "MERGED", True, "cat", 4, ["d.go"], [7]),
        item(6, "unify logger", "", "PR", "CLOSED", False, "cat", 40, []),
        item(7, "logger drops lines", None, days=5),
    ]
    return spark.createDataFrame(rows, S.ITEM).persist()


@pytest.fixture(scope="module")
def store(items):
    return Store.build(items)


def test_bm25_hand_case(spark):
    one = spark.createDataFrame([item(1, "zebra")], S.ITEM)
    q = spark.createDataFrame([(9, "zebra zebra", "")], "qid long, title string, body string")
    hit = retrieval.bm25(index.Index.build(one), q).first()
    assert hit["raw"] == pytest.approx(round(math.log(1 + 0.5 / 1.5) * 3 * 2.2 / 4.2, 9))


def test_statistics_count_empty_documents(store):
    assert store.index.n == 7


def test_file_overlap_keeps_query_order(items):
    q = items.filter("number = 4").select(F.col("number").alias("qid"), F.array(F.lit("c.go"), F.lit("b.go"), F.lit("a.go"), F.lit("go.sum")).alias("files"), F.lit(4).cast("long").alias("exclude"))
    r = retrieval.file_overlap(items, q).collect()
    assert [(x["number"], x["raw"], x["shared"]) for x in r] == [(3, round(2 / 3, 9), ["b.go", "a.go"])]


def test_fusion_ties_prefer_lexical(spark):
    a = spark.createDataFrame([(1, 10, "bm25", 1, 5.0), (1, 30, "bm25", 2, 4.0)], "qid long, number long, retriever string, rnk int, raw double")
    b = spark.createDataFrame([(1, 20, "files", 1, 1.0), (1, 30, "files", 2, 0.5)], "qid long, number long, retriever string, rnk int, raw double")
    r = retrieval.fuse([b, a]).orderBy("rnk").collect()
    assert [x["number"] for x in r] == [30, 10, 20]
    assert r[0]["fused"] == round(2 / 62, 12) and r[1]["fused"] == round(1 / 61, 12)


def test_linked_pairs(spark):
    rows = [item(12, "i"), item(123, "i"), item(5, "i"), item(50, "p", "fixed #123, see #12", "PR", "OPEN", False), item(51, "p", "Fixes: #12", "PR", "OPEN", False, closes=[5]), item(52, "p", None, "PR", "OPEN", False)]
    d = spark.createDataFrame(rows, S.ITEM)
    assert {tuple(r) for r in rules.linked(d, rules.references(d)).collect()} == {(50, 123), (12, 51), (5, 51)}
    assert {tuple(r) for r in rules.linked(d, rules.mentions(d)).collect()} == {(12, 50), (50, 123), (12, 51)}


def score(items, a, b, rank):
    spark = items.sparkSession
    pairs = spark.createDataFrame([(a, b, rank)], "a long, b long, bm25_rank int")
    return rules.score_pairs(pairs, items, rules.file_idf(items), rules.target_vocabulary(items)).first()


def test_duplicate_score_adds_up(items):
    r = score(items, 1, 2, 1)  # same title 0.6, top 0.25, same author within 14 days 0.3 -> 1
    assert r["dup_score"] == 1.0 and r["dup_ev"] == ["identical titles", "top lexical match", "same author, 3d apart (self-refile)"]
    r = score(items, 3, 4, 2)  # half the title 0.25, rank 0.15, same author 0.3, series -0.35
    assert r["dup_score"] == pytest.approx(0.25 + 0.15 + 0.3 - 0.35) and "likely a series" in " ".join(r["dup_ev"])
    assert r["col_score"] == pytest.approx(0.5 + 0.4 * 2 / 3) and r["col_ev"][0] == "2 shared files: a.go, b.go"
    assert score(items, 5, 6, None)["dup_score"] == pytest.approx(0.6 + 0.1 - 0.2)  # files unknown or none: -0.2


def test_report_and_renderer(store):
    report = store.report()
    rows = {(r["a"], r["b"]): r for r in report.collect()}
    assert (1, 2) in rows and (2, 1) not in rows and not any(6 in p for p in rows)
    text = reports.markdown(reports.report_lines(report, "https://example.org/p"))
    assert "## Likely duplicates" in text and "| **100** | [#1](https://example.org/p/issues/1) ISSUE open<br>" in text
    spark = report.sparkSession
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "pos long, value string")
    back = S.parse_report(lines).filter("a = 1 and b = 2").first()
    assert back["rule"] == 100


def test_fold_equals_rebuild(spark, items):
    base = Store.build(items)
    delta = spark.createDataFrame([item(2, "now about sockets", "sockets leak"), item(99, "brand new zebra"), item(99, "brand new zebra"), item(5, "unify logger", "edited", "PR", "MERGED", True)], S.ITEM)
    folded = base.fold(delta)
    rebuilt = index.Index.build(folded.items)
    assert (folded.index.n, folded.index.avg_len) == (rebuilt.n, pytest.approx(rebuilt.avg_len))
    assert index.frequency_difference(index.document_frequency(folded.index.entries), index.document_frequency(rebuilt.entries)).count() == 0
    got = {r["number"]: r for r in folded.items.collect()}
    assert got[5]["files"] == ["d.go"] and got[5]["closes"] == [7] and got[5]["body"] == "edited"
    assert folded.meta == {"added": 1, "updated": 2}
    e = index.entries(index.latest(delta))
    d = index.fold_frequency(index.document_frequency(base.index.entries), base.index.entries, e)
    assert index.frequency_difference(d, index.document_frequency(rebuilt.entries)).count() == 0


def test_validation_of_replies(spark):
    good = {"number": "7", "verdict": "duplicate", "likelihood": 150, "reason": "r" * 300}
    rows = [good, {"number": 8, "verdict": "series", "confidence": 40}, {"number": 8, "verdict": "related", "likelihood": 1}, {"number": 99, "verdict": "duplicate"}, {"number": 9, "verdict": "sure"}, {"number": 9, "verdict": "related", "likelihood": "junk"}]
    replies = [(1, json.dumps({"results": rows}), None), (2, "{}", None), (3, "not json", None), (4, json.dumps({"results": [{"number": 99, "verdict": "duplicate"}]}), None), (5, None, "TimeoutError: slow")]
    r = spark.createDataFrame(replies, "qid long, reply string, error string")
    c = spark.createDataFrame([(q, n) for q in range(1, 6) for n in (7, 8, 9)], "qid long, number long")
    got = {(x["qid"], x["number"]): x for x in judge.validate(r, c).collect()}
    assert got[1, 7]["likelihood"] == 100 and len(got[1, 7]["reason"]) == 200 and got[1, 7]["dropped"] == 2
    assert (got[1, 8]["verdict"], got[1, 8]["likelihood"], got[1, 9]["likelihood"]) == ("series", 40.0, 0.0)
    assert [got[q, None]["error"] for q in (2, 3, 4, 5)] == ["empty reply", "reply is not JSON", "no usable rows in reply", "TimeoutError: slow"]


def test_analyze_and_health(store, spark):
    q = spark.createDataFrame([(100, "ISSUE", "panic in flattenJump target missing", "alpha beta gamma", None), (101, "ISSUE", "qqqq", "", None)], "qid long, kind string, title string, body string, files array<string>")
    got = store.analyze(q, judge.stub_scorer).collect()
    assert {r["qid"] for r in got} <= {100} and all(r["source"] == "judge" for r in got)
    assert store.health().first()["items"] == 7
    down = store.judged(q.filter("qid = 100"), lambda s, u: 1 / 0)
    assert "ZeroDivisionError" in down.first()["error"]


def test_cost(spark):
    d = spark.createDataFrame([("deepseek-v4-flash", 1_000_000, 500_000), ("other", 1_000_000, 500_000), ("other", None, None)], "m string, p long, c long")
    assert [r[0] for r in d.select(judge.cost(F.col("m"), F.col("p"), F.col("c"))).collect()] == [pytest.approx(0.28), pytest.approx(1.0), 0.0]


def claims(spark, rows):
    return spark.createDataFrame([(i, c, DAY + dt.timedelta(seconds=s), v) for i, (c, s, v) in enumerate(rows)], "event_id long, caller string, ts timestamp, cost double")


def test_limits_and_precedence(spark):
    c = claims(spark, [("a", i, 0.0) for i in range(21)] + [("a", 3600, 0.0), ("b", 10, 5.0), ("b", 20, 0.0), ("b", 40 * 86400, 0.0)])
    got = {r["event_id"]: r for r in limits.verdicts(limits.fixed_windows(c), Caps(monthly_usd=3.0)).collect()}
    assert got[19]["ok"] is False  # the month's money went with event 22, ten seconds in
    assert got[5]["ok"] and got[20]["code"] == "BUDGET" and got[23]["code"] == "BUDGET" and got[24]["ok"]
    rich = {r["event_id"]: r for r in limits.verdicts(limits.fixed_windows(c), Caps(monthly_usd=99.0)).collect()}
    assert rich[19]["ok"] and rich[20]["code"] == "RATE" and rich[20]["message"] == "rate limit: 20/hour" and rich[21]["ok"]
    roll = {r["event_id"]: (r["hour_n"], r["day_n"]) for r in limits.rolling_windows(c).collect()}
    assert roll[21] == (21, 22)  # strictly less than an hour old


def test_evaluation(spark):
    s = spark.createDataFrame([(True, 92.0), (True, 85.0), (False, 10.0), (False, 5.0)], "want boolean, score double")
    r = evaluation.separation(s).first()
    assert (r["pos_mean"], r["neg_mean"], r["disjoint"]) == (88.5, 7.5, True)
    best = evaluation.best_cut(evaluation.threshold_sweep(s, 0, 100, 5)).first()
    assert (best["threshold"], best["correct"]) == (15.0, 4)
    assert evaluation.accuracy(s, 70).first()["correct"] == 4
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 9)], "qid long, number long, rnk int")
    want = spark.createDataFrame([(1, 5), (1, 7)], "qid long, number long")
    assert evaluation.hard_gate(want, hits).first()["passed"] is False
    assert {tuple(r) for r in evaluation.recall_at(want, hits).collect()} == {(1, 1, 2), (None, 1, 2)}


def test_sources_round_trip(spark, items, tmp_path):
    S.write_corpus(items, str(tmp_path / "corpus.parquet"))
    assert S.read_corpus(spark, str(tmp_path / "corpus.parquet")).count() == 7
    rows = [json.loads(x) for x in items.toJSON().collect()]
    (tmp_path / "corpus.json").write_text(json.dumps({"owner": "o", "name": "n", "fetchedAt": "2024-05-01T00:00:00Z", "items": rows}))
    assert S.read_corpus(spark, str(tmp_path / "corpus.json")).count() == 7
    assert S.read_corpus_meta(spark, str(tmp_path / "corpus.json")).first()["name"] == "n"
    node = {"number": 1, "title": None, "body": "b", "state": "OPEN", "author": None, "createdAt": "2024-05-01T00:00:00Z", "labels": {"nodes": [{"name": "x"}]}}
    (tmp_path / "n.json").write_text(json.dumps(node))
    r = S.from_crawl(spark.read.schema(S.CRAWL_NODE).json(str(tmp_path / "n.json")), "ISSUE").first()
    assert (r["title"], r["author"], r["labels"], r["files"]) == ("", "ghost", ["x"], None)
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"q": 1, "t": 2, "want": True}]}))
    assert S.read_labelled(spark, str(tmp_path / "cases.json"), "cases", "q: long, t: long, want: boolean").first()["t"] == 2


def test_own_key_is_neither_counted_nor_charged(spark):
    c = claims(spark, [("a", i, 1.0) for i in range(6)])
    flag = F.when(F.col("event_id") == 5, None).otherwise(F.col("event_id") % 2 == 0)
    got = {r["event_id"]: (r["hour_n"], r["spend_before"], r["ok"]) for r in limits.decisions(c.withColumn("own_key", flag), Caps(per_caller_hour=2)).collect()}
    assert got == {0: (None, None, True), 2: (None, None, True), 4: (None, None, True), 1: (1, 0.0, True), 3: (2, 1.0, True), 5: (3, 2.0, False)}


def test_live_fold(spark, items, tmp_path):
    live = LiveStore(spark, str(tmp_path / "store"))
    live.start(items)
    pages = tmp_path / "pages"
    pages.mkdir()
    node = {"number": 3, "title": "add grpc sample", "body": "x", "state": "open", "user": {"login": "bob"}, "created_at": "2024-05-02T00:00:00Z", "labels": [{"name": "k"}, "plain"], "pull_request": {"merged_at": None}}
    (pages / "1.json").write_text(json.dumps(node) + "\n" + json.dumps(node | {"number": 200, "pull_request": None}))
    from twinsight.streaming.live import listing_stream

    live.follow(listing_stream(spark, str(pages)), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got, entries = live.read()
    rows = {r["number"]: r for r in got.collect()}
    assert len(rows) == 8 and rows[3]["files"] == ["a.go", "b.go", "go.mod"] and rows[3]["labels"] == ["k", "plain"]
    assert index.frequency_difference(index.document_frequency(entries), index.document_frequency(index.entries(got))).count() == 0
    f = live.freshness().first()
    assert (f["added"], f["updated"]) == (1, 1)
    live.fold(spark.createDataFrame([item(3, "again")], S.ITEM), 5)
    live.fold(spark.createDataFrame([item(3, "again")], S.ITEM), 5)
    assert live.versions()[-1] == 5 and live.read()[0].count() == 8


def test_live_versions_hold_changes_and_are_compacted(spark, items, tmp_path):
    from twinsight.config import Live

    live = LiveStore(spark, str(tmp_path / "store"), live=Live(compact_after=2))
    live.start(items)
    for v in range(7):
        live.fold(spark.createDataFrame([item(3, f"again {v}", kind="PR"), item(300 + v, "new one")], S.ITEM), v)
        got, ents = live.read()
        rows = {r["number"]: r for r in got.collect()}
        assert len(rows) == got.count() == 8 + v and rows[3]["title"] == f"again {v}" and rows[3]["files"] == ["a.go", "b.go", "go.mod"]
        assert index.frequency_difference(index.document_frequency(ents), index.document_frequency(index.entries(got))).count() == 0
        f = live.freshness().first()
        assert (f["added"], f["updated"]) == (1, 1)
    assert live.whole() == [-1, 2, 5]
    assert spark.read.parquet(str(tmp_path / "store" / "v=6" / "changed_items")).count() == 2
    assert {r["title"] for r in live.read(1)[0].filter("number = 3").collect()} == {"again 1"}
    assert live.vacuum() == [-1, 0, 1] and live.read()[0].count() == 14


def test_live_lookup_and_freshness(spark, items, tmp_path):
    from twinsight.config import Live
    from twinsight.streaming.live import listing_stream

    details = spark.createDataFrame([(201, ["x.go"], [1], False), (202, ["y.go"], [], True)], "number long, files array<string>, closes array<long>, merged boolean")
    live = LiveStore(spark, str(tmp_path / "store"), live=Live(pages=1, page_size=3, enriched=1), lookup=lambda wanted: details.join(wanted, "number", "left_semi"))
    live.start(items)
    assert live.freshness().first()["pending"]
    node = {"title": "t", "state": "open", "updated_at": "2024-06-01T00:00:00Z", "pull_request": {"merged_at": None}}
    (tmp_path / "p").mkdir()
    old = node | {"number": 203, "updated_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "p" / "1.json").write_text("\n".join(json.dumps(x) for x in (node | {"number": 201}, node | {"number": 202}, node | {"number": 204, "pull_request": None}, old)))
    q = live.follow(listing_stream(spark, str(tmp_path / "p"), 1, "2024-05-01T00:00:00Z"), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    got = {r["number"]: r for r in live.read()[0].filter("number > 200").collect()}
    assert set(got) == {201, 202, 204} and got[202]["files"] == ["y.go"] and got[202]["merged"] and got[201]["files"] is None
    f = live.freshness(q).first()
    assert (f["pending"], f["truncated"], f["error"], f["added"]) == (False, True, None, 3)

    def broken(wanted):
        raise OSError("no answer")

    live.lookup = broken
    live.fold(spark.createDataFrame([item(205, "new", kind="PR")], S.ITEM), 9)
    f = live.freshness().first()
    assert f["error"] == "OSError: no answer" and not f["truncated"] and live.read()[0].filter("number = 205").count() == 1


@pytest.mark.parametrize("tile", [2048, 7])
def test_nearest_vectors_match_brute_force(spark, monkeypatch, tile):
    import random

    from twinsight.operators import nearest

    monkeypatch.setattr(nearest, "TILE", tile)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(60)] + [(70, None), (71, [1.0]), (72, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "number long, vector array<double>").repartition(3)
    asked = [(i, i if i % 2 else None, rows[i][1]) for i in range(0, 60, 2)] + [(1, 1, rows[1][1]), (90, None, None)]
    q = spark.createDataFrame(asked, "qid long, exclude long, vector array<double>")
    got = {(r["qid"], r["number"], r["rnk"], r["raw"]) for r in retrieval.vector(v, q, 5).collect()}
    want = set()
    for qid, own, x in asked[:-1]:
        hits = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), n) for n, y in rows[:60] if n != own)[:5]
        want |= {(qid, n, i + 1, -s) for i, (s, n) in enumerate(hits)}
    assert got == want
    assert retrieval.vector(v, q.limit(0), 5).count() == 0 and retrieval.vector(v.limit(0), q, 5).count() == 0


def test_embedding_by_an_injected_encoder(spark, items):
    from twinsight.operators import embedding

    got = {r["number"]: r["vector"] for r in embedding.embed(items, embedding.letter_encoder, 2).collect()}
    assert len(got) == 7 and all(sum(x * x for x in v) == pytest.approx(1) for v in got.values())
    with pytest.raises(Exception, match="vectors of"):
        embedding.embed(items, lambda texts: [[1.0]] * (len(texts) + 1)).count()


def test_crawl_follows_cursors(spark):
    from twinsight.sources import crawl

    def fetch(kind, cursor):
        pages = {("ISSUE", None): ([1, 2], "a"), ("ISSUE", "a"): ([3], None), ("PR", None): ([4], None)}
        numbers, after = pages[kind, cursor]
        return {"nodes": [{"number": n, "title": f"t{n}", "state": "OPEN", "files": {"nodes": [{"path": "a.go"}]}} for n in numbers], "cursor": after}

    got = {r["number"]: (r["kind"], r["title"], r["files"]) for r in crawl.crawl(spark, fetch).collect()}
    assert got == {1: ("ISSUE", "t1", None), 2: ("ISSUE", "t2", None), 3: ("ISSUE", "t3", None), 4: ("PR", "t4", ["a.go"])}
    with pytest.raises(Exception, match="came twice"):
        crawl.crawl_nodes(spark, lambda kind, cursor: {"nodes": [], "cursor": "a"}, "PR").count()


def test_stream_decisions(spark, tmp_path):
    claims(spark, [("a", i, 0.0) for i in range(3)] + [("a", 3601, 0.0), ("b", 5, 0.0)]).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("event_id long, caller string, ts timestamp, cost double").parquet(str(tmp_path / "c"))
    q = decide(stream, Caps(per_caller_hour=2)).writeStream.format("memory").queryName("decided").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["event_id"]: (r["hour_n"], r["day_n"], r["ok"]) for r in spark.table("decided").collect()}
    assert got == {0: (1, 1, True), 1: (2, 2, True), 2: (3, 3, False), 3: (1, 4, True), 4: (1, 1, True)}


def test_late_claims_count_in_their_own_hour(spark, tmp_path):
    """10:01, 10:02, then a late 9:59, then 10:03: the last is the third of its hour."""
    claims(spark, []).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("event_id long, caller string, ts timestamp, cost double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    q = decide(stream, Caps(per_caller_hour=2)).writeStream.format("memory").queryName("late").start()
    try:
        for i, minute in enumerate((601, 602, 599, 603)):
            one = spark.createDataFrame([(i, "a", DAY + dt.timedelta(minutes=minute), 0.0)], "event_id long, caller string, ts timestamp, cost double").coalesce(1)
            one.write.mode("append").parquet(str(tmp_path / "c"))
            q.processAllAvailable()
    finally:
        q.stop()
    got = {r["event_id"]: (r["hour_n"], r["day_n"], r["ok"]) for r in spark.table("late").collect()}
    assert got == {0: (1, 1, True), 1: (2, 2, True), 2: (1, 3, True), 3: (3, 4, False)}


def test_fractions_name_no_candidate(spark):
    reply = json.dumps({"results": [{"number": 12.7, "verdict": "related", "likelihood": 5}, {"number": 12.0, "verdict": "series", "likelihood": 6}]})
    v = judge.validate(spark.createDataFrame([(1, reply, None)], "qid long, reply string, error string"), spark.createDataFrame([(1, 12)], "qid long, number long")).collect()
    assert [(r["number"], r["verdict"], r["dropped"]) for r in v] == [(12, "series", 1)]


def test_scorer_that_hangs_is_an_error():
    import time

    began = time.time()
    assert judge.call(lambda s, u: time.sleep(5), "x", 0.2) == (None, "no reply within 0.2 s")
    assert time.time() - began < 3
    assert judge.call(lambda s, u: u, "x", 5) == ("x", None)


def test_verdict_cache_is_asked_once(store, tmp_path):
    q = store.items.sparkSession.createDataFrame([(900, "ISSUE", "panic in flattenJump when target missing", "stack trace alpha beta gamma panic flattenJump target"), (901, "ISSUE", "zzz", "qqq")], "qid long, kind string, title string, body string")
    log, cache = tmp_path / "calls", str(tmp_path / "cache")

    def scorer(system, user):
        with log.open("a") as f:
            f.write("call\n")
        return judge.stub_scorer(system, user)

    def broken(system, user):
        raise ValueError("down")

    cfg = Config(retrieval=Retrieval(short_circuit_score=1.0))
    s = Store(store.items, store.index, config=cfg)
    first = s.analyze(q, scorer, cache=cache, base="https://x.example/").collect()
    again = s.analyze(q, broken, cache=cache, base="https://x.example/").collect()
    key = lambda rows: sorted((r["qid"], r["number"], r["verdict"], r["likelihood"], r["source"], r["url"], r["is_new"]) for r in rows)
    assert key(first) == key(again) and {r["source"] for r in first} == {"judge"} and first[0]["url"].startswith("https://x.example/issues/")
    assert log.read_text().count("call") == 1
    other = s.analyze(q, broken, cache=str(tmp_path / "other")).collect()
    assert {r["source"] for r in other} == {"retrieval"} and "down" in other[0]["judge_error"]


def test_pair_queries_have_every_pair_and_the_twin_rows(spark):
    import duckdb

    from twinsight.plans import frames
    from twinsight.plans import retrieval_queries as Q
    from twinsight.plans.registry import ORACLE

    path = "/root/testdata/sf0.001"
    prs = {r["number"]: set(r["files"]) for r in frames.pull_requests(spark, path).collect() if r["files"]}
    numbers = sorted(prs)
    want = {(a, b): len(prs[a] & prs[b]) for i, a in enumerate(numbers) for b in numbers[i + 1 :] if prs[a] & prs[b]}
    got = {"file_jaccard_pairs": Q.file_jaccard_pairs(spark, path).collect(), "collision_score": Q.collision_score(spark, path).collect()}
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    for name, rows in got.items():
        have = {(r["a"], r["b"]): tuple(r)[2:] for r in rows}
        assert len(rows) == len(have) and set(have) == set(want)
        twin = con.execute(ORACLE[name]).fetchall()
        assert len(twin) == len(have)
        for a, b, *values in twin:
            assert have[a, b] == pytest.approx(tuple(values), abs=2e-9)
    for r in got["file_jaccard_pairs"]:
        n = want[r["a"], r["b"]]
        assert r["j"] == pytest.approx(n / (len(prs[r["a"]]) + len(prs[r["b"]]) - n), abs=1e-9)
