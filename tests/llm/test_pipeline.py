"""Every stage of the pipeline against a brute-force version on its own input."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
from twinsight.llm import langid

from .test_operators import WORD, brute_classes, plain_bits, plain_ids, plain_tree, repeats, table


def test_stages(docs, spark):
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "source_mixing", "packing"]

    known = stage["language_id"](spark, docs, None).persist()
    assert known.columns == columns
    labelled = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    trees = [plain_tree([t.encode() for d, t, x in labelled if x == g and t and not out(d)]) for g in ("de", "en")]
    fits = lambda b: min(plain_bits(x, b) for x in trees) <= 8 * len(b) + 64
    assert Counter(table(known)) == Counter((d, t) for d, t in table(docs) if t and any(c.isalpha() for c in t) and fits(t.encode()))

    unique = stage["jaccard_join"](spark, known, None).persist()
    assert unique.columns == columns
    want = Counter(c for c in {c for _, c, _, _ in brute_classes(table(known))})
    assert Counter(d for d, _ in table(unique)) == want and set(table(unique)) <= set(table(known))

    cut = stage["suffix_dedup"](spark, unique, None).persist()
    assert cut.columns == columns
    left = {d: n - gone for d, n, gone, _, _ in repeats(table(unique), 200)}
    whole = dict(table(unique))
    for d, t in table(cut):
        n = len(t.encode())
        assert n == left[d] or (n < left[d] and left[d] - n <= 8 and left[d] < len(whole[d].encode()))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = stage["source_mixing"](spark, cut, None).persist()
    assert mixed.columns == columns
    times, before = Counter(table(mixed)), Counter(table(cut))
    assert set(times) <= set(before) and all(times[k] <= 2 * before[k] for k in times)
    size = lambda c: sum(len(WORD.findall(t)) * n for (_, t), n in c.items())
    assert abs(size(times) - 1.5 * size(before)) < 0.05 * size(before) + 20

    got = Counter()
    for r in stage["packing"](spark, mixed, None).collect():
        got[r["doc_id"]] += r["length"]
    want = Counter()
    for (d, t), n in times.items():
        want[d] += n * len(plain_ids([t])[0])
    assert got == want


def test_run_is_the_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_language_stage_goes_by_scores(spark):
    noise = "qzx vkj wqx zzk xjq kvv"
    rows = [(i, f"the lantern by the river and the engine {i}" if i % 2 else f"{noise} {i}", "en" if i % 2 else "und", "web", 40) for i in range(40)]
    rows += [(100, "the engine by the river", None, "web", 23), (101, noise * 3, None, "web", 60), (102, "12 34", None, "web", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, None).collect()}
    assert got == {r["doc_id"] for r in langid.identify(docs).filter("lang_pred <> 'und'").collect()}
    assert got == {i for i in range(40) if i % 2} | {100}


def test_run_hands_over_whole_tables(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read = []
    stage = lambda spark, d, sf_dir: (read.append(d.inputFiles()), d.filter("doc_id > 3"))[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    corpus_pipeline.run(spark, str(tmp_path))
    assert all(str(tmp_path) in f for f in read[0])
    assert read[1] and read[2] and not any(str(tmp_path) in f for x in read[1:] for f in x) and not set(read[1]) & set(read[2])


def test_language_stage_drops_unknown_languages(spark):
    greek = "η γρήγορη καφετιά αλεπού πηδάει πάνω από το τεμπέλικο σκυλί"
    rows = [(i, f"the lantern by the river and the engine {i} over the quiet garden", "en", "web", 60) for i in range(40)]
    rows += [(100, greek, None, "web", 60), (101, "the quiet river", None, "web", 15), (102, "x", None, "web", 1), (103, None, "en", "web", 0)]
    docs = spark.createDataFrame([r + (1, "l") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, letter string")
    kept = corpus_pipeline.language_id(spark, docs, None)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(40), 101, 102}


def test_stages_on_empty_tables(spark, docs):
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, None)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
