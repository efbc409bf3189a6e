"""Each operator against a brute-force version on a small table with nulls, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from twinsight.llm import chat, fingerprint, jaccard, langid, lm, mixing, packing, passages, search, suffix
from twinsight.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(low(t))


def table(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- 1 ---


def test_chat_collapses_prefixes(spark):
    say = lambda c, *t: [(c, i, r, x) for i, (r, x) in enumerate(t)]
    a, b, d = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    rows = say(1, a) + say(2, a, b) + say(3, a, b, d) + say(4, a, d) + say(5, a, b, d) + say(6, ("user", None)) + [(None, 0, None, "x"), (7, None, "user", "q"), (7, 1, "user", "q"), (7, 1, "user", "q")]
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["text"]) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {3, 4, 6, 7, None}
    assert got[3] == (3, 2, "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>\n")
    assert got[6][2] == "<|user|>\n<|end|>\n"
    assert got[7][0] == 3


def test_chat_long_conversation_is_one_row(spark):
    n = 2 * chat.CHUNK + 5
    rows = [(1, i, "user", f"t{i}") for i in range(n)] + [(2, i, "user", f"t{i}") for i in range(chat.CHUNK + 3)]
    rows += [(3, i, "user", f"s{i}") for i in range(chat.CHUNK - 2, chat.CHUNK + 2)]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(1, n), (3, 4)]
    assert got[0]["text"] == "".join(f"<|user|>\nt{i}<|end|>\n" for i in range(n))
    assert got[1]["text"] == "".join(f"<|user|>\ns{i}<|end|>\n" for i in range(chat.CHUNK - 2, chat.CHUNK + 2))


def test_chat_clashing_columns(spark):
    rows = [(1, 0, "user", "a", 9, 9, 9, 9, 9), (1, 1, "user", "b", 8, 8, 8, 8, 8), (2, 0, "user", "a", 7, 7, 7, 7, 7)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int, run int, place int, a int, n int")
    assert [(r["conv_id"], r["n_turns"], r["copies"]) for r in chat.render(t).collect()] == [(1, 2, 1)]


def test_chat_empty(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 2 ---


@pytest.mark.parametrize("block", [1 << 23, 5_000, 700])
def test_lm_matches_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    if block == 700:  # many more shards than tasks, hot words told from a part of the texts
        monkeypatch.setattr(lm, "TASKS", 3)
        monkeypatch.setattr(lm, "SAMPLE", 20_000)
    rows = table(docs)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    uni, pair, head = Counter(), Counter(), Counter()
    for d, t in rows:
        before = "\0"
        for w in () if out(d) else [*words(t), "\1"]:
            uni[w] += 1
            pair[before, w] += 1
            head[before] += 1
            before = w
    fan = Counter(h for h, _ in pair)
    n, v = sum(uni.values()), len(uni)
    want = []
    for d, t in rows:
        base = score = 0.0
        before = "\0"
        for w in [*words(t), "\1"]:
            p = (uni[w] + 1) / (n + v + 1)
            base += math.log10(p)
            score += math.log10((pair[before, w] + fan[before] * p) / (head[before] + fan[before]) if head[before] else p)
            before = w
        want.append((d, out(d), len(words(t)) + 1, sum(uni[w] > 0 for w in [*words(t), "\1"]), n, round(base, 6), round(score, 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- 3 ---


def repeats(rows, length):
    count = Counter(x[i : i + length] for _, t in rows for x in [(t or "").encode()] for i in range(len(x) - length + 1))
    for d, t in rows:
        x = (t or "").encode()
        gone = [False] * len(x)
        end = 0
        for i in range(len(x)):
            if i + length <= len(x) and count[x[i : i + length]] > 1:
                end = max(end, i + length)
            gone[i] = i < end
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        yield d, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()


@pytest.mark.parametrize("length,gram,collection", [(200, 50, 1 << 17), (60, 20, 2)])
def test_suffix_matches_brute_force(docs, monkeypatch, length, gram, collection):
    monkeypatch.setattr(suffix, "COLLECTION", collection)
    got = [tuple(r) for r in suffix.remove_repeats(docs, length=length, gram=gram).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=repr) == sorted(repeats(table(docs), length), key=repr)


def test_suffix_very_long_text(spark):
    """A text over one stretch (and over a megabyte), with repeats across and inside stretches."""
    import random

    rng = random.Random(6)
    passage = prose_of(rng, 60)
    body = [prose_of(rng, 110_000), passage, prose_of(rng, 60_000), passage]
    rows = [(1, " ".join(body)), (2, prose_of(rng, 30) + passage), (3, "x" * 700), (4, None)]
    assert len(rows[0][1]) > 1 << 20
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in suffix.remove_repeats(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == sorted(repeats(rows, 200))


def prose_of(rng, n):
    return " ".join(f"q{rng.randrange(10**7)}" for _ in range(n))


def test_transform_and_common_prefixes():
    """The segments on file against plain sorting of the aligned suffixes."""
    import numpy as np

    docs = [b"abracada", b"abracadb", b"xbracada", b"abracada"]
    columns = [(c, np.array([t[c] + 1 for t in docs], np.int16)) for c in range(7, -1, -1)]
    transform, common = suffix.Segments(), suffix.Segments()
    got = suffix.construct(np.zeros(4, np.int64), columns, 4, 5, transform, common)
    read = lambda f: (f.file.seek(0), np.frombuffer(f.file.read(), np.int16))[1]
    bwt, lcp = read(transform).reshape(-1, 4), read(common).reshape(-1, 5)
    order = list(range(4))
    for k, c in enumerate(range(7, -1, -1)):
        assert bwt[k].tolist() == [docs[i][c] + 1 for i in order]  # before the suffixes at c + 1
        order = sorted(range(4), key=lambda i: (docs[i][c:], i))
        ends = [docs[i][c:] for i in order]
        for x in range(1, 4):
            n = next((m for m, (p, q) in enumerate(zip(ends[x - 1], ends[x])) if p != q), len(ends[x]))
            assert lcp[k + 1][x] == min(n, 5)
    runs = {(d, a, b) for d, a, b in zip(*(x.tolist() for x in got))}
    assert runs == {(0, 0, 4), (3, 0, 4), (2, 1, 4), (1, 0, 3)}


# --- 4 ---


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [[*x.ids, 0] for x in Tokenizer.from_file(vocabulary()["tokenizer"]).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing_round_trip(docs):
    v = vocabulary()
    rows = packing.pack_documents(docs, **v, window=256, slack=4, with_ids=True).collect()
    fill = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) and len(r["ids"]) == r["length"] > 0
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    padding = 0
    for x in fill.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))]
        total = sum(n for _, n in x)
        assert total <= 256
        padding += 0 if total & (total - 1) == 0 else 256 - total
    assert padding <= 4 * len(fill)
    for d, texts in {d: [t for e, t in table(docs) if e == d] for d, _ in table(docs)}.items():
        want = sorted(i for ids in plain_ids(texts) for i in ids)
        assert sorted(i for _, ids in pieces[d] for i in ids) == want
        if len(texts) == 1:
            assert [i for _, ids in sorted(pieces[d]) for i in ids] == plain_ids(texts)[0]


def test_ids_are_the_tokenizers(docs):
    v = vocabulary()
    texts = ["Hello  world", "naïve café 12345\n\n  it's", "hello <|endoftext|> you", "<|endoftext|>", "<|endoftext", "ああ x \t y", "", "\x00 \u2028 𝔘", *(t or "" for _, t in table(docs))]
    want = [x[:-1] for x in plain_ids(texts)]
    assert want[2] == [31373, 220, 50256, 345]
    assert packing.encoder(**{"path": v["tokenizer"], "pattern": v["pattern"]})(texts) == want
    assert packing.encoder(v["tokenizer"], None)(texts) == want


def test_packing_special_token_in_a_text(spark):
    d = spark.createDataFrame([(1, "hello <|endoftext|> you"), (2, None)], "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.pack_documents(d, **vocabulary(), with_ids=True).orderBy("doc_id", "start").collect():
        got[r["doc_id"], r["doc_tokens"]] += r["ids"]
    assert got == {(1, 5): [31373, 220, 50256, 345, 0], (2, 1): [0]}


def best_fit_decreasing(lengths, window):
    """Sequences of (document, length), by a plain search for the tightest open one."""
    full = [[(d, window)] for d, n in enumerate(lengths) for _ in range(n // window)]
    bins = []
    for d, n in sorted(((d, n % window) for d, n in enumerate(lengths) if n % window), key=lambda x: (-x[1], x[0])):
        fits = [b for b in bins if sum(k for _, k in b) + n <= window]
        if fits:
            min(fits, key=lambda b: window - sum(k for _, k in b)).append((d, n))
        else:
            bins.append([(d, n)])
    return full, bins


@pytest.mark.parametrize("seed", range(4))
def test_pack_is_best_fit_decreasing(seed):
    import random

    rng = random.Random(seed)
    lengths = [rng.randint(1, 300) for _ in range(120)] + [64, 64, 128, 1, 1]
    got = defaultdict(list)
    for d, _, n, seq, _ in packing.pack(lengths, 64, 64):
        got[seq].append((d, n))
    full, bins = best_fit_decreasing(lengths, 64)
    fill = lambda x: Counter(sum(n for _, n in b) for b in x)  # noqa: E731 - equally open sequences may change places
    assert fill(got.values()) == fill(full + bins)


def test_pack_leaves_little_padding():
    lengths = [600] * 40 + [3]
    sizes = Counter()
    for _, _, n, seq, _ in packing.pack(lengths, 1024, 16):
        sizes[seq] += n
    assert sum(sizes.values()) == sum(lengths)
    assert all(1024 - n <= 16 or n & (n - 1) == 0 for n in sizes.values())


# --- 5 ---


def brute_classes(rows, threshold=0.8):
    texts = defaultdict(list)
    for d, t in rows:
        texts[t or ""].append(d)
    keys = list(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in keys]
    root, links = list(range(len(keys))), Counter()
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in combinations(range(len(keys)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    member = defaultdict(list)
    for i, t in enumerate(keys):
        member[find(i)] += texts[t]
    least = lambda ids: min((d for d in ids if d is not None), default=None)
    for i, t in enumerate(keys):
        for d in texts[t]:
            yield (d, least(member[find(i)]), links[i], len(texts[t])) if sets[i] else (d, d, 0, 1)


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_matches_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = [tuple(r) for r in jaccard.similar_documents(docs).select("doc_id", "class_id", "links", "copies").collect()]
    assert sorted(got, key=repr) == sorted(brute_classes(table(docs)), key=repr)


def test_keep_one_keeps_all_columns(docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, c, _, _ in brute_classes(table(docs))}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.count() == len(want)


def test_posterior_bound_keeps_likely_pairs():
    for n, least in jaccard.least_matches(0.8, 1e-5, 120):
        assert 0 <= least < 0.8 * n


# --- 6 ---


@pytest.mark.parametrize("shard", [1 << 25, 3_000])
def test_search_matches_brute_force(docs, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD", shard)
    rows = [(d, words(t)) for d, t in table(docs)]
    n, avg = len(rows), sum(len(w) for _, w in rows) / len(rows)
    df = Counter(x for _, w in rows for x in set(w))
    want = []
    for q in {d for d, _ in rows if d is not None and d % 5 == 0}:
        asked = set(next(w for d, w in rows if d == q))
        scores = []
        for d, w in rows:
            tf = Counter(w)
            s = sum(max(0.01, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in asked if tf[t])
            if s > 0:
                scores.append((-round(s, 6), d is None, d))
        want += [(q, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:4])]
    got = [(r[0], r[1], r[2], round(r[3], 6)) for r in search.top_k(docs, docs.filter("doc_id % 5 = 0"), k=4).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_search_empty_texts_among_few_hits(spark):
    texts = ["lantern", None, "rare lantern word", "", "copper river copper", "   ", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(1, "rare"), (2, "copper"), (3, "river lantern")], "doc_id long, text string")
    got = {}
    for r in search.top_k(d, q).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    assert got == {1: {2}, 2: {4}, 3: {0, 2, 4}}


def test_shard_ends_in_empty_text():
    import numpy as np
    import pyarrow as pa

    t = search.Terms()
    t.add(pa.array(["lantern", "", "rare word", ""]))
    t.index()
    s = search.Shard(t, np.arange(4), t.df, 4, 1.0)
    rare, _ = search.word_hashes(np.frombuffer(b"rare", np.uint8), np.array([0, 4]))
    ((ids, scores),) = s.search([np.unique(rare)], 2)
    assert ids.tolist() == [2] and (scores > 0).all()


def test_search_skips_blocks_and_keeps_ties(spark):
    """Blocks are skipped, and what is found equals all documents' scores in order, ties and null ids included."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(vocab[int(len(vocab) ** rng.random()) - 1] for _ in range(rng.choice([4, 30, 200]))) for _ in range(2500)]
    texts += texts[:40] * 2
    t = search.Terms()
    t.add(pa.array(texts))
    t.index()
    ids = np.arange(len(texts))[::-1].copy()
    ids[7] = np.iinfo(np.int64).max
    s = search.Shard(t, ids, t.df, len(texts), float(t.length.mean()))
    idf = np.maximum(0.01, np.log(1 + (len(texts) - t.df + 0.5) / (t.df + 0.5)))
    impact = idf[t.term] * (t.tf * 2.2) / (t.tf + 1.2 * (0.25 + 0.75 * t.length[t.doc] / t.length.mean()))
    queries = [np.unique(search.word_hashes(np.frombuffer(texts[i].encode(), np.uint8), np.array([0, len(texts[i])]))[0]) for i in range(0, 60, 3)]
    for q, got in zip(queries, s.search(queries, 10), strict=True):
        want = np.round(np.bincount(t.doc, weights=np.where(np.isin(t.keys[t.term], q), impact, 0.0)), 9)
        best = np.lexsort((ids, -want))[:10]
        assert got[0].tolist() == ids[best].tolist() and np.allclose(got[1], want[best], atol=2e-9)
    assert s.skipped > 0 and s.visited > 0


def shard_and_queries(texts, step):
    import numpy as np
    import pyarrow as pa

    t = search.Terms()
    t.add(pa.array(texts))
    t.index()
    queries = [np.unique(search.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0]) for x in texts[::step]]
    return t, search.Shard(t, np.arange(len(texts)), t.df, len(texts), float(t.length.mean())), queries


def test_search_index_is_made_without_many_copies_of_its_pairs(monkeypatch):
    """The most memory while a shard is indexed is less than 64 bytes a (document, term) pair."""
    import random
    import tracemalloc

    monkeypatch.setattr(search, "STEP", 1 << 12, raising=False)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(50_000)]
    texts = [" ".join(vocab[int(len(vocab) ** rng.random()) - 1] for _ in range(400)) for _ in range(1500)]
    tracemalloc.start()
    try:
        t, s, _ = shard_and_queries(texts, len(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 * len(s.term), peak / len(s.term)


def test_search_memory_does_not_grow_with_the_number_of_documents(monkeypatch):
    """Of a batch's queries on a shard of very many short texts a bounded number of sums is in memory at a time; what is found
    equals all documents' scores in order."""
    import random
    import tracemalloc

    import numpy as np

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [" ".join(vocab[int(len(vocab) ** rng.random()) - 1] for _ in range(4)) for _ in range(40_000)]
    t, s, queries = shard_and_queries(texts, 320)
    monkeypatch.setattr(search, "SUMS", 1 << 17, raising=False)
    tracemalloc.start()
    try:
        found = s.search(queries, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(queries) == 125 and peak < 125 * len(texts) * 8 / 4, peak
    idf = np.maximum(0.01, np.log(1 + (len(texts) - t.df + 0.5) / (t.df + 0.5)))
    impact = idf[t.term] * (t.tf * 2.2) / (t.tf + 1.2 * (0.25 + 0.75 * t.length[t.doc] / t.length.mean()))
    for q, (ids, scores) in list(zip(queries, found, strict=True))[::5]:
        want = np.round(np.bincount(t.doc, weights=np.where(np.isin(t.keys[t.term], q), impact, 0.0)), 9)
        best = np.lexsort((np.arange(len(texts)), -want))[:5]
        assert ids.tolist() == best.tolist() and np.allclose(scores, want[best], atol=2e-9)


def test_search_by_small_batches(docs, spark, monkeypatch):
    """Texts and queries of a shard that come in several batches, or in one, or several shards in one, give the same rows."""
    monkeypatch.setattr(search, "SHARD", 1 << 14)
    want = sorted(search.top_k(docs, docs.filter("doc_id % 5 = 0"), k=4).collect(), key=repr)
    monkeypatch.setattr(search, "PARTS", 2)
    for rows in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            assert want == sorted(search.top_k(docs, docs.filter("doc_id % 5 = 0"), k=4).collect(), key=repr)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_search_by_more_queries_than_may_wait(spark, monkeypatch):
    """Queries that are many times a shard are searched as they come, after those that came first."""
    rows = [(i, " ".join(f"w{j % 41}" for j in range(i, i + 40))) for i in range(300)]
    q = spark.createDataFrame(rows, "doc_id long, text string")
    d = spark.createDataFrame(rows[:3] + [(7, None)], "doc_id long, text string").coalesce(1)
    want = sorted(search.top_k(d, q, k=2).collect())
    assert {r["query_id"] for r in want} == set(range(300))
    monkeypatch.setattr(search, "SHARD", 1 << 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert want == sorted(search.top_k(d, q, k=2).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_search_disk_does_not_hold_every_copy_of_every_query(spark, monkeypatch):
    """A quarter of the texts as queries of 16 shards, each of which gets them all, and still no more than 4 times the texts
    on disk. Results are those of a single wave."""
    import os
    import random
    import threading

    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.getrandbits(32):08x}" for _ in range(500)) + f" common{i % 7} common{i % 11}") for i in range(400)]
    size = sum(len(t) + 1 for _, t in rows)
    monkeypatch.setattr(search, "SHARD", -(-size // 16))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tops = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {os.path.join(x, f) for top in tops for x, _, names in os.walk(top) for f in names if "shuffle" in f}
    old, peak, over = files(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            total = 0
            for name in files() - old:
                try:
                    total += os.path.getsize(name)
                except OSError:
                    pass
            peak[0] = max(peak[0], total)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = sorted(search.top_k(d, d.filter("doc_id % 4 = 0"), k=3).collect())
    finally:
        over.set()
        watcher.join()
    assert 0 < peak[0] < 4 * size, peak[0] / size
    assert len(got) == 300 and all(r["query_id"] == r["doc_id"] for r in got if r["rank"] == 1)
    monkeypatch.setattr(search, "wave_count", lambda load, shards: 1)
    assert got == sorted(search.top_k(d, d.filter("doc_id % 4 = 0"), k=3).collect())


# --- 7 ---


def test_language_id_held_out(spark):
    import random

    rng = random.Random(1)
    vocab = {"aa": "the of and river stone".split(), "bb": "der die und fluss stein".split(), "cc": "ле ми река камень и".split()}
    rows = [(i, " ".join(rng.choice(vocab[g]) for _ in range(12)), g) for i in range(240) for g in [list(vocab)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "bb"), (None, "der die und", "bb"), (903, "the of", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, g in rows:
        r = got[i]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert r["lang_pred"] == ("und" if i in (900, 901, 902) else g or "aa") and 0 <= r["score"] <= 1


def plain_tree(texts):
    """Successor counts of each context, byte by byte."""
    out = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
    for t in texts:
        for i, b in enumerate(t):
            for n in range(min(i, langid.ORDER) + 1):
                out[n][t[i - n : i]][b] += 1
    return out


def plain_bits(tree, t):
    def bits(ctx, b):
        got = tree[len(ctx)].get(ctx)
        if not got:
            return bits(ctx[1:], b) if ctx else 8.0
        total, kinds = sum(got.values()), len(got)
        if got.get(b):
            return math.log2((total + kinds) / got[b])
        return math.log2((total + kinds) / kinds) + (bits(ctx[1:], b) if ctx else 8.0)

    return sum(bits(t[max(0, j - langid.ORDER) : j], b) for j, b in enumerate(t))


def test_ppm_code_lengths_match_a_plain_tree():
    import numpy as np

    texts = {"x": [b"abracadabra abra", b"ab"], "y": [b"zyzzyva cab", b""]}
    join = lambda v: (np.frombuffer(b"".join(v), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in v]))))
    m = langid.train({k: langid.tree([langid.grams(*join(v), n) for n in range(langid.ORDER + 1)]) for k, v in texts.items()})
    asked = [b"abra cab", b"", b"qq\xff abr", b"z"]
    got = langid.code_lengths(m, *join(asked))
    for i, t in enumerate(asked):
        for k, lang in enumerate(m.langs):
            assert got[i, k] == pytest.approx(plain_bits(plain_tree(texts[lang]), t), rel=1e-5, abs=1e-6)


def test_language_id_matches_plain_trees(docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    trees = {g: plain_tree([t.encode() for d, t, x in rows if x == g and t and not out(d)]) for g in ("de", "en")}
    want = []
    for d, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            want.append((d, "und", 0.0))
            continue
        b = t.encode()
        cost = {g: plain_bits(x, b) for g, x in trees.items()}
        best = min(cost, key=lambda g: (cost[g], g))
        odds = sum(2 ** -min(1000, (c - cost[best]) * min(1, len(b)) / len(b)) for c in cost.values())
        want.append((d, best, round(1 / odds, 4)))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in langid.identify(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- 8 ---


def test_mixing_meets_targets(docs):
    rows = [tuple(r) for r in mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "copies", "taken").collect()]
    src = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    total = Counter()
    for _, s, n in src:
        total[s] += n
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, capped, goal = set(names), {}, 1.5 * sum(total.values())
    while True:
        level = (goal - sum(capped.values())) / max(1e-9, sum(weight[s] for s in left))
        over = [s for s in left if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2 * total[s]
            left.discard(s)
    want = {total[s]: capped.get(s, level * weight[s]) for s in names}
    taken, target = Counter(), {}
    for _, size, source_size, goal, copies, took in rows:
        assert took == copies * size <= 2 * size and goal == pytest.approx(want[source_size])
        taken[source_size] += took
        target[source_size] = goal
    assert sorted(r[1] for r in rows) == sorted(n for _, _, n in src)
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= 0.02 * goal + 5
    again = [tuple(r) for r in mixing.mix_sources(docs.repartition(5)).select("doc_id", "size", "source_size", "target", "copies", "taken").collect()]
    assert sorted(rows, key=repr) == sorted(again, key=repr)


# --- 9 ---


def test_fingerprints(docs):
    rows = sorted(table(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])))
    d = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        got = {r["doc_id"]: r for r in fingerprint.fingerprints(d, parts=parts).collect()}
        for i, (k, t) in enumerate(rows):
            t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
            q = len(t) // 4
            edited = t[: len(t) - q] + nxt[:q]
            r = got[k]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            if edited == t:
                assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        same = defaultdict(set)
        for k, t in rows:
            same[t or ""].add(got[k]["fingerprint"])
        assert all(len(v) == 1 for v in same.values())


def plain_sketch(text):
    """The parse and the sketch, a symbol at a time."""
    from twinsight.llm.arrays import BASE, hash_family

    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    def toss(v):
        out = []
        for i, x in enumerate(v):
            d = (v[i - 1] if i else x ^ 1) ^ x
            bit = (d & -d).bit_length() - 1
            out.append(2 * bit + (x >> bit & 1))
        return out

    v = symbols = list(text.encode())
    found = []
    for level in range(3):
        runs = [i for i in range(len(v)) if i == 0 or v[i] != v[i - 1]]
        label = [v[i] for i in runs]
        for _ in range(4 if level else 3):
            label = toss(label)
        starts = [runs[i] for i in range(len(runs)) if i == 0 or (i < len(runs) - 1 and label[i - 1] < label[i] > label[i + 1])]
        spans = zip(starts, [*starts[1:], len(v)])
        v = [mix((sum((x + 1) * pow(BASE, i, 1 << 64) for i, x in enumerate(symbols[s:e])) + e - s) & top) ^ level for s, e in spans]
        symbols = [mix(x) for x in v]
        found.append(v)
    if not text:
        return [0xFFFF] * 64
    names = {x >> 32 for x in found[1] + found[2]}
    least = [min((x * int(a) + int(b)) & 0xFFFFFFFF for x in names) for a, b in zip(*hash_family(64, 0))]
    return [min((x ^ x >> 16) & 0xFFFF, 0xFFFE) for x in least]


def test_fingerprints_match_a_plain_parse(docs):
    rows = sorted(table(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])))
    rows = [(k, t if t is None or len(t) < 3000 else t[:3000]) for k, t in rows]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"), parts=3).collect()}
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        a, b, c = plain_sketch(t), plain_sketch(t[: len(t) - q] + nxt[:q]), plain_sketch(nxt)
        raw = lambda x: "" if x[0] == 0xFFFF else "".join(f"{y:04x}" for y in x)
        like = lambda x, y: sum(p == q for p, q in zip(x, y)) / 64
        assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == (raw(a), raw(b))
        assert (got[k]["near_edited"], got[k]["near_next"]) == (like(a, b), like(a, c))


def test_names_do_not_depend_on_offset():
    import numpy as np

    text = (" ".join(f"word{i * i % 997}" for i in range(400))).encode()
    names = lambda x: set(fingerprint.names(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[-1][0].tolist())
    a, b = names(text), names(b"zz some other beginning " + text)
    assert len(a & b) / len(a) > 0.9


# --- 10 ---


def test_wrapped_paragraphs_and_short_lines(spark):
    import random

    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    wrap = lambda w: "\n".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8))
    block, short = fresh(60), " ".join(fresh(6))
    edited = [x + "x" if i == 30 else x for i, x in enumerate(block)]
    texts = {
        1: wrap(fresh(40)) + "\n\n" + wrap(block) + "\n\n" + wrap(fresh(40)),
        2: wrap(fresh(30)) + "\n\n" + " ".join(edited[:33]) + "\n" + " ".join(edited[33:]) + "\n\n" + wrap(fresh(20)),
        3: " ".join(fresh(15)) + "\n" + short + "\n" + " ".join(fresh(15)),
        4: " ".join(fresh(15)) + "\n" + short.upper() + "\n" + " ".join(fresh(15)),
        5: "head\n" + " ".join(fresh(48)),  # a block of mostly one line is no repeat of it
    }
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = passages.repeated_passages(d).collect()
    cut = lambda r: " ".join(texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode().split())
    got = {(r["doc_id"], r["cluster"], r["removed"], cut(r).lower()) for r in rows}
    assert {(1, 1, False, " ".join(block)), (2, 1, True, " ".join(edited)), (3, 3, False, short), (4, 3, True, short)} <= got
    assert 5 not in {r["doc_id"] for r in rows}


def test_passages(docs):
    got = {(r["doc_id"], r["cluster"]) for r in passages.clusters(passages.repeated_passages(docs)).collect()}
    rows = [(d, words(t)) for d, t in table(docs)]
    has = defaultdict(set)
    for d, w in rows:
        for i in range(len(w) - 49):
            has[tuple(w[i : i + 50])].add(d)
    flagged = {d for d, _ in got}
    for ids in has.values():
        if len(ids) > 1:
            assert ids <= flagged
    small = Counter(g for d, w in rows for g in {tuple(w[i : i + 20]) for i in range(len(w) - 19)})
    alone = {d for d, w in rows if all(small[tuple(w[i : i + 20])] == 1 for i in range(len(w) - 19))}
    near = {d for d, c, _, _ in brute_classes(table(docs)) if d != c} | {c for d, c, _, _ in brute_classes(table(docs)) if d != c}
    repeated_inside = {d for d, w in rows if len(w) - 19 > len({tuple(w[i : i + 20]) for i in range(len(w) - 19)})}
    assert not flagged & (alone - near - repeated_inside - {7})


def brute_passages(rows, threshold=0.8):
    """(doc_id, start, end, cluster, removed) of lines and blocks, each compared with every other; no windows."""
    places = []
    for d, t in rows:
        raw = (t or "").encode()
        spans = []
        lines = [(m.start(), m.end()) for m in re.finditer(rb"[^\n]+", raw)]
        spans += [(a, b, False) for a, b in lines]
        spans += [(m.start(), m.end(), True) for m in re.finditer(rb"(?:[^\n]*[^\s][^\n]*(?:\n|$))+", raw) if len([x for x in m[0].split(b"\n") if WORD.search(x.decode())]) > 1]
        for a, b, block in spans:
            w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw[a:b])]
            if len(w) >= 5:
                places.append((d, a + w[0][0], a + w[-1][1], block, words(raw[a:b].decode())))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for *_, w in places]
    root = list(range(len(places)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in combinations(range(len(places)), 2):
        if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    member = defaultdict(list)
    for i, x in enumerate(places):
        member[find(i)].append(x)
    return [sorted(m, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2])) for m in member.values() if len(m) > 1]


@pytest.mark.parametrize("block", [1024, 2])
def test_paragraph_clusters_match_brute_force(spark, monkeypatch, block):
    """Every cluster of lines that brute force finds, its first document, and that all its other places go."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", 4 if block == 2 else 64)
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    long, short = fresh(80), fresh(6)
    rows = []
    for i in range(60):
        lines = [" ".join(fresh(rng.choice([3, 12, 30]))) for _ in range(4)]
        if i % 3 == 0:
            w = list(long)
            w[rng.randrange(80)] = f"edit{i}"
            lines.insert(rng.randrange(4), " ".join(w))
        if i % 4 == 0:
            lines.insert(1, " ".join(short))
        rows.append((i, "\n\n".join(lines)))
    rows += [(60, None), (61, ""), (62, rows[3][1]), (None, "\n".join([" ".join(short)] * 2))]
    got = {(r["doc_id"], r["start"], r["end"]): (r["cluster"], r["removed"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = 0
    for cluster in brute_passages(rows):
        lines = [x for x in cluster if not x[3]]
        if len(lines) != len(cluster):
            continue
        for i, (d, a, b, _, _) in enumerate(lines):
            assert got[d, a, b] == (lines[0][0], i > 0)
            seen += 1
    assert seen > 30


def test_near_copy_recall(spark):
    """Of pairs of paragraphs at an index of 0.8 or a little more, at least 0.9 are found."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(300):
        w = [f"r{rng.randrange(10**7)}" for _ in range(94)]
        e = list(w)
        e[10] = e[60] = "edit"  # 90 five-word shingles, ten of them changed: 80 of 100
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(e))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lines = {r["doc_id"] for r in passages.repeated_passages(d).filter("removed and end - start > 500").collect()}
    assert len(lines) >= 0.9 * 300
    assert jaccard.similar_documents(d).filter("links = 1").count() >= 0.9 * 600


def test_large_buckets_are_joined_like_small_ones():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, (5, 120), dtype=np.uint64).astype(np.uint32)
    sig = base[rng.integers(0, 5, 400)].copy()
    change = rng.random(sig.shape) < 0.1
    sig[change] = rng.integers(0, 1 << 32, int(change.sum()), dtype=np.uint64).astype(np.uint32)
    a = jaccard.labels(400, *jaccard.bucket_links(sig, 0.8))
    b = jaccard.labels(400, *jaccard.survivors(sig, sig, True, 0.8))
    assert (a == b).all() and len(set(a.tolist())) == 5


def test_every_long_passage_has_a_window():
    import numpy as np

    rng = np.random.default_rng(1)
    n = passages.WINDOW + passages.PLACES - 1
    for _ in range(200):
        passage = rng.integers(0, 1 << 62, n).astype(np.uint64)
        cut = []
        for _ in range(2):
            a, b = (rng.integers(0, 1 << 62, rng.integers(0, 60)).astype(np.uint64) for _ in range(2))
            h = np.concatenate((a, passage, b, passage[:9]))
            woff = np.array([0, len(a) + n + len(b), len(h)])
            at = passages.anchors(h, woff)
            cut.append({tuple(h[i : i + passages.WINDOW].tolist()) for i in at.tolist()})
        assert cut[0] & cut[1]


# --- all ---


def test_empty_tables(empty):
    assert lm.score(empty).count() == 0
    assert suffix.remove_repeats(empty).count() == 0
    assert packing.pack_documents(empty, **vocabulary()).count() == 0
    assert jaccard.similar_documents(empty).count() == 0
    assert search.top_k(empty, empty).count() == 0
    assert langid.identify(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert fingerprint.fingerprints(empty).count() == 0
    assert passages.clusters(passages.repeated_passages(empty)).count() == 0


def test_null_ids_and_copies_do_not_crash(docs):
    assert fingerprint.fingerprints(docs).count() == docs.count()
    assert langid.identify(docs).count() == docs.count()
    assert search.top_k(docs, docs.filter("doc_id % 9 = 0")).count() > 0
