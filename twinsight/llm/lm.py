"""Language-model scoring with a weighted backoff automaton.

The model is a word bigram model with Witten-Bell smoothing over add-one unigrams, trained on all documents of the
training fold: ``P(w|h) = (c(hw) + T(h) P(w)) / (c(h) + T(h))`` with ``T(h)`` the number of distinct successors of h and
``P(w) = (c(w)+1) / (N+V+1)``. As an automaton: a state for every known word and one without history; an arc for every
n-gram seen, weighing log10 P; a failure arc from state h to the state without history, weighing
log10 T(h)/(c(h)+T(h)). Scoring walks each text once from left to right, carrying the state and adding weights.

The automaton grows with the corpus and is never held whole. Texts are dealt to blocks of about ``BLOCK`` bytes. A block
sends its distinct words and bigrams, with training counts, as packed sorted arrays to the shards that own them (a word
and its successors live on one shard; successors of hot words are spread over several). Shards add up counts over all
blocks and answer every block with just the arcs and states that it asked for, aligned with the question. A block then
walks its own texts over its part of the automaton, all texts in step. What is hot is told from a sample of about
``SAMPLE`` bytes, read where it lies; it decides placement only, never a number. A block writes to the shards that own
something of its own, so its rows are at most its distinct n-grams, and tasks take one block or shard at a time, so
their number (``TASKS`` at most) need not follow the corpus.

Defined results: null or empty text is the end token alone; A-Z are lower-cased; null ids belong to the training fold;
equal rows each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U64, grouped, mix, pieces, prefix_hash, rows_of, span_hash, words
from .scratch import Scratch

BLOCK = 8 << 20
BEGIN, END = U64(0x5EED_0F_BE61), U64(0x5EED_0F_E4D0)
SAMPLE = 16 << 20
TASKS = 4096
HOT = 1 << 16
ASK = "shard int, block int, kind int, words binary, counts binary, fanout binary, heads binary, tails binary, pairs binary"
REPLY = "block int, kind int, shard int, counts binary, fan binary, pairs binary"


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    s, e, woff = words(data, off)
    return span_hash(prefix_hash(data), s, e), woff


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, missing: int = 0) -> np.ndarray:
    """The value of each key in a sorted table."""
    if not len(known):
        return np.full(len(keys), missing, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing)


def sorted_table(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values, by key, of (signed key, value) rows."""
    keys = np.array([r[0] for r in rows], np.int64).view(U64)
    order = np.argsort(keys)
    return keys[order], np.array([r[1] for r in rows], np.int64)[order]


class Block:
    """The tokens of a block's texts and its distinct words and bigrams, ordered by owning shard."""

    def __init__(self, shards: int, hot: tuple[np.ndarray, np.ndarray]):
        self.shards, self.hot, self.hashes, self.sizes, self.train = shards, hot, [], [], []

    def add(self, column: pa.Array, train: np.ndarray) -> None:
        for rows, data, off in pieces(column):
            h, woff = word_hashes(data, off)
            self.hashes.append(h)
            self.sizes.append(np.diff(woff))
            self.train.append(train[rows])

    def index(self) -> None:
        size = np.concatenate(self.sizes) + 1  # with the end token
        self.off = np.concatenate(([0], np.cumsum(size)))
        row = rows_of(self.off)
        cur = np.empty(self.off[-1], U64)
        last = self.off[1:] - 1
        is_end = np.zeros(len(cur), bool)
        is_end[last] = True
        cur[~is_end], cur[last] = np.concatenate(self.hashes), END
        self.hashes = []
        train = np.concatenate(self.train)[row]
        keys, ids = np.unique(np.append(cur, BEGIN), return_inverse=True)
        shard = (mix(keys) % U64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys, self.shard = keys[order], shard[order]
        ids = place[ids]
        self.word, begin = ids[:-1], ids[-1]
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.off[:-1]] = begin
        self.counts = np.bincount(self.word, weights=train, minlength=len(keys)).astype(np.int64)
        self.counts[begin] += int(np.concatenate(self.train).sum())  # as a history
        pair, self.arc = np.unique(before * len(keys) + self.word, return_inverse=True)
        self.arc_counts = np.bincount(self.arc, weights=train, minlength=len(pair)).astype(np.int64)
        self.head, self.tail = pair // len(keys), pair % len(keys)
        salt = looked_up(self.keys, *self.hot)[self.head]
        self.cold = salt == 0
        spread = mix(self.keys[self.tail[~self.cold]]) % salt[~self.cold].astype(U64)
        owner = (self.shard[self.head[~self.cold]] + 1 + spread.astype(np.int64)) % self.shards
        self.spread = np.flatnonzero(~self.cold)[np.argsort(owner, kind="stable")]
        self.spread_shard = np.sort(owner, kind="stable")
        self.kept = np.flatnonzero(self.cold)
        self.fanout = np.bincount(self.head[self.kept], minlength=len(keys))

    def cuts(self):
        """(shard, slice of words, slice of kept arcs, slice of spread arcs) of every shard that owns any."""
        own = np.union1d(self.shard, self.spread_shard)
        cut = lambda x: zip(np.searchsorted(x, own, "left").tolist(), np.searchsorted(x, own, "right").tolist(), strict=True)
        all_cuts = zip(own.tolist(), cut(self.shard), cut(self.shard[self.head[self.kept]]), cut(self.spread_shard), strict=True)
        return [(p, slice(*w), slice(*k), slice(*s)) for p, w, k, s in all_cuts]

    def ask(self, block: int) -> pa.RecordBatch:
        rows = []
        raw = lambda x, t: np.ascontiguousarray(x, t).tobytes()
        for p, w, k, s in self.cuts():
            a = self.kept[k]
            if w.stop > w.start:
                rows.append((p, block, 0, raw(self.keys[w], "<u8"), raw(self.counts[w], "<u4"), raw(self.fanout[w], "<u4"), b"", raw(self.keys[self.tail[a]], "<u8"), raw(self.arc_counts[a], "<u4")))
            a = self.spread[s]
            if len(a):
                rows.append((p, block, 1, b"", b"", b"", raw(self.keys[self.head[a]], "<u8"), raw(self.keys[self.tail[a]], "<u8"), raw(self.arc_counts[a], "<u4")))
        names = [x.split()[0] for x in ASK.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def walk(self, replies: dict[tuple[int, int], tuple[bytes, bytes, bytes]], total: int, kinds: int, hot_fan: tuple[np.ndarray, np.ndarray]):
        """(tokens, known tokens, base score, score) of every text."""
        count, fan, arc = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64), np.zeros(len(self.head), np.int64)
        for p, w, k, s in self.cuts():
            if w.stop > w.start:
                c, f, a = replies[p, 0]
                count[w], fan[w], arc[self.kept[k]] = (np.frombuffer(x, "<i8") for x in (c, f, a))
            if s.stop > s.start:
                arc[self.spread[s]] = np.frombuffer(replies[p, 1][2], "<i8")
        many = looked_up(self.keys, *hot_fan, missing=-1)
        fan = np.where(many >= 0, many, fan)
        one = (count + 1.0) / (total + kinds + 1.0)
        free = np.log10(one)
        with np.errstate(divide="ignore", invalid="ignore"):
            failure = np.where(fan > 0, np.log10(fan / (count + fan)), 0.0)
            h = self.head
            arcs = np.where(arc > 0, np.log10((arc + fan[h] * one[self.tail]) / (count[h] + fan[h])), 0.0)
        size = np.diff(self.off)
        order = np.argsort(-size, kind="stable")
        start, score = self.off[:-1][order], np.zeros(len(size))
        begin = np.searchsorted(-size[order], -np.arange(size.max() if len(size) else 0), "left")  # texts longer than the step
        state = np.full(len(size), self.begin_state(), np.int64)
        for step, live in enumerate(begin.tolist()):
            at = start[:live] + step
            w, a = self.word[at], self.arc[at]
            score[:live] += np.where(arc[a] > 0, arcs[a], failure[state[:live]] + free[w])
            state[:live] = w
        out = np.empty(len(size))
        out[order] = score
        return size, np.add.reduceat((count[self.word] > 0).astype(np.int64), self.off[:-1]), np.add.reduceat(free[self.word], self.off[:-1]), out

    def begin_state(self) -> int:
        return int(np.flatnonzero(self.keys == BEGIN)[0])


def answer(batches):
    """A shard after another: adds up the counts of all blocks and answers each; a last row of block -1 has tokens,
    distinct words and the successors of hot words counted here."""
    arr = lambda r, c, t: np.frombuffer(r[c], t)
    for shard, held in grouped(batches, "shard"):
        got, out = [r for b in held for r in b.to_pylist()], []
        plain, spread = [r for r in got if r["kind"] == 0], [r for r in got if r["kind"] == 1]
        stats = (0, 0)
        if plain:
            keys, at = np.unique(np.concatenate([arr(r, "words", "<u8") for r in plain]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([arr(r, "counts", "<u4") for r in plain]), minlength=len(keys)).astype(np.int64)
            head = np.repeat(at, np.concatenate([arr(r, "fanout", "<u4") for r in plain]))
            pair = mix(mix(keys)[head] ^ np.concatenate([arr(r, "tails", "<u8") for r in plain]))
            uniq, first, arc = np.unique(pair, return_index=True, return_inverse=True)
            many = np.bincount(arc, weights=np.concatenate([arr(r, "pairs", "<u4") for r in plain]), minlength=len(uniq)).astype(np.int64)
            fan = np.bincount(head[first], weights=many > 0, minlength=len(keys)).astype(np.int64)
            tokens = keys != BEGIN
            stats = (int(count[tokens].sum()), int((count[tokens] > 0).sum()))
            i = j = 0
            for r in plain:
                n, m = len(r["words"]) // 8, len(r["tails"]) // 8
                a = at[i : i + n]
                out.append((r["block"], 0, shard, count[a].tobytes(), fan[a].tobytes(), many[arc[j : j + m]].tobytes()))
                i, j = i + n, j + m
        hot = (np.zeros(0, U64), np.zeros(0, np.int64))
        if spread:
            head = np.concatenate([arr(r, "heads", "<u8") for r in spread])
            pair = mix(mix(head) ^ np.concatenate([arr(r, "tails", "<u8") for r in spread]))
            uniq, first, arc = np.unique(pair, return_index=True, return_inverse=True)
            many = np.bincount(arc, weights=np.concatenate([arr(r, "pairs", "<u4") for r in spread]), minlength=len(uniq)).astype(np.int64)
            heads, at = np.unique(head[first], return_inverse=True)
            hot = heads, np.bincount(at, weights=many > 0, minlength=len(heads)).astype(np.int64)
            j = 0
            for r in spread:
                m = len(r["tails"]) // 8
                out.append((r["block"], 1, shard, b"", b"", many[arc[j : j + m]].tobytes()))
                j += m
        out.append((-1, 0, shard, np.array(stats, "<i8").tobytes(), hot[0].tobytes(), hot[1].tobytes()))
        names = [x.split()[0] for x in REPLY.split(", ")]
        for k in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64], strict=True), [pa.int32()] * 3 + [pa.binary()] * 3, strict=True)], names)


def totals(batches):
    """(k, n) rows of the shards' last rows: hot words' successors; under null, tokens and distinct words as ``n, v``."""
    for b in batches:
        for r in b.to_pylist():
            n, v = np.frombuffer(r["counts"], "<i8").tolist()
            k, f = np.frombuffer(r["fan"], "<i8"), np.frombuffer(r["pairs"], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([None, *k.tolist()], pa.int64()), pa.array([n, *f.tolist()]), pa.array([v, *[0] * len(k)])], ["k", "n", "v"])


def hot_words(d: DataFrame, size: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes that hold over a quarter of a shard's share of tokens in a sample, and over how many shards to spread
    their successors. Placement only: any answer here gives the same scores. At most ``HOT`` words, the most frequent;
    any other has under one token in ``HOT``."""
    if shards < 2:
        return np.zeros(0, U64), np.zeros(0, np.int64)

    def count(batches):
        for b in batches:
            for _, data, off in pieces(b["text"]):
                k, n = np.unique(word_hashes(data, off)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k", "n"])

    sample = d.select("text") if size <= SAMPLE else d.select("text").sample(SAMPLE / size, seed=2)
    with Scratch(d.sparkSession, "lm-words") as s:
        rows = s.table(sample.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")))
        total = rows.agg(F.sum("n")).first()[0] or 0
        top = rows.filter(F.col("n") * (4 * shards) > total).orderBy(F.desc("n"), "k").limit(HOT).collect()
    return sorted_table([(r["k"], max(2, -(-4 * r["n"] * shards // total))) for r in top])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), out.alias("held_out"))
    size = d.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    tasks = min(blocks, TASKS)
    hot = hot_words(d, size, blocks)
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(batches):
        for key, held in grouped(batches, "block"):
            b = Block(blocks, hot)
            for x in held:
                b.add(x["text"], ~x["held_out"].to_numpy(zero_copy_only=False))
            b.index()
            yield b.ask(key)

    with Scratch(spark, "lm") as s:
        asked = lambda: d.select("block", "held_out", "text").repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(ask, ASK)
        replies = s.table(asked().repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(answer, REPLY), keep=True, tidy=True)
        s.tidy()  # the questions are answered: their shuffle files can go before texts move again
    last = replies.filter("block = -1").select("counts", "fan", "pairs").mapInArrow(totals, "k long, n long, v long")
    sums = last.groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # a row for each hot word
    total, kinds = next(((r["n"], r["v"]) for r in sums if r["k"] is None), (0, 0))
    hot_fan = sorted_table([(r["k"], r["n"]) for r in sums if r["k"] is not None])
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def walk(batches):
        for _, held in grouped(batches, "block"):
            known, b, ids, folds_ = {}, Block(blocks, hot), [], []
            for x in held:
                is_text = x["kind"].to_numpy() == 2
                first = int(np.argmax(is_text)) if is_text.any() else len(x)
                for r in x.slice(0, first).select(["shard", "kind", "counts", "fan", "pairs"]).to_pylist():
                    known[r["shard"], r["kind"]] = (r["counts"], r["fan"], r["pairs"])
                if first < len(x):
                    x = x.slice(first)
                    b.add(x["text"], ~x["held_out"].to_numpy(zero_copy_only=False))
                    ids.append(x["doc_id"])
                    folds_.append(x["held_out"])
            b.index()
            n, k, base, got = b.walk(known, total, kinds, hot_fan)
            cols = [pa.concat_arrays(ids), pa.concat_arrays(folds_), *(pa.array(c) for c in (n, k, np.full(len(n), total), base, got))]
            yield pa.RecordBatch.from_arrays(cols, names)

    texts = d.select("block", F.lit(2).alias("kind"), F.lit(0).alias("shard"), "doc_id", "held_out", "text")
    both = texts.unionByName(replies.filter("block >= 0"), allowMissingColumns=True)
    kind = dict(d.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition(tasks, "block").sortWithinPartitions("block", "kind", "shard").mapInArrow(walk, schema)
