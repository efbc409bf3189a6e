"""N-gram Jaccard join with Bayesian candidate pruning.

Shingles are five successive words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased); a text of one to
four words has one shingle of all. Documents are alike if their shingle sets' Jaccard index is at least ``threshold``.

1. Equal texts become one class; only classes are compared.
2. MinHash bands (``BANDS`` of ``ROWS`` values: a pair at 0.8 is missed once in 13,000 times) deal classes to buckets.
   Signatures, without texts, go to the buckets of two classes or more; a bucket of over ``BUCKET`` classes is cut into
   blocks and every pair of blocks is a unit of work. Pairs are compared a few MinHash values at a time; a pair is
   dropped when, under a uniform prior, the posterior probability that its index reaches the threshold falls below
   ``TOLERANCE``. A class that is already linked in its bucket is compared with those that are not yet, so what is found
   are the components of likely pairs, a row for each class and never pairs.
3. These components are groups of classes that most likely are alike, not chains of chance collisions. Only here texts
   move: a group is cut into blocks by number and by bytes, and every pair of blocks is one unit of work. Inside, pairs
   are pruned again and what is left is verified by exact intersections of shingle sets.
4. Verified links are counted for every class and joined into components; pairs never leave a task.

Joins on a class's or a text's key have written tables on both sides, so adaptive execution can split a hot key.

Defined results: a text without words has no links and is a class of its own; ids may be null or repeated; equal rows
are copies of each other; an empty table gives an empty result; other columns are ignored (or travel, see
:func:`keep_one`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, column_bytes, minhash, mix, pieces, prefix_hash, shingles, signed, span_hash, words
from .components import components
from .scratch import Scratch

SHINGLE = 5
BANDS, ROWS = 24, 5
TOLERANCE = 1e-5
STEP = 8
SMALL, BUCKET = 64, 1 << 14
BLOCK, BYTES = 1024, 8 << 20
COLUMNS = 2048


def text_shingles(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each row and their row offsets (a set's members may repeat)."""
    data = LOWER[data]
    s, e, woff = words(data, off)
    return shingles(span_hash(prefix_hash(data), s, e), woff, n)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) keys of bands of ``rows`` MinHash values."""
    bands = sig.shape[1] // rows
    v = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), v.shape[:2]).copy()
    for k in range(rows):
        key = mix(key ^ v[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
    return key


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, slots: int) -> list[tuple[int, int]]:
    """(values compared, least matches to go on): below, P(J >= threshold | matches) < tolerance.

    With a uniform prior the posterior after m matches of n is Beta(m+1, n-m+1), whose upper tail at t equals
    P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(STEP, slots + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b; i < j if ``same``) that Bayesian pruning leaves."""
    plan = least_matches(threshold, TOLERANCE, a.shape[1])
    keep_i, keep_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # a side may be empty
    stride = max(1, (1 << 20) // max(1, len(b)))
    for first in range(0, len(a), stride):
        x = a[first : first + stride]
        n, least = plan[0]
        hits = np.zeros((len(x), len(b)), np.int16)
        for k in range(n):
            hits += x[:, k, None] == b[None, :, k]
        ok = hits >= least
        if same:
            ok &= np.arange(len(b)) > np.arange(first, first + len(x))[:, None]
        i, j = np.nonzero(ok)
        got = hits[i, j]
        i += first
        for n, least in plan[1:]:
            for k in range(n - STEP, n):
                got = got + (a[i, k] == b[j, k])
            ok = got >= least
            i, j, got = i[ok], j[ok], got[ok]
        keep_i.append(i)
        keep_j.append(j)
    return np.concatenate(keep_i), np.concatenate(keep_j)


def verified(v: np.ndarray, off: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of the shingle table reach the threshold exactly."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((row, v))
    v, row = v[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    v, row = v[new], row[new]
    size = np.bincount(row, minlength=len(off) - 1)
    change = np.ones(len(v), bool)
    change[1:] = v[1:] != v[:-1]
    column = np.cumsum(change) - 1
    often = np.bincount(column) > 1
    use = often[column]
    row, column = row[use], (np.cumsum(often) - 1)[column[use]]
    inter = np.zeros(len(i), np.float32)
    rows = np.unique(np.concatenate([i, j]))
    at = np.full(len(off) - 1, -1)
    at[rows] = np.arange(len(rows))
    dense = len(i) > 4 * len(rows)
    both = np.zeros((len(rows), len(rows)), np.float32) if dense else None
    for c in range(0, int(often.sum()), COLUMNS):  # columns ascend, so a slice of them is a slice of the table
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(rows), min(COLUMNS, int(often.sum()) - c)), np.float32)
        there = at[row[a:b]] >= 0
        m[at[row[a:b][there]], column[a:b][there] - c] = 1
        if dense:
            both += m @ m.T
        else:
            for p in range(0, len(i), 1024):
                inter[p : p + 1024] += np.einsum("ij,ij->i", m[at[i[p : p + 1024]]], m[at[j[p : p + 1024]]])
    if dense:
        inter = both[at[i], at[j]]
    return inter >= threshold * (size[i] + size[j] - inter) - 1e-6


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least node of its component, from the links i to j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def likely(sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that Bayesian pruning leaves."""
    got = np.zeros(len(i), np.int16)
    for n, least in least_matches(threshold, TOLERANCE, sig.shape[1]):
        got = got + (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(axis=1, dtype=np.int16)
        ok = got >= least
        i, j, got = i[ok], j[ok], got[ok]
    return i, j


def bucket_links(sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that have the components of all likely pairs of one large bucket."""
    todo, front = np.arange(len(sig)), np.zeros(0, np.int64)
    out = [(np.zeros(0, np.int64),) * 2]
    while len(todo) or len(front):
        if not len(front):
            front, todo = todo[:SMALL], todo[SMALL:]
            i, j = survivors(sig[front], sig[front], True, threshold)
            out.append((front[i], front[j]))
        part, front = front[:SMALL], front[SMALL:]
        i, j = survivors(sig[part], sig[todo], False, threshold)
        if len(i):
            both = np.concatenate((part, todo))
            label = labels(len(both), i, j + len(part))
            own = np.flatnonzero(label != np.arange(len(both)))
            out.append((both[own], both[label[own]]))
            new = np.zeros(len(todo), bool)
            new[j] = True
            front, todo = np.concatenate((front, todo[new])), todo[~new]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def buckets(threshold: float):
    """A mapInArrow function: (unit, uid, sig) sorted by unit to links (a, b) that have each unit's components."""

    def run(batches):
        def solve(held):
            t = pa.Table.from_batches(held).combine_chunks()
            uid, unit = t["uid"].combine_chunks(), t["unit"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u4").reshape(len(t), -1)
            start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            stop = np.append(start[1:], len(t))
            large = stop - start > SMALL
            found = [(x + a, y + a) for a, b in zip(start[large].tolist(), stop[large].tolist(), strict=True) for x, y in [bucket_links(sig[a:b], threshold)]]
            end = np.repeat(np.where(large, 0, stop), stop - start)  # of each row's small bucket
            rows = np.flatnonzero(end > np.arange(len(t)) + 1)
            for first in range(0, len(rows), 1 << 14):
                r = rows[first : first + (1 << 14)]
                n = end[r] - r - 1
                cut = np.cumsum(n) - n
                found.append(likely(sig, np.repeat(r, n), np.arange(int(n.sum())) + np.repeat(r + 1 - cut, n), threshold))
            i, j = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *found, strict=True))
            label = labels(len(t), i, j)  # buckets that met in this batch may be joined already
            own = np.flatnonzero(label != np.arange(len(t)))
            return pa.RecordBatch.from_arrays([uid.take(pa.array(own)), uid.take(pa.array(label[own]))], ["a", "b"])

        held, size, last = [], 0, None
        for b in batches:
            unit = b["unit"].to_numpy()
            first = 0
            if size >= BUCKET:  # hand over what ends before this batch's last unit
                other = np.flatnonzero(unit != last)
                if len(other):
                    first = int(other[0])
                    yield solve([*held, b.slice(0, first)])
                    held, size = [], 0
            held.append(b.slice(first))
            size, last = size + len(b) - first, unit[-1] if len(unit) else last
        if size:
            yield solve(held)

    return run


def sign(batches):
    """(uid, text) to (uid, size, sig, text)."""
    for b in batches:
        sig = []
        for _, data, off in pieces(b["text"]):
            sig += [x.tobytes() for x in minhash(*text_shingles(data, off), BANDS * ROWS).astype("<u4", copy=False)]
        yield pa.RecordBatch.from_arrays([b["uid"], pa.array(np.diff(column_bytes(b["text"])[1])), pa.array(sig, pa.binary()), b["text"]], ["uid", "size", "sig", "text"])


def group_links(texts: pa.Array, sig: np.ndarray, half: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of each text of a unit of work; ``half`` tells the two blocks apart. A label is the place of the
    first text that links lead to."""
    if same:
        i, j = survivors(sig, sig, True, threshold)
    else:
        left, right = np.flatnonzero(~half), np.flatnonzero(half)
        i, j = survivors(sig[left], sig[right], False, threshold)
        i, j = left[i], right[j]
    if len(i):
        sh, offs, base = [], [np.zeros(1, np.int64)], 0
        for _, data, off in pieces(texts):
            v, o = text_shingles(data, off)
            sh.append(v)
            offs.append(o[1:] + base)
            base += o[-1]
        ok = verified(np.concatenate(sh), np.concatenate(offs), i, j, threshold)
        i, j = i[ok], j[ok]
    n = len(texts)
    return np.bincount(i, minlength=n) + np.bincount(j, minlength=n), labels(n, i, j)


def groups(threshold: float):
    """A mapInArrow function: (root, x, y, half, uid, sig, text) sorted by the unit (root, x, y) to (uid, label, links)."""

    def run(batches):
        held, key = [], None

        def solve():
            t = pa.Table.from_batches(held).combine_chunks()
            half = t["half"].to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u4").reshape(len(t), -1)
            links, label = group_links(t["text"].combine_chunks(), sig, half, key[1] == key[2], threshold)
            uid = t["uid"].combine_chunks()
            return pa.RecordBatch.from_arrays([uid, uid.take(pa.array(label)), pa.array(links)], ["uid", "label", "links"])

        for b in batches:
            keys = list(zip(b["root"].to_pylist(), b["x"].to_pylist(), b["y"].to_pylist(), strict=True))
            first = 0
            for i, k in enumerate(keys):
                if k != key:
                    if i > first:
                        held.append(b.slice(first, i - first))
                    if held:
                        yield solve()
                    held, key, first = [], k, i
            held.append(b.slice(first))
        if held:
            yield solve()

    return run


def alike(s: Scratch, units: Callable[[DataFrame], DataFrame], bands: DataFrame, threshold: float) -> DataFrame:
    """(uid, root, links) of the units that have a link. ``bands``: rows (uid, key); ``units(wanted)``: one row
    (uid, text) for each of the wanted uids at least."""
    parts = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small bytes of long work are not put together
    kind = dict(bands.dtypes)["uid"]
    part = F.pmod(F.xxhash64("uid"), F.lit(1 << 20))
    bands = bands.select("uid", "key")
    size = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = s.table(bands.join(size, "key"))
    signed_ = s.table(units(shared.select("uid").distinct()).mapInArrow(sign, f"uid {kind}, size long, sig binary, text string"), tidy=True)

    blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    x = F.pmod(part, F.col("blocks")).cast("int")
    met = shared.withColumn("blocks", blocks).withColumn("x", x).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("uid", F.xxhash64("key", F.least("x", "other"), F.greatest("x", "other")).alias("unit")).join(signed_.select("uid", "sig"), "uid")
    near = met.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(buckets(threshold), f"a {kind}, b {kind}")
    found = s.table(components(s, near).withColumnRenamed("node", "uid"), tidy=True)

    member = found.join(signed_.select("uid", "size"), "uid")
    sizes = s.table(member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BYTES), F.lit(1)).cast("int").alias("blocks")))
    member = found.join(sizes, "root").withColumn("x", x)
    rows = signed_.join(member.hint("shuffle_hash"), "uid")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("x", "other").alias("a"), F.greatest("x", "other").alias("b"), (F.col("x") > F.col("other")).alias("half"), "uid", "sig", "text").withColumnsRenamed({"a": "x", "b": "y"})
    links = rows.repartition(parts, "root", "x", "y").sortWithinPartitions("root", "x", "y", "uid").mapInArrow(groups(threshold), f"uid {kind}, label {kind}, links long")
    links = s.table(links.filter("links > 0"), tidy=True)
    s.done(shared, signed_)
    final = components(s, links.select(F.col("uid").alias("a"), F.col("label").alias("b")))
    return links.groupBy("uid").agg(F.sum("links").alias("links")).join(final.withColumnRenamed("node", "uid"), "uid")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, links, copies, dk): class_id is the least id of the class of documents joined by links or
    equality, links the number of other texts that are alike, copies that of rows with this very text."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.lit(5), id_col, text_col).alias("dk")).withColumn("uid", F.unhex(F.md5("text")))

    def keys(batches):
        for b in batches:
            out = []
            for _, data, off in pieces(b["text"]):
                v, o = text_shingles(data, off)
                k = band_keys(minhash(v, o, BANDS * ROWS), ROWS)
                some = np.diff(o) > 0
                cut = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0))))
                out.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(signed(k[some].ravel()))))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["dk"], b["uid"], pa.concat_arrays(out)], ["doc_id", "dk", "uid", "keys"])

    kind = dict(d.dtypes)["doc_id"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "dk")).alias("best")
    with Scratch(spark, "jaccard") as s:
        slim = s.table(d.mapInArrow(_nonempty(keys), f"doc_id {kind}, dk long, uid binary, keys array<long>"))
        classes = s.table(slim.filter(F.size("keys") > 0).groupBy("uid").agg(F.min("dk").alias("rep"), F.count("*").alias("copies"), best, F.first("keys").alias("keys")))
        reps = classes.select("uid", F.col("rep").alias("dk"))
        texts = lambda wanted: d.select("uid", "text", "dk").join(reps.join(wanted, "uid", "left_semi"), ["uid", "dk"]).dropDuplicates(["uid"]).select("uid", "text")
        linked = s.table(alike(s, texts, classes.select("uid", F.explode("keys").alias("key")), threshold))
        info = classes.select("uid", "copies", "best").join(linked, "uid", "left")
        info = s.table(info.select("uid", "copies", "best", F.coalesce("root", "uid").alias("class"), F.coalesce("links", F.lit(0)).alias("links")))
        first = s.table(info.groupBy("class").agg(F.min("best").alias("m")))
        info = s.table(info.join(first, "class").select("uid", F.col("m.doc_id").alias("class_id"), F.col("m.dk").alias("class_dk"), "links", "copies"), tidy=True)
        some = slim.filter(F.size("keys") > 0).select("uid", "doc_id", "dk").join(info, "uid").select("doc_id", "class_id", "links", "copies", "dk", (F.col("dk") == F.col("class_dk")).alias("first"))
        none = slim.filter(F.size("keys") == 0).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(1).cast("long").alias("copies"), "dk", F.lit(True).alias("first"))
        return s.table(some.unionByName(none), keep=True)


def _nonempty(f):
    return lambda batches: f(b for b in batches if len(b))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of one document of each class, that of the least id."""
    kept = similar_documents(docs, id_col, text_col, **options).filter("first").select("dk").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(5), id_col, text_col).alias("dk"))
    return rows.join(kept.hint("shuffle_hash"), "dk").dropDuplicates(["dk"]).select("row.*")
