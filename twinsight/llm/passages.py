"""Repeated passages: paragraph MinHash banding, exact verification, clusters by components.

Units of a text are its paragraphs of at least ``LEAST`` words, the length of a shingle, and windows of ``WINDOW`` words
inside it that start at content-defined places (where the hash of three words is least among ``PLACES`` successive
ones), so a passage of over 50 words (``WINDOW + PLACES - 1`` at least) that other documents carry in the midst of a paragraph, or over
several, always has a unit of its own. Paragraphs are single lines, and blocks: wrapped lines up to a blank one (a text without blank lines is one).

* Paragraphs: MinHash bands tuned for recall (``BANDS`` of ``ROWS``: an index of 0.8 is missed twice in a thousand
  times), colliding paragraphs joined, exact Jaccard index of five-word shingles at ``threshold`` or more, components of
  verified links. Equal paragraphs are one unit before that; the units of a large bucket meet its least unit only.
* Windows are secondary: they are alike if equal (their index is 1), told by a 64-bit hash of their words' hashes. With n
  distinct windows in all, some two differ under one hash with odds of about n**2 / 2**65.

Units, classes and first occurrences are written before they are joined, so adaptive execution can split a hot key.

Of every cluster the occurrence first by (document, place) stays, the others are to be removed. A block and a line in it
do not repeat each other: where one is the first occurrence, the other stays too. Words are compared with A-Z lower-cased and white space left out of account.

Defined results: null or short texts have no units; documents with one id count as one (equal rows repeat each other at
the same place, which removes neither); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, column_bytes, mix, minhash, pieces, prefix_hash, rows_of, shingles, signed, span_hash, words
from .jaccard import SHINGLE, alike, band_keys
from .scratch import Scratch
from .suffix import sliding_min

LEAST, WINDOW, PLACES = SHINGLE, 20, 32
BANDS, ROWS = 12, 4


def anchors(h: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """Places of words where windows start: the first with the least hash of three words among every ``PLACES``
    successive places (or those left in the text) with ``WINDOW`` words ahead."""
    at = np.flatnonzero(np.arange(len(h)) + WINDOW <= np.repeat(woff[1:], np.diff(woff)))
    if not len(at):
        return at
    row = rows_of(woff)[at]
    n, low = np.arange(len(at)), np.uint64((1 << 28) - 1)
    to = n + (PLACES - 1) * np.cumsum(np.diff(row, prepend=row[:1]) > 0)  # texts are set apart
    value = np.full(to[-1] + PLACES, np.iinfo(np.uint64).max, np.uint64)
    value[to] = (span_hash(prefix_hash(mix(h)), at, at + 3) & ~low) | n.astype(np.uint64)
    least = (sliding_min(value, PLACES)[to] & low).astype(np.int64)
    return at[least[np.append(True, least[1:] != least[:-1])]]


def units(data: np.ndarray, off: np.ndarray):
    """(uid, row, a, b) of windows, and of lines and blocks of lines with their band keys."""
    low = LOWER[data]
    s, e, woff = words(low, off)
    h = span_hash(prefix_hash(low), s, e)
    row = rows_of(woff)
    run = prefix_hash(mix(h))
    i = anchors(h, woff)
    window = span_hash(run, i, i + WINDOW), row[i], s[i] - off[row[i]], e[i + WINDOW - 1] - off[row[i]]
    line = np.cumsum(data == 10)[s] if len(s) else np.zeros(0, np.int64)
    apart = np.diff(line, prepend=line[:1])
    other = np.ones(len(s), bool)
    other[1:] = row[1:] != row[:-1]

    def paragraphs(new, least_lines):
        p = np.flatnonzero(new)
        q = np.append(p[1:], len(s))[: len(p)]
        long = (q - p >= LEAST) & (line[q - 1] - line[p] + 1 >= least_lines)
        p, q = p[long], q[long]
        size = q - p
        cut = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(cut[-1]) + np.repeat(p - cut[:-1], size)
        v, o = shingles(h[at], cut, SHINGLE)
        keys = band_keys(minhash(v, o, BANDS * ROWS, seed=10), ROWS)
        r = row[p]
        return (span_hash(run, p, q), r, s[p] - off[r], e[q - 1] - off[r]), keys

    return window, paragraphs(other | (apart > 0), 1), paragraphs(other | (apart > 1), 2)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, start, end, cluster, removed): byte ranges of units that are repeated; cluster is the id of the document
    with the occurrence that stays."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(10), id_col, text_col).alias("dk"))
    kind = dict(d.dtypes)["doc_id"]

    def describe(batches):
        for b in batches:
            for rows, data, off in pieces(b["text"]):
                w, lines, blocks = units(data, off)
                for (uid, row, a, e), k, block in ((w, None, False), (*lines, False), (*blocks, True)):
                    if not len(uid):
                        continue
                    at = pa.array(row + rows.start)
                    if k is None:
                        held = pa.nulls(len(uid), pa.list_(pa.int64()))
                    else:
                        held = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1]), pa.array(signed(k.ravel())))
                    yield pa.RecordBatch.from_arrays(
                        [b["doc_id"].take(at), b["dk"].take(at), pa.array(signed(uid)), pa.array(a.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(np.full(len(uid), block)), held],
                        ["doc_id", "dk", "uid", "start", "end", "block", "keys"],
                    )

    def fetch(batches):
        for b in batches:
            data, off = column_bytes(b["text"])
            want = b["want"]
            row = np.repeat(np.arange(len(b)), want.value_lengths().to_numpy())
            w = want.flatten()
            raw = data.tobytes()
            texts = [raw[off[r] + x : off[r] + y].decode() for r, x, y in zip(row.tolist(), w.field("start").to_pylist(), w.field("end").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([w.field("uid"), pa.array(texts, pa.string())], ["uid", "text"])

    with Scratch(spark, "passages") as s:
        found = s.table(d.filter(F.octet_length("text") >= 2 * min(LEAST, WINDOW) - 1).mapInArrow(describe, f"doc_id {kind}, dk long, uid long, start int, end int, block boolean, keys array<long>"))
        place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "start")
        windows = found.filter(F.col("keys").isNull()).select("uid", "doc_id", "start", "end")
        twice = s.table(windows.groupBy("uid").agg(F.count("*").alias("c"), F.min(place).alias("first")).filter("c > 1").select("uid", "first"))
        equal = s.table(windows.join(twice, "uid").select("doc_id", "start", "end", "first"), tidy=True)
        keyed = found.filter(F.col("keys").isNotNull())
        classes = s.table(keyed.groupBy("uid").agg(F.count("*").alias("c"), F.min(F.struct("dk", "start", "end")).alias("at"), F.first("keys").alias("keys")), tidy=True)

        lines = s.table(keyed.select("uid", "doc_id", "start", "end", "block"), tidy=True)
        s.done(found, twice)  # band keys lie in the classes from here on

        def texts(wanted):
            lists = classes.select("uid", "at").join(wanted, "uid").groupBy("at.dk").agg(F.collect_list(F.struct("uid", F.col("at.start").alias("start"), F.col("at.end").alias("end"))).alias("want"))
            return d.select("dk", "text").join(lists.hint("shuffle_hash"), "dk").select("text", "want").mapInArrow(fetch, "uid long, text string").dropDuplicates(["uid"])

        linked = s.table(alike(s, texts, classes.select("uid", F.explode("keys").alias("key")), threshold))
        roots = s.table(classes.select("uid", "c").join(linked, "uid", "left").filter((F.col("c") > 1) | F.col("root").isNotNull()).select("uid", F.coalesce("root", "uid").alias("root")))
        member = s.table(lines.select("uid", "doc_id", "start", "end", "block").join(roots, "uid"), tidy=True)
        span = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "start", "end")
        line, block = F.when(~F.col("block"), span), F.when(F.col("block"), span)
        over = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["start"] < y["end"]) & (x["end"] > y["start"])
        first = member.groupBy("root").agg(F.min(span).alias("first"), F.min(line).alias("line"), F.min(block).alias("part"), F.count(line).alias("lines"), F.count(block).alias("parts"))
        # a block with a line that makes up most of it, and nothing else, is no repeat
        first = s.table(first.filter(~F.coalesce((F.col("lines") == 1) & (F.col("parts") == 1) & over(F.col("line"), F.col("part")), F.lit(False))))
        near = member.join(first, "root").withColumns({"own": F.when(F.col("block"), F.col("part")).otherwise(F.col("line")), "at": span})
        near = near.withColumn("stays", over(F.col("at"), F.col("first")) & F.col("own.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own.start") == F.col("start")))
        equal = equal.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")))
        columns = ["doc_id", "start", "end", F.col("first.doc_id").alias("cluster"), (~F.col("stays")).alias("removed")]
        out = equal.select(*columns).unionByName(near.select(*columns))
        return s.table(out.distinct(), keep=True, tidy=True)


def clusters(passages: DataFrame) -> DataFrame:
    """(doc_id, cluster, passages, removed): of each document and cluster, how many units it holds and how many go."""
    return passages.groupBy("doc_id", "cluster").agg(F.count("*").alias("passages"), F.count_if("removed").alias("removed"))
