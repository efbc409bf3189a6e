"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing reduces each symbol, by the lowest bit in which it differs from its left neighbour, to a
label below 6 in a few rounds; places with a label above both neighbours' start phrases of 2 to about 12 symbols. The
hash of a phrase's content is its name, and names are the symbols of the next level. Where a phrase starts depends on
a handful of neighbouring symbols only, so equal substrings share all names but those at their ends, at any offset.
Runs of one symbol count as one for the tossing and stay whole inside a phrase.

The names of the last two of ``LEVEL`` levels (phrases of about 5 and 15 bytes) of a text form a set, whatever its
length: the shortest text has a name on each. The fingerprint is a MinHash sketch of the set in hexadecimal; the
likeness of two fingerprints is the share of equal slots, which estimates the Jaccard index of the sets.

Defined results: null text is empty; an empty text has an empty fingerprint, like another empty one (1.0) and unlike
all else (0.0); documents are ordered by (id, text hash), null ids first, so equal rows follow each other; the last
one's next is the first, and a single document is its own next; an empty table gives an empty result; other columns
are ignored. Ids must be numeric.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U64, column_bytes, minhash, mix, pieces, prefix_hash, span_hash

LEVEL = 3
SLOTS = 64
_BIT = np.zeros(1 << 16, np.uint8)
for _i in range(15, -1, -1):
    _BIT[np.arange(1 << 16) >> _i & 1 == 1] = _i
_at = np.arange(256)
#: Of (left, symbol) bytes: twice the lowest bit in which they differ, plus the symbol's bit there.
TOSS = (2 * _BIT[_at[:, None] ^ _at] + (_at >> _BIT[_at[:, None] ^ _at] & 1)).astype(np.uint8).ravel()


def _toss(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing; a row's first symbol differs in its lowest bit from what would stand before it."""
    left = np.empty_like(v)
    left[1:] = v[:-1]
    left[first] = v[first] ^ v.dtype.type(1)
    if v.dtype == np.uint8:
        return TOSS[(left.astype(np.uint16) << np.uint16(8)) | v]
    x = left ^ v
    bit, part = np.zeros(len(v), np.uint8), x.astype(np.uint16)
    for k in range(4):
        shifted = (x >> U64(16 * k)).astype(np.uint16)
        new = (part == 0) if k else np.ones(len(v), bool)
        if k and not new.any():
            break
        bit[new] = _BIT[shifted[new]] + 16 * k
        part = np.where(new, shifted, part)
    return (2 * bit + ((v >> bit.astype(U64)) & U64(1)).astype(np.uint8)).astype(np.uint8)


def phrases(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the phrases of each row's symbols."""
    first = off[:-1][np.diff(off) > 0]
    head = np.ones(len(v), bool)
    head[1:] = v[1:] != v[:-1]
    head[first] = True
    at = np.flatnonzero(head)
    begin = np.searchsorted(at, first)
    label = v[at]
    for _ in range(3 if v.dtype == np.uint8 else 4):
        label = _toss(label, begin)
    top = np.zeros(len(label), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.append(begin[1:], len(label)) - 1
    top[last] = False
    top[begin] = True
    return at[top]


def names(data: np.ndarray, off: np.ndarray, levels: int = LEVEL) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, row offsets) of each level from 1."""
    out, v, symbols = [], data, data
    for level in range(levels):
        if not len(v):
            out.append((np.zeros(0, U64), np.zeros(len(off), np.int64)))
            continue
        s = phrases(v, off)
        e = np.append(s[1:], len(v))
        v = span_hash(prefix_hash(symbols), s, e) ^ U64(level)
        off = np.searchsorted(s, off)
        symbols = mix(v)
        out.append((v, off))
    return out


def sketches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, SLOTS) of 16 bits; rows of empty texts are all ones, which no other row is."""
    sig = np.minimum(*(minhash(v, o, SLOTS) for v, o in names(data, off)[-2:]))
    short = (sig ^ (sig >> np.uint32(16))).astype(np.uint16)
    short[short == 0xFFFF] = 0xFFFE
    short[np.diff(off) == 0] = 0xFFFF
    return short


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def _hex(sig: np.ndarray) -> list[str]:
    return ["" if row[0] == 0xFFFF else row.astype(">u2").tobytes().hex() for row in sig]


def _edited(data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Edited texts and code points of all rows but the last, from each row and the one after it."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    loff = np.searchsorted(lead, off)
    lead = np.append(lead, len(data))
    count = np.diff(loff)
    quarter = count // 4
    stop = lead[loff[1:] - quarter]
    stop = np.where(quarter > 0, stop, off[1:])
    taken = np.minimum(quarter[:-1], count[1:])
    upto = np.where(taken < count[1:], lead[loff[1:-1] + taken], off[2:])
    raw = data.tobytes()
    return [raw[a:b] + raw[c:d] for a, b, c, d in zip(off[:-2].tolist(), stop[:-1].tolist(), off[1:-1].tolist(), upto.tolist(), strict=True)], count[:-1]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents are dealt by id ranges; the first of each range also goes to the range before, as the next of its last.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = sorted(set(d.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    d = d.withColumn("h", F.xxhash64("text"))
    bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    firsts = d.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("f"))
    every = Window.partitionBy()
    heads = firsts.select("bucket", F.col("f.doc_id").alias("doc_id"), F.col("f.h").alias("h"), F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(every)).alias("to"))
    a, b = d.alias("a"), F.broadcast(heads).alias("b")  # a row for each range, at most ``parts``
    same = (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    own = F.struct(F.col("a.bucket").alias("bucket"), F.lit(False).alias("copy"))
    sent = F.when(F.col("b.to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("b.to").alias("bucket"), F.lit(True).alias("copy"))))
    rows = a.join(b, same, "left").select("a.doc_id", "a.text", "a.h", F.explode(sent).alias("s")).select("s.bucket", "s.copy", "doc_id", "h", "text")
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "copy", "doc_id", "h").select("copy", "doc_id", "text")
    names_ = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            t = t.combine_chunks()
            copy, ids, text = t["copy"].to_numpy(), t["doc_id"].combine_chunks(), t["text"].combine_chunks()
            rest = t.slice(len(t) - 1)
            whole, woff = column_bytes(text)
            for part, data, off in pieces(text):
                stop = min(part.stop + 1, len(t))  # with the row after
                data, off = whole[woff[part.start] : woff[stop]], woff[part.start : stop + 1] - woff[part.start]
                if len(off) < 3:
                    continue
                texts, count = _edited(data, off)
                sig = sketches(data, off)
                eoff = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
                esig = sketches(np.frombuffer(b"".join(texts), np.uint8), eoff)
                cols = [ids.slice(part.start, len(texts)), count, [hashlib.sha256(x).hexdigest() for x in texts], _hex(sig[:-1]), _hex(esig), likeness(sig[:-1], esig), likeness(sig[:-1], sig[1:])]
                out = pa.Table.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in cols], names_)
                yield from out.filter(pa.array(~copy[part.start : part.start + len(texts)])).combine_chunks().to_batches()

    kind = dict(d.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
