"""Removing repeated byte strings with a column-wise multi-document suffix construction.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the collection.

1. *Cutting the collection.* Every window of ``length`` bytes has a minimiser: the ``gram``-byte string inside it with
   the least hash, leftmost if tied. Successive windows with one minimiser form a piece of under twice ``length``
   bytes. Equal windows have equal minimisers at the same place, so pieces with different minimisers need never be
   compared, and pieces with the same one are aligned by it. Pieces are pre-aggregated by content: pieces that repeat
   within a stretch of texts (a phrase repeated without end makes one for every byte) leave it as one.
2. *Construction.* The contents of every minimiser that occurs twice go to the executors by minimiser; one that occurs
   several times enters its collection twice. Aligned pieces are the documents of a collection whose suffixes are sorted
   column by column from the right: each round inserts one symbol for every document, and a stable sort by that symbol
   (its count plus its rank, as in the backward step of a Burrows-Wheeler transform) gives the new order. The symbols in
   front of the sorted suffixes are the round's segment of the collection's transform, and the common prefix of
   neighbours is one more than the least on the way between their old places. Symbols, transform and common prefixes lie
   in sequential external files, a segment each round; a round reads the last segment and appends the next, so memory
   holds one segment and the order. A window repeats if its suffix shares ``length`` bytes with a neighbour.
3. *Spans.* Repeated windows are joined back to every occurrence of their piece and removed there.

Strings are judged on the input and never cross documents. Only minimisers that occur twice go past the first
aggregation. Groups of equal pieces are one row by then, and joins on them are plain equi-joins that adaptive execution
may split, so copies of a third of all rows do not meet in a task.

Defined results: null text is empty; ids may be null or repeated (rows are told apart by id and text; equal rows
repeat each other's strings); texts under ``length`` bytes stay whole; an empty table gives an empty result; other
columns travel in ``row``.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LIMIT, U64, column_bytes, pieces, prefix_hash, signed, span_hash
from .scratch import Scratch

PIECE = "mini long, content long, dk long, tag int, start int, n int, anchor int, c int"
BLOCK = 1 << 14  # documents to a block of the column file
COLLECTION = 1 << 17  # documents to a collection, unless one minimiser has more


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w successive values."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def cut(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimiser, content, row, start, windows, minimiser's place) of the pieces of some rows' bytes."""
    none = (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(4)))
    if len(data) < length:
        return none
    h = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    g = span_hash(h, at, at + gram)
    low = U64((1 << 21) - 1)
    m = sliding_min((g & ~low) | at.astype(U64), length - gram + 1)
    end = np.repeat(off[1:], np.diff(off))[: len(m)]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(m)]
    good = np.arange(len(m)) + length <= end
    new = good.copy()
    new[1:] &= (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
    last = good.copy()
    last[:-1] &= new[1:] | ~good[1:]
    s, e = np.flatnonzero(new), np.flatnonzero(last) + 1
    if not len(s):
        return none
    place = (m[s] & low).astype(np.int64)
    return g[place], span_hash(h, s, e - 1 + length), row[s], s - off[row[s]], e - s, place - s


def cut_batch(column: pa.Array, length: int, gram: int):
    """Pieces of a batch; a text longer than LIMIT is cut in overlapping stretches."""
    for rows, data, off in pieces(column):
        if len(data) <= 2 * LIMIT:
            yield rows.start, 0, cut(data, off, length, gram)
            continue
        for a in range(0, len(data) - length + 1, LIMIT):
            part = data[a : a + LIMIT + length - 1]
            yield rows.start, a, cut(part, np.array([0, len(part)]), length, gram)


class Segments:
    """A sequential external file of 16-bit segments: one is appended each round, and the last one is read back."""

    def __init__(self):
        self.file, self.sizes = tempfile.TemporaryFile(), []

    def append(self, segment: np.ndarray) -> None:
        self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(segment, np.int16))
        self.sizes.append(len(segment))

    def last(self) -> np.ndarray:
        self.file.seek(-2 * self.sizes[-1], 2)
        return np.frombuffer(self.file.read(2 * self.sizes[-1]), np.int16)

    def close(self) -> None:
        self.file.close()


def construct(group: np.ndarray, columns, count: int, length: int, transform: Segments, common: Segments):
    """Repeated windows of aligned documents, as (document, column, end) runs.

    ``columns`` yields, from the last column to the first, (column, a symbol for each document; 0 where it has none).
    ``group`` holds each document's minimiser number, ascending. ``transform`` and ``common`` get a segment each round:
    the symbols that stand before the sorted suffixes of the round before, and the sorted suffixes' common prefixes.
    """
    order = np.arange(count)
    common.append(np.zeros(count + 1, np.int16))
    run_end = np.zeros(count, np.int16)
    before = np.zeros(count, bool)
    out = []
    column = 0
    for column, symbols in columns:
        transform.append(symbols[order])
        sym, was = transform.last().astype(np.int64), common.last()
        step = np.argsort(group[order] * 512 + sym, kind="stable")
        order, sym = order[step], sym[step]
        same = np.zeros(count, bool)
        same[1:] = (sym[1:] == sym[:-1]) & (sym[1:] > 0) & (group[order[1:]] == group[order[:-1]])
        least = np.zeros(count, np.int16)
        i = np.flatnonzero(same)
        near = step[i] == step[i - 1] + 1
        least[i[near]] = was[step[i[near]]]
        far = i[~near]
        if len(far):
            far = far[np.argsort(-step[far - 1], kind="stable")]  # from the right: what lies between queries is empty
            ask = np.empty(2 * len(far), np.int64)
            ask[::2], ask[1::2] = step[far - 1] + 1, step[far] + 1
            least[far] = np.minimum.reduceat(was, ask)[::2]
        now = np.zeros(count + 1, np.int16)
        now[:count] = np.where(same, np.minimum(least + 1, length), 0)
        common.append(now)
        hit = now[:count] >= length
        hit[:-1] |= hit[1:]
        there = np.zeros(count, bool)
        there[order] = hit
        run_end[there & ~before] = column + 1
        if len(closed := np.flatnonzero(before & ~there)):
            out.append((closed, np.full(len(closed), column + 1), run_end[closed].astype(np.int64)))
        before = there
    if len(closed := np.flatnonzero(before)):
        out.append((closed, np.full(len(closed), column), run_end[closed].astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


class Collection:
    """Aligned documents in an external file, column by column within blocks."""

    def __init__(self, width: int):
        self.width, self.file, self.blocks, self.count, self.held = width, tempfile.TemporaryFile(), [], 0, []
        self.keys, self.contents, self.firsts, self.group, self.copy = [], [], [], [], []

    def add(self, mini: int, content: int, data: np.ndarray, first: int, copy: bool) -> None:
        self.group.append(self.group[-1] + (mini != self.keys[-1]) if self.keys else 0)
        self.keys.append(mini)
        self.contents.append(content)
        self.firsts.append(first)
        self.copy.append(copy)
        self.held.append((data, first))
        if len(self.held) == BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.held:
            m = np.zeros((len(self.held), self.width), np.int16)
            for i, (data, first) in enumerate(self.held):
                m[i, first : first + len(data)] = data
                m[i, first : first + len(data)] += 1
            self.blocks.append((self.file.tell(), len(m)))
            self.file.write(np.ascontiguousarray(m.T))
            self.count, self.held = self.count + len(m), []

    def columns(self):
        for c in range(self.width - 1, -1, -1):
            got = []
            for at, n in self.blocks:
                self.file.seek(at + 2 * n * c)
                got.append(np.frombuffer(self.file.read(2 * n), np.int16))
            yield c, np.concatenate(got)

    def solve(self, length: int) -> pa.RecordBatch:
        """Repeated runs of windows of every content; the files go when this is over."""
        transform, common = Segments(), Segments()
        try:
            self.flush()
            d, a, b = construct(np.array(self.group), self.columns(), self.count, length, transform, common)
        finally:
            for f in (self.file, transform, common):
                f.close()
        own = ~np.array(self.copy)[d]  # a content's second copy has the same runs
        d, a, b = d[own], a[own], b[own]
        first = np.array(self.firsts)[d]
        return pa.RecordBatch.from_arrays([pa.array(np.array(self.keys)[d]), pa.array(np.array(self.contents)[d]), pa.array((a - first).astype(np.int32)), pa.array((b - first).astype(np.int32))], ["mini", "content", "first", "last"])


def repeated(length: int, gram: int):
    """A mapInArrow function: rows (mini, content, anchor, c, bytes) sorted by mini to (mini, content, first, last) runs of windows."""
    lead = length - gram
    width = lead + length

    def run(batches):
        docs = Collection(width)
        for batch in batches:
            data, off = column_bytes(batch["bytes"].cast(pa.binary()))
            for i, (mini, content, anchor, c) in enumerate(zip(*(batch[x].to_pylist() for x in ("mini", "content", "anchor", "c")), strict=True)):
                if docs.keys and mini != docs.keys[-1] and len(docs.keys) >= COLLECTION:
                    yield docs.solve(length)
                    docs = Collection(width)
                piece = data[off[i] : off[i + 1]].copy()
                for copy in range(min(c, 2)):
                    docs.add(mini, content, piece, lead - anchor, copy > 0)
        if docs.keys:
            yield docs.solve(length)

    return run


def spans(s: Scratch, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(dk, tag, spans): byte ranges to remove, of rows (dk, tag, text)."""

    def describe(batches):
        for b in batches:
            dk, tag = b["dk"].to_numpy(), b["tag"].to_numpy()
            for first, base, (mini, content, row, start, n, anchor) in cut_batch(b["text"], length, gram):
                if not len(row):
                    continue
                row, start = row + first, start + base
                _, one, group, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
                again = np.flatnonzero(times[group] > 1)
                # what repeats within the stretch is known to go, as merged spans, and goes on as one piece that counts twice
                begin, end = start[again], (start + n)[again] + length - 1
                new = np.ones(len(again), bool)
                new[1:] = (row[again][1:] != row[again][:-1]) | (begin[1:] > end[:-1])
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(again))[: len(at)] - 1
                spanned = row[again][at]
                zeros, none = np.zeros(len(at), np.int32), pa.nulls(len(at), pa.int64())
                ints = lambda *x: [pa.array(v.astype(np.int32)) for v in x]
                names = ["mini", "content", "dk", "tag", "start", "n", "anchor", "c"]
                yield pa.RecordBatch.from_arrays([none, none, pa.array(dk[spanned]), pa.array(tag[spanned]), *ints(begin[at], end[last] - begin[at], zeros, zeros)], names)
                mini, content, row, start, n, anchor = (x[one] for x in (mini, content, row, start, n, anchor))
                yield pa.RecordBatch.from_arrays([pa.array(signed(mini)), pa.array(signed(content)), pa.array(dk[row]), pa.array(tag[row]), *ints(start, n, anchor, np.minimum(times, 2))], names)

    def fetch(batches):
        for b in batches:
            data, off = column_bytes(b["text"])
            want = b["want"]
            row = np.repeat(np.arange(len(b)), want.value_lengths().to_numpy())
            w = want.flatten()
            size = w.field("n").to_numpy().astype(np.int64) + length - 1
            to = np.concatenate(([0], np.cumsum(size)))
            at = np.arange(to[-1]) + np.repeat(off[row] + w.field("start").to_numpy() - to[:-1], size)
            cutout = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])
            yield pa.RecordBatch.from_arrays([w.field("mini"), w.field("content"), w.field("anchor"), w.field("c"), cutout], ["mini", "content", "anchor", "c", "bytes"])

    found = s.table(docs.filter(F.octet_length("text") >= length).mapInArrow(describe, PIECE))
    known = s.table(found.filter("mini is null").select("dk", "tag", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")).alias("span")))
    twice = found.filter("mini is not null").groupBy("mini").agg(F.sum("c").alias("c")).filter("c > 1").select("mini")
    shared = s.table(tidy=True, df=found.join(twice, "mini"))
    s.drop(s.paths[-3])
    classes = shared.groupBy("mini", "content").agg(F.sum("c").alias("c"), F.min(F.struct("dk", "tag", "start", "n", "anchor")).alias("r"))
    want = classes.groupBy("r.dk", "r.tag").agg(F.collect_list(F.struct(F.col("r.start").alias("start"), F.col("r.n").alias("n"), F.col("r.anchor").alias("anchor"), "mini", "content", F.least("c", F.lit(2)).cast("int").alias("c"))).alias("want"))
    aligned = docs.join(want.hint("shuffle_hash"), ["dk", "tag"]).select("text", "want").mapInArrow(fetch, "mini long, content long, anchor int, c int, bytes binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = aligned.repartition(parts, "mini").sortWithinPartitions("mini", "content").mapInArrow(repeated(length, gram), "mini long, content long, first int, last int")
    marks = s.table(tidy=True, df=runs)
    span = F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + (length - 1)).alias("b"))
    every = shared.join(marks, ["mini", "content"]).select("dk", "tag", span.alias("span")).unionByName(known)
    return every.groupBy("dk", "tag").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 50, carry: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256); if ``carry``, also ``kept`` (what is left, as text without
    characters that were cut apart) and ``row`` (all input columns)."""
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [F.xxhash64(F.lit(3), id_col, text_col).alias("dk"), F.hash(id_col, text_col).alias("tag")]

    def finish(batches):
        for b in batches:
            data, off = column_bytes(b["text"])
            sp = b["spans"]
            flat = sp.flatten()
            a, e = flat.field("a").to_numpy(), flat.field("b").to_numpy()
            cuts = np.concatenate(([0], np.cumsum(sp.value_lengths().fill_null(0).to_numpy())))
            gone, runs, sha, left = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), [], []
            for i in range(len(b)):
                x = data[off[i] : off[i + 1]]
                if cuts[i] < cuts[i + 1]:
                    depth = np.bincount(a[cuts[i] : cuts[i + 1]], minlength=len(x) + 1) - np.bincount(e[cuts[i] : cuts[i + 1]], minlength=len(x) + 1)
                    keep = np.cumsum(depth)[:-1] <= 0
                    gone[i] = len(x) - np.count_nonzero(keep)
                    runs[i] = np.count_nonzero(~keep[1:] & keep[:-1]) + (not keep[0])
                    x = x[keep]
                x = x.tobytes()
                sha.append(hashlib.sha256(x).hexdigest())
                if carry:
                    left.append(x.decode("utf-8", "ignore"))
            cols = [b["doc_id"], pa.array(np.diff(off)), pa.array(gone), pa.array(runs), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if carry:
                cols, names = [*cols, pa.array(left, pa.string()), b["row"]], [*names, "kept", "row"]
            yield pa.RecordBatch.from_arrays(cols, names)

    with Scratch(spark, "suffix") as s:
        found = s.table(spans(s, docs.select(*keys, text.alias("text")), length, gram), keep=True, tidy=True)
    rows = docs.select(*keys, F.col(id_col).alias("doc_id"), text.alias("text"), *([F.struct("*").alias("row")] if carry else []))
    rows = rows.join(found.hint("shuffle_hash"), ["dk", "tag"], "left").drop("dk", "tag")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(finish, schema + (f", kept string, row {rows.schema['row'].dataType.simpleString()}" if carry else ""))
