"""Packing token sequences by best-fit decreasing.

Documents are tokenised and end in id 0. One longer than the window is first cut into full windows, each a sequence of
its own; what is left of every document is placed, longest first, in the open sequence with the least room that
suffices, found by a segment tree indexed by remaining room. Sequences that stay poorly filled (more than ``slack``
ids of padding) are dissolved: their pieces, end to end, fill full windows, and the last ids go to sequences whose
lengths are powers of two, which need no padding.

Packing runs inside the scan: every task packs its own split, ``PORTION`` ids at a time, so nothing is shuffled, no
source or group of copies meets in a task, and a task that is run again gives the same pieces. ``sequence_id`` holds
the split in its upper bits. So the layout follows the input's splits: other files or split sizes give another packing
of the same ids, as full as this one but for the last sequences of each portion.

Ids are those of the tokenizer file's own library without special tokens added; a special token that a text spells
becomes its id, as in that library. Given the vocabulary's splitting ``pattern``, texts without such a spelling are
encoded by a second library from the same file's vocabulary, with equal ids in a third of the time.

Defined results: null text is empty (the single id 0); equal rows are packed each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import pieces

PORTION = 4 << 20
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Room:
    """A segment tree over remaining room 0 to ``size``: which rooms have an open sequence."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room of at least ``need`` with an open sequence, or -1."""
        count, i = self.count, need + self.leaves
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        i = room + self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[room].pop()


def pack(lengths: list[int], window: int, slack: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of these lengths."""
    made = 0
    rest = []
    for d, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            yield d, start, window, made, 0
            made += 1
        if n % window:
            rest.append((n % window, d))
    rest.sort(key=lambda x: (-x[0], x[1]))
    room, bins = Room(window), []
    for n, d in rest:
        if (least := room.tightest(n)) >= 0:
            b = room.take(least)
        else:
            b, least = len(bins), window
            bins.append([])
        bins[b].append((d, lengths[d] - n, n))
        if least > n:
            room.add(least - n, b)
    loose = []
    for b in bins:
        total = sum(x[2] for x in b)
        if window - total > slack and total & (total - 1):
            loose += b
            continue
        at = 0
        for d, start, n in b:
            yield d, start, n, made, at
            at += n
        made += 1
    left = sum(x[2] for x in loose)
    goal, at = min(window, 1 << max(left.bit_length() - 1, 0)), 0
    for d, start, n in loose:
        while n:
            k = min(n, goal - at)
            yield d, start, k, made, at
            start, n, at, left = start + k, n - k, at + k, left - k
            if at == goal:
                made, at = made + 1, 0
                goal = min(window, 1 << max(left.bit_length() - 1, 0))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str | None) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to lists of ids, kept by the Python worker."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    by_file = lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]
    if pattern is None:
        return by_file
    import tiktoken

    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in the file
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte[c] for c in token): i for token, i in own.get_vocab(with_added_tokens=False).items()}
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [x.content for x in own.get_added_tokens_decoder().values()]

    def encode(texts):
        spelled = [i for i, t in enumerate(texts) if any(x in t for x in special)]
        out = fast.encode_ordinary_batch(texts, num_threads=1)
        for i, ids in zip(spelled, by_file([texts[i] for i in spelled]), strict=True):
            out[i] = ids
        return out

    return encode


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str | None = None, window: int = 1024, slack: int = 16, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ``ids`` if asked for.

    ``tokenizer`` is the path of a byte-level BPE tokenizer file, which must be readable on the executors.
    """

    def run(batches):
        encode, split, made = encoder(tokenizer, pattern), TaskContext.get().partitionId(), 0

        def flush(ids, keys):
            nonlocal made
            rows = list(pack([len(x) for x in ids], window, slack))
            if not rows:
                return
            d, start, n, seq, at = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            crc = np.fromiter((zlib.crc32(ids[a][b : b + c].tobytes()) for a, b, c in zip(d.tolist(), start.tolist(), n.tolist(), strict=True)), np.int64, len(d))
            size = np.array([len(x) for x in ids], np.int64)
            cols = [pa.concat_arrays(keys).take(pa.array(d)), start, n, crc, size[d], seq + made + (split << 40), at]
            if with_ids:
                cols.append(pa.array([ids[a][b : b + c] for a, b, c in zip(d.tolist(), start.tolist(), n.tolist(), strict=True)], pa.list_(pa.int32())))
            made += int(seq.max()) + 1
            yield from pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], FIELDS + ["ids"] * with_ids).to_batches(10_000)

        ids, keys, held = [], [], 0
        for b in batches:
            for rows, _, _ in pieces(b["text"]):
                first = rows.start
                for i, got in enumerate(encode(["" if t is None else t for t in b["text"][rows].to_pylist()]), rows.start):
                    ids.append(np.array([*got, 0], "<i4"))
                    held += len(ids[-1])
                    if held >= PORTION:
                        keys.append(b["doc_id"].slice(first, i + 1 - first))
                        yield from flush(ids, keys)
                        ids, keys, held, first = [], [], 0, i + 1
                keys.append(b["doc_id"].slice(first, rows.stop - first))
        yield from flush(ids, keys)

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in FIELDS[1:]) + (", ids array<int>" if with_ids else ""))
