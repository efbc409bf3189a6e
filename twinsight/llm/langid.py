"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order 0 to 3 with method-C escapes: in a context seen ``t`` times with ``q``
distinct successors, a successor seen ``c`` times has probability c/(t+q), the escape q/(t+q); below order 0 all 256
bytes are equally likely. Statistics are frozen after training, so the code length of a byte depends on its context
alone: all trees are compiled into one table (deepest known context, byte) -> bits in every language, and a text's exact
code lengths are sums of table rows, taken for whole batches at once. The language with the shortest code wins.

Training reads a bounded sample, the documented parameters ``sample_docs`` (of each language, smallest hashes) and
``sample_chars`` (of each of these): 4 languages take some MB at most. Scoring reads every byte of every text.

Defined results: null text, or one without a letter, or no training rows: ``und`` with score 0; ties go to the language
first in code-point order; repeated rows are scored alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import column_bytes, pieces

ORDER = 3
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # byte -> symbol; the last symbol stands for every byte not seen in training
    context: np.ndarray  # three symbols -> node
    bits: np.ndarray  # node * symbols + symbol -> bits by language


def grams(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``order`` + 1 bytes (as numbers, the last byte lowest) inside the rows, and how often each occurs."""
    at = np.arange(order, len(data))
    first = np.repeat(off[:-1], np.diff(off))
    at = at[at - order >= first[order:]]
    g = data[at].astype(np.uint32)
    for k in range(1, order + 1):
        g |= data[at - k].astype(np.uint32) << np.uint32(8 * k)
    return np.unique(g, return_counts=True)


def tree(found: list[tuple[np.ndarray, np.ndarray]]) -> list[dict[bytes, Counter]]:
    """Successor counts of the contexts of each order, from the strings of orders 0 to ``ORDER``."""
    out: list[dict[bytes, Counter]] = []
    for order, (v, n) in enumerate(found):
        level: dict[bytes, Counter] = {}
        for g, c in zip(v.tolist(), n.tolist(), strict=True):
            level.setdefault(bytes((g >> (8 * k)) & 255 for k in range(order, 0, -1)), Counter())[g & 255] = c
        out.append(level)
    return out


def train(trees: dict[str, list[dict[bytes, Counter]]]) -> Model:
    """The table of each language's :func:`tree`."""
    langs = sorted(trees)
    seen = sorted({b for x in langs for b in trees[x][0].get(b"", ())})
    codes = np.full(256, len(seen), np.uint8)
    codes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    known = [sorted({c for x in langs for c in trees[x][n]}) for n in range(ORDER + 1)]
    node = {c: i for i, c in enumerate([b"", *(c for n in range(1, ORDER + 1) for c in known[n])])}
    bits = np.empty((len(node), width, max(len(langs), 1)), np.float32)
    for k, x in enumerate(langs):
        for c, i in node.items():
            row = bits[node[c[1:]], :, k].copy() if c else np.full(width, 8.0, np.float32)
            if got := trees[x][len(c)].get(c):
                total, kinds = sum(got.values()), len(got)
                row += np.log2((total + kinds) / kinds)
                at = codes[list(got)]
                row[at] = np.log2((total + kinds) / np.array(list(got.values()), float))
            bits[i, :, k] = row
    context = np.zeros((width, width, width), np.int32)
    for n in range(1, ORDER + 1):
        for c in known[n]:
            context[(*[slice(None)] * (ORDER - n), *codes[list(c)])] = node[c]
    return Model(langs, codes, context.ravel(), bits.reshape(len(node) * width, -1))


def code_lengths(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of each row's bytes in every language."""
    out = np.zeros((len(off) - 1, len(model.langs)))
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    c, width = model.codes[data].astype(np.int32), int(round(len(model.context) ** (1 / 3)))
    at = np.zeros(len(c), np.int32)
    for k in range(ORDER, 0, -1):
        before = np.full(len(c), width - 1, np.int32)
        before[k:] = c[:-k]
        for j in range(k):  # a context does not reach into the row before
            x = off[full] + j
            before[x[x < off[full + 1]]] = width - 1
        at *= width
        at += before
    at = model.context[at]
    at *= width
    at += c
    out[full] = np.add.reduceat(model.bits[at], off[full], axis=0, dtype=np.float64)
    return out


def sample(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(lang, text) of the bounded training sample: of each language the documents with the smallest hashes of id and text.

    A language's count tells below which hash about twice as many lie, so no more than these meet to be ranked.
    """
    h = F.xxhash64(F.lit(7), "doc_id", "text")
    usable = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    size = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not size:
        return usable.select("lang", "text")
    cut = {k: min((1 << 63) - 1, (1 << 64) * 2 * sample_docs // n - (1 << 63)) for k, n in size.items()}
    under = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])
    rows = usable.withColumn("h", h).filter(F.col("h") <= under[F.col("lang")])
    last = rows.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample_docs)
    ends = {r["lang"]: r["last"] for r in last.groupBy("lang").agg(F.max("h").alias("last")).collect()}
    upto = F.create_map(*[F.lit(x) for kv in ends.items() for x in kv])
    return usable.withColumn("h", h).filter(F.col("h") <= upto[F.col("lang")]).select("lang", "text")


def learn(docs: DataFrame, sample_docs: int) -> Model:
    """The model of a bounded sample of (doc_id, text, lang). The driver receives a row for each distinct byte string."""

    def count(batches):
        for b in batches:
            lang = np.array(b["lang"].to_pylist(), object)
            for rows, data, off in pieces(b["text"]):
                for x in sorted(set(lang[rows])):
                    mine = np.flatnonzero(lang[rows] == x)
                    size = np.diff(off)[mine]
                    cut = np.concatenate(([0], np.cumsum(size)))
                    part = data[np.arange(cut[-1]) + np.repeat(off[mine] - cut[:-1], size)]
                    for order in range(ORDER + 1):
                        v, n = grams(part, cut, order)
                        yield pa.RecordBatch.from_arrays([pa.array([x] * len(v), pa.string()), pa.array(np.full(len(v), order, np.int32)), pa.array(v.astype(np.int64)), pa.array(n)], ["lang", "k", "g", "n"])

    sums = sample(docs, sample_docs).mapInArrow(count, "lang string, k int, g long, n long").groupBy("lang", "k", "g").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang", "k").agg(F.collect_list("g").alias("g"), F.collect_list("n").alias("n"))
    found: dict[str, list] = {}
    for r in packed.collect():
        found.setdefault(r["lang"], [(np.zeros(0, np.int64),) * 2] * (ORDER + 1))[r["k"]] = (np.array(r["g"]), np.array(r["n"]))
    return train({k: tree(v) for k, v in found.items()})


def predict(model: Model, text: pa.Array, letter: pa.Array, stretch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, excess) of each whole text; ``letter`` marks those with one. The excess is by how many bits the
    shortest code is longer than the text's plain bytes (negative if shorter)."""
    pred, sure, excess = np.full(len(text), UNKNOWN, object), np.zeros(len(text)), np.full(len(text), np.inf)
    if model.langs:
        known = letter.to_numpy(zero_copy_only=False)
        for rows, data, off in pieces(text):
            cost, size = code_lengths(model, data, off), np.diff(off)
            best = cost.argmin(axis=1)
            least = cost[np.arange(len(cost)), best]
            apart = (cost - least[:, None]) * (np.minimum(stretch, size) / np.maximum(size, 1))[:, None]
            odds = np.exp2(-np.minimum(apart, 1000)).sum(axis=1)
            pred[rows] = np.where(known[rows], np.array(model.langs, object)[best], UNKNOWN)
            sure[rows] = np.where(known[rows], 1 / odds, 0.0)
            excess[rows] = least - 8.0 * size
    return pred, sure, excess


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, text, lang, held_out): rows whose crc32(id) mod ``folds`` is ``held_out`` are not learned from."""
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), out.alias("held_out"))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_out: int = 2,
    sample_docs: int = 300,
    stretch: float = 1.0,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits): ``bits`` a byte are those of the shortest code (null for empty texts)."""
    d = _training(docs, id_col, text_col, lang_col, folds, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(learn(d.filter(~F.col("held_out")), sample_docs))  # bounded by the sample
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def score(batches):
        m = shared.value
        for b in batches:
            pred, sure, excess = predict(m, b["text"], b["letter"], stretch)
            size = np.diff(column_bytes(b["text"])[1])
            bits = pa.array(8.0 + excess / np.maximum(size, 1), mask=(size == 0) | ~np.isfinite(excess))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(pred, pa.string()), pa.array(sure), bits], ["doc_id", "held_out", "lang_pred", "score", "bits"])

    kind = dict(d.dtypes)["doc_id"]
    return d.select("doc_id", "held_out", letter.alias("letter"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits double")


def keep_known(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_out: int = 2,
    sample_docs: int = 300,
    grace: float = 64.0,
) -> DataFrame:
    """All columns of the rows in a known language: the filter for pipelines.

    Each whole text is scored as :func:`identify` scores it. A row goes if its language is ``und``, or if every language's
    code is longer than the plain bytes by more than ``grace`` bits: no learned language explains such a text (the
    grace spares short texts, whose first bytes have no context). The scores are taken in the rows themselves, so no
    join is needed. Null and empty texts go; repeated rows stay or go together; columns may have any names.
    """
    d = _training(docs, id_col, text_col, lang_col, folds, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(learn(d.filter(~F.col("held_out")), sample_docs))
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def keep(batches):
        m = shared.value
        for b in batches:
            text, known, row = b.columns
            pred, _, excess = predict(m, text, known, 1.0)
            yield pa.RecordBatch.from_arrays([row.filter(pa.array((pred != UNKNOWN).astype(bool) & (excess <= grace)))], ["row"])

    rows = docs.select(F.col(text_col).alias("text"), letter.alias("letter"), F.struct("*").alias("row"))
    return rows.mapInArrow(keep, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
