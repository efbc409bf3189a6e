"""Tokens of :func:`text.tokenize` in one pass of Python: for whole corpora, where the column expression, whose lambdas are
interpreted once an element, takes most of an index's time. A word's tokens are remembered, as most words come again."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import text as T


def _pattern(java: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m[1].rjust(4, "0"), java), re.ASCII)


_FENCE, _COMMENT, _LINK, _URL, _WORDS, _HUMP, _ACRONYM, _PARTS = map(_pattern, (T.FENCE, T.COMMENT, T.LINK, T.URL, T.WORDS, T.HUMP, T.ACRONYM, T.PARTS))
_DIGITS, _STOP, KEPT = re.compile(r"[0-9]+"), frozenset(T.STOP_WORDS), 200_000
_STOP_WORDS = pa.array(T.STOP_WORDS)
#: Words of one part: without humps, and punctuation only at their end.
PLAIN = r"^(?:[A-Za-z][a-z0-9]*|[A-Z]+[0-9]*)[_./\-]*$"


class _Expanded(dict):
    """word -> its tokens; forgotten as a whole once there are many."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        humps = _ACRONYM.sub(r"\1 \2", _HUMP.sub(r"\1 \2", word))
        parts = [p for p in _PARTS.split(humps) if len(p) > 2]
        low = [t.lower() for t in ([word, *parts] if len(parts) > 1 else [word])]
        out = tuple(t for t in low if T.SHORTEST <= len(t) <= T.LONGEST and t not in _STOP and not _DIGITS.fullmatch(t))
        if len(self) >= KEPT:
            self.clear()
        self[word] = out
        return out


_TOKENS = _Expanded()


def _words(text: str | None) -> list[str]:
    if not text:
        return []
    if "```" in text:
        text = _FENCE.sub(" ", text)
    if "<!--" in text:
        text = _COMMENT.sub(" ", text)
    if "[" in text:
        text = _LINK.sub(r"\1", text)
    if "http" in text:
        text = _URL.sub(" ", text)
    return _WORDS.findall(text)


def tokens(text: str | None) -> list[str]:
    """Lower-case tokens in order, repeats kept; null gives none."""
    return list(chain.from_iterable(map(_TOKENS.__getitem__, _words(text))))


def _expanded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place, token) of distinct words, by place; those of one part all at once, as hardly any vocabulary is closed."""
    plain, low = pc.match_substring_regex(words, PLAIN), pc.ascii_lower(words)
    size = pc.binary_length(low)
    kept = pc.and_(pc.and_(plain, pc.invert(pc.is_in(low, _STOP_WORDS))), pc.and_(pc.greater_equal(size, T.SHORTEST), pc.less_equal(size, T.LONGEST)))
    one, other = np.flatnonzero(kept), np.flatnonzero(pc.invert(plain))
    each = [_TOKENS[w] for w in words.take(pa.array(other)).to_pylist()]
    place = np.concatenate([one, np.repeat(other, np.array([len(x) for x in each], np.int64))])
    order = np.argsort(place, kind="stable")
    token = pa.concat_arrays([low.take(pa.array(one)), pa.array(list(chain.from_iterable(each)), pa.string())])
    return place[order], token.take(pa.array(order))


def counts(*weighted: tuple[pa.Array, int]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, token, n), by row and token: how often the rows' texts have each, times the texts' weights. A word that comes
    again anywhere is expanded once."""
    words, rows, weights = [], [], []
    for column, weight in weighted:
        each = [_words(x) for x in column.to_pylist()]
        rows.append(np.repeat(np.arange(len(each)), np.array([len(x) for x in each], np.int64)))
        weights.append(np.full(len(rows[-1]), weight, np.int64))
        words.extend(chain.from_iterable(each))
    coded = pa.array(words, pa.string()).dictionary_encode()
    place, token = _expanded(coded.dictionary)
    token = token.dictionary_encode()
    order = pc.array_sort_indices(token.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    rank = rank[token.indices.to_numpy()]
    size, word = np.bincount(place, minlength=len(coded.dictionary)), coded.indices.to_numpy()
    first, size = (np.cumsum(size) - size)[word], size[word]
    at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    key = np.repeat(np.concatenate(rows), size) * len(order) + rank[at]
    by = np.argsort(key, kind="stable")
    key = key[by]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.add.reduceat(np.repeat(np.concatenate(weights), size)[by], new) if len(new) else np.zeros(0, np.int64)
    row, rank = np.divmod(key[new], max(1, len(order)))
    return row, token.dictionary.take(order).take(pa.array(rank)), n
