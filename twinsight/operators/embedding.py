"""Vectors of items from an injected encoder, in batches.

The encoder is any callable from a list of texts to a list of vectors, importable on executors. Items stay in their
splits; each batch of ``BATCH`` texts is one call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embed_text

BATCH = 32
Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(size > 0, size, 1.0)


def embed(items: DataFrame, encoder: Encoder, batch: int = BATCH) -> DataFrame:
    """(number, vector): unit vectors of title and body. A batch of which the encoder makes another number of vectors
    than texts fails the job: vectors must not shift to other items."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.slice(at, batch)
                texts = part["text"].to_pylist()
                got = np.asarray(encoder(texts), np.float64)
                if len(got) != len(texts):
                    raise ValueError(f"the encoder made {len(got)} vectors of {len(texts)} texts")
                yield pa.RecordBatch.from_arrays([part["number"], pa.array(list(unit(got)), pa.list_(pa.float64()))], ["number", "vector"])

    text = embed_text(F.col("title"), F.col("body"))
    return items.select("number", text.alias("text")).mapInArrow(run, "number long, vector array<double>")


def letter_encoder(texts: list[str]) -> list[list[float]]:
    """A stand-in without a model: how often each vowel occurs, and a constant."""
    return [[1.0, *(float(t.count(v)) for v in "aeiou")] for t in texts]
