"""Encoders of the user's own for chunks of text, as iterators of Arrow batches.

``load()`` runs once per worker process and returns a function from a list of texts
to a matrix with a row for each. Texts go to it in groups of similar length, so
that a model which pads its inputs wastes little.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TEXTS = 64  # encoded at once
_loaded: dict[str, Callable] = {}


def batched(encode: Callable[[Sequence[str]], np.ndarray], texts: Sequence[str], dims: int, size: int = TEXTS) -> np.ndarray:
    """The vectors of the texts in their order, encoded in groups of similar length."""
    out = np.zeros((len(texts), dims))
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for at in range(0, len(order), size):
        group = order[at:at + size]
        found = np.asarray(encode([texts[i] for i in group]), dtype=np.float64)
        if found.shape != (len(group), dims):
            raise ValueError(f"the encoder returned {found.shape} for {len(group)} texts of {dims} dimensions")
        out[group] = found
    return out


def model_encoder(load: Callable[[], Callable[[Sequence[str]], np.ndarray]], dims: int, size: int = TEXTS):
    """An encoder for :func:`~textlab.operators.vectors.embed_chunks`: ``(doc_id, chunk, text)`` to
    ``(doc_id, chunk, vector)``. A null text is encoded as an empty one."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = load()
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            vectors = batched(_loaded[key], texts, dims, size)
            lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, dims, dtype=np.int32), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "chunk", "vector"])

    def encode(chunks: DataFrame) -> DataFrame:
        kinds = dict(chunks.dtypes)
        return chunks.select("doc_id", "chunk", "text").mapInArrow(
            run, f"doc_id {kinds['doc_id']}, chunk {kinds['chunk']}, vector array<double>")

    return encode
