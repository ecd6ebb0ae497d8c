"""Vector similarity, normalisation and the hashing embedding.

Higher-order functions over arrays are not code-generated, so per-row vector arithmetic runs
in Arrow batches: the list column arrives as one contiguous buffer and a whole batch costs a
single NumPy product.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import text as T

# Hashing-embedding contract.
EMBEDDING_DIMENSION = 768
EMBEDDING_TOKEN = T.EMBEDDING_TOKEN


def rows_of(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the vectors whose length is ``dimension`` plus the mask selecting them."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    mask = lengths == dimension
    kept = vectors if mask.all() else vectors.filter(pa.array(mask))
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(-1, dimension), mask


def norms(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return np.where(length == 0.0, 1.0, length)


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity of an ARRAY column to one query vector.

    Vectors of another length, and missing vectors, score 0; a zero norm counts as 1.
    """
    q = np.asarray(list(query), dtype=np.float64)
    q = q / (float(np.sqrt(q @ q)) or 1.0)
    dimension = len(q)

    @F.arrow_udf("double")
    def cosine(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors))
        if dimension:
            matrix, mask = rows_of(vectors, dimension)
            out[mask] = (matrix @ q) / norms(matrix)
        return pa.array(out)

    return cosine(vector)


def cosine_between(left: Column, right: Column) -> Column:
    """Cosine similarity of two ARRAY columns, evaluated row by row in the JVM."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.sqrt(s)))
    same = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    return F.when(same, dot / (norm(left) * norm(right))).otherwise(F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; the zero vector is left as it is."""

    @F.arrow_udf("array<double>")
    def normalize(vectors: pa.Array) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        owner = np.repeat(np.arange(len(vectors)), np.diff(offsets))
        length = np.sqrt(np.bincount(owner, weights=flat * flat, minlength=len(vectors)))
        length[length == 0.0] = 1.0
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat / length[owner]), mask=vectors.is_null() if vectors.null_count else None)

    return normalize(vector)


def _token_slots(tokens: Sequence[str], dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and weight of each token, from the first two 32-bit numbers of its digest."""
    heads = b"".join([blake2b(t.encode("utf-8"), digest_size=16).digest()[:8] for t in tokens])
    numbers = np.frombuffer(heads, ">u4").reshape(-1, 2)
    return (numbers[:, 0] % dimension).astype(np.int64), 1.0 + numbers[:, 1] / 2**32


def hash_vector(text: str, dimension: int = EMBEDDING_DIMENSION) -> list[float]:
    """Embedding of one query string on the driver."""
    slots, weights = _token_slots([t.lower() for t in re.findall(EMBEDDING_TOKEN, text)], dimension)
    values = np.bincount(slots, weights=weights, minlength=dimension).astype(np.float64)  # counts, if there is no token
    length = float(np.sqrt(values @ values))
    return (values / length if length else values).tolist()


def hash_embedding(text: Column, dimension: int = EMBEDDING_DIMENSION) -> Column:
    """Deterministic bag-of-tokens embedding as ARRAY<FLOAT>.

    Tokens are taken in the JVM. A batch hashes each of its distinct tokens once and adds all
    weights up in one pass over the token codes.
    """

    @F.arrow_udf("array<float>")
    def embed(tokens: pa.Array) -> pa.Array:
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        slots, weights = _token_slots(coded.dictionary.to_pylist(), dimension)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cells = np.repeat(np.arange(len(tokens)) * dimension, sizes) + slots[code]
        matrix = np.bincount(cells, weights=weights[code], minlength=len(tokens) * dimension).astype(np.float64).reshape(-1, dimension)
        matrix /= norms(matrix)[:, None]
        offsets = np.arange(0, (len(tokens) + 1) * dimension, dimension, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel().astype(np.float32)))

    return embed(T.embedding_tokens(text))


def to_literal(vector: Column) -> Column:
    """``[a,b,c]`` with eight decimals, the exchange form of a vector column."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def from_literal(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def space_id(model: str, dimension: int, revision: str = "v1") -> str:
    return f"{model}:{dimension}:{revision}"


def batch_limit(dimension: int, available_bytes: int | None, bytes_per_value: int = 4, safety: float = 4.0) -> int:
    """Rows per Arrow batch that fit a memory budget; set ``maxRecordsPerBatch`` from it."""
    if not available_bytes or available_bytes <= 0:
        return 1
    return max(1, available_bytes // max(1, int(dimension * bytes_per_value * safety)))
