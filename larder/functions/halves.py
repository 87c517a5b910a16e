"""Vectors of 16-bit floats in a binary column: half the bytes, exact ranks all the same.

Little-endian IEEE 754 halves, one after the other. Rounding changes a component by at most 2^-11 of itself (below
2^-14 by at most 2^-25), so the product with a unit vector moves by at most ERROR times the rounded vector's length.
A coarse ranking by halves that keeps everything within twice that of the k-th place holds all of the exact k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import cosine_similarity

#: Most that a cosine can move by, with some room for components below 2^-14 and for sums in single precision.
ERROR = 2.0**-10


def _to_half(vectors: pa.Array) -> pa.Array:
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = whole.flatten()
    if flat.null_count:
        raise ValueError("a vector has a null component")
    data = flat.to_numpy(zero_copy_only=False).astype("<f2")
    if not np.isfinite(data).all():
        raise ValueError("a component is beyond what 16 bits hold")
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(whole).to_pylist()], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    held = whole.is_valid().to_pylist()
    return pa.array([data[a:b].tobytes() if ok else None for a, b, ok in zip(at, at[1:], held, strict=False)], pa.binary())


def _from_half(halves: pa.Array) -> pa.Array:
    return pa.array([None if h is None else np.frombuffer(h, "<f2").astype(np.float32) for h in halves.to_pylist()], pa.list_(pa.float32()))


def to_half(vector: Column) -> Column:
    """array<float> as halves; null stays null, a null or too large component is an error."""
    return F.arrow_udf(_to_half, "binary")(vector.cast("array<float>"))


def from_half(halves: Column) -> Column:
    """array<float> from halves; null stays null."""
    return F.arrow_udf(_from_half, "array<float>")(halves)


def _coarse(query: np.ndarray):
    unit = query / (np.linalg.norm(query) + 1e-30)

    def run(halves: pa.Array) -> pa.Array:
        out = []
        for h in halves.to_pylist():
            v = None if h is None else np.frombuffer(h, "<f2").astype(np.float64)
            length = 0.0 if v is None else float(np.linalg.norm(v))
            out.append(None if not length else float(v @ unit) / length)
        return pa.array(out, pa.float64())

    return run


def top_k_halves(halves: DataFrame, vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", half_col: str = "half", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of vectors by exact cosine, ties by id: rows (id_col, similarity).

    All rows of halves (id_col, half_col) are scored; only those within the rounding's bound of the k-th are looked up
    in vectors (id_col, vector_col) and compared exactly. Null and zero vectors are never found; ids are unique.
    """
    asked = np.array(query, np.float64)
    scored = halves.select(id_col, F.arrow_udf(_coarse(asked), "double")(half_col).alias("coarse")).where("coarse is not null")
    least = scored.orderBy(F.desc("coarse")).limit(k).agg(F.min("coarse")).first()[0]
    if least is None:
        return vectors.select(id_col, F.lit(0.0).alias("similarity")).limit(0)
    able = scored.where(F.col("coarse") >= least - 2 * ERROR).select(id_col)
    exact = cosine_similarity(F.col(vector_col), F.array(*[F.lit(float(x)) for x in asked]))
    found = vectors.join(able, id_col, "left_semi").select(id_col, exact.alias("similarity"))
    return found.orderBy(F.desc("similarity"), id_col).limit(k)
