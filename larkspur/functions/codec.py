"""Packed float32 vectors at the import and export boundary (little-endian)."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur import errors as E


def pack_one(vector) -> bytes:
    return struct.pack(f"<{len(vector)}f", *vector)


def is_legacy(blob: bytes, strict_reference: bool = False) -> bool:
    """Whether a blob is a JSON list. The strict form looks at the first byte alone, as older stores did."""
    if blob[:1] != b"[":
        return False
    if strict_reference:
        return True
    try:
        return blob.rstrip()[-1:] == b"]" and isinstance(json.loads(blob), list)
    except ValueError:
        return False


def unpack_one(blob: bytes, strict_reference: bool = False) -> list[float]:
    if is_legacy(blob, strict_reference):
        raise E.EngineError("vector is stored as JSON", E.CODEC_LEGACY)
    if len(blob) % 4:
        raise E.EngineError("packed vector's length is no multiple of 4", E.CODEC_LENGTH)
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))


def repack_one(blob: bytes) -> bytes:
    try:
        values = json.loads(blob)
    except ValueError as e:
        raise E.EngineError("bad JSON", E.LEGACY_JSON) from e
    if not isinstance(values, list) or not values:
        raise E.EngineError("empty or no list", E.LEGACY_SHAPE)
    if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        raise E.EngineError("an element is no number", E.LEGACY_NUMBER)
    return pack_one(values)


@F.arrow_udf(T.BinaryType())
def pack(vectors: pa.Array) -> pa.Array:
    """One copy of the floats of a batch; each vector is a slice of it."""
    flat = pc.fill_null(vectors.flatten().cast(pa.float32()), float("nan")).to_numpy(zero_copy_only=False).astype("<f4")
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
    return pc.if_else(vectors.is_valid(), packed, pa.scalar(None, pa.binary()))


def _attempt(f, blob):
    if blob is None:
        return None, None
    try:
        return f(bytes(blob)), None
    except E.EngineError as e:
        return None, e.code


_UNPACKED = pa.struct([("vector", pa.list_(pa.float32())), ("error", pa.int64())])


@F.arrow_udf(T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.LongType())]))
def unpack(blobs: pa.Array) -> pa.Array:
    """Blobs of whole floats that don't begin like JSON are read in one piece; the others one by one."""
    length = pc.fill_null(pc.binary_length(blobs), 0).to_numpy().astype(np.int64)
    odd = (length % 4 != 0) | pc.fill_null(pc.starts_with(blobs, "["), False).to_numpy(zero_copy_only=False)
    errors: list[int | None] = [None] * len(blobs)
    for i in np.flatnonzero(odd).tolist():
        errors[i] = _attempt(unpack_one, blobs[i].as_py())[1]
    bad = np.array([e is not None for e in errors], bool)
    good = pc.if_else(pa.array(bad), pa.scalar(b""), pc.fill_null(blobs, b""))
    flat = np.frombuffer(b"".join(good.to_pylist()), "<f4")
    ends = np.concatenate([[0], np.cumsum(np.where(bad, 0, length) // 4)]).astype(np.int32)
    vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()))
    known = blobs.is_valid().to_numpy(zero_copy_only=False) & ~bad
    vectors = pc.if_else(pa.array(known), vectors, pa.scalar(None, vectors.type))
    return pa.StructArray.from_arrays([vectors, pa.array(errors, pa.int64())], fields=list(_UNPACKED))


@F.pandas_udf(T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("error", T.LongType())]))
def repack(blobs: pd.Series) -> pd.DataFrame:
    got = [_attempt(repack_one, b) for b in blobs]
    return pd.DataFrame({"blob": [v for v, _ in got], "error": pd.array([e for _, e in got], dtype="Int64")})
