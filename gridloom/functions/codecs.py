"""Binary forms that other stores of the same data keep, as columns (Arrow batches)."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.operators.series import varint_decode, varint_encode


def _pack(deltas: pd.Series) -> pd.Series:
    return deltas.map(lambda d: None if d is None else varint_encode([int(x) for x in d]))


def _unpack(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else varint_decode(bytes(b)))


def _floats(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def _vector(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(_whole(bytes(b)), "<f4"))


def _whole(data: bytes) -> bytes:
    if len(data) % 4:
        raise ValueError("bytes of a vector must be a multiple of four")
    return data


def pack_deltas(c: Column) -> Column:
    """Deltas as groups of 7 bits with a sign byte each; null stays null."""
    return F.pandas_udf(_pack, "binary")(c)


def unpack_deltas(c: Column) -> Column:
    return F.pandas_udf(_unpack, "array<bigint>")(c)


def pack_vector(c: Column) -> Column:
    """A vector as little-endian float32; null stays null."""
    return F.pandas_udf(_floats, "binary")(c)


def unpack_vector(c: Column) -> Column:
    """The way back; a length that is no multiple of four raises."""
    return F.pandas_udf(_vector, "array<float>")(c)
