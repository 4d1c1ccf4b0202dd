"""Stored element types, their numpy and Spark counterparts, and exact type checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..errors import TypeMismatchError, UnsupportedError
from ..fmt.messages import ENUM, FIXED, FLOAT, STRING, VARIABLE, Datatype

#: Spark types of the ten element types.  Unsigned ones take the next wider signed type; u64 the exact decimal.
SPARK = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "f32": "float", "f64": "double"}
ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def numpy_type(t: Datatype) -> np.dtype:
    order = ">" if t.big_endian else "<"
    if t.cls in (FIXED, ENUM) and t.size in (1, 2, 4, 8):
        return np.dtype(f"{order}{'i' if t.signed and t.cls == FIXED else 'u'}{t.size}")
    if t.cls == FLOAT and t.size in (4, 8):
        return np.dtype(f"{order}f{t.size}")
    raise UnsupportedError(f"reading {t.describe()} as numbers")


def name_of(t: Datatype) -> str:
    """One of the ten names; an enumeration goes by its base as an unsigned number."""
    n = numpy_type(t)
    return f"{n.kind}{8 * n.itemsize}"


def check(t: Datatype, wanted: str) -> None:
    """The wanted element type must be the stored one in class, sign and size."""
    if wanted not in SPARK:
        raise TypeMismatchError(f"unknown element type {wanted}")
    if t.cls not in (FIXED, FLOAT) or t.describe() != wanted:
        raise TypeMismatchError(f"asked for {wanted}, stored as {t.describe()}")


def spark_type(t: Datatype, u64: str = "decimal", enum: str = "int") -> str:
    if t.cls in (STRING, VARIABLE):
        return "string"
    if t.cls == ENUM:
        if enum == "boolean":
            return "boolean"
        if enum == "strict":
            raise TypeMismatchError("an enumeration has no number type of its own")
    name = name_of(t)
    return "bigint" if name == "u64" and u64 == "bigint" else SPARK[name]


def to_arrow(values: np.ndarray, spark: str) -> pa.Array:
    """A flat numpy array in the column type; native byte order first."""
    if values.dtype.byteorder == ">":
        values = values.astype(values.dtype.newbyteorder("="))
    if spark == "boolean":
        return pa.array(values != 0)
    if spark == "decimal(20,0)":
        return pa.array(values).cast(pa.decimal128(20, 0))
    if spark == "bigint" and values.dtype == np.uint64:
        return pa.array(values.view(np.int64))
    return pa.array(np.ascontiguousarray(values)).cast(ARROW[spark])
