"""Element types, their promotion, and C-like conversion between them as columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DType:
    name: str
    size: int
    kind: str  # bool, int, uint, float or void
    spark: str
    label: str  # as printed

    @property
    def is_integer(self) -> bool:
        return self.kind in ("int", "uint")

    @property
    def is_float(self) -> bool:
        return self.kind == "float"

    @property
    def is_signed(self) -> bool:
        return self.kind in ("int", "float")

    @property
    def bits(self) -> int:
        return 8 * self.size

    def numpy(self) -> np.dtype:
        return np.dtype({"bool": "bool", "twofloat32": "float64"}.get(self.name, self.name))

    def __repr__(self) -> str:
        return self.name


BOOL = DType("bool", 1, "bool", "boolean", "bool")
FLOAT16 = DType("float16", 2, "float", "float", "half")
FLOAT32 = DType("float32", 4, "float", "float", "float")
FLOAT64 = DType("float64", 8, "float", "double", "double")
#: Two float32 as one number: 53 bits of a double hold its 48.
TWOFLOAT32 = DType("twofloat32", 8, "float", "double", "::twofloat::two<float>")
INT8 = DType("int8", 1, "int", "tinyint", "signed char")
INT16 = DType("int16", 2, "int", "smallint", "short")
INT32 = DType("int32", 4, "int", "int", "int")
INT64 = DType("int64", 8, "int", "bigint", "long long")
UINT8 = DType("uint8", 1, "uint", "smallint", "unsigned char")
UINT16 = DType("uint16", 2, "uint", "int", "unsigned short")
UINT32 = DType("uint32", 4, "uint", "bigint", "unsigned int")
UINT64 = DType("uint64", 8, "uint", "decimal(20,0)", "unsigned long long")
VOID = DType("void", 0, "void", "void", "void")

ALL = (BOOL, FLOAT16, FLOAT32, FLOAT64, TWOFLOAT32, INT8, UINT8, INT16, UINT16, INT32, UINT32, INT64, UINT64, VOID)
_BY_NAME = {t.name: t for t in ALL}
_FROM_SPARK = {"boolean": BOOL, "float": FLOAT32, "double": FLOAT64, "tinyint": INT8, "smallint": INT16, "int": INT32, "bigint": INT64}


def parse_type(name: str) -> DType:
    if name not in _BY_NAME:
        raise ValueError(f"unknown type {name!r}")
    return _BY_NAME[name]


def from_spark(simple: str) -> DType:
    """The element type of a Spark type, also inside an array."""
    simple = simple.removeprefix("array<").removesuffix(">")
    if simple not in _FROM_SPARK:
        raise TypeError(f"no element type for {simple}")
    return _FROM_SPARK[simple]


def from_value(value: object) -> DType:
    if isinstance(value, (bool, np.bool_)):
        return BOOL
    if isinstance(value, np.generic):
        return parse_type(value.dtype.name)
    if isinstance(value, int):
        return INT32 if -(1 << 31) <= value < 1 << 31 else INT64
    if isinstance(value, float):
        return FLOAT32
    raise TypeError(f"no element type for {type(value).__name__}")


def smallest_uint(maximum: int) -> DType:
    """The narrowest unsigned type that holds indices up to ``maximum``."""
    for t in (UINT8, UINT16, UINT32, UINT64):
        if maximum < 1 << t.bits:
            return t
    raise OverflowError(maximum)


def larger_type(a: DType, b: DType) -> DType:
    """More bytes win; at equal size a float, then an unsigned type."""
    if a.size != b.size:
        return a if a.size > b.size else b
    if a.is_float != b.is_float:
        return a if a.is_float else b
    if a.is_signed != b.is_signed:
        return b if a.is_signed else a
    return a


ARITHMETIC = {"add", "subtract", "multiply", "divide", "remainder"}
BITWISE = {"bitwise_and", "bitwise_or", "bitwise_xor", "bitwise_xnor", "shift_left", "shift_right"}
COMPARE = {"equal", "not_equal", "greater_than", "greater_than_equal", "less_than", "less_than_equal", "logical_and", "logical_or"}
LARGER = {"power", "atan2", "maximum", "minimum", "dot_product", "cross_product"}

SAME = {"absolute", "negate", "square", "ceil", "floor", "round", "trunc", "nearby_int", "relu", "signum"}
AT_LEAST_FLOAT = {"asin", "cbrt", "cos", "erf", "exponent", "exponent_minus_one", "exponent2", "gelu_erf", "inverse", "logarithm", "logarithm_one_plus", "sin", "tan", "tanh", "sqrt", "sigmoid", "rsqrt"}
INTEGER_ONLY = {"bitwise_not", "count_leading_zeros", "popcount"}
TO_BOOL = {"logical_not", "is_finite", "is_inf", "is_nan"}


def infer_binary(op: str, a: DType, b: DType) -> DType:
    if TWOFLOAT32 in (a, b):
        other = b if a == TWOFLOAT32 else a
        if op not in ARITHMETIC - {"remainder"} or other not in (FLOAT32, TWOFLOAT32):
            raise TypeError(f"{op} of {a} and {b}")
        return TWOFLOAT32
    if op in ARITHMETIC:
        if BOOL in (a, b):
            raise TypeError(f"{op} of {a} and {b}")
        if a.is_float != b.is_float:
            return a if a.is_float else b
        return larger_type(a, b)
    if op in BITWISE:
        if not (a.is_integer and b.is_integer):
            raise TypeError(f"{op} of {a} and {b}")
        return larger_type(a, b)
    if op in COMPARE:
        return BOOL
    if op in LARGER:
        return larger_type(a, b)
    raise ValueError(f"unknown operator {op}")


def infer_unary(op: str, a: DType) -> DType:
    if op in SAME:
        return a
    if op in AT_LEAST_FLOAT:
        return larger_type(FLOAT32, a)
    if op in INTEGER_ONLY:
        if not a.is_integer:
            raise TypeError(f"{op} of {a}")
        return a
    if op in TO_BOOL:
        return BOOL
    raise ValueError(f"unknown operator {op}")


def infer_clamp(x: DType, low: DType, high: DType) -> DType:
    return larger_type(larger_type(x, low), high)


def infer_select(condition: DType, a: DType, b: DType) -> DType:
    if condition != BOOL:
        raise TypeError(f"select needs a bool condition, not {condition}")
    return larger_type(a, b)




def wrap(col: Column, to: DType) -> Column:
    """An integer column (bigint or decimal) reduced modulo 2^bits into a type's range."""
    if to.bits < 64:
        x = col.cast("decimal(38,0)") if to.name == "uint64" else col.cast("bigint")
        span, half = 1 << to.bits, 1 << (to.bits - 1)
        if to.kind == "uint":
            return F.pmod(x, F.lit(span)).cast(to.spark)
        return (F.pmod(x + F.lit(half), F.lit(span)) - F.lit(half)).cast(to.spark)
    x = col.cast("decimal(38,0)")
    span = F.expr("cast(18446744073709551616 as decimal(38,0))")
    if to.kind == "uint":
        return F.pmod(x, span).cast(to.spark)
    half = F.expr("cast(9223372036854775808 as decimal(38,0))")
    return (F.pmod(x + half, span) - half).cast(to.spark)


def convert(col: Column, source: DType, to: DType) -> Column:
    """A C cast: floats lose their fraction toward zero, integers wrap, all but zero is true."""
    if source == to:
        return col
    if to == BOOL:
        return col != F.lit(0)
    if source == BOOL:
        return col.cast("int").cast(to.spark)
    if to.is_float:
        return col.cast(to.spark)
    if source.is_float:
        whole = F.when(col < 0, F.ceil(col.cast("double"))).otherwise(F.floor(col.cast("double")))
        if to.bits == 64:
            # Beyond the range the result is the nearest end, as for Spark's own casts without ANSI.
            top, low = ((1 << 64) - 1, 0) if to.kind == "uint" else ((1 << 63) - 1, -(1 << 63))
            inside = (col.cast("double") < F.lit(float(top))) & (col.cast("double") > F.lit(float(low)))
            safe = F.when(inside, col.cast("double")).otherwise(F.lit(0.0))
            return F.when(inside, safe.cast("decimal(38,0)" if to.kind == "uint" else "bigint")).when(col.cast("double") >= F.lit(float(top)), F.lit(top).cast("decimal(38,0)") if to.kind == "uint" else F.lit(top)).otherwise(F.lit(low)).cast(to.spark)
        return wrap(whole, to)
    if source.bits < to.bits and (source.kind == "uint" or to.kind == "int"):
        return col.cast(to.spark)
    return wrap(col, to)
