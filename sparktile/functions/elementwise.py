"""The 34 unary and 25 binary operators, clamp and select, as typed columns.

Every function takes columns with their element types and gives a column of the
inferred type with C and IEEE semantics (wrapping integers, truncating division,
infinities and NaN from float division and logarithms, NaN-aware comparison),
whatever the session's ANSI setting. Integer division by zero, undefined in C,
gives null. All run inside generated JVM code.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, FLOAT32, FLOAT64, INT64, UINT64, DType, convert, infer_binary, infer_clamp, infer_select, infer_unary, larger_type, wrap

Unary = Callable[[Column, DType], Column]

NAN, INF = float("nan"), float("inf")


def _double(x: Column) -> Column:
    return x.cast("double")


def ieee_div(a: Column, b: Column) -> Column:
    """Float division with infinities and NaN in place of errors and nulls."""
    sign = F.when(b.cast("string").startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, sign * F.lit(INF)).otherwise(sign * F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def _log(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.log(x))


def _log1p(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < -1), F.lit(NAN)).when(x == -1, F.lit(-INF)).otherwise(F.log1p(x))


def _whole(x: Column, rounded: Column) -> Column:
    """Large, infinite and NaN floats are whole already."""
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(2.0**52)), x).otherwise(rounded.cast("double"))


def erf(x: Column) -> Column:
    """The error function: its all-positive series up to 3, a continued fraction of erfc beyond."""
    x = _double(x)
    a = F.abs(x)
    square = a * a
    series = F.lit(1.0)
    for n in range(48, 0, -1):
        series = F.lit(1.0) + F.lit(2.0 / (2 * n + 1)) * square * series
    near = F.lit(2 / math.sqrt(math.pi)) * a * F.exp(-square) * series
    fraction = F.lit(1.0)
    for n in range(30, 0, -1):
        fraction = F.lit(1.0) + F.lit(n / 2) / (square * fraction)
    far = F.lit(1.0) - F.exp(-square) / (a * F.lit(math.sqrt(math.pi)) * fraction)
    value = F.when(F.isnan(x), F.lit(NAN)).when(a <= 3, near).when(a >= 6, F.lit(1.0)).otherwise(far)
    return F.when(x < 0, -value).otherwise(value)


def _pattern(x: Column, t: DType) -> Column:
    """An integer's bits as a bigint (a 64-bit unsigned one in two's complement)."""
    return wrap(x, INT64) if t == UINT64 else x.cast("bigint")


def _from_pattern(x: Column, t: DType) -> Column:
    return x if t == INT64 else wrap(x, t)


def _low_bits(x: Column, t: DType) -> Column:
    return _pattern(x, t) if t.bits == 64 else _pattern(x, t).bitwiseAND(F.lit((1 << t.bits) - 1))


def _clz(x: Column, t: DType) -> Column:
    bits = _low_bits(x, t)
    return F.when(bits == 0, F.lit(t.bits)).when(bits < 0, F.lit(0)).otherwise(F.lit(t.bits) - F.length(F.bin(bits))).cast(t.spark)


def _negative(x: Column, t: DType) -> Column:
    if t.is_float:
        return -x
    return wrap(F.lit(0) - x.cast("decimal(38,0)" if t.bits == 64 else "bigint"), t)


def _integer_same(x: Column, t: DType, float_form: Column) -> Column:
    return float_form.cast(t.spark) if t.is_float else x


def _as_float(form: Callable[[Column], Column]) -> Unary:
    """Computed in double, then brought to the inferred type."""

    def run(x: Column, t: DType) -> Column:
        to = larger_type(FLOAT32, t)
        return convert(form(_double(x)), FLOAT64, to)

    return run


UNARY: dict[str, Unary] = {
    "absolute": lambda x, t: F.abs(x) if t.is_float else F.when(x < 0, _negative(x, t)).otherwise(x),
    "asin": _as_float(F.asin),
    "bitwise_not": lambda x, t: _from_pattern(F.bitwise_not(_pattern(x, t)), t),
    "cbrt": _as_float(F.cbrt),
    "ceil": lambda x, t: _integer_same(x, t, _whole(_double(x), F.ceil(_double(x)))),
    "cos": _as_float(F.cos),
    "count_leading_zeros": _clz,
    "erf": _as_float(erf),
    "exponent": _as_float(F.exp),
    "exponent_minus_one": _as_float(F.expm1),
    "exponent2": _as_float(lambda x: F.pow(F.lit(2.0), x)),
    "floor": lambda x, t: _integer_same(x, t, _whole(_double(x), F.floor(_double(x)))),
    "gelu_erf": _as_float(lambda x: F.lit(0.5) * x * (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0))))),
    "inverse": _as_float(lambda x: ieee_div(F.lit(1.0), x)),
    "is_finite": lambda x, t: (~F.isnan(_double(x)) & (F.abs(_double(x)) != F.lit(INF))) if t.is_float else x.isNotNull(),
    "is_inf": lambda x, t: (F.abs(_double(x)) == F.lit(INF)) if t.is_float else x.isNull(),
    "is_nan": lambda x, t: F.isnan(_double(x)) if t.is_float else x.isNull(),
    "logarithm": _as_float(_log),
    "logarithm_one_plus": _as_float(_log1p),
    "logical_not": lambda x, t: ~convert(x, t, BOOL),
    "negate": _negative,
    "nearby_int": lambda x, t: _integer_same(x, t, F.rint(_double(x))),
    "popcount": lambda x, t: F.bit_count(_low_bits(x, t)).cast(t.spark),
    "relu": lambda x, t: F.when(x < F.lit(0), F.lit(0).cast(t.spark)).otherwise(x),
    "signum": lambda x, t: F.signum(_double(x)).cast(t.spark),
    "sin": _as_float(F.sin),
    "tan": _as_float(F.tan),
    "tanh": _as_float(F.tanh),
    "round": lambda x, t: _integer_same(x, t, _whole(_double(x), F.when(x < 0, -F.floor(F.abs(_double(x)) + 0.5)).otherwise(F.floor(_double(x) + 0.5)))),
    "sqrt": _as_float(F.sqrt),
    "square": lambda x, t: x * x if t.is_float else _multiply(x, x, t),
    "sigmoid": _as_float(lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))),
    "rsqrt": _as_float(lambda x: ieee_div(F.lit(1.0), F.sqrt(x))),
    "trunc": lambda x, t: _integer_same(x, t, _whole(_double(x), F.when(x < 0, F.ceil(_double(x))).otherwise(F.floor(_double(x))))),
}


def unary(op: str, x: Column, t: DType) -> tuple[Column, DType]:
    to = infer_unary(op, t)
    return UNARY[op](x, t), to


def _plus(a: Column, b: Column, t: DType, sign: int) -> Column:
    if t.bits < 64:
        a, b = a.cast("bigint"), b.cast("bigint")
        return wrap(a + b if sign > 0 else a - b, t)
    wide_a, wide_b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    wide = wrap(wide_a + wide_b if sign > 0 else wide_a - wide_b, t)
    if t == UINT64:
        return wide
    return F.coalesce(F.try_add(a, b) if sign > 0 else F.try_subtract(a, b), wide)


def _multiply(a: Column, b: Column, t: DType) -> Column:
    if t.bits < 32 or (t.bits == 32 and t.kind == "int"):
        return wrap(a.cast("bigint") * b.cast("bigint"), t)
    if t.bits == 32:
        return wrap(F.pmod(a.cast("decimal(38,0)") * b.cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)")), t)
    # 64 bits: the second factor in halves, so that no product passes 38 digits.
    half = F.lit(1 << 32).cast("decimal(38,0)")
    x, y = _unsigned64(a), _unsigned64(b)
    low = F.pmod(y, half)
    high = F.floor((y - low) / half).cast("decimal(38,0)")  # exact: a rounded quotient could pass a whole number
    part = F.pmod(F.pmod(x, half) * high, half)  # the rest of x * high leaves 64 bits
    wide = wrap((x * low).cast("decimal(38,0)") + (part * half).cast("decimal(38,0)"), t)
    return wide if t == UINT64 else F.coalesce(F.try_multiply(a, b), wide)


def _unsigned64(x: Column) -> Column:
    return F.pmod(x.cast("decimal(38,0)"), F.expr("cast(18446744073709551616 as decimal(38,0))"))


def _integer_div(a: Column, b: Column, t: DType) -> Column:
    if t == UINT64:
        return F.when(b == 0, None).otherwise(((a - a % b) / b).cast(t.spark))
    quotient = F.call_function("div", a.cast("bigint"), F.when(b != 0, b.cast("bigint")))
    return quotient if t == INT64 else wrap(quotient, t)


def _shift(name: str) -> Callable[[Column, Column, DType], Column]:
    def run(a: Column, b: Column, t: DType) -> Column:
        count = F.pmod(b.cast("bigint"), F.lit(t.bits)).cast("int")
        return _from_pattern(F.call_function("shiftrightunsigned" if t == UINT64 and name == "shiftright" else name, _pattern(a, t), count), t)

    return run


def _bits(method: str) -> Callable[[Column, Column, DType], Column]:
    return lambda a, b, t: _from_pattern(getattr(_pattern(a, t), method)(_pattern(b, t)), t)


def less(a: Column, b: Column, t: DType) -> Column:
    return ((a < b) & ~F.isnan(b)) if t.is_float else a < b


def _floats(t: DType, test: Column, *others: Column) -> Column:
    for x in others if t.is_float else ():
        test = test & ~F.isnan(x)
    return test


BINARY: dict[str, Callable[[Column, Column, DType], Column]] = {
    "add": lambda a, b, t: a + b if t.is_float else _plus(a, b, t, 1),
    "atan2": lambda a, b, t: convert(F.atan2(_double(a), _double(b)), FLOAT64, t),
    "bitwise_and": _bits("bitwiseAND"),
    "bitwise_or": _bits("bitwiseOR"),
    "bitwise_xor": _bits("bitwiseXOR"),
    "bitwise_xnor": lambda a, b, t: _from_pattern(F.bitwise_not(_pattern(a, t).bitwiseXOR(_pattern(b, t))), t),
    "divide": lambda a, b, t: ieee_div(_double(a), _double(b)).cast(t.spark) if t.is_float else _integer_div(a, b, t),
    "equal": lambda a, b, t: _floats(t, a == b, a),
    "greater_than_equal": lambda a, b, t: _floats(t, a >= b, a, b),
    "greater_than": lambda a, b, t: _floats(t, a > b, a),
    "less_than_equal": lambda a, b, t: _floats(t, a <= b, b),
    "logical_and": lambda a, b, t: convert(a, t, BOOL) & convert(b, t, BOOL),
    "logical_or": lambda a, b, t: convert(a, t, BOOL) | convert(b, t, BOOL),
    "less_than": less,
    "maximum": lambda a, b, t: F.when(less(a, b, t), b).otherwise(a),
    "minimum": lambda a, b, t: F.when(less(b, a, t), b).otherwise(a),
    "multiply": lambda a, b, t: a * b if t.is_float else _multiply(a, b, t),
    "not_equal": lambda a, b, t: ((a != b) | F.isnan(a)) if t.is_float else a != b,
    "power": lambda a, b, t: convert(F.pow(_double(a), _double(b)), FLOAT64, t),
    "remainder": lambda a, b, t: a % F.when(b != 0, b),
    "shift_left": _shift("shiftleft"),
    "shift_right": _shift("shiftright"),
    "subtract": lambda a, b, t: a - b if t.is_float else _plus(a, b, t, -1),
}
#: Row-wise products of rank-2 operands, which the expression layer compiles.
ROW_PRODUCTS = ("dot_product", "cross_product")


def _common(op: str, a: DType, b: DType, to: DType) -> DType:
    """The type in which both operands meet."""
    if op in ("logical_and", "logical_or"):
        return BOOL
    if to != BOOL:
        return to
    if BOOL in (a, b):
        return b if a == BOOL else a
    return a if a.is_float and not b.is_float else b if b.is_float and not a.is_float else larger_type(a, b)


def binary(op: str, a: Column, ta: DType, b: Column, tb: DType) -> tuple[Column, DType]:
    to = infer_binary(op, ta, tb)
    common = _common(op, ta, tb, to)
    if op in ("shift_left", "shift_right"):
        return BINARY[op](convert(a, ta, to), b, to), to
    return BINARY[op](convert(a, ta, common), convert(b, tb, common), common), to


def clamp(x: Column, tx: DType, low: Column, tl: DType, high: Column, th: DType) -> tuple[Column, DType]:
    to = infer_clamp(tx, tl, th)
    x, low, high = convert(x, tx, to), convert(low, tl, to), convert(high, th, to)
    return BINARY["minimum"](BINARY["maximum"](x, low, to), high, to), to


def select(condition: Column, tc: DType, a: Column, ta: DType, b: Column, tb: DType) -> tuple[Column, DType]:
    to = infer_select(tc, ta, tb)
    return F.when(condition, convert(a, ta, to)).otherwise(convert(b, tb, to)), to
