"""Queries of the elementwise operators over parts."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..types import BOOL, FLOAT32, FLOAT64, INT8, INT32, INT64, UINT8, DType
from .tables import part_vector

#: Inputs: their Spark expression, type and SQL.
INPUTS: dict[str, tuple[str, DType, str]] = {
    "x": ("(p_retailprice - 1500.0D) / 400.0D", FLOAT64, "((p_retailprice - 1500.0::DOUBLE) / 400.0::DOUBLE)"),
    "y": ("(p_size - 25) / 7.0D", FLOAT64, "((p_size - 25) / 7.0::DOUBLE)"),
    "unit": ("(p_size - 25) / 26.0D", FLOAT64, "((p_size - 25) / 26.0::DOUBLE)"),
    "positive": ("p_retailprice / 400.0D", FLOAT64, "(p_retailprice / 400.0::DOUBLE)"),
    "k": ("cast(p_size - 25 as int)", INT32, "(p_size - 25)::INTEGER"),
    "m": ("cast(p_partkey % 5 + 1 as int)", INT32, "(p_partkey % 5 + 1)::INTEGER"),
    "flag": ("p_size > 25", BOOL, "(p_size > 25)"),
    "flag2": ("p_partkey % 3 = 0", BOOL, "(p_partkey % 3 = 0)"),
    "special": (
        "case p_size % 5 when 0 then double('NaN') when 1 then double('Infinity') when 2 then -double('Infinity') else p_retailprice end",
        FLOAT64,
        "(CASE p_size % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE p_retailprice END)",
    ),
}


def _erf_sql(x: str) -> str:
    """The error function as SQL: series up to 3, continued fraction beyond."""
    a = f"abs({x})"
    series = "1.0::DOUBLE"
    for n in range(48, 0, -1):
        series = f"(1.0::DOUBLE + {2.0 / (2 * n + 1)!r}::DOUBLE * s * {series})"
    fraction = "1.0::DOUBLE"
    for n in range(30, 0, -1):
        fraction = f"(1.0::DOUBLE + {n / 2}::DOUBLE / (s * {fraction}))"
    near = f"{2 / math.sqrt(math.pi)!r}::DOUBLE * a * exp(-s) * {series}"
    far = f"1.0::DOUBLE - exp(-s) / (a * {math.sqrt(math.pi)!r}::DOUBLE * {fraction})"
    return f"(SELECT sign(z) * CASE WHEN a <= 3 THEN {near} WHEN a >= 6 THEN 1.0::DOUBLE ELSE {far} END FROM (SELECT {x} AS z, {a} AS a, {x} * {x} AS s))"


#: operator: (input, SQL of it)
UNARY: dict[str, tuple[str, str]] = {
    "absolute": ("x", "abs({0})"),
    "asin": ("unit", "asin({0})"),
    "bitwise_not": ("k", "~{0}"),
    "cbrt": ("x", "cbrt({0})"),
    "ceil": ("x", "ceil({0})"),
    "cos": ("x", "cos({0})"),
    "count_leading_zeros": ("k", "(CASE WHEN {0} = 0 THEN 32 WHEN {0} < 0 THEN 0 ELSE 32 - length(bin({0})) END)::INTEGER"),
    "erf": ("x", "erf"),
    "exponent": ("x", "exp({0})"),
    "exponent_minus_one": ("x", "exp({0}) - 1"),
    "exponent2": ("x", "pow(2.0::DOUBLE, {0})"),
    "floor": ("x", "floor({0})"),
    "gelu_erf": ("x", "gelu"),
    "inverse": ("positive", "1 / {0}"),
    "is_finite": ("special", "isfinite({0})"),
    "is_inf": ("special", "isinf({0})"),
    "is_nan": ("special", "isnan({0})"),
    "logarithm": ("positive", "ln({0})"),
    "logarithm_one_plus": ("positive", "ln(1 + {0})"),
    "logical_not": ("flag", "NOT {0}"),
    "negate": ("k", "-{0}"),
    "nearby_int": ("y", "round_even({0}, 0)"),
    "popcount": ("k", "bit_count({0})::INTEGER"),
    "relu": ("x", "greatest({0}, 0)"),
    "signum": ("x", "sign({0})::DOUBLE"),
    "sin": ("x", "sin({0})"),
    "tan": ("unit", "tan({0})"),
    "tanh": ("x", "tanh({0})"),
    "round": ("y", "round({0})"),
    "sqrt": ("positive", "sqrt({0})"),
    "square": ("x", "{0} * {0}"),
    "sigmoid": ("x", "1 / (1 + exp(-{0}))"),
    "rsqrt": ("positive", "1 / sqrt({0})"),
    "trunc": ("y", "trunc({0})"),
}

#: operator: (inputs, SQL of them)
BINARY: dict[str, tuple[str, str, str]] = {
    "add": ("x", "y", "{0} + {1}"),
    "atan2": ("x", "y", "atan2({0}, {1})"),
    "bitwise_and": ("k", "m", "{0} & {1}"),
    "bitwise_or": ("k", "m", "{0} | {1}"),
    "bitwise_xor": ("k", "m", "xor({0}, {1})"),
    "bitwise_xnor": ("k", "m", "~xor({0}, {1})"),
    "divide": ("k", "m", "({0} // {1})::INTEGER"),
    "equal": ("k", "m", "{0} = {1}"),
    "greater_than_equal": ("x", "y", "{0} >= {1}"),
    "greater_than": ("x", "y", "{0} > {1}"),
    "less_than_equal": ("x", "y", "{0} <= {1}"),
    "logical_and": ("flag", "flag2", "{0} AND {1}"),
    "logical_or": ("flag", "flag2", "{0} OR {1}"),
    "less_than": ("x", "y", "{0} < {1}"),
    "maximum": ("x", "y", "greatest({0}, {1})"),
    "minimum": ("x", "y", "least({0}, {1})"),
    "multiply": ("x", "y", "{0} * {1}"),
    "not_equal": ("k", "m", "{0} <> {1}"),
    "power": ("positive", "y", "pow({0}, {1})"),
    "remainder": ("k", "m", "({0} % {1})::INTEGER"),
    "shift_left": ("m", "m", "({0} << {1})::INTEGER"),
    "shift_right": ("k", "m", "({0} >> {1})::INTEGER"),
    "subtract": ("x", "y", "{0} - {1}"),
}


def _shown(df: DataFrame) -> DataFrame:
    v = F.round("v", 6) + F.lit(0.0) if dict(df.dtypes)["v"] in ("double", "float") else F.col("v")
    return df.select("i", v.alias("v"))


def _sql(value: str, is_float: bool) -> str:
    return f"SELECT p_partkey AS i, {f'round({value}, 6) + 0.0::DOUBLE' if is_float else value} AS v FROM part"


def _input(spark: SparkSession, sf_dir: str, name: str):
    expression, dtype, _ = INPUTS[name]
    return part_vector(spark, sf_dir, F.expr(expression), dtype)


def _pair(spark: SparkSession, sf_dir: str, a: str, b: str):
    """Two tensors over one frame: between them no join is needed."""
    part = part_vector(spark, sf_dir, F.struct(F.expr(INPUTS[a][0]).alias("a"), F.expr(INPUTS[b][0]).alias("b")), INPUTS[a][1])
    return part.field("a", INPUTS[a][1]), part.field("b", INPUTS[b][1])


def _unary(op: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(getattr(_input(spark, sf_dir, UNARY[op][0]), op)().lazy().df)


def _binary(op: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = BINARY[op]
    left, right = _pair(spark, sf_dir, a, b)
    return _shown(getattr(left, op)(right).lazy().df)


def _divide_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark, sf_dir, "x", "positive")
    return _shown((a / b).lazy().df)


def _clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_input(spark, sf_dir, "x").clamp(-0.5, 0.5).cast(FLOAT64).lazy().df)


def _select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_input(spark, sf_dir, "flag").select(_input(spark, sf_dir, "x"), _input(spark, sf_dir, "y")).lazy().df)


def _cast(name: str, to: DType, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_input(spark, sf_dir, name).cast(to).lazy().df)


def _wrap(to: DType, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(part_vector(spark, sf_dir, F.expr("cast(p_partkey * 37 as bigint)"), INT64).cast(to).lazy().df)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One projection for a whole tree: sigmoid(2 x + y) * max(x, y) - |y|."""
    x, y = _pair(spark, sf_dir, "x", "y")
    e = (x * 2 + y).sigmoid() * x.maximum(y) - y.absolute()
    return _shown(e.lazy().df)


QUERIES = (
    {f"unary_{op}": partial(_unary, op) for op in UNARY}
    | {f"binary_{op}": partial(_binary, op) for op in BINARY}
    | {
        "binary_divide_float": _divide_float,
        "clamp": _clamp,
        "select": _select,
        "cast_float_to_int": partial(_cast, "x", INT32),
        "cast_int_to_float": partial(_cast, "k", FLOAT32),
        "cast_int_to_bool": partial(_cast, "k", BOOL),
        "cast_wrap_int8": partial(_wrap, INT8),
        "cast_wrap_uint8": partial(_wrap, UINT8),
        "fused_expression": _fused,
    }
)


def _unary_sql(op: str) -> str:
    name, sql = UNARY[op]
    x, t = INPUTS[name][2], INPUTS[name][1]
    if sql == "erf":
        sql = _erf_sql(x)
    elif sql == "gelu":
        sql = f"0.5::DOUBLE * {x} * (1 + {_erf_sql(f'({x} / {math.sqrt(2.0)!r}::DOUBLE)')})"
    else:
        sql = sql.format(x)
    return _sql(sql, t.is_float and not op.startswith("is_"))


def _binary_sql(op: str) -> str:
    a, b, sql = BINARY[op]
    value = sql.format(INPUTS[a][2], INPUTS[b][2])
    return _sql(value, INPUTS[a][1].is_float and op not in ("greater_than_equal", "greater_than", "less_than_equal", "less_than"))


_X, _Y = INPUTS["x"][2], INPUTS["y"][2]
ORACLE = (
    {f"unary_{op}": _unary_sql(op) for op in UNARY}
    | {f"binary_{op}": _binary_sql(op) for op in BINARY}
    | {
        "binary_divide_float": _sql(f"{_X} / {INPUTS['positive'][2]}", True),
        "clamp": _sql(f"least(greatest({_X}, -0.5::DOUBLE), 0.5::DOUBLE)", True),
        "select": _sql(f"CASE WHEN {INPUTS['flag'][2]} THEN {_X} ELSE {_Y} END", True),
        "cast_float_to_int": _sql(f"trunc({_X})::INTEGER", False),
        "cast_int_to_float": f"SELECT p_partkey AS i, round(({INPUTS['k'][2]})::DOUBLE, 6) AS v FROM part",
        "cast_int_to_bool": _sql(f"{INPUTS['k'][2]} <> 0", False),
        "cast_wrap_int8": _sql("((p_partkey * 37 + 128) % 256 - 128)::TINYINT", False),
        "cast_wrap_uint8": _sql("((p_partkey * 37) % 256)::SMALLINT", False),
        "fused_expression": _sql(f"(1 / (1 + exp(-({_X} * 2 + {_Y})))) * greatest({_X}, {_Y}) - abs({_Y})", True),
    }
)
assert set(UNARY) == set(ew.UNARY) and set(BINARY) == set(ew.BINARY)
