"""Lazy typed expressions over tensors, compiled to one projection.

A tensor is a frame with a row for each index of dimension 0 (``i``, ``tile``,
``v``); trailing dimensions are a row-major array in ``v``. An expression compiles
to a function from a flat trailing index to a column, so a whole tree becomes one
scalar expression (rank 1, or one element a row) or one array per row; operands of
different frames are joined on ``i``, one-row operands are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..shape import Dims, DistributedShape, strides
from ..types import BOOL, DType, convert, from_value, infer_binary, infer_clamp, infer_select, infer_unary
from .placement import tile_of

if TYPE_CHECKING:
    from .tensor import Tensor

Index = int | Column
At = Callable[[Index], Column]
UNROLL = 8  # rows of up to so many elements are written out; longer ones use a transform


class Expression:
    dtype: DType
    shape: DistributedShape

    def children(self) -> tuple[Expression, ...]:
        return ()

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        """Given the column of each leaf: from a flat trailing index to the value's column."""
        raise NotImplementedError

    # Operators are added below from the tables of names.
    def cast(self, to: DType) -> Expression:
        return Cast(self, to)

    def broadcast(self, shape: DistributedShape | Dims) -> Expression:
        return Broadcast(self, shape if isinstance(shape, DistributedShape) else DistributedShape(tuple(shape)))

    def permute(self, *order: int) -> Expression:
        return Permute(self, order)

    def clamp(self, low: object, high: object) -> Expression:
        return Clamp(self, wrap(low), wrap(high))

    def select(self, a: object, b: object) -> Expression:
        return Select(self, wrap(a), wrap(b))

    def element(self, flat: int) -> Expression:
        """One element of every row, by its flat place among the trailing dimensions."""
        return Element(self, flat)

    def dot(self, other: Expression) -> Expression:
        return Dot(self, other)

    def cross(self, other: Expression) -> Expression:
        return Cross(self, other)

    def leaves(self) -> list[Leaf]:
        out: dict[int, Leaf] = {}
        todo: list[Expression] = [self]
        while todo:
            e = todo.pop()
            if isinstance(e, Leaf):
                out.setdefault(id(e.tensor), e)
            todo += e.children()
        return list(out.values())

    def lazy(self, name: str = "") -> Tensor:
        """The expression as a tensor that is not yet computed."""
        from .tensor import Tensor

        return Tensor(compiled(self), self.shape, self.dtype, name)

    def materialize(self, name: str = "") -> Tensor:
        return self.lazy(name).materialize()

    def materialize_if_necessary(self) -> Tensor:
        return self.materialize()

    def reduce(self, dim: int = 0, op: str = "add") -> Tensor:
        return self.lazy().reduce(dim, op)

    def norm(self, kind: str = "L2") -> Tensor:
        return self.lazy().norm(kind)


class Leaf(Expression):
    def __init__(self, tensor: Tensor):
        self.tensor, self.dtype, self.shape = tensor, tensor.dtype, tensor.shape

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        col, is_array = cols[id(self.tensor)]
        if not is_array:
            return lambda k: col
        return lambda k: F.get(col, k if isinstance(k, Column) else F.lit(k))


class Constant(Expression):
    """A scalar, or a list of one row's values with a trailing shape."""

    def __init__(self, value: object, dtype: DType | None = None, dims: Dims = (1,)):
        self.values = list(value) if isinstance(value, (list, tuple)) else [value]
        self.dtype = dtype or from_value(self.values[0])
        if prod(dims) != len(self.values):
            raise ValueError(f"{len(self.values)} values for shape {dims}")
        if len(dims) > 1 and dims[0] != 1:
            raise ValueError("a constant has one row")
        self.shape = DistributedShape(tuple(dims))

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        items = [F.lit(v).cast(self.dtype.spark) for v in self.values]
        if self.shape.rank == 1 and len(items) > 1:
            raise ValueError("a constant list needs a trailing shape")
        if len(items) == 1:
            return lambda k: items[0]
        return lambda k: F.get(F.array(*items), k) if isinstance(k, Column) else items[k]


def wrap(value: object, near: DType | None = None) -> Expression:
    from .tensor import Tensor

    if isinstance(value, Expression):
        return value
    if isinstance(value, Tensor):
        return Leaf(value)
    if near is not None and near.is_float and isinstance(value, float):
        return Constant(value, near)
    return Constant(value)


def _trailing(shape: DistributedShape, out: DistributedShape) -> Callable[[Index], Index]:
    """From a flat trailing index of a broadcast shape to that of one operand."""
    inner, outer = shape.dims[1:], out.dims[1:]
    if shape.rank < out.rank and shape.elements > 1:
        inner = shape.dims[-(out.rank - 1) :] if shape.rank == out.rank else (1,) * (out.rank - 1 - shape.rank) + shape.dims
    inner = (1,) * (len(outer) - len(inner)) + tuple(inner)
    if inner == outer:
        return lambda k: k
    if prod(inner) == 1:
        return lambda k: 0
    steps = [(so, do, si) for so, do, si, di in zip(strides(outer), outer, strides(inner), inner, strict=True) if di > 1]

    def place(k: Index) -> Index:
        total: Index = 0
        for so, do, si in steps:
            digit = F.floor(k / so).cast("int") % do if isinstance(k, Column) else k // so % do
            total = digit * si + total
        return total

    return place


class _Node(Expression):
    def __init__(self, *args: Expression):
        self.args = args

    def children(self) -> tuple[Expression, ...]:
        return self.args

    def _meet(self) -> DistributedShape:
        shape = self.args[0].shape
        for a in self.args[1:]:
            both = shape.broadcast(a.shape)
            if both is None:
                raise ValueError(f"shapes {shape} and {a.shape} do not go together")
            shape = both
        return shape

    def _parts(self, cols: dict[int, tuple[Column, bool]]) -> list[At]:
        parts = []
        for a in self.args:
            get, place = a.at(cols), _trailing(a.shape, self.shape)
            parts.append(lambda k, get=get, place=place: get(place(k)))
        return parts


class Unary(_Node):
    def __init__(self, op: str, x: Expression):
        super().__init__(x)
        self.op, self.dtype, self.shape = op, infer_unary(op, x.dtype), x.shape

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        get = self.args[0].at(cols)
        return lambda k: ew.unary(self.op, get(k), self.args[0].dtype)[0]


class Binary(_Node):
    def __init__(self, op: str, a: Expression, b: Expression):
        super().__init__(a, b)
        self.op, self.dtype, self.shape = op, infer_binary(op, a.dtype, b.dtype), self._meet()

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        a, b = self._parts(cols)
        return lambda k: ew.binary(self.op, a(k), self.args[0].dtype, b(k), self.args[1].dtype)[0]


class Cast(_Node):
    def __init__(self, x: Expression, to: DType):
        super().__init__(x)
        self.dtype, self.shape = to, x.shape

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        get = self.args[0].at(cols)
        return lambda k: convert(get(k), self.args[0].dtype, self.dtype)


class Broadcast(_Node):
    def __init__(self, x: Expression, shape: DistributedShape):
        super().__init__(x)
        both = x.shape.broadcast(shape)
        if x.shape.rank > shape.rank or both is None or both.dims != shape.dims:
            raise ValueError(f"{x.shape} cannot become {shape}")
        self.dtype, self.shape = x.dtype, shape

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        return self._parts(cols)[0]


class Permute(_Node):
    """Trailing dimensions in another order; dimension 0 stays."""

    def __init__(self, x: Expression, order: tuple[int, ...]):
        super().__init__(x)
        if sorted(order) != list(range(x.shape.rank)):
            raise ValueError(f"{order} is no order of {x.shape.rank} dimensions")
        if order[0] != 0:
            raise ValueError("dimension 0 cannot be permuted")
        self.order = order
        self.dtype, self.shape = x.dtype, x.shape.with_trailing(tuple(x.shape.dims[d] for d in order[1:]))

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        get = self.args[0].at(cols)
        inner = strides(self.args[0].shape.dims[1:])
        outer, dims = strides(self.shape.dims[1:]), self.shape.dims[1:]

        def place(k: Index) -> Index:
            total: Index = 0
            for d, (so, n) in enumerate(zip(outer, dims, strict=True)):
                digit = F.floor(k / so).cast("int") % n if isinstance(k, Column) else k // so % n
                total = digit * inner[self.order[d + 1] - 1] + total
            return total

        return lambda k: get(place(k))


class Clamp(_Node):
    def __init__(self, x: Expression, low: Expression, high: Expression):
        super().__init__(x, low, high)
        self.dtype, self.shape = infer_clamp(x.dtype, low.dtype, high.dtype), self._meet()

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        x, low, high = self._parts(cols)
        t = [a.dtype for a in self.args]
        return lambda k: ew.clamp(x(k), t[0], low(k), t[1], high(k), t[2])[0]


class Select(_Node):
    def __init__(self, condition: Expression, a: Expression, b: Expression):
        super().__init__(condition, a, b)
        self.dtype, self.shape = infer_select(condition.dtype, a.dtype, b.dtype), self._meet()

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        c, a, b = self._parts(cols)
        t = [x.dtype for x in self.args]
        return lambda k: ew.select(c(k), BOOL, a(k), t[1], b(k), t[2])[0]


class Element(_Node):
    """A subscript: rank 1, one element a row."""

    def __init__(self, x: Expression, flat: int):
        super().__init__(x)
        if not 0 <= flat < x.shape.row_size:
            raise IndexError(f"no element {flat} in rows of {x.shape.row_size}")
        self.flat, self.dtype, self.shape = flat, x.dtype, x.shape.with_trailing(())

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        get = self.args[0].at(cols)
        return lambda _: get(self.flat)


def _rows_of_two(a: Expression, b: Expression, size: int | None) -> None:
    if a.shape.rank != 2 or b.shape.rank != 2 or a.shape.dims[1] != b.shape.dims[1] or a.shape.dims[1] < 2:
        raise ValueError(f"row products need two (n, k) operands, not {a.shape} and {b.shape}")
    if size and a.shape.dims[1] != size:
        raise ValueError(f"cross products need rows of {size}")


class Dot(_Node):
    """Row-wise dot products, (n, k) and (n, k) to (n, 1)."""

    def __init__(self, a: Expression, b: Expression):
        super().__init__(wrap(a), wrap(b))
        _rows_of_two(*self.args, None)
        self.dtype = infer_binary("dot_product", self.args[0].dtype, self.args[1].dtype)
        self.width, self.shape = self.args[0].shape.dims[1], self._meet().with_trailing((1,))

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        a, b = (x.at(cols) for x in self.args)
        ta, tb = (x.dtype for x in self.args)

        def product(k: Index) -> Column:
            return ew.binary("multiply", a(k), ta, b(k), tb)[0]

        if self.width <= UNROLL:
            total = product(0)
            for k in range(1, self.width):
                total = ew.binary("add", total, self.dtype, product(k), self.dtype)[0]
            return lambda _: total.cast(self.dtype.spark)
        zero = F.lit(0).cast("double" if self.dtype.is_float else self.dtype.spark)
        add = (lambda s, k: s + product(k).cast("double")) if self.dtype.is_float else (lambda s, k: ew.binary("add", s, self.dtype, product(k), self.dtype)[0])
        return lambda _: F.aggregate(F.sequence(F.lit(0), F.lit(self.width - 1)), zero, add).cast(self.dtype.spark)


class Cross(_Node):
    """Row-wise cross products of (n, 3) operands."""

    def __init__(self, a: Expression, b: Expression):
        super().__init__(wrap(a), wrap(b))
        _rows_of_two(*self.args, 3)
        self.dtype, self.shape = infer_binary("cross_product", self.args[0].dtype, self.args[1].dtype), self._meet()

    def at(self, cols: dict[int, tuple[Column, bool]]) -> At:
        a, b = (x.at(cols) for x in self.args)
        ta, tb = (x.dtype for x in self.args)

        def element(k: int) -> Column:
            p, q = (k + 1) % 3, (k + 2) % 3
            left, right = ew.binary("multiply", a(p), ta, b(q), tb)[0], ew.binary("multiply", a(q), ta, b(p), tb)[0]
            return ew.binary("subtract", left, self.dtype, right, self.dtype)[0]

        parts = [element(k) for k in range(3)]
        return lambda k: F.get(F.array(*parts), k) if isinstance(k, Column) else parts[k]


def compiled(e: Expression) -> DataFrame:
    """The expression's rows (i, tile, v): one projection over its joined leaves."""
    frame, cols = _joined(e)
    get = e.at(cols)
    width = e.shape.row_size
    if e.shape.rank == 1:
        value = get(0).cast(e.dtype.spark)
    elif width <= UNROLL:
        value = F.array(*[get(k).cast(e.dtype.spark) for k in range(width)])
    else:
        value = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: get(k).cast(e.dtype.spark))
    return frame.select("i", "tile", value.alias("v"))


def _joined(e: Expression) -> tuple[DataFrame, dict[int, tuple[Column, bool]]]:
    """Leaves side by side: full ones joined on i (or seen to be one frame), one-row ones broadcast."""
    n, full, single = e.shape.dims[0], [], []
    for leaf in e.leaves():
        t = leaf.tensor
        # A lower rank stands for trailing dimensions, and so for one row.
        (full if t.shape.dims[0] == n and (t.shape.rank == e.shape.rank or n == 1 or not _as_row(t, e)) else single).append(t)
    cols: dict[int, tuple[Column, bool]] = {}
    frame = None
    by_frame: dict[int, list] = {}
    for t in full:
        by_frame.setdefault(id(t.df), []).append(t)
    for k, group in enumerate(by_frame.values()):
        part = group[0].df
        for t in group:
            cols[id(t)] = (F.col(t.value_col.replace("v", f"v{k}", 1)), t.is_array)
        part = part.select("i", *(["tile"] if frame is None else []), F.col("v").alias(f"v{k}"))
        frame = part if frame is None else frame.join(part, "i")
    for k, t in enumerate(single):
        row = t.df.select(F.col("v").alias(f"s{k}")) if t.shape.dims[0] == 1 else t.as_row().select(F.col("v").alias(f"s{k}"))
        cols[id(t)] = (F.col(f"s{k}"), t.is_array or t.shape.dims[0] > 1)
        frame = row.select(F.lit(0).cast("bigint").alias("i"), F.lit(0).alias("tile"), f"s{k}") if frame is None else frame.crossJoin(F.broadcast(row))
    if frame is None:
        from pyspark.sql import SparkSession

        frame = SparkSession.getActiveSession().range(1).select(F.col("id").alias("i"), F.lit(0).alias("tile"))
    have = max([1, *(t.shape.dims[0] for t in full)])
    if n > have:  # only one-row operands, spread over all rows
        spread = frame.sparkSession.range(n).select(F.col("id").alias("i"), tile_of(F.col("id"), e.shape).alias("tile"))
        frame = spread.crossJoin(F.broadcast(frame.drop("i", "tile")))
    return frame, cols


def _as_row(t: Tensor, e: Expression) -> bool:
    return t.shape.rank < e.shape.rank


for _op in ew.UNARY:
    setattr(Expression, _op, lambda self, _op=_op: Unary(_op, self))
for _op in ew.BINARY:
    setattr(Expression, _op, lambda self, other, _op=_op: Binary(_op, self, wrap(other)))
#: Fixed correspondence of Python's symbols.
_SYMBOLS = {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "mod": "remainder", "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor", "lshift": "shift_left", "rshift": "shift_right", "pow": "power"}
for _s, _op in _SYMBOLS.items():
    setattr(Expression, f"__{_s}__", lambda self, other, _op=_op: Binary(_op, self, wrap(other)))
    setattr(Expression, f"__r{_s}__", lambda self, other, _op=_op: Binary(_op, wrap(other), self))
for _s, _op in {"lt": "less_than", "le": "less_than_equal", "gt": "greater_than", "ge": "greater_than_equal", "eq": "equal", "ne": "not_equal"}.items():
    setattr(Expression, f"__{_s}__", lambda self, other, _op=_op: Binary(_op, self, wrap(other)))
Expression.__hash__ = object.__hash__
Expression.__neg__ = lambda self: Unary("negate", self)
Expression.__invert__ = lambda self: Unary("logical_not" if self.dtype == BOOL else "bitwise_not", self)
Expression.__abs__ = lambda self: Unary("absolute", self)
