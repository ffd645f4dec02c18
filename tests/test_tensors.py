import math

import numpy as np
import pytest

from sparktile import types as T
from sparktile.functions.elementwise import BINARY, UNARY
from sparktile.operators import control, kernel
from sparktile.operators.expression import Constant
from sparktile.operators.tensor import Tensor
from sparktile.shape import DistributedShape
from sparktile.sources.host import HostTensor, PrintFormat, RemoteTensor, copy_to_host, format_tensor


def values(e):
    t = e if isinstance(e, Tensor) else e.lazy()
    return HostTensor.of(t).values


def f32(spark, rows):
    return Tensor.from_numpy(spark, np.array(rows, np.float32))


def test_remote_round_trip(spark):
    t = Tensor.iota(spark, DistributedShape.linear((8, 2), 4))
    host = HostTensor.of(t)
    back = RemoteTensor.of(host.to_tensor(spark)).to_tile()
    seen = []
    copy_to_host(back, seen.append)
    assert (seen[0].values == np.arange(16).reshape(8, 2)).all()
    assert seen[0].get(3, 1) == 7 and seen[0].at_flat_index(7) == 7
    with pytest.raises(IndexError):
        seen[0].get(3)


def test_print(spark):
    t = Tensor.iota(spark, DistributedShape.linear((8, 2), 4))
    rows = [f"  [{2 * k}, {2 * k + 1}]" for k in range(8)]
    assert format_tensor(t, "tensor", PrintFormat(8)) == "tensor<8x2xfloat> tensor = [\n" + "\n".join(rows) + "\n]\n"
    short = [*rows[:2], "  ...", *rows[6:]]
    assert format_tensor(t, "tensor", PrintFormat(5, 0, "fixed", 2)) == "tensor<8x2xfloat> tensor = [\n" + "\n".join(short) + "\n]\n"
    t = Tensor.iota(spark, DistributedShape.linear((3, 3), 2))
    assert format_tensor(t, "tensor", PrintFormat(2, 0, "fixed", 1)) == "tensor<3x3xfloat> tensor = [\n  [0, ..., 2]\n  ...\n  [6, ..., 8]\n]\n"
    with pytest.raises(ValueError):
        PrintFormat(2, 0, "fixed", 2)


def test_reductions(spark):
    t = Tensor.iota(spark, DistributedShape.linear((8, 2), 4))
    assert values(t.reduce(0)).tolist() == [[56, 64]]
    far = Tensor.iota(spark, DistributedShape.on_tiles((8, 2), {0: 2, 1000: 2, 1472: 2, 2472: 2}))
    assert values(far.reduce(0)).tolist() == [[56, 64]]
    assert values(far.reduce_grouped(1472)).tolist() == [[12, 16], [44, 48]]
    t = Tensor.iota(spark, DistributedShape.linear((8, 8), 4))
    assert values(t.reduce(1)).ravel().tolist() == [28, 92, 156, 220, 284, 348, 412, 476]
    with pytest.raises(ValueError):
        t.reduce(2)
    with pytest.raises(ValueError):
        t.reduce(0, "median")
    one = Tensor.with_initial_value(spark, 3.0, DistributedShape.scalar())
    assert one.reduce(0, "square_add").scalar() == 9.0 and one.norm("L2").scalar() == 3.0
    v = f32(spark, [1, -2, 3])
    assert [v.norm(k).scalar() for k in ("L1", "LINF")] == [6.0, 3.0]
    assert v.norm("L2").scalar() == pytest.approx(math.sqrt(14))
    with pytest.raises(ValueError):
        v.norm("None")


def test_row_products(spark):
    assert values(f32(spark, [[1, 2, 3], [4, 5, 6]]).dot(f32(spark, [[2, 3, 4], [1, 2, 1]]))).ravel().tolist() == [20, 20]
    assert values(f32(spark, [[1, 0, 0], [0, 1, 0]]).cross(f32(spark, [[0, 1, 0], [0, 0, 1]]))).tolist() == [[0, 0, 1], [1, 0, 0]]
    a, b, c = f32(spark, [[1, 2, 3], [2, 3, 4]]), f32(spark, [[4, 5, 6], [1, 2, 1]]), f32(spark, [[0.5, 1.5, 2.5], [3, 1, 2]])
    assert values((a.cross(b) + 2.0 * c).dot(a - b)).ravel().tolist() == [-27, 20]
    a, b = f32(spark, [[1, 2, 3], [4, 5, 6]]), f32(spark, [[11, 12, 13], [14, 15, 16]])
    assert values(a.cross(b).dot(a)).ravel().tolist() == [0, 0]
    assert values(f32(spark, [[1, 2, 3], [2, 3, 4], [3, 4, 5], [4, 5, 6]]).square().reduce(1)).ravel().tolist() == [14, 29, 50, 77]
    with pytest.raises(ValueError):
        a.cross(f32(spark, [[1, 2], [3, 4]]))


def test_arithmetic_and_broadcast(spark):
    x, y = f32(spark, [[1, 2, 3], [4, 5, 6]]), f32(spark, [[10, 20, 30], [40, 50, 60]])
    assert values(x + y).ravel().tolist() == [11, 22, 33, 44, 55, 66]
    assert values(f32(spark, [[100, 200, 300]]) + x).ravel().tolist() == [101, 202, 303, 104, 205, 306]
    assert values(y + x - 2.0 * x).ravel().tolist() == [9, 18, 27, 36, 45, 54]
    outer = f32(spark, [[1], [2], [3]]) * f32(spark, [[1, 2, 3]])
    assert values(outer).tolist() == [[1, 2, 3], [2, 4, 6], [3, 6, 9]]
    assert values(f32(spark, [10, 20, 30]) + x).tolist() == [[11, 22, 33], [14, 25, 36]]  # a lower rank stands beside every row
    assert values(x + Constant([1.0, 2.0, 3.0], T.FLOAT32, (1, 3))).tolist() == [[2, 4, 6], [5, 7, 9]]
    with pytest.raises(ValueError):
        x + f32(spark, [[1, 2]])
    with pytest.raises(ValueError):
        x.permute(1, 0)


def test_permute_cast_assign(spark):
    cube = np.arange(2 * 3 * 4, dtype=np.float32).reshape(2, 3, 4)
    t = Tensor.from_numpy(spark, cube)
    assert (values(t.permute(0, 2, 1)) == cube.transpose(0, 2, 1)).all()
    assert (values(t.reduce(1, "max")) == cube.max(1, keepdims=True)).all()
    assert (values(t.reduce(2)) == cube.sum(2, keepdims=True)).all()
    x = Tensor.from_numpy(spark, np.array([-3.9, 3.9, 300.0, -129.0]))
    assert values(x.cast(T.INT8)).tolist() == [-3, 3, 44, 127]
    into = Tensor.uninitialised(spark, DistributedShape((4,)), T.INT32)
    assert values(into.assign(x)).tolist() == [-3, 3, 300, -129]
    with pytest.raises(ValueError):
        Tensor.uninitialised(spark, DistributedShape((4,)), mapping={0: [(0, 3)]})
    u = Tensor.from_numpy(spark, np.array([1.0 + 2.0**-30, 2.0]), dtype=T.TWOFLOAT32).unroll()
    assert u.shape.dims == (2, 2) and values(u)[0].sum(dtype=np.float64) == 1.0 + 2.0**-30


def test_ieee_edges(spark):
    x = Tensor.from_numpy(spark, np.array([-2.5, -0.5, -0.0, 0.0, 2.5, np.nan, np.inf]))
    assert values(x.inverse())[:5].tolist() == [-0.4, -2.0, -np.inf, np.inf, 0.4]
    assert np.isnan(values(x.logarithm())[:2]).all() and values(x.logarithm())[3] == -np.inf
    assert values(x.equal(x)).tolist() == [True] * 5 + [False, True]
    assert values(x.greater_than(0.0)).tolist() == [False] * 4 + [True, False, True]
    assert values(x.round())[[0, 1, 4]].tolist() == [-3, -1, 3]
    assert values(x.nearby_int())[[0, 1, 4]].tolist() == [-2, 0, 2]
    assert values(x.erf())[4] == pytest.approx(math.erf(2.5), abs=1e-15)
    assert np.isnan(values((x * 0.0) / 0.0)).all()


@pytest.mark.parametrize("name", ["int8", "uint8", "int16", "uint16", "int32", "uint32", "int64"])
def test_integers_wrap(spark, name):
    kind = np.dtype(name)
    limits = np.iinfo(kind)
    a = np.array([limits.min, limits.max, 5, 7, limits.max // 3], kind)
    b = np.array([limits.max, limits.max, 3, 2, limits.max], kind)
    both = Tensor.from_numpy(spark, a), Tensor.from_numpy(spark, b)
    with np.errstate(all="ignore"):
        for op, f in (("add", np.add), ("subtract", np.subtract), ("multiply", np.multiply), ("bitwise_and", np.bitwise_and), ("bitwise_xor", np.bitwise_xor), ("remainder", np.fmod), ("maximum", np.maximum)):
            assert values(getattr(both[0], op)(both[1])).tolist() == f(a, b).tolist(), op
        for op, f in (("absolute", np.abs), ("negate", np.negative), ("bitwise_not", np.invert), ("square", np.square)):
            assert values(getattr(both[0], op)()).tolist() == f(a).tolist(), op
    assert values(both[0].divide(both[1]))[2:4].tolist() == [1, 3]
    assert values(both[0].count_leading_zeros())[2] == kind.itemsize * 8 - 3
    assert values(both[0].popcount())[1] == bin(limits.max).count("1")


def test_every_operator_compiles(spark):
    x = Tensor.from_numpy(spark, np.array([[0.25, 0.5], [0.75, 1.0]]))
    k = Tensor.from_numpy(spark, np.array([[1, 2], [3, 4]], np.int32))
    for op in UNARY:
        source = k if op in ("bitwise_not", "count_leading_zeros", "popcount") else x
        assert values(getattr(source, op)()).shape == (2, 2)
    for op in BINARY:
        source = k if op.startswith(("bitwise", "shift", "remainder")) else x
        assert values(getattr(source, op)(source)).shape == (2, 2)
    low, high = np.float32(0.3), np.float32(0.6)
    assert np.allclose(values(x.clamp(0.3, 0.6)).ravel(), [low, 0.5, high, high])
    assert values((x > 0.5).select(x, -x)).ravel().tolist() == [-0.25, -0.5, 0.75, 1.0]


def test_fused_into_one_projection(spark):
    """A tree over one frame is scanned once, without joins, shuffles or Python."""
    df = spark.range(100).selectExpr("id", "struct(id * 1.0D as a, id * 2.0D as b) as s")
    t = Tensor.from_dataframe(df, "s", "id", (100,), 1, T.FLOAT64)
    e = (t.field("a", T.FLOAT64) * 2.0 + t.field("b", T.FLOAT64)).sigmoid()
    plan = e.lazy().df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_kernels_and_control(spark):
    t = Tensor.iota(spark, DistributedShape.linear((10,), 2), T.FLOAT64)
    out = kernel.execute(lambda x, by: {"y": x - x.min() + by}, x=kernel.In(t), by=kernel.Member(1.0), y=kernel.Out(T.FLOAT64))["y"]
    assert values(out).tolist() == [1, 2, 3, 4, 5] * 2
    out = kernel.execute_threaded(lambda x, worker: {"x": x * 0 + worker}, x=kernel.InOut(t))["x"]
    assert values(out).tolist() == [k % 6 for k in range(10)]
    bits = kernel.reinterpret(Tensor.from_numpy(spark, np.array([1.0], np.float32)), T.INT32)
    assert values(bits).tolist() == [0x3F800000]
    end = control.while_(lambda s: s["x"].reduce(0, "max") < 20.0, lambda s: {"x": s["x"] * 2.0}, {"x": t})
    assert values(end["x"]).max() == 36
    assert values(control.repeat(2, lambda s: {"x": s["x"] + 1.0}, {"x": t})["x"])[0] == 2
    with pytest.raises(TypeError):
        control.if_(t.reduce(0), lambda: 1)
    assert control.timed(lambda: t + 1.0)[1] > 0
