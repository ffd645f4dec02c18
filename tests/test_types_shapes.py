import pytest

from sparktile import types as T
from sparktile.shape import DistributedShape, VectorMap, broadcast_dims, compatible, coordinate, scale_up, simplify, strides, to_devices


def test_type_properties():
    assert T.INT32.is_integer and T.INT32.is_signed and T.INT32.size == 4
    assert T.UINT32.is_integer and not T.UINT32.is_signed
    assert T.FLOAT32.is_float and T.FLOAT32.size == 4
    assert not T.BOOL.is_integer and not T.BOOL.is_float and T.BOOL.size == 1
    assert T.VOID.size == 0
    assert [T.parse_type(t.name) for t in T.ALL] == list(T.ALL)
    with pytest.raises(ValueError):
        T.parse_type("float128")
    assert T.smallest_uint(255) == T.UINT8 and T.smallest_uint(256) == T.UINT16 and T.smallest_uint(1 << 20) == T.UINT32


@pytest.mark.parametrize(
    ("op", "a", "b", "to"),
    [
        ("add", T.INT64, T.FLOAT32, T.FLOAT32),
        ("add", T.INT32, T.UINT32, T.UINT32),
        ("multiply", T.FLOAT32, T.FLOAT64, T.FLOAT64),
        ("divide", T.INT8, T.INT32, T.INT32),
        ("add", T.TWOFLOAT32, T.FLOAT32, T.TWOFLOAT32),
        ("bitwise_and", T.UINT8, T.INT16, T.INT16),
        ("less_than", T.INT8, T.FLOAT64, T.BOOL),
        ("maximum", T.INT32, T.FLOAT32, T.FLOAT32),
    ],
)
def test_binary_types(op, a, b, to):
    assert T.infer_binary(op, a, b) == to


@pytest.mark.parametrize(("op", "a", "b"), [("add", T.BOOL, T.INT32), ("bitwise_or", T.FLOAT32, T.INT32), ("less_than", T.TWOFLOAT32, T.FLOAT32), ("add", T.TWOFLOAT32, T.FLOAT64)])
def test_binary_type_errors(op, a, b):
    with pytest.raises(TypeError):
        T.infer_binary(op, a, b)


def test_unary_types():
    assert T.infer_unary("sqrt", T.INT64) == T.INT64
    assert T.infer_unary("sqrt", T.INT32) == T.FLOAT32
    assert T.infer_unary("ceil", T.FLOAT64) == T.FLOAT64
    assert T.infer_unary("is_nan", T.FLOAT32) == T.BOOL
    with pytest.raises(TypeError):
        T.infer_unary("popcount", T.FLOAT32)


def test_shapes():
    s = DistributedShape.scalar(3)
    assert s.rank == 1 and s.elements == 1 and s.rows.keys() == [3]
    s = DistributedShape.on_single_tile((4, 3, 2), 5)
    assert s.elements_on(5) == 24 and s.elements_on(4) == 0
    s = DistributedShape.on_tiles((6, 3, 2), {0: 2, 1: 4})
    assert (s.elements_on(0), s.elements_on(1)) == (12, 24)
    with pytest.raises(ValueError):
        DistributedShape.on_tiles((4, 2), {0: 2, 1: 1})
    with pytest.raises(ValueError):
        DistributedShape.on_tiles((0, 2), {})
    assert DistributedShape((2, 3)).push_back(4).elements == 24
    s = DistributedShape.from_mapping((4, 3, 2), {0: [(0, 12)], 1: [(12, 24)]})
    assert (s.elements_on(0), s.elements_on(1)) == (12, 12)
    s = DistributedShape.on_tiles((4, 2), {0: 1, 1: 1, 2: 1, 3: 1})
    assert s.group(2).rows == VectorMap({0: 2, 2: 2}) and s.group(1) == s
    assert str(DistributedShape((2, 3, 4))) == "2x3x4"
    assert DistributedShape((4, 3, 2)).strides() == (6, 2, 1)
    assert DistributedShape.linear((7, 3, 2), 3).rows.values() == [2, 2, 3]
    assert DistributedShape((2, 3)) != DistributedShape((3, 2))
    assert DistributedShape.on_tiles((2, 3), {0: 2}) != DistributedShape.on_tiles((2, 3), {0: 1, 1: 1})


def test_broadcasting():
    assert DistributedShape((2, 3)).broadcast(DistributedShape((2, 3))).dims == (2, 3)
    assert DistributedShape((1, 4)).broadcast(DistributedShape((2, 3, 4))).dims == (2, 3, 4)
    assert DistributedShape.scalar().broadcast(DistributedShape((3, 2))).dims == (3, 2)
    assert DistributedShape((10,)).broadcast(DistributedShape((1, 3))) is None
    # Rows dealt differently are moved rather than refused.
    assert DistributedShape.on_tiles((2, 3), {0: 2}).broadcast(DistributedShape.on_tiles((2, 3), {0: 1, 1: 1})).dims == (2, 3)
    assert broadcast_dims((3, 1), (1, 4)) == (3, 4)


def test_mappings():
    assert strides((2, 3, 4)) == (12, 4, 1) and coordinate(17, (2, 3, 4)) == (1, 1, 1)
    assert simplify([(4, 6), (0, 2), (2, 3), (5, 5)]) == [(0, 3), (4, 6)]
    assert scale_up({1: [(0, 2)]}, 3) == {1: [(0, 6)]}
    assert to_devices({0: [(0, 2)], 1: [(2, 4)], 5: [(4, 6)]}, 4) == {0: [(0, 4)], 1: [(4, 6)]}
    assert compatible({0: [(0, 2)], 1: [(2, 4)]}, 4) and not compatible({0: [(0, 2)], 1: [(3, 4)]}, 4)


def test_vector_map():
    m = VectorMap({3: 5, 1: 0, 2: 4})
    assert m.keys() == [2, 3] and m[1] == 0 and m[99] == 0 and len(m) == 2
    assert m.at(3) == 5 and m.min_key() == 2 and m.max_key() == 3 and m.count(1) == 0 and 2 in m
    with pytest.raises(KeyError):
        m.at(1)
    m[2] = 0
    assert 2 not in m and m == VectorMap({3: 5})
    assert m.map(lambda v: v * 2) == VectorMap({3: 10})
    m.erase(3)
    assert len(m) == 0
    m[7] = 1
    m.clear()
    assert list(m) == []
    with pytest.raises(IndexError):
        m[-1] = 2
