"""Shapes, their distribution over tiles, and broadcasting."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from math import prod


class VectorMap:
    """A tile-indexed map in which the default value means absent."""

    def __init__(self, items: Mapping[int, int] | None = None, default: int = 0):
        self.default, self._at = default, {}
        for k, v in (items or {}).items():
            self[k] = v

    def __getitem__(self, key: int) -> int:
        return self._at.get(key, self.default)

    def __setitem__(self, key: int, value: int) -> None:
        if key < 0:
            raise IndexError(key)
        if value == self.default:
            self._at.pop(key, None)
        else:
            self._at[key] = value

    def at(self, key: int) -> int:
        if key not in self._at:
            raise KeyError(key)
        return self._at[key]

    def map(self, function) -> VectorMap:
        return VectorMap({k: function(v) for k, v in self.items()}, self.default)

    def erase(self, key: int) -> None:
        self._at.pop(key, None)

    def clear(self) -> None:
        self._at.clear()

    def count(self, key: int) -> int:
        return int(key in self._at)

    def keys(self) -> list[int]:
        return sorted(self._at)

    def items(self) -> Iterator[tuple[int, int]]:
        return ((k, self._at[k]) for k in self.keys())

    def values(self) -> list[int]:
        return [v for _, v in self.items()]

    def min_key(self) -> int:
        return min(self._at)

    def max_key(self) -> int:
        return max(self._at)

    def __iter__(self) -> Iterator[int]:
        return iter(self.keys())

    def __contains__(self, key: int) -> bool:
        return key in self._at

    def __len__(self) -> int:
        return len(self._at)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, VectorMap) and self._at == other._at

    def __repr__(self) -> str:
        return f"VectorMap({dict(self.items())})"


Dims = tuple[int, ...]


def strides(dims: Dims) -> Dims:
    """Elements between neighbours of each dimension, row-major."""
    return tuple(prod(dims[d + 1 :]) for d in range(len(dims)))


def coordinate(flat: int, dims: Dims) -> Dims:
    """Row-major coordinates of a flat index."""
    return tuple(flat // s % n for s, n in zip(strides(dims), dims, strict=True))


def broadcast_dims(a: Dims, b: Dims) -> Dims | None:
    """Right-aligned broadcasting; None if the shapes do not go together."""
    out = []
    for k in range(1, max(len(a), len(b)) + 1):
        x, y = (a[-k] if k <= len(a) else 1), (b[-k] if k <= len(b) else 1)
        if x != y and 1 not in (x, y):
            return None
        out.append(max(x, y))
    return tuple(reversed(out))


@dataclass(frozen=True)
class TileRun:
    """``count`` tiles, ``step`` apart from ``tile`` on, that hold ``each`` rows from ``row`` on; ``place`` is the first one's place among all tiles."""

    row: int
    tile: int
    place: int
    each: int
    step: int = 1
    count: int = 1


@dataclass(frozen=True, eq=False)
class DistributedShape:
    """A global shape with the rows of dimension 0 that each tile holds."""

    dims: Dims
    rows: VectorMap = field(default_factory=VectorMap)

    def __post_init__(self) -> None:
        if not self.dims:
            object.__setattr__(self, "dims", (1,))
        if 0 in self.dims:
            raise ValueError(f"a dimension of {self.dims} is zero")
        if not len(self.rows):
            object.__setattr__(self, "rows", VectorMap({0: self.dims[0]}))
        if sum(self.rows.values()) != self.dims[0]:
            raise ValueError(f"{self.rows} does not add up to {self.dims[0]} rows")

    @classmethod
    def scalar(cls, tile: int = 0) -> DistributedShape:
        return cls((1,), VectorMap({tile: 1}))

    @classmethod
    def on_single_tile(cls, dims: Dims, tile: int = 0) -> DistributedShape:
        return cls(tuple(dims), VectorMap({tile: dims[0]}))

    @classmethod
    def on_tiles(cls, dims: Dims, rows: Mapping[int, int]) -> DistributedShape:
        if not any(rows.values()):
            raise ValueError("no tile has rows")
        return cls(tuple(dims), VectorMap(rows))

    @classmethod
    def linear(cls, dims: Dims, tiles: int) -> DistributedShape:
        """Equal parts, the remainder on the last tile."""
        dims = tuple(dims)
        if 0 in dims:
            raise ValueError(f"a dimension of {dims} is zero")
        each = dims[0] // tiles
        return cls(dims, VectorMap({t: each + (dims[0] - each * tiles) * (t == tiles - 1) for t in range(tiles)}))

    @classmethod
    def from_mapping(cls, dims: Dims, mapping: Mapping[int, list[tuple[int, int]]]) -> DistributedShape:
        """From each tile's half-open ranges of flat elements, which must be whole rows."""
        step, rows = prod(dims[1:]), {}
        for tile, ranges in mapping.items():
            size = sum(b - a for a, b in ranges)
            if size % step or any(a % step or b % step for a, b in ranges):
                raise ValueError(f"tile {tile} holds part of a row")
            rows[tile] = size // step
        return cls.on_tiles(dims, rows)

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def elements(self) -> int:
        return prod(self.dims)

    @property
    def row_size(self) -> int:
        return prod(self.dims[1:])

    def strides(self) -> Dims:
        return strides(self.dims)

    def elements_on(self, tile: int) -> int:
        return self.rows[tile] * self.row_size

    def mapping(self) -> dict[int, list[tuple[int, int]]]:
        """Each tile's range of flat elements, in tile order."""
        out, at = {}, 0
        for tile, n in self.rows.items():
            out[tile] = [(at * self.row_size, (at + n) * self.row_size)]
            at += n
        return out

    def runs(self) -> list[TileRun]:
        """The distribution in few words: regular ones are one or two runs, whatever the number of tiles."""
        out: list[TileRun] = []
        row = 0
        for place, (tile, n) in enumerate(self.rows.items()):
            last = out[-1] if out else None
            if last and last.each == n and (last.count == 1 or tile == last.tile + last.step * last.count):
                out[-1] = replace(last, step=tile - last.tile if last.count == 1 else last.step, count=last.count + 1)
            else:
                out.append(TileRun(row, tile, place, n))
            row += n
        return out

    def group(self, size: int) -> DistributedShape:
        """Rows of ``size`` neighbouring tiles gathered on the first of them."""
        if size < 1:
            raise ValueError(size)
        rows: dict[int, int] = {}
        for tile, n in self.rows.items():
            rows[tile - tile % size] = rows.get(tile - tile % size, 0) + n
        return DistributedShape(self.dims, VectorMap(rows))

    def push_back(self, n: int) -> DistributedShape:
        return DistributedShape((*self.dims, n), self.rows)

    def with_trailing(self, trailing: Dims) -> DistributedShape:
        return DistributedShape((self.dims[0], *trailing), self.rows)

    def broadcast(self, other: DistributedShape) -> DistributedShape | None:
        """The shape of both together. Where rows are dealt differently they are moved: only shapes must agree."""
        dims = broadcast_dims(self.dims, other.dims)
        if dims is None:
            return None
        for one in (self, other):
            if one.rank == len(dims) and one.dims[0] == dims[0]:
                return DistributedShape(dims, one.rows)
        return DistributedShape(dims, VectorMap({0: dims[0]}))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, DistributedShape) and self.dims == other.dims and self.rows == other.rows

    def __hash__(self) -> int:
        return hash((self.dims, tuple(self.rows.items())))

    def __str__(self) -> str:
        return "x".join(map(str, self.dims))


def simplify(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring or overlapping half-open ranges joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(r for r in ranges if r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scale_up(mapping: Mapping[int, list[tuple[int, int]]], factor: int) -> dict[int, list[tuple[int, int]]]:
    """A mapping of rows as a mapping of their elements."""
    return {t: [(a * factor, b * factor) for a, b in r] for t, r in mapping.items()}


def to_devices(mapping: Mapping[int, list[tuple[int, int]]], tiles_per_device: int) -> dict[int, list[tuple[int, int]]]:
    """A mapping by tile as one by device."""
    out: dict[int, list[tuple[int, int]]] = {}
    for tile, ranges in mapping.items():
        out.setdefault(tile // tiles_per_device, []).extend(ranges)
    return {d: simplify(r) for d, r in out.items()}


def compatible(mapping: Mapping[int, list[tuple[int, int]]], elements: int) -> bool:
    """Whether ranges cover every element exactly once."""
    ranges = sorted(r for rs in mapping.values() for r in rs)
    return bool(ranges) and ranges[0][0] == 0 and ranges[-1][1] == elements and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:], strict=False))
