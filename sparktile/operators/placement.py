"""Where rows are, as columns: plans whose size does not grow with the number of tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shape import DistributedShape

FEW = 3  # runs that are told apart by conditions; more are searched


def _values(numbers: list[int]) -> Column:
    """One constant array, however long."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _at_last(key: Column, starts: list[int], fields: list[list[int]]) -> list[Column]:
    """For each field its value at the last start that does not exceed the key.

    Many starts are searched by halving, in as many steps as their number has bits.
    """
    if len(starts) <= FEW:
        out = [F.lit(values[0]).cast("bigint") for values in fields]
        for k, start in enumerate(starts[1:], 1):
            out = [F.when(key >= start, F.lit(values[k]).cast("bigint")).otherwise(o) for values, o in zip(fields, out, strict=True)]
        return out
    known = _values(starts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((len(starts) - 1).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(known, at + step), F.lit((1 << 63) - 1)) <= key, at + step).otherwise(at))
    return [F.get(_values(values), at) for values in fields]


def tile_of(i: Column, shape: DistributedShape) -> Column:
    """The tile of a row."""
    runs = shape.runs()
    row, tile, each, step = _at_last(i, [r.row for r in runs], [[getattr(r, f) for r in runs] for f in ("row", "tile", "each", "step")])
    return (tile + step * F.floor((i - row) / each)).cast("int")


@dataclass(frozen=True)
class OfTile:
    """What is known of a tile: its place among all tiles, its first row, and its rows."""

    place: Column
    begin: Column
    rows: Column


def of_tile(tile: Column, shape: DistributedShape) -> OfTile:
    runs = shape.runs()
    first, place, row, each, step = _at_last(tile.cast("bigint"), [r.tile for r in runs], [[getattr(r, f) for r in runs] for f in ("tile", "place", "row", "each", "step")])
    nth = F.floor((tile - first) / step)
    return OfTile((place + nth).cast("bigint"), (row + nth * each).cast("bigint"), each)
