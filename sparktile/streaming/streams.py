"""Named streams of rows into and out of programs, and products over unbounded ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row

from ..operators.sparse import Matrix


class Streams:
    """Callbacks by name: a sink gets frames, a source gives them."""

    def __init__(self) -> None:
        self._sinks: dict[str, Callable[[Iterator[Row]], None]] = {}
        self._sources: dict[str, Callable[[], DataFrame]] = {}

    def register_callback(self, handle: str, callback: Callable[[Iterator[Row]], None]) -> None:
        if handle in self._sinks:
            raise ValueError(f"stream {handle!r} exists")
        self._sinks[handle] = callback

    def register_source(self, handle: str, source: Callable[[], DataFrame]) -> None:
        self._sources[handle] = source

    def read(self, handle: str) -> DataFrame:
        return self._sources[handle]()

    def write(self, handle: str, df: DataFrame) -> None:
        """Rows in index order, one partition at a time on the driver."""
        self._sinks[handle](df.orderBy("i").toLocalIterator() if "i" in df.columns else df.toLocalIterator())


def spmv_stream(matrix: Matrix, vectors: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """A x for every micro-batch of (i, v) rows, which add up as A is linear. Returns the running query.

    ``trigger`` is that of a streaming writer, such as availableNow=True.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        sink(matrix.products(batch.select("i", "v")), epoch)

    writer = vectors.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
