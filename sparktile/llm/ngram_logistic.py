"""Quality rules: base counts, and a hashed n-gram logistic regression.

Words and word pairs, and runs of four characters, are hashed into two tables of
weights. The regression learns from a bounded labelled sample over their relative
frequencies, is calibrated on a part that it did not see, and is scored in Arrow
batches against a fixed threshold. The sample is the first ``SAMPLE_ROWS`` labelled
documents in hash order, of those as many as fit into ``SAMPLE_BYTES`` of features.

Cases: null or empty text has no words and fails the base rule; a text of any length
is read whole; without labels of both kinds every probability is the smoothed share; a
document with several labels has their mean, rounded half up; of rows that share an id
one teaches, the first in the hash order of its text; repeated rows are judged one by
one; an empty table gives no rows; only the id and the text are read, whatever other
columns are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, mix64, pack_array, slices, text_bytes, trimmed, unpack_array
from .features import Counted, class_table, duplicate_lines, lengths_of, sums_between

SAMPLE_ROWS = 3000
SAMPLE_BYTES = 64 << 20  # of the sample's packed features, which the driver reads
BITS = 15  # of each of the two tables
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
KEEP_AT = 0.3
_SYMBOLS = class_table(b"#*$%&|<>")
_SPACE = class_table(b" \t\n\r\x0b\x0c")
_WORD_CHAR = ((np.arange(256) & 0xC0) != 0x80).astype(np.uint8) * (1 - _SPACE)
_RUN = (2654435761, 2246822519, 3266489917, 668265263)  # odd multipliers, one for each place in a run


class Parsed:
    """A slice of texts with its words as hashes and its character runs as table places."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.counted = Counted(texts)
        split = [t.split() for t in texts]
        self.n_words = lengths_of(split)
        self.ends = np.cumsum(self.n_words)
        self.starts = self.ends - self.n_words
        ids: dict[bytes, int] = defaultdict(count().__next__)
        flat = np.fromiter((i for w in split for i in map(ids.__getitem__, w)), np.int64, int(self.n_words.sum()))
        self.exact = np.array([xxhash.xxh3_64_intdigest(w) for w in ids], np.uint64)[flat] if len(flat) else np.empty(0, np.uint64)
        self.folded = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in ids], np.uint64)[flat] if len(flat) else self.exact
        self.lines = [duplicate_lines(t)[1] for t in texts]

    def repeat_words(self) -> np.ndarray:
        """Words inside a window of WINDOW words that the text has at least twice."""
        n = len(self.exact)
        doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        starts = np.arange(n)[: max(0, n - WINDOW + 1)]
        starts = starts[doc[starts] == doc[starts + WINDOW - 1]] if len(starts) else starts
        cover = np.zeros(n + 1, np.int64)
        if len(starts):
            key = mix64(doc[starts].astype(np.uint64) + np.uint64(1))
            for i in range(WINDOW):
                key = mix64(key) + self.exact[starts + i]
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(key), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            np.add.at(cover, starts[again], 1)
            np.add.at(cover, starts[again] + WINDOW, -1)
        inside = (np.cumsum(cover[:-1]) > 0).astype(np.int64)
        return sums_between(inside, self.starts, self.ends)

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(table places, starts, ends) for words and pairs, then for character runs, by document."""
        word = (mix64(self.folded) >> np.uint64(64 - BITS)).astype(np.int64)
        pair = np.zeros(len(word), np.int64)
        if len(word) > 1:
            pair[1:] = (mix64(mix64(self.folded[:-1]) + self.folded[1:]) >> np.uint64(64 - BITS)).astype(np.int64)
        first = np.zeros(len(word), bool)
        first[self.starts[self.n_words > 0]] = True
        yield np.stack([word, np.where(first, word, pair)], 1).reshape(-1), 2 * self.starts, 2 * self.ends
        chars = [t.lower().decode(errors="replace") for t in self.texts]
        points = np.frombuffer("".join(chars).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths_of(chars))
        starts, n = ends - lengths_of(chars), max(len(points) - 3, 0)
        run = np.zeros(n, np.uint32)
        for i, factor in enumerate(_RUN):
            run += points[i : n + i] * np.uint32(factor)
        run = (run * np.uint32(_RUN[0])) >> np.uint32(32 - BITS)
        # The last runs of a document take in the next one's characters, so they are left out.
        yield (1 << BITS) + run.astype(np.int64), np.minimum(starts, n), np.clip(ends - 3, np.minimum(starts, n), n)


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    slope: float = 1.0  # of the calibration
    offset: float = 0.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))

    def margins(self, parsed: Parsed) -> np.ndarray:
        total = np.full(len(parsed.n_words), self.bias)
        for places, starts, ends in parsed.places():
            total += sums_between(self.weights[places].astype(np.float64), starts, ends) / np.maximum(ends - starts, 1)
        return total


class Rows:
    """Sparse rows twice: by row for margins, by column for gradients."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int):
        sizes = np.array([len(c) for c, _ in rows], np.int64)
        self.col, self.val = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        self.col, self.val = self.col.astype(np.intp), self.val.astype(np.float32)
        self.full = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.full]
        row = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(self.col, kind="stable")
        self.row_c, self.val_c = row[order], self.val[order]
        counts = np.bincount(self.col, minlength=size)
        self.used = np.flatnonzero(counts)
        self.starts_c = (np.cumsum(counts) - counts)[self.used]
        self.n, self.size = len(rows), size

    def margins(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.full):
            out[self.full] = np.add.reduceat(self.val * w.astype(np.float32).take(self.col, mode="clip"), self.starts)
        return out

    def gradient(self, error: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if len(self.used):
            out[self.used] = np.add.reduceat(self.val_c * error.astype(np.float32).take(self.row_c, mode="clip"), self.starts_c)
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, turns: int = 40, decay: float = 1e-6, still: float = 1e-3) -> Logistic:
    """Weights by L-BFGS on two thirds of the rows until the gradient is still, calibrated (Platt) on the rest."""
    size = 2 << BITS
    if len(y) < 30 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Logistic(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    teach = np.arange(len(y)) % 3 != 0
    if y[teach].min() == y[teach].max():
        teach[:] = True
    x, n = Rows(rows, size), teach.sum()
    dot = lambda a, b: float(np.einsum("i,i->", a, b))  # noqa: E731  # one thread, whatever the library has

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.clip(x.margins(v[:-1]) + v[-1], -40, 40)
        error = (1 / (1 + np.exp(-margin)) - y) * teach / n
        value = ((np.logaddexp(0, margin) - y * margin) * teach).sum() / n + decay / 2 * dot(v[:-1], v[:-1])
        return float(value), np.append(x.gradient(error) + decay * v[:-1], error.sum())

    v = np.zeros(size + 1)
    v[-1] = np.log(y[teach].mean() / (1 - y[teach].mean()))
    now, grad = loss(v)
    begun, past = dot(grad, grad) ** 0.5, []
    for _ in range(turns):
        if dot(grad, grad) ** 0.5 <= still * begun:
            break
        step, kept = -grad, []
        for s, d in reversed(past):
            kept.append(dot(s, step) / dot(s, d))
            step = step - kept[-1] * d
        if past:
            s, d = past[-1]
            step = step * (dot(s, d) / dot(d, d))
        else:
            step = step / max(begun, 1e-12)
        for (s, d), a in zip(past, reversed(kept), strict=True):
            step = step + s * (a - dot(d, step) / dot(s, d))
        rate, slope = 1.0, dot(grad, step)
        while rate > 1e-8:
            value, ahead = loss(v + rate * step)
            if value <= now + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, d = rate * step, ahead - grad
        if dot(s, d) > 1e-12:
            past = [*past[-7:], (s, d)]
        v, now, grad = v + s, value, ahead
    margin = x.margins(v[:-1]) + v[-1]
    model = Logistic(v[:-1].astype(np.float32), float(v[-1]))
    model.slope, model.offset = _platt(margin[~teach], y[~teach]) if (~teach).any() else (1.0, 0.0)
    return model


def _platt(margin: np.ndarray, y: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """Slope and offset by damped Newton steps, with Platt's smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        error, weight = p - target, p * (1 - p) + 1e-6
        h = np.array([[(weight * margin**2).sum() + 1e-3, (weight * margin).sum()], [(weight * margin).sum(), weight.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(error * margin).sum() + 1e-3 * (a - 1), error.sum()])
        a, b = a - 0.5 * da, b - 0.5 * db
    return float(max(a, 1e-3)), float(b)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed features: places of both tables in order, how often each occurs, and the tables' totals."""
    for batch in batches:
        for part in slices(batch, "text"):
            parsed = Parsed(text_bytes(part.column(1)))
            cols, times, totals = ([[] for _ in range(part.num_rows)] for _ in range(3))
            for places, starts, ends in parsed.places():
                for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    place, n = np.unique(places[a:b], return_counts=True)
                    cols[i].append(place.astype(np.uint32))
                    times[i].append(n.astype(np.uint32))
                    totals[i].append(b - a)
            packed = [[pack_array(np.concatenate(x)) for x in y] for y in (cols, times)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([[len(x) for x in c] for c in cols], pa.list_(pa.int32())), pa.array(totals, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in packed)],
                names=["doc_id", "label", "sizes", "totals", "col", "times"],
            )


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Logistic:
    """A model from at most ``sample_rows`` labelled documents, the first in hash order, and ``sample_bytes`` of features."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    mean = (F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double")
    chosen = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(mean.alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")
    scratch = Scratch(docs.sparkSession)
    features = scratch.write(texts.mapInArrow(_sample_features, "doc_id long, label double, sizes array<int>, totals array<long>, col binary, times binary"), "features")
    size = (F.octet_length("col") + F.octet_length("times")).alias("size")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    at = np.cumsum([r["size"] for r in features.orderBy(*order).select(size).collect()], dtype=np.int64)
    few = max(1, int(np.searchsorted(at, sample_bytes, side="right")))
    rows, y = [], []
    for r in features.orderBy(*order).limit(few).collect():
        n = sum(r.sizes)
        total = np.repeat(np.maximum(r.totals, 1), r.sizes)
        rows.append((unpack_array(r.col, np.uint32, n), unpack_array(r.times, np.uint32, n) / total))
        y.append(r.label)
    scratch.drop()
    return fit(rows, np.array(y, float))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT, **options) -> DataFrame:
    """Per document: the base counts, base_failed, the probability of good quality, and kept."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                parsed = Parsed(text_bytes(part.column(1)))
                repeat = parsed.repeat_words()
                failed = (parsed.n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * parsed.n_words)
                probability = model.value.probability(model.value.margins(parsed))
                cols = [parsed.n_words, parsed.counted.count(_WORD_CHAR), parsed.counted.count(_SYMBOLS), np.array(parsed.lines, np.int64), repeat]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in cols], pa.array(failed), pa.array(probability), pa.array(~failed & (probability >= keep_at))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(trimmed(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")
