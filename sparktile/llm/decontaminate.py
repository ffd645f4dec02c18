"""Benchmark decontamination with an FM-index over each shard of training text.

Texts are lower-cased (A-Z) and cut into words. The words of about
``SHARD_WORDS`` words of documents form one shard; its suffix array gives a
Burrows-Wheeler transform kept in a wavelet matrix. All benchmark windows are
searched backward at once by wavelet ranks, occurrences are located by walking
to sampled suffix positions, and their spans are merged.

Cases: null or empty text has no words and no hits; a text of any length is searched
whole, in one shard; repeated documents and items are handled row by row, and rows that
share an id apart; an item shorter than a window is one window; an item without words is
never found; windows of an item without an id are found and cut like others, but name no
item; of overlapping occurrences the union is cut; empty tables give empty results;
columns of the input that clash with the output's are replaced, all others keep their
values, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, place, positional, release, replace_columns, slices, text_bytes, trimmed

WINDOW = 10
SHARD_WORDS = 500_000
SAMPLE_RATE = 8
BLOCK_BYTES = 16 << 20  # benchmark text that is broadcast at once

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x20]+")
_ADDED = ("n_words", "n_hit", "hit_items", "hit_spans")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only groups that still tie are sorted again."""
    n, width = len(s), max(1, int(s.max()).bit_length())
    step = max(1, 62 // width)
    key = s.astype(np.int64)
    padded = np.concatenate([key, np.zeros(step, np.int64)])
    for i in range(1, step):
        key = (key << width) | padded[i : i + n]
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.empty(n, bool)
    new[0], new[1:] = True, ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    open_at = np.flatnonzero(~new | np.append(~new[1:], False))
    while len(open_at):
        pos = sa[open_at]
        ahead = pos + step
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[pos]
        order = np.argsort(group * np.int64(n + 1) + follow)
        pos, group, follow = pos[order], group[order], follow[order]
        sa[open_at] = pos
        start = np.empty(len(pos), bool)
        start[0] = True
        start[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        rank[pos] = open_at[np.maximum.accumulate(np.where(start, np.arange(len(pos)), 0))]
        open_at = open_at[~start | np.append(~start[1:], False)]
        step *= 2
    return sa


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit row a level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.ones, self.zeros, self.levels, self.n = [], [], levels, len(values)
        for level in range(levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros_like(at), at
        for depth, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, bit = self.ones[depth], (symbols >> level) & 1 == 1
            low1, high1 = ones[low], ones[high]
            low = np.where(bit, self.zeros[depth] + low1, low - low1)
            high = np.where(bit, self.zeros[depth] + high1, high - high1)
        return high - low

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before it."""
        low, high, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for depth in range(self.levels):
            ones = self.ones[depth]
            low1, high1 = ones[low], ones[high]
            bit = ones[high + 1] > high1
            symbol = symbol << 1 | bit
            low = np.where(bit, self.zeros[depth] + low1, low - low1)
            high = np.where(bit, self.zeros[depth] + high1, high - high1)
        return symbol, high - low


class FMIndex:
    """Symbols above 1 can be searched; 1 is any other word, 0 the end of a document."""

    def __init__(self, s: np.ndarray, top: int, rate: int = SAMPLE_RATE):
        self.n, n = len(s), len(s)
        ends = s == 0
        apart = s.astype(np.int64) + int(ends.sum())
        apart[ends] = np.arange(1, int(ends.sum()) + 1)  # ends differ, so that copies of a text differ
        sa = suffix_array(apart)
        self.bwt = WaveletMatrix(s[sa - 1], max(1, int(top).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))]).astype(np.int64)
        marked = (sa % rate == 0) | (s[sa - 1] == 0)  # a walk back never leaves its document
        self.marked = np.zeros(n + 1, np.int32)
        np.cumsum(marked, out=self.marked[1:])
        self.samples = sa[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of right-aligned phrases (rows); empty ranges where not found."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live, width = np.arange(len(phrases)), phrases.shape[1]
        for i in range(1, width + 1):
            live = live[(lengths[live] >= i) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, width - i].astype(np.int64)
            base = self.before[symbol]
            low[live], high[live] = base + self.bwt.rank(symbol, low[live]), base + self.bwt.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walking back to the nearest sample."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            here = self.marked[rows + 1] > self.marked[rows]
            out[todo[here]] = self.samples[self.marked[rows[here]]] + steps
            todo, rows = todo[~here], rows[~here]
            if len(todo):
                symbol, seen = self.bwt.access_rank(rows)
                rows, steps = self.before[symbol] + seen, steps + 1
        return out


def compile_windows(items: list[tuple[str | None, bytes]], window: int):
    """Vocabulary, distinct right-aligned windows, their lengths, and the items (with an id) that hold each."""
    vocab: dict[bytes, int] = {}
    holders: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocab.setdefault(w, len(vocab) + 2) for w in words_of(text)]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            holders.setdefault(tuple(ids[i : i + window]), set()).update([] if item is None else [item])
    phrases = np.zeros((len(holders), window), np.int32)
    for row, p in zip(phrases, holders, strict=True):
        row[window - len(p) :] = p
    return vocab, phrases, np.array([len(p) for p in holders], np.int64), [sorted(x) for x in holders.values()]


def shard_hits(texts: list[list[int]], phrases, lengths, holders, top: int):
    """For each text of a shard: its merged spans of hit words and the items found there."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    s = np.zeros(int(starts[-1]), np.int32)
    for at, x in zip(starts[:-1], texts, strict=True):
        s[at : at + len(x)] = x
    index = FMIndex(s, top)
    low, high = index.search(phrases, lengths)
    found = np.flatnonzero(low < high)
    counts = (high - low)[found]
    which = np.repeat(found, counts)
    rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[found], counts)
    at = index.locate(rows)
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + lengths[which], -1)
    hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    doc_of_edge = np.searchsorted(starts, edges[::2], side="right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, a, b in zip(doc_of_edge.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    items: list[set[str]] = [set() for _ in texts]
    doc_of = np.searchsorted(starts, at, side="right") - 1
    for pair in np.unique(doc_of * len(lengths) + which).tolist():
        items[pair // len(lengths)].update(holders[pair % len(lengths)])
    return spans, items


def _searcher(shared, text_col: str, keep: list[str], window: int, shard_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, phrases, lengths, holders = shared.value
        known = vocab.get

        def finish(parts: list[pa.RecordBatch], texts: list[list[int]]) -> Iterator[pa.RecordBatch]:
            if len(holders) and sum(map(len, texts)):
                spans, items = shard_hits(texts, phrases, lengths, holders, len(vocab) + 1)
            else:
                spans, items = [[] for _ in texts], [set() for _ in texts]
            at = 0
            for part in parts:
                here = slice(at, at + part.num_rows)
                at += part.num_rows
                bounds = [word_bytes(t, sp) for t, sp in zip(text_bytes(part.column(text_col)), spans[here], strict=True)]
                span_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("word_start", "word_end", "byte_start", "byte_end")]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep]
                    + [
                        pa.array([len(t) for t in texts[here]], pa.int64()),
                        pa.array([sum(b - a for a, b in sp) for sp in spans[here]], pa.int64()),
                        pa.array([sorted(x) for x in items[here]], pa.list_(pa.string())),
                        pa.array([[dict(zip(("word_start", "word_end", "byte_start", "byte_end"), x, strict=True)) for x in b] for b in bounds], span_type),
                    ],
                    names=[*keep, *_ADDED],
                )

        parts, texts, size = [], [], 0
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                parts.append(part)
                for text in text_bytes(part.column(text_col)):
                    texts.append([known(w, 1) for w in words_of(text)])
                    size += len(texts[-1])
                if size >= shard_words:
                    yield from finish(parts, texts)
                    parts, texts, size = [], [], 0
                    release()
        if parts:
            yield from finish(parts, texts)

    return trimmed(run)


def word_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Word spans with the bytes from the first word's start to the last word's end."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    return [(a, b, at[a][0], at[b - 1][1]) for a, b in spans]


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, hit_items and hit_spans (merged).

    Items are searched in blocks of at most about ``block_bytes`` of text, so what
    is broadcast is bounded whatever the benchmark's size; documents stay in place.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs, names = positional(replace_columns(docs, list(_ADDED)))
    text_col = place(names, text_col)
    pairs = items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    total = pairs.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    keep = docs.columns
    added = T.StructType(
        [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("word_start", "word_end", "byte_start", "byte_end")])))]
    )
    out, scratch = None, Scratch(spark) if blocks > 1 else None
    for b in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else pairs
        compiled = spark.sparkContext.broadcast(compile_windows([(r.i, r.t.encode()) for r in part.collect()], window))
        source = docs if out is None else out.select(*keep, *[F.col(c).alias(f"_{c}") for c in _ADDED])
        found = source.mapInArrow(_searcher(compiled, text_col, source.columns, window, shard_words), T.StructType([*source.schema.fields, *added.fields]))
        if out is not None:
            found = _merged(found, keep)
        out = scratch.write(found, f"block{b}") if scratch else found
    return out.toDF(*names, *_ADDED)


def _merged(df: DataFrame, keep: list[str]) -> DataFrame:
    """Hits of two blocks of items as one: items united, overlapping spans joined."""
    both = F.array_sort(F.concat("_hit_spans", "hit_spans"))
    joined = F.aggregate(
        both,
        F.expr("cast(array() as array<struct<word_start:bigint,word_end:bigint,byte_start:bigint,byte_end:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["word_end"] >= x["word_start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["word_start"].alias("word_start"), F.greatest(F.try_element_at(acc, F.lit(-1))["word_end"], x["word_end"]).alias("word_end"),
                F.try_element_at(acc, F.lit(-1))["byte_start"].alias("byte_start"), F.greatest(F.try_element_at(acc, F.lit(-1))["byte_end"], x["byte_end"]).alias("byte_end"))))
        ).otherwise(F.concat(acc, F.array(x))),
    )
    df = df.select(*keep, "n_words", F.array_sort(F.array_union("_hit_items", "hit_items")).alias("hit_items"), joined.alias("hit_spans"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["word_end"] - x["word_start"])
    return df.select(*keep, "n_words", n_hit.alias("n_hit"), "hit_items", "hit_spans")


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every merged span cut out of its text; a text left without words goes."""
    inner, names = positional(docs)
    text = place(names, text_col)
    found = search(inner, items, text_col=text, **options).withColumn("raw", F.col(text).cast("binary"))
    pieces = F.concat_ws(
        "",
        F.transform(
            F.sequence(F.lit(0), F.size("hit_spans")),
            lambda i: F.substring(
                F.col("raw"),
                F.coalesce(F.get("hit_spans", i - 1)["byte_end"], F.lit(0)).cast("int") + 1,
                (F.coalesce(F.get("hit_spans", i)["byte_start"], F.octet_length("raw").cast("bigint")) - F.coalesce(F.get("hit_spans", i - 1)["byte_end"], F.lit(0))).cast("int"),
            ).cast("string"),
        ),
    )
    hit = F.size("hit_spans") > 0
    out = found.withColumn("clean", F.when(hit, pieces).otherwise(F.col(text))).where(~(hit & (F.col("n_hit") >= F.col("n_words"))))
    new = {text: F.col("clean")}
    if "n_chars" in names:
        n = place(names, "n_chars")
        new[n] = F.when(hit, F.length("clean").cast("bigint")).otherwise(F.col(n))
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in inner.columns]).toDF(*names)
