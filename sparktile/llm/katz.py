"""Katz back-off language model over word n-grams of any order, trained and evaluated in blocks.

P(w|h) = d(c(hw)) c(hw) / c(h) if the n-gram hw was seen, else alpha(h) P(w|h'), where
h' is h without its first word; below the bigrams stands P(w), the Good-Turing
discounted unigram with the freed mass for the unknown word. alpha(h) makes every
context sum to one; a context that was never seen passes its word on as it is.
Discounts of each order are Turing's estimate for small counts and its log-linear
smoothing (simple Good-Turing) beyond, so that every context keeps mass to back off
with. A document starts after ``order - 1`` start marks, which are no tokens.

Documents are tokenised once into blocks of bounded size, a table bucketed by block.
Each block sends its distinct n-grams, as compressed sorted hash arrays, to buckets of
the hash space (a frequent n-gram is one entry a block, so no key is hot); buckets,
as many as the text's bytes ask for, add up the counts and answer each block with the
totals of what it asked, and with whether other blocks hold the n-gram at all. Words
and bigrams are asked first; of a longer n-gram only those whose two parts other blocks
hold too, as all others' counts are the block's own. A seen n-gram is owned by one of
its blocks, which adds its share to its context's sums; contexts that other blocks may
need are summed in buckets the same way, and their back-off weights returned. Each
token's probability is then found recursively from the longest context down.

``keep`` writes the model's tables, partitioned by order: ngrams (order, key, context,
count, log10 of the probability, probability after the context's last words) and weights (order, key of the context, log10 alpha).
N-grams are keyed by 64-bit hashes; counts are 64-bit.

Cases: null or empty text is the end token alone; a text of any length is one document
and stays in one block; repeated rows each count and are each scored; rows that share
an id are scored one by one; equal counts need no order; with no training rows every
token is unknown and the score is the unknown word's; empty tables give no rows; only
the id, the text and the columns of ``held`` are read, whatever others are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, pack_array, slices, text_bytes, trimmed, unpack_array

ORDER = 3
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20  # of text, whose n-grams one bucket of the hash space adds up
STATS = 20  # counts of counts kept for the discounts
STATS_GROUPS = 4096  # that blocks' own counts of counts are added up in
TURING = 5  # counts up to which Turing's estimate itself is used
#: Hashes of the start mark and of the end token, which are no words.
_START, _END = 0x3C6EF372FE94F82B, 0x5DEECE66D1234567
_FOLLOW = np.uint64(0xA5A5A5A5A5A5A5A5)

_BLOCK = {"block": ("long", pa.int64()), "doc_id": ("array<long>", pa.list_(pa.int64())), "held": ("array<boolean>", pa.list_(pa.bool_())), "lens": ("array<int>", pa.list_(pa.int32())), "n_words": ("int", pa.int32()), "words": ("binary", pa.binary()), "n_ids": ("int", pa.int32()), "ids": ("binary", pa.binary())}
_ASK = {"kind": ("int", pa.int32()), "bucket": ("int", pa.int32()), "block": ("long", pa.int64()), "n": ("int", pa.int32()), "keys": ("binary", pa.binary()), "train": ("binary", pa.binary()), "other": ("binary", pa.binary()), "stats": ("array<long>", pa.list_(pa.int64()))}
_ANSWER = {"kind": ("int", pa.int32()), "bucket": ("int", pa.int32()), "block": ("long", pa.int64()), "n": ("int", pa.int32()), "totals": ("binary", pa.binary()), "bits": ("binary", pa.binary()), "stats": ("array<long>", pa.list_(pa.int64()))}
_PART = {"block": ("long", pa.int64()), "kind": ("int", pa.int32()), "bucket": ("long", pa.int64()), "n": ("int", pa.int32()), "keys": ("binary", pa.binary()), "total": ("binary", pa.binary()), "kept": ("binary", pa.binary()), "lower": ("binary", pa.binary()), "need": ("binary", pa.binary()), "doc_id": ("array<long>", pa.list_(pa.int64())), "held": ("array<boolean>", pa.list_(pa.bool_())), "n_tokens": ("array<long>", pa.list_(pa.int64())), "n_known": ("array<long>", pa.list_(pa.int64())), "base": ("array<double>", pa.list_(pa.float64())), "part": ("array<double>", pa.list_(pa.float64())), "back_doc": ("binary", pa.binary()), "back_at": ("binary", pa.binary()), "n_back": ("int", pa.int32())}
#: Of a part, what stays when contexts have been summed: a block's weights, and its documents as far as they are scored.
_DONE = {k: _PART[k] for k in ("block", "kind", "bucket", "n")} | {"alpha": ("binary", pa.binary())} | {k: t for k, t in list(_PART.items())[9:]}
_OUT = {"doc_id": ("long", pa.int64()), "held_out": ("boolean", pa.bool_()), "n_tokens": ("long", pa.int64()), "n_known": ("long", pa.int64()), "base_score": ("double", pa.float64()), "score": ("double", pa.float64())}
_NGRAM = {"order": ("int", pa.int32()), "key": ("long", pa.int64()), "context": ("long", pa.int64()), "count": ("long", pa.int64()), "log_p": ("double", pa.float64()), "lower": ("double", pa.float64())}
Fields = dict[str, tuple[str, pa.DataType]]


def _ddl(fields: Fields) -> str:
    return ", ".join(f"{k} {t}" for k, (t, _) in fields.items())


def _arrays(fields: Fields, rows: list[list]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields.values())]


def _batch(fields: Fields, rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_arrays(fields, rows), names=list(fields))


def _follow(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of n-grams that are one word longer."""
    return mix64(mix64(keys) + (words ^ _FOLLOW))


def start_key(order: int) -> int:
    """The key of ``order`` start marks."""
    one = np.array([_START], np.uint64)
    key = one
    for _ in range(order - 1):
        key = _follow(key, one)
    return int(key[0])


def blocks_of(docs: DataFrame, held: Column, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row a block: the hashes of its words in order, and its documents as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 24, 0
        state: dict = {}

        def reset() -> None:
            state.update(vocab=defaultdict(count(2).__next__), docs=[], held=[], lens=[], ids=[], size=0)

        def finish() -> pa.RecordBatch:
            nonlocal made
            hashes = np.array([_START, _END, *map(xxhash.xxh3_64_intdigest, state["vocab"])], np.uint64)
            order = np.argsort(hashes)
            place = np.empty(len(hashes), np.int32)
            place[order] = np.arange(len(hashes), dtype=np.int32)
            ids = place[np.concatenate(state["ids"])]
            row = [base + made, state["docs"], state["held"], state["lens"], len(hashes), pack_array(hashes[order]), len(ids), pack_array(ids)]
            made += 1
            return _batch(_BLOCK, [row])

        reset()
        mark, end = np.zeros(1, np.int32), np.ones(1, np.int32)
        for batch in batches:
            for part in slices(batch, "text", min(block_bytes, 1 << 20)):
                state["docs"] += part.column(0).to_pylist()
                state["held"] += part.column(1).to_pylist()
                for text in text_bytes(part.column(2)):
                    ids = np.fromiter(map(state["vocab"].__getitem__, text.lower().split()), np.int32)
                    state["ids"] += [mark, ids, end]
                    state["lens"].append(len(ids) + 1)
                    state["size"] += len(text) + 1
                if state["size"] >= block_bytes:
                    yield finish()
                    reset()
        if state["docs"]:
            yield finish()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(trimmed(run), _ddl(_BLOCK))


class Grams:
    """The distinct n-grams of one order in a block, and what is known of them."""

    def __init__(self, at: np.ndarray, keys: np.ndarray, train: np.ndarray, every: np.ndarray, pre: np.ndarray, suf: np.ndarray, start: int):
        self.at, self.keys, self.pre, self.suf, self.start = at, keys, pre, suf, start  # at: by position
        self.train, self.other = train, every - train  # occurrences in training text, and in other text
        self.total, self.owned = train.astype(np.int64), np.ones(len(keys), bool)
        self.own, self.wanted = np.ones(len(keys), bool), self.other > 0  # own: no other block holds it
        self.asked = np.empty(0, np.int64)

    def ask(self, among: np.ndarray) -> None:
        self.asked = among[np.argsort(self.keys[among])]

    def learn(self, rows: list[dict]) -> None:
        """Answers of all buckets, in bucket order, to what was asked in key order."""
        if not rows:
            return
        rows = sorted(rows, key=lambda r: r["bucket"])
        self.total[self.asked] = np.concatenate([unpack_array(r["totals"], np.uint64, r["n"]) for r in rows]).astype(np.int64)
        bits = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=3 * r["n"]).reshape(3, -1) for r in rows]
        self.owned[self.asked], self.own[self.asked], self.wanted[self.asked] = np.concatenate(bits, 1).astype(bool)

    def seen(self) -> np.ndarray:
        """Owned n-grams that training text holds; start marks are none."""
        mine = self.owned & (self.total > 0)
        mine[self.start] = False
        return mine


class Block:
    """A block's tokens and its n-grams of orders 1 to ``order``."""

    def __init__(self, row: dict, order: int):
        self.block, self.doc_id, self.held, self.lens = row["block"], row["doc_id"], row["held"], np.array(row["lens"], np.int64)
        hashes = unpack_array(row["words"], np.uint64, row["n_words"])
        tokens = unpack_array(row["ids"], np.int32, row["n_ids"]).astype(np.int64)
        self.starts = np.cumsum(self.lens + 1) - self.lens - 1  # of the documents, at their start marks
        self.doc_of = np.repeat(np.arange(len(self.lens)), self.lens + 1)
        before = np.arange(len(tokens)) - 1
        before[self.starts] = self.starts
        train = np.repeat(~np.array(self.held, bool), self.lens + 1)
        self.is_token = np.ones(len(tokens), bool)
        self.is_token[self.starts] = False
        none = np.empty(0, np.int64)
        first = int(self.starts[0])
        self.grams = [Grams(tokens, hashes, np.bincount(tokens[train], minlength=len(hashes)), np.bincount(tokens, minlength=len(hashes)), none, none, int(tokens[first]))]
        for _ in range(order - 1):
            low = self.grams[-1]
            codes, where, at = np.unique(low.at[before] * len(hashes) + tokens, return_index=True, return_inverse=True)
            pre = codes // len(hashes)
            keys = _follow(low.keys[pre], hashes[codes % len(hashes)])
            self.grams.append(Grams(at, keys, np.bincount(at[train], minlength=len(codes)), np.bincount(at, minlength=len(codes)), pre, low.at[where], int(at[first])))

    def of(self, kind: int) -> Grams:
        return self.grams[kind - 1]

    def ask(self, kind: int) -> None:
        """All words and bigrams; a longer n-gram only if other blocks hold both of its parts."""
        g = self.of(kind)
        if kind <= 2:
            return g.ask(np.arange(len(g.keys)))
        low = self.of(kind - 1)
        return g.ask(np.flatnonzero(~low.own[g.pre] & ~low.own[g.suf]))

    def learn(self, answers: list[dict], most: int) -> None:
        for kind in range(1, most + 1):
            self.ask(kind)
            self.of(kind).learn([r for r in answers if r["kind"] == kind])

    def asks(self, kind: int, buckets: int) -> list[list]:
        """Rows for the buckets, and one of what is not asked: its counts of counts."""
        self.ask(kind)
        g, rows = self.of(kind), []
        keys = g.keys[g.asked]
        for bucket, a, b in _cuts(keys, buckets):
            at = g.asked[a:b]
            rows.append([kind, bucket, self.block, b - a, pack_array(keys[a:b]), pack_array(g.train[at].astype(np.uint32)), pack_array(g.other[at].astype(np.uint32)), None])
        if kind > 2:
            alone = np.ones(len(g.keys), bool)
            alone[g.asked] = False
            alone[g.start] = False
            rows.append([kind, -1 - self.block % STATS_GROUPS, self.block, 0, None, None, None, _stats(g.train[alone])])
        return rows


def _cuts(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of each bucket's part of sorted keys."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64) if buckets > 1 else np.empty(0, np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        yield bucket, int(cuts[bucket]), int(cuts[bucket + 1])


def _stats(counts: np.ndarray) -> list[int]:
    """Sum, number, and counts of counts of what was seen."""
    seen = counts[counts > 0].astype(np.int64)
    return [int(seen.sum()), len(seen), *np.bincount(seen[seen <= STATS], minlength=STATS + 1)[1:].tolist()]


def _first_asks(kinds: tuple[int, ...], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one block at a time
                b = Block(batch.slice(k, 1).to_pylist()[0], max(kinds))
                for kind in kinds:
                    yield _batch(_ASK, b.asks(kind, buckets))

    return trimmed(run)


def _later_asks(kind: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, answers = [], right.to_pylist()
        for row in left.to_pylist():
            b = Block(row, kind)
            b.learn(answers, kind - 1)
            rows += b.asks(kind, buckets)
        return pa.table(_arrays(_ASK, rows), names=list(_ASK))

    return run


def _gather(group: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's asks: rows, their distinct keys, the place of each asked key, its first asker, and offsets."""
    rows = group.sort_by("block").to_pylist()
    keys = np.concatenate([unpack_array(r["keys"], np.uint64, r["n"]) for r in rows])
    distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return rows, distinct, inverse, first, np.cumsum([0] + [r["n"] for r in rows])


def _added(values: np.ndarray, inverse: np.ndarray, n: int) -> np.ndarray:
    """Exact 64-bit sums by place."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, inverse, values.astype(np.uint64))
    return out


def _count(group: pa.Table) -> pa.Table:
    """Totals of a bucket's n-grams, returned to each block that asked, and the counts of counts."""
    if group.column("bucket")[0].as_py() < 0:  # of n-grams that blocks hold alone
        rows = group.to_pylist()
        out = [[rows[0]["kind"], rows[0]["bucket"], -1, 0, None, None, np.sum([r["stats"] for r in rows], axis=0).tolist()]]
        return pa.table(_arrays(_ANSWER, out), names=list(_ANSWER))
    rows, distinct, inverse, first, at = _gather(group)
    kind, bucket = rows[0]["kind"], rows[0]["bucket"]
    train, other = (np.concatenate([unpack_array(r[c], np.uint32, r["n"]) for r in rows]) for c in ("train", "other"))
    total, beside = _added(train, inverse, len(distinct)), _added(other, inverse, len(distinct))
    bits = np.zeros((3, len(inverse)), bool)
    bits[0, first] = True
    bits[1] = (total + beside)[inverse] == train.astype(np.uint64) + other
    bits[2] = beside[inverse] > 0
    out = [[kind, bucket, r["block"], r["n"], pack_array(total[inverse[a:b]]), np.packbits(bits[:, a:b]).tobytes(), None] for r, a, b in zip(rows, at[:-1], at[1:], strict=True)]
    out.append([kind, bucket, -1, 0, None, None, _stats(total[distinct != np.uint64(start_key(kind))].astype(np.int64))])
    return pa.table(_arrays(_ANSWER, out), names=list(_ANSWER))


class Discount:
    """Good-Turing: the share of a count that stays with the n-gram."""

    def __init__(self, of_counts: list[int]):
        n = np.array(of_counts, float)  # n[r - 1] n-grams were seen r times
        r = np.arange(1, len(n) + 1)
        use = n > 0
        slope = np.polyfit(np.log(r[use]), np.log(n[use]), 1)[0] if use.sum() > 1 else -2.0
        self.slope = min(slope, -1.05)
        self.small = np.array([0.0] + [self._turing(n, k) for k in range(1, TURING + 1)])

    def _turing(self, n: np.ndarray, r: int) -> float:
        smooth = float((1 + 1 / r) ** (self.slope + 1))
        raw = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        return raw if 0 < raw < 1 else smooth

    def kept(self, c: np.ndarray) -> np.ndarray:
        """The discounted counts d(c) c."""
        c = c.astype(float)
        big = np.maximum(c, 1)
        return np.where(c <= TURING, self.small[np.minimum(c, TURING).astype(int)] * c, c * (1 + 1 / big) ** (self.slope + 1))


class Model:
    """What every block needs beside the counts: totals and discounts (a few numbers)."""

    def __init__(self, stats: dict[int, list[int]], order: int):
        of = [stats.get(k, [0] * (STATS + 2)) for k in range(1, order + 1)]
        self.order, self.n, self.v = order, of[0][0], of[0][1]
        self.discounts = [Discount(x[2:]) for x in of]
        # Kept mass of all words from the counts of counts alone would miss large counts; `unknown` is set from a sum.
        self.unknown = 1.0

    def kept(self, kind: int, c: np.ndarray) -> np.ndarray:
        return self.discounts[kind - 1].kept(c)

    def p_word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.kept(1, c) / max(self.n, 1), self.unknown)


class Scored:
    """A block with its totals: probabilities of its seen n-grams and its share of its contexts' sums."""

    def __init__(self, b: Block, model: Model):
        self.b, self.p = b, [model.p_word(b.of(1).total)]
        self.kept_sum, self.lower_sum = [], []  # by order from 2, over the contexts
        for kind in range(2, model.order + 1):
            g, low = b.of(kind), b.of(kind - 1)
            kept = model.kept(kind, g.total)
            mine = g.seen()
            self.kept_sum.append(np.bincount(g.pre[mine], weights=kept[mine], minlength=len(low.keys)))
            self.lower_sum.append(np.bincount(g.pre[mine], weights=self.p[-1][g.suf[mine]], minlength=len(low.keys)))
            self.p.append(np.where(g.total > 0, kept / np.maximum(low.total[g.pre], 1), 0.0))

    def alpha(self, kind: int) -> np.ndarray:
        """log10 weights of contexts whose n-grams this block holds alone."""
        return _alpha(self.kept_sum[kind - 2], self.b.of(kind - 1).total, self.lower_sum[kind - 2])


def _alpha(kept: np.ndarray, total: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 of the mass that a context keeps over the mass that its lower context has for unseen words."""
    left = 1 - kept / np.maximum(total.astype(np.float64), 1)
    return np.log10(np.maximum(left, 1e-12) / np.maximum(1 - lower, 1e-12))


def _partial(model: Model, buckets: int):
    """A block with its totals: partial scores of its documents, and its share of contexts that others need."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, answers = [], right.to_pylist()
        for row in left.to_pylist():
            b = Block(row, model.order)
            b.learn(answers, model.order)
            s = Scored(b, model)
            logp = np.zeros(len(b.doc_of))
            back_doc, back_at, needed = [], [], 0
            left_over = np.flatnonzero(b.is_token)
            for kind in range(model.order, 1, -1):
                g, low = b.of(kind), b.of(kind - 1)
                here = g.at[left_over]
                seen = g.total[here] > 0
                logp[left_over[seen]] += np.log10(s.p[kind - 1][here[seen]])
                left_over, context = left_over[~seen], g.pre[here[~seen]]
                back = low.total[context] > 0  # an unseen context passes the word on
                at, context = left_over[back], context[back]
                alone = low.own[context]
                logp[at[alone]] += s.alpha(kind)[context[alone]]
                need = np.zeros(len(low.keys), bool)
                need[context[~alone]] = True
                given = (s.kept_sum[kind - 2] > 0) & low.wanted & ~low.own
                use = np.flatnonzero(given | need)
                use = use[np.argsort(low.keys[use])]
                nth = np.empty(len(low.keys), np.int64)
                nth[use] = np.cumsum(need[use]) - 1
                back_doc.append(b.doc_of[at[~alone]])
                back_at.append(needed + nth[context[~alone]])
                needed += int(need.sum())
                for bucket, x, y in _cuts(low.keys[use], buckets):
                    u = use[x:y]
                    rows.append([b.block, kind, bucket, y - x, pack_array(low.keys[u]), pack_array(low.total[u]), pack_array(s.kept_sum[kind - 2][u]), pack_array(s.lower_sum[kind - 2][u]), np.packbits(need[u]).tobytes(), *[None] * 8, 0])
            words = b.of(1)
            logp[left_over] += np.log10(s.p[0][words.at[left_over]])
            c = words.total[words.at]
            base = np.where(b.is_token, np.log10((c + 1) / (model.n + model.v + 1)), 0.0)
            known = (b.is_token & (c > 0)).astype(np.int64)
            docs, at = (np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32) for x in (back_doc, back_at))
            sums = [np.add.reduceat(x, b.starts).tolist() for x in (known, base, logp)]
            rows.append([b.block, 0, -1 - b.block, 0, None, None, None, None, None, b.doc_id, b.held, b.lens.tolist(), *sums, pack_array(docs), pack_array(at), len(docs)])
        return pa.table(_arrays(_PART, rows), names=list(_PART))

    return run


def _weights(group: pa.Table) -> pa.Table:
    """Back-off weights (log10) of a bucket's contexts, returned to the blocks that need them.

    What a block has of its documents comes as a bucket of its own, and goes on as it is.
    """
    none = [None] * (len(_DONE) - 6)
    if group.column("bucket")[0].as_py() < 0:
        return group.select([k for k in _DONE if k != "alpha"]).add_column(4, "alpha", pa.nulls(group.num_rows, pa.binary()))
    rows, distinct, inverse, _, at = _gather(group)
    kept, lower = (np.bincount(inverse, weights=np.concatenate([unpack_array(r[c], np.float64, r["n"]) for r in rows]), minlength=len(distinct)) for c in ("kept", "lower"))
    total = np.zeros(len(distinct), np.int64)
    total[inverse] = np.concatenate([unpack_array(r["total"], np.int64, r["n"]) for r in rows])
    alpha, out = _alpha(kept, total, lower), []
    for r, a, b in zip(rows, at[:-1], at[1:], strict=True):
        need = np.unpackbits(np.frombuffer(r["need"], np.uint8), count=r["n"]).astype(bool)
        if need.any():
            out.append([r["block"], r["kind"], r["bucket"], int(need.sum()), pack_array(alpha[inverse[a:b][need]]), *none, 0])
    return pa.table(_arrays(_DONE, out), names=list(_DONE))


def _final(group: pa.Table) -> pa.Table:
    """A block's documents with the weights that they back off by."""
    rows, out = group.to_pylist(), [[] for _ in _OUT]
    answers = sorted((r for r in rows if r["bucket"] >= 0), key=lambda r: (-r["kind"], r["bucket"]))
    alpha = np.concatenate([unpack_array(r["alpha"], np.float64, r["n"]) for r in answers]) if answers else np.empty(0)
    for r in rows:
        if r["bucket"] >= 0:
            continue
        score = np.array(r["part"], float)
        if r["n_back"]:
            docs, at = unpack_array(r["back_doc"], np.int32, r["n_back"]), unpack_array(r["back_at"], np.int32, r["n_back"])
            score += np.bincount(docs, weights=alpha[at], minlength=len(score))
        for col, v in zip(out, (r["doc_id"], r["held"], r["n_tokens"], r["n_known"], r["base"], score.tolist()), strict=True):
            col += v
    return pa.table([pa.array(c, t) for c, (_, t) in zip(out, _OUT.values(), strict=True)], names=list(_OUT))


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, keep: str | None = None) -> DataFrame:
    """Every document's log10 probability under a model of those for which ``held`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score (the Katz model of n-grams of up to ``order`` words).
    """
    if order < 1:
        raise ValueError("the order is 1 at least")
    scratch = Scratch(docs.sparkSession)
    size = int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + 1)).first()[0] or 0)
    buckets = max(8, -(-size // bucket_bytes))
    # Bucketed by block, so that no later step moves the blocks again.
    blocks = scratch.write_bucketed(blocks_of(docs, held, id_col, text_col, block_bytes), "blocks", "block", max(8, -(-size // block_bytes)))
    kinds = (1,) if order == 1 else (1, 2)
    counted = lambda asks: asks.groupBy("kind", "bucket").applyInArrow(_count, _ddl(_ANSWER))
    every = scratch.write(counted(blocks.mapInArrow(_first_asks(kinds, buckets), _ddl(_ASK))), "answers_2")
    for kind in range(3, order + 1):
        asks = blocks.groupBy("block").cogroup(every.where("block >= 0").groupBy("block")).applyInArrow(_later_asks(kind, buckets), _ddl(_ASK))
        every = every.union(scratch.write(counted(asks), f"answers_{kind}"))
    rows = every.where("stats is not null").groupBy("kind").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(STATS + 2)]).collect()
    model = Model({r["kind"]: [int(r[f"s{i}"]) for i in range(STATS + 2)] for r in rows}, order)
    model.unknown = _unknown_mass(blocks, every, model)
    totals = every.where("block >= 0").groupBy("block")
    # Contexts are summed on their way: only weights and scores are written.
    parts = blocks.groupBy("block").cogroup(totals).applyInArrow(_partial(model, buckets), _ddl(_PART))
    done = scratch.write(parts.groupBy("kind", "bucket").applyInArrow(_weights, _ddl(_DONE)), "done")
    if keep:
        _kept_tables(blocks, totals, model, keep)
    scratch.drop("blocks", "answers_2", *[f"answers_{k}" for k in range(3, order + 1)])
    out = done.groupBy("block").applyInArrow(_final, _ddl(_OUT))
    return out.withColumn("train_tokens", F.lit(model.n).cast("long"))


def _unknown_mass(blocks: DataFrame, answers: DataFrame, model: Model) -> float:
    """1 minus the kept mass of all training words; each word is summed by the block that owns it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = 0.0
            for r in batch.to_pylist():
                counts = unpack_array(r["totals"], np.uint64, r["n"]).astype(np.int64)
                owned = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=3 * r["n"]).reshape(3, -1)[0].astype(bool)
                total += float(model.kept(1, counts[owned & (counts > 0)]).sum())
            yield pa.RecordBatch.from_pydict({"kept": [total]})

    rows = answers.where("kind = 1 and block >= 0").select("n", "totals", "bits").mapInArrow(run, "kept double").agg(F.sum("kept")).first()[0]
    # The start mark is asked for like a word, but is none.
    starts = blocks.select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.sum("n")).first()[0] or 0
    mark = float(model.kept(1, np.array([starts]))[0]) if starts else 0.0
    return 1.0 - ((rows or 0.0) - mark) / max(model.n, 1) if model.n else 1.0


def _kept_tables(blocks: DataFrame, totals, model: Model, path: str) -> None:
    """The model's tables: each n-gram by the block that owns it, each context's weight by an aggregate of those."""

    def ngrams(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[] for _ in _NGRAM]
        answers = right.to_pylist()
        for row in left.to_pylist():
            b = Block(row, model.order)
            b.learn(answers, model.order)
            s = Scored(b, model)
            for kind in range(1, model.order + 1):
                g = b.of(kind)
                mine = g.seen()
                context = b.of(kind - 1).keys[g.pre[mine]] if kind > 1 else np.zeros(int(mine.sum()), np.uint64)
                lower = s.p[kind - 2][g.suf[mine]] if kind > 1 else np.zeros(len(context))
                for col, v in zip(cols, (np.full(len(context), kind), g.keys[mine].view(np.int64), context.view(np.int64), g.total[mine], np.log10(s.p[kind - 1][mine]), lower), strict=True):
                    col.append(v)
        return pa.table([pa.array(np.concatenate(c), t) for c, (_, t) in zip(cols, _NGRAM.values(), strict=True)], names=list(_NGRAM))

    found = blocks.groupBy("block").cogroup(totals).applyInArrow(ngrams, _ddl(_NGRAM))
    found.write.mode("overwrite").partitionBy("order").parquet(f"{path}/ngrams")
    seen = blocks.sparkSession.read.parquet(f"{path}/ngrams").where("order > 1")
    sums = seen.groupBy("order", "context").agg(F.sum(F.pow(F.lit(10.0), "log_p")).alias("p"), F.sum("lower").alias("lower"))
    weights = sums.select("order", F.col("context").alias("key"), F.log10(F.greatest(1 - F.col("p"), F.lit(1e-12)) / F.greatest(1 - F.col("lower"), F.lit(1e-12))).alias("log_alpha"))
    weights.write.mode("overwrite").partitionBy("order").parquet(f"{path}/weights")
