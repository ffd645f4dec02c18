"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bulk-synchronous supersteps over Spark tables. Documents' last pieces are range-sorted
by length, so that equal lengths form runs whose members have ranks; gaps are runs of
sequences with equal room, sorted by size. A superstep deals both by rank to shards of
about ``SHARD_SEQUENCES`` sequences; every shard, in its own task, sweeps its runs from
the longest down: a run's successor is the smallest gap that it fits, equal claims are
settled by rank, gaps shrink, and the sweep goes on with what is left. A shard opens
only as many sequences as its tokens fill; documents that then find no gap, and gaps
that are left, are the next superstep's tables, dealt to a ``FAN``-th of the shards,
until one shard is left, which opens what it still needs. A shard whose rest exceeds
``REST`` of its tokens (or two sequences) opens sequences for it at once, so that rests
fall by a fixed factor from step to step. A task's state are runs and gap sizes, at most ``capacity``
of each and few ranges of them, whatever the number of documents.

Cases: null text is an empty document of one token (the end id); a document
longer than the capacity is cut and its full pieces fill sequences alone; equal
lengths are ranked by range order; repeated rows, and rows that share an id, are packed
one by one; an empty table gives no rows; only the id and the text are read, so
columns of other names, whatever they are called, change nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, slices, text_bytes, trimmed

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 400_000  # of each of two generations
SHARD_SEQUENCES = 1024  # that the tokens of one shard fill
FAN = 16  # shards of a superstep for each one of the next
REST = 0.05  # of a shard's tokens that may wait for the next superstep
BROADCAST_ROWS = 100_000  # of 32 bytes; beyond it joins are shuffled

_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_JOINED = 512  # plain words encoded in one call
_LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(k) for k in range(0xDF, 0x100) if k != 0xF7)  # lower-case letters that NFC keeps
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch  # words of these, in UTF-8


class ChunkTokenizer:
    """Token ids of whole texts through a bounded cache of white-space-free chunks.

    Where the vocabulary's tokens never span white space, nor an ASCII letter and the
    punctuation after it, and it folds case, a text's ids are the ids of its chunks, and
    a chunk's those of its letters and of its closing punctuation. Whether a tokenizer
    does so is tried when it is loaded, over all pairs of ASCII characters; one that does
    not encodes whole texts. Words of lower-case Latin letters, which are as normalised
    already, are encoded without its normaliser if that makes no difference to all pairs
    of such letters. The cache has two generations and lives as long as the Python worker.
    """

    _kept: dict[str, ChunkTokenizer] = {}

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.new, self.old, self.most = Tokenizer.from_file(path), {}, {}, cache_words
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.chunked = not any(c.isspace() for w in vocabulary for c in w) and self._falls_into_chunks()
        self.bare = self.chunked and self._leaves_plain_words()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _falls_into_chunks(self) -> bool:
        """Whether probes' ids are those of their parts."""
        seen = [chr(k) for k in range(33, 127)]
        pairs = [x + y for x in seen for y in seen]
        apart = dict(zip(pairs, self._encoded(pairs), strict=True))
        for space in (" ", "\n", "\t \r\x0b\x0c"):
            if self._encoded([space.join(pairs)])[0] != b"".join(apart.values()):
                return False
        tails = [chr(k) for k in _PUNCTUATION]
        tails += [x + y for x in tails for y in tails]
        stem, *ends = self._encoded(["word", *tails])
        if self._encoded(["word" + t for t in tails]) != [stem + t for t in ends]:
            return False
        return self._encoded(["A Mixed WORD"]) == self._encoded(["a mixed word"])

    def _leaves_plain_words(self) -> bool:
        """Whether the normaliser changes no pair of plain letters."""
        normalizer = self.tokenizer.normalizer
        pairs = " ".join(x + y for x in _LATIN for y in _LATIN)
        return normalizer is not None and normalizer.normalize_str(pairs) == pairs

    @classmethod
    def of_worker(cls, path: str) -> ChunkTokenizer:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _learn(self, words: set[bytes]) -> None:
        unknown = words.difference(self.new)
        if len(self.new) + len(unknown) > self.most:
            self.old, self.new, unknown = self.new, {}, words
        new, old, parts, wanted = self.new, self.old, [], set()
        again = old.keys() & unknown if old else ()
        new.update(zip(again, map(old.__getitem__, again)))
        plain = set(filter(_PLAIN, unknown.difference(again)))
        odd = []
        for w in unknown.difference(again, plain):
            stem = w.rstrip(_PUNCTUATION)
            if len(stem) < len(w) and stem and (97 <= stem[-1] <= 122 or _PLAIN(stem)) and b"<|" not in w:
                tail = w[len(stem) :]
                parts.append((w, stem, tail))
                wanted.add(stem)
                wanted.add(tail)
            else:
                odd.append(w)
        for w in wanted.difference(new, plain, odd):
            if w in old:
                new[w] = old[w]
            elif _PLAIN(w):
                plain.add(w)
            else:
                odd.append(w)
        plain = list(plain)
        normalizer = self.tokenizer.normalizer
        if self.bare:
            self.tokenizer.normalizer = None
        try:
            for at in range(0, len(plain), _JOINED):
                self._learn_plain(plain[at : at + _JOINED])
        finally:
            self.tokenizer.normalizer = normalizer
        new.update(zip(odd, self._encoded([w.decode() for w in odd]), strict=True))
        for w, stem, tail in parts:
            new[w] = new[stem] + new[tail]

    def _learn_plain(self, words: list[bytes]) -> None:
        """Words of plain letters in one call; each ends with its only token that ends a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.uint32)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(words) or cuts[-1] != 4 * len(ids):
            self.new.update(zip(words, self._encoded([w.decode() for w in words]), strict=True))
            return
        blob, at = ids.tobytes(), 0
        for w, end in zip(words, cuts, strict=True):
            self.new[w] = blob[at:end]
            at = end

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.chunked:
            return self._encoded([t.decode() for t in texts])
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]  # special tokens are taken as written
        self._learn(set().union(*split))
        return [b"".join(map(self.new.__getitem__, words)) for words in split]


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked, ids (binary)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ChunkTokenizer.of_worker(tokenizer_path)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                cols: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer.ids(text_bytes(part.column(1))), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        for col, v in zip(cols, (doc, piece, at // 4, len(cut) // 4, zlib.crc32(cut), cut), strict=True):
                            col.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                kept = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:kept], types, strict=False)], names=names[:kept])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias(text_col))
    return source.mapInArrow(trimmed(run), schema)


Run = tuple[int, int, int, int]  # length, shard of origin, first local rank, members
Placed = tuple[int, int, int, int, int, int]  # length, shard of origin, first local rank, members, first sequence, offset
Gap = tuple[int, int, int]  # size, first sequence, sequences


def sweep(runs: list[Run], gaps: list[Gap], capacity: int, first: int, most: int | None) -> tuple[list[Placed], list[Run], list[Gap]]:
    """Best fit of runs, longest first, into the tightest gaps: what was placed, what found no place, and gaps left.

    At most ``most`` sequences are opened (None: any number), numbered from ``first``.
    Member k of a placed row sits in the row's first sequence + k. Gaps of one size are
    kept as ranges of sequences, so that whole ranges move at once.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    placed, rest, opened = [], [], 0

    def give(size: int, at: int, count: int) -> None:
        if size and count:
            if size not in room:
                room[size] = []
                insort(order, size)
            room[size].append((at, count))

    for size, at, count in sorted(gaps, reverse=True):
        give(size, at, count)
    for length, origin, rank, left in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
        while left:
            at = bisect_left(order, length)  # the successor among the gaps
            if at < len(order):
                size = order[at]
                begin, count = room[size].pop()
                take = min(left, count)
                if take < count:
                    room[size].append((begin + take, count - take))
                if not room[size]:
                    del room[size], order[at]
            else:
                size, begin = capacity, first + opened
                take = -(-left // (capacity // length))
                if most is not None:
                    take = min(take, most - opened)
                if not take:
                    rest.append((length, origin, rank, left))
                    break
                opened += take
            placed.append((length, origin, rank, take, begin, capacity - size))
            give(size - length, begin, take)
            rank, left = rank + take, left - take
    return placed, rest, [(size, at, count) for size in order for at, count in room[size]]


_STEP = {"kind": ("int", pa.int32()), "length": ("long", pa.int64()), "origin": ("long", pa.int64()), "rank": ("long", pa.int64()), "n": ("long", pa.int64()), "sequence": ("long", pa.int64()), "offset": ("long", pa.int64())}
_PLACED, _RUN, _GAP = 0, 1, 2  # kinds of rows; a gap's length is its size


def _superstep(step: int, last: bool, capacity: int):
    """One shard's sweep over its rows."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        cols = [c.to_pylist() for c in (group.column(k) for k in ("kind", "length", "origin", "rank", "n", "sequence"))]
        rows = list(zip(*cols, strict=True))
        runs = [(length, origin, rank, n) for kind, length, origin, rank, n, _ in rows if kind == _RUN]
        gaps = [(length, sequence, n) for kind, length, _, _, n, sequence in rows if kind == _GAP]
        tokens = sum(r[0] * r[3] for r in runs)
        full = (tokens - sum(g[0] * g[2] for g in gaps)) // capacity
        first = (step << 56) + (int(key[0].as_py()) << 24)  # a shard opens fewer sequences than 2^24
        placed, rest, left = sweep(runs, gaps, capacity, first, None if last else max(0, full))
        if not last and sum(r[0] * r[3] for r in rest) > max(REST * tokens, 2 * capacity):
            placed, rest, left = sweep(runs, gaps, capacity, first, None)
        out = [(_PLACED, *p) for p in placed] + [(_RUN, *r, None, None) for r in rest]
        out += [(_GAP, size, None, None, n, sequence, None) for size, sequence, n in left] if rest or not last else []
        return pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_STEP.values())], names=list(_STEP))

    return run


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of the next superstep, range-sorted and dealt by rank; gaps that no run fits stay behind."""
    least = rows.where(F.col("kind") == _RUN).agg(F.min("length")).first()[0]
    rows = rows.where((F.col("kind") == _RUN) | (F.col("length") >= F.lit(least)))
    if shards == 1:
        return rows.withColumn("shard", F.lit(0).cast("long"))
    ordered = rows.repartitionByRange("kind", "length", "origin", "rank", "sequence").sortWithinPartitions("kind", "length", "origin", "rank", "sequence")
    return ordered.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_sequences: int = SHARD_SEQUENCES, **options) -> DataFrame:
    """Pieces with sequence_id and offset; sequences hold at most ``capacity`` tokens without gaps."""
    scratch = Scratch(docs.sparkSession)
    pieces = tokenized(docs, tokenizer_path, capacity=capacity, **options)
    table = scratch.write(pieces, "pieces")
    # Equal lengths side by side, ties cut at any row: no length can fill one task.
    ordered = table.repartitionByRange("length", "doc_id", "piece", "start").sortWithinPartitions("length", "doc_id", "piece")
    at = F.monotonically_increasing_id()
    ranked = scratch.write(ordered.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)), "ranked")
    scratch.drop("pieces")
    # At most one row for each partition and length that meet: range order bounds this by partitions + capacity.
    met = ranked.groupBy("_part", "length").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")
    met = scratch.write(met.withColumn("_base", before), "met")
    tokens = met.agg(F.sum(F.col("length") * F.col("n"))).first()[0] or 0
    shards = max(1, -(-tokens // (capacity * shard_sequences)))
    # A length's members go round the shards: member r is number r // shards of shard r % shards.
    runs = met.groupBy("length").agg(F.sum("n").alias("_n"))
    runs = runs.select("length", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_n"), F.lit(shards)) - 1)).alias("origin"))
    n = F.floor((F.col("_n") - F.col("origin") - 1) / shards) + 1
    null = F.lit(None).cast("long")
    rows = runs.select(F.lit(_RUN).alias("kind"), "length", "origin", F.lit(0).cast("long").alias("rank"), n.alias("n"), null.alias("sequence"), null.alias("offset"), F.col("origin").alias("shard"))
    placed, step, now = [], 0, shards
    while True:
        swept = rows.groupBy("shard").applyInArrow(_superstep(step, now == 1, capacity), ", ".join(f"{k} {t}" for k, (t, _) in _STEP.items()))
        done = scratch.write(swept, f"step{step}")
        placed.append(done.where(F.col("kind") == _PLACED).drop("kind"))
        rest = done.where(F.col("kind") != _PLACED)
        if now == 1 or rest.where(F.col("kind") == _RUN).isEmpty():
            break
        step, now = step + 1, -(-now // FAN)
        rows = _dealt(rest, now)
    every = placed[0]
    for p in placed[1:]:
        every = every.union(p)
    segment = F.struct("rank", "sequence", "offset")
    plan = scratch.write(every.groupBy("length", "origin").agg(F.array_sort(F.collect_list(segment)).alias("segments")), "plan")
    nth = F.col("_at") - F.col("_first") + F.col("_base")
    out = ranked.join(_sized(met.drop("n")), ["_part", "length"]).withColumn("origin", nth % shards).withColumn("_rank", F.floor(nth / shards))
    out = out.join(_sized(plan), ["length", "origin"]).withColumn("_s", _last_begun(F.col("segments"), F.col("_rank")))
    return out.select(
        *[c for c in ranked.columns if not c.startswith("_")],
        (F.col("_s")["sequence"] + F.col("_rank") - F.col("_s")["rank"]).alias("sequence_id"),
        F.col("_s")["offset"].alias("offset"),
    )


def _last_begun(segments: Column, rank: Column) -> Column:
    """The last segment that starts at or before a rank: segments are in rank order and start at 0."""
    return F.element_at(segments, F.size(F.filter(segments, lambda s: s["rank"] <= rank)))


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """The real output: one row a sequence with its token ids (binary, little-endian 32-bit) and its pieces."""
    packed = pack(docs, tokenizer_path, capacity=capacity, with_ids=True, **options)
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"),
    )
