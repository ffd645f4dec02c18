"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one class, and only classes go on. Bands of
their signatures give buckets of candidates. In a bucket, pairs are compared batch
of signature values by batch; a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold (uniform prior) is below
``MISS``. Survivors are verified on the full shingle sets.

Two rounds keep large groups from being compared pair by pair. First each tile of
a bucket of the first ``FIRST_BANDS`` bands (tiles are dealt by a hash that differs from
band to band) sends only a spanning forest of its best survivors to verification. Then
buckets of any band that still hold
several components are cut into units of two tiles; a bucket whose units would take in
more rows than dealing it out again by a second shared band, or a third, is dealt out
before that, so that documents that only share a passage part. Units are
compared on signatures alone; only rows of pairs across components that survive go
on with their full sets, and are verified there, the likeliest first.

Nothing is capped: a link is missed only with the chosen probabilities. There are so
many bands that a pair at the threshold shares at least ``DEPTH`` but with ``MISS``.

Cases: null or empty text has an empty set and is linked with nothing; a text of any
length is one set; a row without an id is linked with nothing and kept; of rows that
share an id each is judged by its own text; repeated rows are one class; of equal ids
all rows are kept; an empty table gives no rows; other columns are ignored, whatever
they are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, mix64, slices, text_bytes, trimmed
from .components import components

SHINGLE = 5
PERCENT = 80  # links: 100 * intersection >= PERCENT * union
ROWS = 5  # signature values in a band
DEPTH = 3  # bands by which a pair may be dealt
HASHES, BATCH = 128, 16  # signature values at least, and those compared at once
MISS = 1e-6  # probability that a pair at the threshold shares fewer than DEPTH bands, and that a batch drops it
FIRST_BANDS = 12  # whose buckets the first round looks into: it need only join up large groups
TILE = 128
BROADCAST_ROWS = 1_000_000  # of 16 bytes; beyond it a shuffled join is used



@cache
def _factors(hashes: int) -> np.ndarray:
    """Odd multipliers, one for each hash function; fewer are the first of more."""
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 32, hashes, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def band_count(percent: int = PERCENT, miss: float = MISS, depth: int = DEPTH) -> int:
    """Bands of which a pair at the threshold shares fewer than ``depth`` with probability ``miss`` at most."""
    p, bands = (percent / 100) ** ROWS, depth
    while sum(comb(bands, k) * p**k * (1 - p) ** (bands - k) for k in range(depth)) > miss:
        bands += 1
    return bands


def hash_count(bands: int) -> int:
    """Signature values, in whole batches: those of the bands, and ``HASHES`` at least."""
    return -(-max(HASHES, bands * ROWS) // BATCH) * BATCH


def least_matches(percent: int = PERCENT, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(k, m): after k values, pairs with fewer than m equal ones are dropped.

    With a uniform prior the posterior P(J >= t | m of k) is P(Bin(k + 1, t) <= m).
    """
    t, out = percent / 100, []
    for k in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append((k, m))
    return out


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a shorter text is one shingle."""
    vocab: dict[bytes, int] = defaultdict(count().__next__)
    ids = [np.fromiter(map(vocab.__getitem__, t.lower().split()), np.int64) for t in texts]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocab], np.uint64)
    out = []
    for x in ids:
        n = len(x)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        words, k = hashes[x], min(n, size)
        mixed = words[: n - k + 1] + np.uint64(k)
        for i in range(1, k):
            mixed = mix64(mixed) + words[i : n - k + 1 + i]
        out.append(np.unique(mix64(mixed)))
    return out


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The least value of each hash function over a set."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best, factors = np.full(hashes, np.iinfo(np.uint32).max, np.uint32), _factors(hashes)[:, None]
    for at in range(0, len(low), 512):
        best = np.minimum(best, (low[None, at : at + 512] * factors + high[None, at : at + 512]).min(1))
    return best


def _class_of(shingles: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def _sign(size: int, bands: int):
    hashes = hash_count(bands)
    salt = np.arange(1, bands + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(text_bytes(part.column(1)), size)
                full = np.array([len(x) > 0 for x in sets], bool)
                sigs = np.stack([signature(x, hashes) for x in sets if len(x)]) if full.any() else np.empty((0, hashes), np.uint32)
                keys = np.tile(salt, (len(sigs), 1))
                for k in range(ROWS):
                    keys = mix64(keys + sigs[:, k : bands * ROWS : ROWS])
                nth, sigs = np.cumsum(full) - 1, sigs.astype(np.uint16)
                keys = keys.view(np.int64)
                told = [(_class_of(x), sigs[i].tobytes(), keys[i].tolist()) if len(x) else (None, None, None) for x, i in zip(sets, nth.tolist(), strict=True)]
                names, sigs, keys = zip(*told, strict=True) if told else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "th", "n", "cid", "sig", "bands"],
                )

    return trimmed(run)


def _survivors(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (left[i], right[i]) no batch drops, and their equal values."""
    small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
    live = np.flatnonzero(100 * small >= percent * large)
    same, done = np.zeros(len(live), np.int64), 0
    for k, least in steps:
        same = same + (sig[left[live], done:k] == sig[right[live], done:k]).sum(1)
        keep = same >= least
        live, same, done = live[keep], same[keep], k
    return live, same


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray | list]]:
    """Runs of equal keys in sorted rows; a run may go on in the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        if not now.num_rows:
            continue
        change = np.zeros(now.num_rows, bool)
        for k in keys:
            col = now.column(k).to_numpy()
            change[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(change).tolist()
        edges = [0, *starts]
        yield from _cut(now.slice(0, edges[-1]), edges)
        held = now.slice(edges[-1])
    if held is not None and held.num_rows:
        yield from _cut(held, [0, held.num_rows])


def _cut(rows: pa.Table, edges: list[int]) -> Iterator[dict]:
    if not rows.num_rows:
        return
    cols = {c: rows.column(c).to_numpy() for c in rows.column_names if c not in ("sig", "s", "bands")}
    if "s" in rows.column_names:
        cols["s"] = rows.column("s").to_pylist()
    if "bands" in rows.column_names:
        cols["bands"] = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    cols["sig"] = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(rows.num_rows, -1)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield {c: v[a:b] for c, v in cols.items()}


def _forest(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> list[int]:
    """Indices of a heaviest spanning forest."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.argsort(-weight, kind="stable").tolist():
        a, b = find(int(left[i])), find(int(right[i]))
        if a != b:
            root[a] = b
            out.append(i)
            if len(out) == n - 1:
                break
    return out


def _emit(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _within_tiles(steps, percent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in _groups(batches, ["key", "tile"]):
            left, right = np.triu_indices(len(g["cid"]), 1)
            live, same = _survivors(g["sig"], g["n"], left, right, steps, percent)
            if len(live):
                chosen = live[_forest(len(g["cid"]), left[live], right[live], same)]
                a.append(g["cid"][left[chosen]])
                b.append(g["cid"][right[chosen]])
            if len(a) > 5000:
                yield _emit(a, b)
                a, b = [], []
        yield _emit(a, b)

    return trimmed(run)


def _crossing(g: dict, steps, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A unit's pairs across components that no batch drops, and their equal values.

    A unit is one tile with itself, or two tiles: rows of side 0 against rows of side 1.
    Pairs meet in several bands; those that they share first see to them.
    """
    side, label = g["side"], g["label"]
    if side.min() == side.max():
        left, right = np.triu_indices(len(side), 1)
    else:
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = np.repeat(first, len(second)), np.tile(second, len(first))
    apart = label[left] != label[right]
    left, right = left[apart], right[apart]
    live, same = _survivors(g["sig"], g["n"], left, right, steps, percent)
    left, right = left[live], right[live]
    met = g["bands"][left] == g["bands"][right]
    own, path = np.ones(len(left), bool), int(g["path"][0])
    while path:
        band = path % _PLACE - 1
        own &= met.argmax(1) == band
        met[:, band] = False
        path //= _PLACE
    return left[own], right[own], same[own]


_PLACE = 1 << 12  # a path holds a unit's bands, the first one lowest, each as a digit from 1
_UNIT = ("key", "i", "j", "side", "path", "cid", "label")


def _possible(steps, percent):
    """The rows of units that stand in a pair that may be a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for g in _groups(batches, ["key", "i", "j"]):
            left, right, _ = _crossing(g, steps, percent)
            if len(left):
                use = np.union1d(left, right)
                held.append({c: g[c][use] for c in _UNIT})
            if len(held) > 2000:
                yield _rows(held)
                held = []
        if held:
            yield _rows(held)

    return trimmed(run)


def _rows(held: list[dict]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "path": pa.int64(), "cid": pa.int64(), "label": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[c] for h in held]), kinds.get(c, pa.int32())) for c in _UNIT], names=list(_UNIT))


def _across(steps, percent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["key", "i", "j"]):
            left, right, same = _crossing(g, steps, percent)
            label, sets = g["label"], [np.frombuffer(x, np.uint64) for x in g["s"]]
            root = {x: x for x in label.tolist()}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            chosen = []
            for k in np.argsort(-same, kind="stable").tolist():  # the likeliest first: later pairs of one component need no look
                a, b = int(left[k]), int(right[k])
                x, y = find(int(label[a])), find(int(label[b]))
                if x != y and _similar(sets[a], sets[b], percent):
                    root[x] = y
                    chosen.append(k)
            yield _emit([g["cid"][left[chosen]]], [g["cid"][right[chosen]]])

    return trimmed(run)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("sa", "sb")]
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                ok[i] = _similar(x, y, percent)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return trimmed(run)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(text_bytes(part.column(1)), size)
                rows = [(c, s.tobytes()) for c, s in zip(part.column(0).to_pylist(), sets, strict=True) if len(s) and _class_of(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cid", "s"])

    return trimmed(run)


def _sets_of(cids: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch, tag: str, size: int) -> DataFrame:
    """(cid, s): the full sets of some classes, from one text each."""
    wanted = scratch.write(cids.distinct().join(reps.select("cid", F.col("rep").alias("doc_id")), "cid"), f"{tag}_wanted")
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("cid", "text")
    # Rows that share an id and a text give a set twice; what is found with them is made distinct later.
    sets = scratch.write(texts.mapInArrow(_sets(size), "cid long, s binary"), f"{tag}_sets")
    scratch.drop(f"{tag}_wanted")
    return sets


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, scratch: Scratch, tag: str, size: int, percent: int) -> DataFrame:
    """The pairs of classes whose full sets are similar enough."""
    pairs = scratch.write(pairs.distinct(), f"{tag}_pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))), reps, docs, scratch, tag, size)
    joined = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    out = scratch.write(joined.select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long"), f"{tag}_links")
    scratch.drop(f"{tag}_sets", f"{tag}_pairs")
    return out


def _mixed(rows: DataFrame) -> DataFrame:
    """Buckets of several components: their sizes, and their largest component with its rows."""
    told = "later" in rows.columns
    shares = rows.groupBy("key", "label").agg(F.count("*").alias("n_label"), *([F.sum("later").alias("later")] if told else []))
    deals = [F.sum("later").alias("deals")] if told else []
    whole = shares.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n_label").alias("size"), F.max(F.struct("n_label", "label")).alias("top"), *deals)
    return whole.where("kinds > 1").select("key", "size", F.col("top.n_label").alias("n_top"), F.col("top.label").alias("top"), *(["deals"] if told else []))


def _unit_rows(tile: int) -> Column:
    """Rows that a bucket's units take in."""
    rest = F.col("size") - F.col("n_top")
    rest_tiles, top_tiles = F.ceil(rest / tile), F.ceil(F.col("n_top") / tile)
    return F.when(F.col("size") <= 2 * tile, F.col("size")).otherwise(rest * (rest_tiles + top_tiles) + F.col("n_top") * rest_tiles)


def _cells(rows: DataFrame, tile: int) -> DataFrame:
    """Units of two tiles: the largest component's rows meet only the other rows; those meet each other too.

    What fits into two tiles is one unit.
    """
    unit = rows.withColumns({
        "is_top": F.col("label") == F.col("top"),
        "top_tiles": F.ceil(F.col("n_top") / tile).cast("int"),
        "rest_tiles": F.ceil((F.col("size") - F.col("n_top")) / tile).cast("int"),
    })
    own = F.pmod(F.xxhash64("cid", "key"), F.when(F.col("is_top"), F.col("top_tiles")).otherwise(F.col("rest_tiles"))).cast("int")
    unit = unit.withColumn("own", own)
    cell = "struct<i:int,j:int,side:int>"
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")).cast(cell))
    rest = F.transform(F.sequence(F.lit(0), F.col("rest_tiles") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") > k).cast("int").alias("side")).cast(cell))
    to_top = F.transform(F.sequence(F.lit(0), F.col("top_tiles") - 1), lambda k: F.struct((-1 - k).cast("int").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")).cast(cell))
    from_top = F.transform(F.sequence(F.lit(0), F.col("rest_tiles") - 1), lambda k: F.struct((-1 - F.col("own")).cast("int").alias("i"), k.cast("int").alias("j"), F.lit(0).alias("side")).cast(cell))
    cells = unit.select("key", "path", "cid", "label", F.explode(F.when(F.col("size") <= 2 * tile, whole).when(F.col("is_top"), from_top).otherwise(F.concat(rest, to_top))).alias("c"))
    return cells.select("key", "c.i", "c.j", "c.side", "path", "cid", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept; kept rows are the first of their component."""
    return judged(docs, id_col, text_col, size, percent, miss, tile).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """``near_duplicates`` with th (the hash of the row's text) and label (one a component, which shared ids are not)."""
    spark = docs.sparkSession
    scratch, bands = Scratch(spark), band_count(percent, miss)
    steps = least_matches(percent, miss, hash_count(bands))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.write(docs.withColumn("th", F.xxhash64("text")).mapInArrow(_sign(size, bands), "doc_id long, th long, n long, cid long, sig binary, bands array<long>"), "signed")
    named = signed.where("cid is not null and doc_id is not null")
    reps = scratch.write(named.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "reps")
    rows = reps.select("cid", F.posexplode("bands").alias("band", "key"))
    multi = scratch.write(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "multi")
    members = scratch.write(rows.join(multi, "key"), "members")
    sigs = reps.select("cid", "n", "sig")

    tiles = members.where(F.col("band") < FIRST_BANDS).withColumn("tile", F.pmod(F.xxhash64("cid", "key"), F.ceil(F.col("size") / tile)).cast("int"))
    tiled = tiles.join(sigs, "cid").select("key", "tile", "cid", "n", "sig").repartition("key", "tile").sortWithinPartitions("key", "tile")
    first = _links(tiled.mapInArrow(_within_tiles(steps, percent), "a long, b long"), reps, docs, scratch, "one", size, percent)
    labels = components(first, scratch, "cc1")

    labelled = members.join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("key", "band", "cid", F.coalesce("label", "cid").alias("label"))
    labelled = scratch.write(labelled, "labelled")
    # In a bucket of two the first round has seen the only pair, if it looked there.
    seen = labelled.where(F.col("band") < FIRST_BANDS)
    mixed = scratch.write(_mixed(seen).where("size > 2").union(_mixed(labelled.where(F.col("band") >= FIRST_BANDS))), "mixed")
    later = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("band"))) - 1  # a class has one row a band
    live = scratch.write(labelled.join(mixed, "key").withColumn("later", later), "live")
    deals = live.groupBy("key").agg(F.sum("later").alias("deals"))
    rows, cells, depth = live.join(deals, "key").withColumn("path", (F.col("band") + 1).cast("long")), None, 1
    others = live.select("cid", F.col("band").alias("next"), F.col("key").alias("second"), "later")
    while True:
        # Where units would take in more rows than another shared band deals out, it deals them out again.
        wide = (2 * F.col("deals") < _unit_rows(tile)) if depth < DEPTH else F.lit(False)
        some = _cells(rows.where(~wide), tile)
        cells = some if cells is None else cells.union(some)
        if depth == DEPTH or rows.where(wide).isEmpty():
            break
        again = rows.where(wide).select("key", "path", "band", "cid", "label").join(others, "cid").where("next > band")
        again = again.select(F.xxhash64("key", "second").alias("key"), (F.col("path") + (F.col("next") + 1) * F.lit(_PLACE**depth)).alias("path"), F.col("next").alias("band"), "cid", "label", "later")
        dealt = scratch.write(again, f"dealt{depth}")
        rows, depth = scratch.write(dealt.join(_mixed(dealt), "key"), f"rows{depth}"), depth + 1
    cells = scratch.write(cells, "cells")
    signatures = reps.select("cid", "n", "sig", "bands")
    units = cells.join(signatures, "cid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    kinds = {"key": "long", "path": "long", "cid": "long", "label": "long"}
    likely = scratch.write(units.mapInArrow(_possible(steps, percent), ", ".join(f"{c} {kinds.get(c, 'int')}" for c in _UNIT)), "likely")
    scratch.drop("cells", "live", *[f"{t}{k}" for t in ("dealt", "rows") for k in range(1, DEPTH)])
    full = signatures.join(_sets_of(likely.select("cid"), reps, docs, scratch, "two", size), "cid")
    units = likely.join(full, "cid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    second = scratch.write(units.mapInArrow(_across(steps, percent), "a long, b long"), "two_links")
    scratch.drop("two_sets", "likely")
    labels = components(first.union(second), scratch, "cc2")

    classes = reps.select("cid", "rep").join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("cid", "rep", F.coalesce("label", "cid").alias("label"))
    least = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = scratch.write(classes.join(least, "label").select("cid", "component_id", "label"), "of_class")
    scratch.drop("multi", "members", "labelled", "mixed", "one_links", "two_links", "reps")
    out = signed.select("doc_id", "th", F.col("n").alias("n_shingles"), "cid").join(of_class, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th", "label")
