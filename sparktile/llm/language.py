"""Language identification with bit-sliced Bloom filters over byte 4-grams.

One table of slots serves all languages: a slot is a mask with a bit for each
language, so the slots of an n-gram's hashes, ANDed, are the set of all languages
whose filter holds it. A document's votes are the popcounts by language, corrected
for each filter's false positives.

The filters are fitted on a bounded sample (expected ``SAMPLE_PER_LANGUAGE`` documents
of each language, chosen by a hash of id and text; equal texts once). A language's
filter takes the ``MAX_KEPT`` most frequent n-grams of its sample that make up at least
``LEAST_SHARE`` of them, so that it stays sparse: these are parameters of the fit, and
every n-gram of every document is looked up when documents are judged.

Cases: null text or one without a letter is ``und`` with score 0; a text of any length
is read whole; a text whose n-grams no filter holds gets the most frequent language with
score 0; ties go to the first name; languages are compared as strings; without learned
languages all is ``und``; more than ``MAX_LANGUAGES`` raise an error, as each adds a bit
to every slot; repeated rows and rows that share an id are judged one by one; an empty
table gives no rows; only id, text and lang are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pack_array, slices, text_bytes, unpack_array
from .features import lengths_of, sums_between

SAMPLE_PER_LANGUAGE = 1000
MAX_LANGUAGES = 1024
MAX_KEPT = 12_000  # n-grams in one filter, the most frequent ones
LEAST_SHARE = 2e-5  # of a language's n-grams
SLOT_BITS = 17
HASHES = (2654435761, 2246822519, 3266489917)  # odd multipliers
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BLANK = np.uint32(0x20202020)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 4-grams of a slice of padded texts, and where each text's start and end."""
    raw = _FOLD[np.frombuffer(b"".join(b" " + t + b"   " for t in texts), np.uint8)].astype(np.uint32)
    ends = np.cumsum(lengths_of(texts) + 4)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(len(raw) - 3, 0)
    return raw[:n] | raw[1 : n + 1] << np.uint32(8) | raw[2 : n + 2] << np.uint32(16) | raw[3 : n + 3] << np.uint32(24), starts, ends - 3


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode(errors="replace"))) if text else False


@dataclass
class Filters:
    languages: list[str]
    default: int
    slots: np.ndarray  # (words, slots): masks of 8 languages each
    false_rate: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the set of languages that hold it."""
        out = None
        for h in HASHES:
            found = self.slots[:, (grams * np.uint32(h)) >> np.uint32(32 - SLOT_BITS)]
            out = found if out is None else out & found
        return out

    def decide(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        grams, starts, ends = grams_of(texts)
        masks = self.masks(grams)
        real = grams != _BLANK
        masks[:, ~real] = 0
        n = sums_between(real.view(np.uint8), starts, ends)
        votes = np.stack([sums_between((masks[k // 8] >> (k % 8)) & 1, starts, ends) for k in range(len(self.languages))], 1)
        votes = np.maximum((votes - n[:, None] * self.false_rate) / (1 - self.false_rate), 0)
        total, best = votes.sum(1), votes.argmax(1)
        score = np.where(total > 0, votes.max(1) / np.maximum(total, 1e-12), 0)
        best = np.where(total > 0, best, self.default)
        said = [self.languages[k] if has_letter(t[:256]) or has_letter(t) else "und" for k, t in zip(best.tolist(), texts, strict=True)]
        return said, np.where([x == "und" for x in said], 0.0, np.clip(score, 0, 1))


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language, one row a batch and language."""
    for batch in batches:
        for part in slices(batch, "text"):
            langs = np.array(part.column(0).to_pylist())
            texts = text_bytes(part.column(1))
            out: list[list] = [[], [], [], []]
            for lang in sorted(set(langs.tolist())):
                grams, starts, ends = grams_of([t for t, x in zip(texts, langs, strict=True) if x == lang])
                inside = np.zeros(len(grams) + 1, np.int8)
                np.add.at(inside, starts[starts < len(inside)], 1)
                np.add.at(inside, ends[ends < len(inside)], -1)
                grams = grams[(np.cumsum(inside[:-1]) > 0) & (grams != _BLANK)]
                kinds, times = np.unique(grams, return_counts=True)
                for col, v in zip(out, (lang, len(kinds), pack_array(kinds), pack_array(times.astype(np.uint32))), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["lang", "n", "grams", "times"])


def _kept_grams(max_kept: int, least_share: float):
    """One language's n-grams that its filter takes."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        kinds, inverse = np.unique(np.concatenate([unpack_array(r["grams"], np.uint32, r["n"]) for r in rows]), return_inverse=True)
        times = np.bincount(inverse, weights=np.concatenate([unpack_array(r["times"], np.uint32, r["n"]) for r in rows]))
        order = np.argsort(-times, kind="stable")[:max_kept]
        keep = kinds[order[times[order] >= least_share * times.sum()]]
        return pa.table({"lang": pa.array([rows[0]["lang"]], pa.string()), "n": pa.array([len(keep)], pa.int32()), "grams": pa.array([pack_array(keep)], pa.binary())})

    return run


def learn(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, max_kept: int = MAX_KEPT, least_share: float = LEAST_SHARE) -> Filters:
    """Filters of all languages that the allowed rows name."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    named = docs.where(allowed).select(F.xxhash64(F.col(id_col).cast("string"), text).alias("th"), lang.alias("lang"), text.alias("text")).where("lang is not null")
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    size = 1 << SLOT_BITS
    slots = np.zeros((max(1, -(-len(languages) // 8)), size), np.uint8)
    false_rate = np.zeros(len(languages))
    if not languages:
        return Filters([], 0, slots, false_rate)
    draw = F.pmod(F.col("th"), F.lit(1 << 20))
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int((1 << 20) * per_language / n) + 1)) for k, n in counts.items()])
    sample = named.where(F.col("text").isNotNull() & (draw < limit)).dropDuplicates(["lang", "th"]).select("lang", "text")
    grams = sample.mapInArrow(_sample_grams, "lang string, n int, grams binary, times binary")
    # One row a language reaches the driver, of at most max_kept n-grams.
    for r in grams.groupBy("lang").applyInArrow(_kept_grams(max_kept, least_share), "lang string, n int, grams binary").collect():
        k, keep = languages.index(r.lang), unpack_array(r.grams, np.uint32, r.n)
        for h in HASHES:
            slots[k // 8, (keep * np.uint32(h)) >> np.uint32(32 - SLOT_BITS)] |= np.uint8(1 << (k % 8))
        false_rate[k] = ((slots[k // 8] >> (k % 8)) & 1).mean() ** len(HASHES)
    default = languages.index(max(languages, key=lambda x: (counts[x], x)))
    return Filters(languages, default, slots, false_rate)


def identify(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Per document: doc_id, lang_pred and score, learned from the rows that ``allowed`` admits."""
    bound_batches(docs.sparkSession)
    filters = docs.sparkSession.sparkContext.broadcast(learn(docs, allowed, id_col, text_col, lang_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                said, score = filters.value.decide(text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")
