"""Transcript parsing with a hidden Markov model, and canonical turn rendering.

States are the roles. A segment (a turn, or a line of a raw transcript) emits
categorical features: its speaker marker, its length, its questions and its lines.
Emissions and transitions are add-one counts over all training conversations.
Roles are recovered by Viterbi.

Turns are sorted over the cluster and ranked in their conversation; chunks are
``CHUNK`` ranks long. A conversation of one chunk is decoded in place; of a longer one
each chunk becomes a max-plus matrix between the states at its ends, the short chain of
matrices is decoded, and the chunks are decoded again between the states found: no task
holds more than a chunk or a chain, whatever turn numbers a conversation has.

Cases: null text is an empty segment; a text of any length is one segment; a null turn
number sorts first; equal turn numbers are ordered by text; repeated rows are a segment
each; of equally likely roles the first by name is taken; rows without a conversation id
are one conversation each; null roles teach nothing; without training rows the role is
``unknown``; more than ``MAX_ROLES`` roles raise an error, as the model's tables grow
with their square; an empty table gives no rows; columns that are not named are not
read, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

CHUNK = 1024
MAX_ROLES = 64
BROADCAST_ROWS = 200_000  # of 32 bytes; beyond it a shuffled join is used
#: Fixed speaker markers, by class.
MARKERS = {
    "user": ("user", "human", "question", "q", "prompt", "customer"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model"),
    "system": ("system", "instructions", "context"),
}
_MARKER_CLASS = {word: k + 1 for k, words in enumerate(MARKERS.values()) for word in words}
_MARKER = re.compile(r"\s*(?:#+\s*|<\|?|\[|\*\*)?([A-Za-z]{1,12})(?:\|?>|\]|\*\*)?\s*[:>\]]\s*")
SIZES = (len(MARKERS) + 1, 16, 3, 6, 2)  # values of each feature


def marker_of(text: str) -> tuple[int, int]:
    """The marker's class (0 for none) and where the text after it starts."""
    m = _MARKER.match(text)
    kind = _MARKER_CLASS.get(m[1].lower(), 0) if m else 0
    return kind, m.end() if kind else 0


def features_of(text: str) -> tuple[int, ...]:
    return (
        marker_of(text)[0],
        min(len(text).bit_length(), SIZES[1] - 1),
        min(text.count("?"), SIZES[2] - 1),
        min(text.count("\n"), SIZES[3] - 1),
        int(text.rstrip().endswith((".", "!", "?"))),
    )


@dataclass
class Hmm:
    roles: list[str]
    first: np.ndarray  # log probabilities of the first state
    move: np.ndarray
    emit: list[np.ndarray]  # by feature: (states, values)

    @classmethod
    def from_counts(cls, counts: Counter) -> Hmm:
        """counts: (what, role, value) -> n, where what is first, move or a feature's place."""
        roles = sorted({role for what, role, _ in counts})
        if len(roles) > MAX_ROLES:
            raise ValueError(f"more than {MAX_ROLES} roles")
        roles = roles or ["unknown"]
        at = {r: i for i, r in enumerate(roles)}
        first, move, emit = np.ones(len(roles)), np.ones((len(roles), len(roles))), [np.ones((len(roles), s)) for s in SIZES]
        for (what, role, value), n in counts.items():
            if what == "first":
                first[at[role]] += n
            elif what == "move":
                if value in at:
                    move[at[role], at[value]] += n
            else:
                emit[int(what)][at[role], int(value)] += n
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        return cls(roles, log(first), log(move), [log(e) for e in emit])

    def emissions(self, texts: list[str]) -> np.ndarray:
        f = np.array([features_of(t) for t in texts], np.int64).reshape(-1, len(SIZES))
        return sum(self.emit[k][:, f[:, k]].T for k in range(len(SIZES)))

    def decode(self, emissions: np.ndarray, start: np.ndarray, end: int | None = None) -> list[int]:
        """The best states given log scores of the first (and, if told, the last state); ties go to the first state."""
        score, back = start + emissions[0], []
        for e in emissions[1:]:
            each = score[:, None] + self.move
            back.append(each.argmax(0))
            score = each.max(0) + e
        path = [int(score.argmax()) if end is None else end]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def matrix(self, emissions: np.ndarray, first: bool) -> np.ndarray:
        """Best log scores from the state before (the row; alike for a first chunk) to the last state."""
        n = len(self.roles)
        score = (np.tile(self.first, (n, 1)) if first else self.move) + emissions[0]
        for e in emissions[1:]:
            score = (score[:, :, None] + self.move[None]).max(1) + e
        return score


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Rows of equal keys, as columns, from sorted batches."""
    held: dict[str, list] = {}
    last = None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for i, key in enumerate(zip(*(cols[k] for k in keys), strict=True)):
            if key != last and held:
                yield held
                held = {}
            last = key
            for n, c in cols.items():
                held.setdefault(n, []).append(c[i])
    if held:
        yield held


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "at")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for run in _runs(batches, ("conv", "chunk")):
        before = None
        for role, text in zip(run["role"], run["text"], strict=True):
            if role is not None:
                for k, v in enumerate(features_of(text or "")):
                    found[str(k), role, str(v)] += 1
                if before is None and not run["chunk"][0]:
                    found["first", role, ""] += 1
                elif before is not None:
                    found["move", before, role] += 1
            before = role
    keys = list(found)
    yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.string()) for i in range(3)], pa.array([found[k] for k in keys], pa.int64())], names=["what", "role", "value", "n"])


def learn(rows: DataFrame, allowed: Column) -> Hmm:
    """A model from the counts of all allowed rows (conv, chunk, turn, role, text)."""
    counts = _sorted(rows.where(allowed & F.col("role").isNotNull())).mapInArrow(_counted, "what string, role string, value string, n long").groupBy("what", "role", "value").agg(F.sum("n").alias("n"))
    return Hmm.from_counts(Counter({(r.what, r.role, r.value): r.n for r in counts.collect()}))


def _decoded(model, states: bool):
    """Decode chunks: alone, or between the states that columns ``before`` and ``last`` name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = model.value
        out: list[list] = [[], [], [], []]
        for r in _runs(batches, ("conv", "chunk")):
            texts = [t or "" for t in r["text"]]
            before = r["before"][0] if states else None
            start = hmm.first if before is None else hmm.move[before]
            path = hmm.decode(hmm.emissions(texts), start, r["last"][0] if states else None)
            for col, v in zip(out, (r["conv"], r["turn"], [hmm.roles[s] for s in path], r["text"]), strict=True):
                col += v
            if len(out[0]) >= 5000:
                yield _batch(out)
                out = [[], [], [], []]
        yield _batch(out)

    return run


def _batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv", "turn", "role_pred", "text"])


def _matrices(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches, ("conv", "chunk")):
            m = model.value.matrix(model.value.emissions([t or "" for t in r["text"]]), r["chunk"][0] == r["first_chunk"][0])
            yield pa.RecordBatch.from_pydict({"conv": [r["conv"][0]], "chunk": [r["chunk"][0]], "matrix": [m.reshape(-1).tolist()]})

    return run


def _chain(model):
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("chunk").to_pylist()
        n = len(model.value.roles)
        ms = [np.array(r["matrix"]).reshape(n, n) for r in rows]
        score, back = ms[0][0], []
        for m in ms[1:]:
            each = score[:, None] + m
            back.append(each.argmax(0))
            score = each.max(0)
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        return pa.table({"conv": pa.array([r["conv"] for r in rows], pa.int64()), "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "before": pa.array([None, *path[:-1]], pa.int32()), "last": pa.array(path, pa.int32())})

    return run


_OUT = "conv long, turn long, role_pred string, text string"


def _ranked(rows: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """``rows`` (conv, turn, text, ...) with ``at``, which sorts a conversation's turns, and ``chunk``.

    Ranges are cut by any row, equal ones too, so that no conversation and no turn number fills one task;
    the few (range, conversation) pairs that meet tell where each conversation's ranks begin.
    """
    apart = rows.withColumn("apart", F.monotonically_increasing_id())
    ordered = apart.repartitionByRange(F.col("conv"), F.col("turn").asc_nulls_first(), F.col("text"), F.col("apart")).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "text", "apart")
    table = scratch.write(ordered.drop("apart").withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    met = table.where("conv is not null").groupBy("conv", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # Only conversations that a range's edge cuts, or that are long, need ranks; others are one chunk.
    spans = met.groupBy("conv").agg(F.count("*").alias("parts"), F.sum("n").alias("size"))
    cut = scratch.write(spans.where(F.col("size") > chunk).select("conv"), "cut")
    alone = F.when(F.col("conv").isNull(), F.col("at")).otherwise(F.lit(0).cast("long"))
    if cut.isEmpty():
        return table.withColumn("chunk", alone)
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    bases = scratch.write(met.join(cut, "conv").withColumn("base", before).select("conv", "part", "first", "base"), "bases")
    few = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases
    placed = table.withColumn("part", part).join(few, ["conv", "part"], "left")
    nth = F.floor((F.col("at") - F.col("first") + F.col("base")) / chunk)
    return placed.withColumn("chunk", F.coalesce(nth, alone)).drop("part", "first", "base")


def _rows_of(turns: DataFrame, allowed: Column, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return turns.select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), F.coalesce(allowed, F.lit(False)).alias("allowed")
    )


def recover(turns: DataFrame, allowed: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per turn: conv, turn, role_pred and text; roles are learned from the rows that ``allowed`` admits."""
    spark = turns.sparkSession
    scratch = Scratch(spark)
    rows = _ranked(_rows_of(turns, allowed, id_col, turn_col, role_col, text_col), scratch, chunk)
    return _recovered(rows, spark.sparkContext.broadcast(learn(rows, F.col("allowed"))), scratch)


def _recovered(rows: DataFrame, model, scratch: Scratch) -> DataFrame:
    """Ranked rows decoded."""
    spans = rows.where("conv is not null").groupBy("conv").agg(F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))
    long = scratch.write(spans.where("first_chunk <> last_chunk"), "long")
    plain = rows.select("conv", "chunk", "turn", "text", "at")
    if long.isEmpty():
        return _sorted(plain).mapInArrow(_decoded(model, False), _OUT)
    short = _sorted(plain.join(long, "conv", "left_anti")).mapInArrow(_decoded(model, False), _OUT)
    parts = scratch.write(plain.join(long, "conv"), "parts")
    chains = _sorted(parts).mapInArrow(_matrices(model), "conv long, chunk long, matrix array<double>").groupBy("conv").applyInArrow(_chain(model), "conv long, chunk long, before int, last int")
    ends = scratch.write(chains, "ends")
    return short.union(_sorted(parts.select("conv", "chunk", "turn", "text", "at").join(ends, ["conv", "chunk"])).mapInArrow(_decoded(model, True), _OUT))


_ANY_MARKER = r"(?i)^\s*(?:#+\s*|<\|?|\[|\*\*)?(?:{0})(?:\|?>|\]|\*\*)?\s*[:>\]]\s*".format("|".join(sorted(_MARKER_CLASS, key=lambda w: (-len(w), w))))


def rendered(role: Column, text: Column) -> Column:
    """A turn in canonical form, without the marker that named its speaker."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _ANY_MARKER, "")), F.lit("\n<|end|>\n"))


def parse_text(docs: DataFrame, turns: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Raw transcripts (one text each) as canonical turns: doc_id, line (the turn's first), role, rendered.

    The model is learned from ``turns`` alone. A turn begins where the role changes and at
    every speaker marker; blank lines belong to the turn before them, those ahead of the
    first turn to it. Every row of ``docs`` is a transcript of its own, whatever its id
    (null, negative, shared); one without a non-blank line gives one row whose line, role
    and rendering are null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    taught = _ranked(_rows_of(turns, allowed, "conv_id", "turn", "role", "text"), scratch, chunk)
    model = spark.sparkContext.broadcast(learn(taught, F.col("allowed")))
    own = docs.select(F.monotonically_increasing_id().alias("conv"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw = scratch.write(own, "raw")
    lines = raw.select("conv", F.posexplode(F.split("text", "\n")).alias("turn", "text"))
    spoken = Scratch(spark)
    rows = _ranked(lines.where(F.trim("text") != "").select("conv", F.col("turn").cast("long").alias("turn"), "text"), spoken, chunk)
    said = spoken.write(_recovered(rows, model, spoken), "said")
    w = Window.partitionBy("conv").orderBy("turn")  # one text's lines
    begins = (F.lag("role_pred").over(w).isNull() | (F.lag("role_pred").over(w) != F.col("role_pred")) | F.col("text").rlike(_ANY_MARKER)).cast("int")
    nth = said.withColumn("begins", begins).select("conv", "turn", "role_pred", "begins")
    whole = lines.select("conv", F.col("turn").cast("long").alias("turn"), "text").join(nth, ["conv", "turn"], "left")
    marked = whole.withColumn("nth", F.greatest(F.sum(F.coalesce("begins", F.lit(0))).over(w), F.lit(1)))
    grouped = marked.groupBy("conv", "nth").agg(F.min(F.when(F.col("role_pred").isNotNull(), F.col("turn"))).alias("line"), F.first("role_pred", ignorenulls=True).alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("text"))
    found = grouped.where("role is not null").select("conv", "line", "role", rendered(F.col("role"), F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("rendered"))
    return raw.select("conv", "doc_id").join(found, "conv", "left").select("doc_id", "line", "role", "rendered")
