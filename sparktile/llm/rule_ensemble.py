"""Quality classifier: a sparse ensemble of rules over document statistics.

Shallow trees are grown on bootstrap samples of a bounded labelled sample; the
paths to their nodes are conjunctive rules; a lasso logistic regression keeps few
of them; the kept rules and weights are compiled into one Spark column expression.

Cases: null text counts as empty, whose statistics are all zero; a text of any length
is read whole; a document with several labels has their mean, rounded half up; null
labels teach nothing; of rows that share an id one teaches, the first in the hash order
of its text; without labels of both kinds the score is the smoothed share of label 1;
equal scores need no order; repeated rows are scored one by one; an empty table gives no
rows; other columns are neither read nor changed, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, place, positional, release, text_bytes
from .features import Counted, class_table, duplicate_lines, lengths_of

SAMPLE_ROWS = 8000  # labelled rows that the trees and the lasso are fitted on, at most
SLICE = 2 << 20  # bytes of text whose words are held at once
TREES, DEPTH, CUTS = 40, 3, 24
TREE_ROWS = 2000  # rows of the sample that each tree is grown on, drawn with replacement
LASSO = 0.002
THRESHOLD = 0.3

STATS = ("log_bytes", "log_words", "word_bytes", "symbols", "pipes", "marks", "upper", "digits", "stops", "newlines", "wide", "distinct_words", "repeated_lines", "repeated_words")
_CLASSES = {
    "symbols": class_table(b"#*$%&|<>{}[]=~^_\\"),
    "pipes": class_table(b"|"),
    "marks": class_table(b"!?"),
    "upper": class_table(bytes(range(65, 91))),
    "digits": class_table(bytes(range(48, 58))),
    "stops": class_table(b".,;:"),
    "newlines": class_table(b"\n"),
    "wide": class_table(bytes(range(192, 256))),
}


def statistics_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    counted = Counted(texts)
    size = np.maximum(counted.sizes, 1)
    out = {k: counted.count(t) / size for k, t in _CLASSES.items()}
    words, distinct, adjacent, lines, again = (np.zeros(len(texts)) for _ in range(5))
    for i, text in enumerate(texts):
        w = text.lower().split()
        kinds = len(set(w))
        words[i], distinct[i], adjacent[i] = len(w), kinds, len(set(zip(w, w[1:], strict=False)))
        lines[i], again[i] = duplicate_lines(text)
    many = np.maximum(words, 1)
    return out | {
        "log_bytes": np.log1p(counted.sizes),
        "log_words": np.log1p(words),
        "word_bytes": counted.sizes / many,
        "distinct_words": distinct / many,
        "repeated_lines": again / np.maximum(lines, 1),
        "repeated_words": np.where(words > 1, 1 - adjacent / np.maximum(words - 1, 1), 0),
    }


_SCHEMA = "struct<" + ",".join(f"{s}:double" for s in STATS) + ">"


def _statistics(texts: pa.Array) -> pa.Array:
    parts, at, raw = [], 0, text_bytes(texts)
    sizes = np.cumsum(lengths_of(raw))
    while at < len(raw):
        base = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + SLICE, side="right")))
        parts.append(statistics_of(raw[at:end]))
        at = end
    cols = [np.concatenate([p[s] for p in parts]) if parts else np.empty(0) for s in STATS]
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in cols], names=list(STATS))


def statistics(text_col: str) -> Column:
    """The statistics of a text column, computed in Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        out = _statistics(texts)
        release()
        return out

    return F.arrow_udf(run, _SCHEMA)(F.col(text_col).cast("string"))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut): value > cut if above, else value <= cut


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for stat, above, cut in rule:
        out &= (x[:, stat] > cut) == above
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, path: Rule, depth: int, rules: set[Rule]) -> None:
    if path:
        rules.add(tuple(sorted(path)))
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = (0.0, None)
    impurity = y.mean() * (1 - y.mean())
    for stat in rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False).tolist():
        for cut in np.unique(np.quantile(x[:, stat], np.linspace(0.02, 0.98, CUTS)).astype(np.float32).astype(float)).tolist():
            above = x[:, stat] > cut
            k = int(above.sum())
            if not 5 <= k <= len(y) - 5:
                continue
            p, q = y[above].mean(), y[~above].mean()
            gain = impurity - (k * p * (1 - p) + (len(y) - k) * q * (1 - q)) / len(y)
            if gain > best[0] + 1e-12:
                best = (gain, (stat, cut))
    if best[1] is None:
        return
    stat, cut = best[1]
    above = x[:, stat] > cut
    for side in (True, False):
        _grow(x[above == side], y[above == side], rng, (*path, (stat, side, cut)), depth - 1, rules)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, turns: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps."""
    n, k = r.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1.0)
    for _ in range(turns):
        error = 1 / (1 + np.exp(-np.clip(r @ v + c, -40, 40))) - y
        new = v - step * (r.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias = c - step * error.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), bias + (t - 1) / t2 * (bias - b)
        w, b, t = new, bias, t2
    return w, float(b)


@dataclass
class RuleEnsemble:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def score(self, stats: str) -> Column:
        """The compiled score over a struct column of statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for stat, above, cut in rule:
                value = F.col(f"{stats}.{STATS[stat]}")
                test = test & ((value > F.lit(cut)) if above else (value <= F.lit(cut)))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, trees: int = TREES, penalty: float = LASSO) -> RuleEnsemble:
    """Rules from trees on bootstrap samples, then a lasso over them."""
    if len(y) < 20 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(bias=float(np.log(share / (1 - share))))
    rng, rules = np.random.default_rng(seed), set()
    for _ in range(trees):
        pick = rng.integers(0, len(y), min(len(y), TREE_ROWS))
        _grow(x[pick], y[pick], rng, (), DEPTH, rules)
    ordered = sorted(rules)
    held = np.stack([_holds(r, x) for r in ordered], 1)
    share = held.mean(0)
    _, first = np.unique(np.packbits(held, axis=0), axis=1, return_index=True)
    use = np.array([i for i in sorted(first.tolist()) if 0.003 <= share[i] <= 0.997], int)
    if not len(use):
        return fit(x[:0], y[:0])
    w, b = _lasso(held[:, use].astype(float), y.astype(float), penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([ordered[use[i]] for i in keep], [float(w[i]) for i in keep], b)


def _sample(labels: DataFrame, allowed: Column, id_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(doc_id, label) of at most ``sample_rows`` documents, the first in hash order."""
    known = labels.where(allowed & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    mean = (F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int")
    return known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(mean.alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def learn(stats: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """A model from the statistics (doc_id, th, stats) of at most ``sample_rows`` labelled documents."""
    chosen = _sample(labels, allowed, id_col, label_col, sample_rows)
    rows = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("stats", "th").alias("stats")).orderBy("doc_id").collect()
    x = np.array([[float(v) for v in r["stats"]] for r in rows], float).reshape(-1, len(STATS))
    return fit(x, np.array([r["label"] for r in rows], float))


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, stats): th orders rows that share an id."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), statistics(text_col).alias("stats"))


def score(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, stats, score and predicted, learned from labels that ``allowed`` admits."""
    stats = Scratch(docs.sparkSession).write(_measured(docs, id_col, text_col), "statistics")  # texts are read once
    model = learn(stats, labels, allowed, **options)
    out = stats.drop("th").withColumn("score", model.score("stats"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their own columns.

    The model is that of ``score``: only the sample's statistics are computed before it.
    """
    scratch = Scratch(docs.sparkSession)
    small = _sample(labels, allowed, "doc_id", label_col, sample_rows).select("doc_id")
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(small), "doc_id")
    model = learn(scratch.write(_measured(sample, "doc_id", "text"), "statistics"), labels, allowed, label_col=label_col, sample_rows=sample_rows)
    scratch.drop("statistics")
    inner, names = positional(docs)
    return inner.withColumn("stats", statistics(place(names, text_col))).where(model.score("stats") >= THRESHOLD).drop("stats").toDF(*names)
