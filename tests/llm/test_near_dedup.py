import math
import random

import numpy as np
import pytest

from sparktile.llm import near_dedup, stages
from sparktile.llm.common import Scratch
from sparktile.llm.components import components

from .util import EDGES, docs, prose


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def corpus():
    rng = random.Random(11)
    texts = list(EDGES)
    for _ in range(12):
        base = prose(rng, rng.choice([20, 120, 400])).split()
        for k in range(rng.choice([2, 5, 9])):
            copy = list(base)
            for _ in range(k * len(base) // 90):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(50))
            texts.append(" ".join(copy))
    texts += [prose(rng, 60) for _ in range(30)]
    passage = prose(rng, 60)
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(20)]
    base = prose(rng, 200).split()
    for _ in range(150):  # a large group of near copies, of which many pairs are no links
        copy = list(base)
        for _ in range(rng.randrange(1, 14)):
            copy[rng.randrange(len(copy))] = "other" + str(rng.randrange(900))
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("size", "percent", "tile"), [(3, 85, 256), (5, 80, 16)])
def test_matches_brute_force(spark, size, percent, tile):
    texts = corpus()
    found = near_dedup.near_duplicates(docs(spark, texts), size=size, percent=percent, tile=tile).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in found] == brute(texts, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_missing_and_shared_ids_and_empty(spark):
    rows = [(None, "a b c d e f", None), (None, "a b c d e f", None), (5, "a b c d e f", "x"), (7, "a b c d e f", "y"), (7, "q r s t u v", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = near_dedup.near_duplicates(table).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [(-1, -1, True), (-1, -1, True), (5, 5, True), (7, 5, False), (7, 7, True)]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_stage_keeps_one_row_of_each_group(spark):
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(5, "a b c d e f"), (7, "a b c d e f"), (7, "q r s t u v"), (7, "q r s t u v"), (8, "q r s t u v"), (9, base), (9, base + " more"), (None, "a b c d e f"), (None, "a b c d e f"), (3, ""), (3, None)]
    table = spark.createDataFrame([(k, t, len(t or "")) for k, t in rows], "doc_id long, text string, n_chars long")
    out = stages.near_dedup(spark, table, "")
    assert out.columns == table.columns
    found = [(r.doc_id, r.text) for r in out.collect()]
    nine = [r for r in found if r[0] == 9]
    assert len(nine) == 1 and nine[0] in rows
    expected = [(5, "a b c d e f"), (7, "q r s t u v"), (None, "a b c d e f"), (None, "a b c d e f"), (3, ""), (3, None)]
    assert sorted(map(repr, found)) == sorted(map(repr, [*expected, *nine]))


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001 + k) for k in range(300)] + [(5000, 5000)]
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")
    labels = {r.v: r.label for r in components(df, Scratch(spark), "t").collect()}
    assert set(labels.values()) == {0, 1000} and len(labels) == 201 + 301


def test_posterior_limits():
    steps = near_dedup.least_matches(85, 1e-6)
    assert [k for k, _ in steps] == list(range(16, 129, 16)) and all(m < 0.85 * k for k, m in steps)
    assert (1 - 0.85**4) ** near_dedup.band_count(85, 1e-6) <= 1e-6
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):  # pairs at the threshold are hardly ever dropped
        same = np.cumsum(rng.random(128) < 0.85)
        lost += any(same[k - 1] < m for k, m in steps)
    assert lost == 0



def test_units_of_a_shared_passage(spark, monkeypatch):
    """Documents that share a long passage and are no links: no pair is verified, and units take in few rows a document."""
    rows: dict[str, int] = {}

    class Counting(near_dedup.Scratch):
        def write(self, df, tag):
            out = super().write(df, tag)
            rows[tag] = out.count()
            return out

    monkeypatch.setattr(near_dedup, "Scratch", Counting)
    made = {}
    for n in (1000, 4000):
        rng = random.Random(3)
        passage = prose(rng, 100, 100_000)
        texts = [prose(rng, 30, 100_000) + " " + passage + " " + prose(rng, 30, 100_000) for _ in range(n)]
        rows.clear()
        found = near_dedup.near_duplicates(docs(spark, texts), size=3, percent=85)
        assert found.where("not kept").isEmpty()
        made[n] = rows["cells"] + sum(c for t, c in rows.items() if t.startswith("dealt")) + rows["likely"]
        assert rows["likely"] == 0
    assert made[1000] <= 12 * 1000 and made[4000] <= 28 * 4000  # 45 a document with full sets, before buckets were dealt again


def test_shared_bands_are_enough():
    """A pair at the threshold shares fewer bands than it may be dealt by with the chosen probability at most."""
    for percent in (80, 85, 95):
        b, p = near_dedup.band_count(percent), (percent / 100) ** near_dedup.ROWS
        few = sum(math.comb(b, k) * p**k * (1 - p) ** (b - k) for k in range(near_dedup.DEPTH))
        assert few <= near_dedup.MISS and near_dedup.hash_count(b) >= b * near_dedup.ROWS
