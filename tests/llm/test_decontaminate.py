import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktile.llm import decontaminate as D

from .util import EDGES, docs, prose

ITEMS = "item_id long, text string"


def brute(texts, items, window=10):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (p := tuple(w[k : k + size])) in wins:
                    hit.update(range(k, k + size))
                    found |= wins[p]
        out.append((len(w), len(hit), sorted(found)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 5))
def test_index_finds_all(symbols, size):
    s = np.array([*[x + 1 if x else 0 for x in symbols], 0], np.int32)
    index = D.FMIndex(s, 4, rate=3)
    patterns = {tuple(s[k : k + size].tolist()) for k in range(len(s) - size + 1) if (s[k : k + size] > 1).all()} | {(2,) * size}
    phrases = np.array(sorted(patterns), np.int32)
    low, high = index.search(phrases, np.full(len(phrases), size))
    for p, a, b in zip(phrases, low, high, strict=True):
        expected = [k for k in range(len(s) - size + 1) if (s[k : k + size] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (50, 2), (500, 3), (2000, 50)):
        s = rng.integers(1, k, n) if k > 1 else np.ones(n, np.int64)
        assert D.suffix_array(s.astype(np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def corpus():
    rng = random.Random(3)
    items = [(k, prose(rng, n)) for k, n in enumerate([30, 12, 10, 4, 1])] + [(9, "w1 " * 12), (10, None), (11, ""), (12, "...")]
    texts = [*EDGES, *(prose(rng, 80) for _ in range(30))]
    for k in range(12):
        body = items[k % 5][1].split()
        texts.append(prose(rng, 15) + " " + " ".join(body[:11]).upper() + ", " + prose(rng, 9) + " " + " ".join(body[-10:]))
    return [*texts, texts[-1], "w1 " * 40], items


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 200])
def test_matches_brute_force(spark, block_bytes):
    texts, items = corpus()
    found = D.search(docs(spark, texts), spark.createDataFrame(items, ITEMS), shard_words=3000, block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.hit_items) for r in found] == brute(texts, items)


def test_removal_empty_and_clashes(spark):
    item = "w1 w2 w3 w4 w5 w6 w7 w8 w9 wa wb"
    texts = [f"Before it. {item.upper()}! After.", item, "clean text stays", None, ""]
    table = docs(spark, texts).selectExpr("*", "1 as n_hit", "'x' as extra")
    kept = {r.doc_id: r for r in D.remove_spans(table, spark.createDataFrame([(0, item)], ITEMS)).collect()}
    assert set(kept) == {0, 2, 3, 4} and kept[0].text == "Before it. ! After." and kept[0].n_chars == len(kept[0].text)
    assert kept[2].text == texts[2] and kept[0].extra == "x"
    assert D.search(docs(spark, []), spark.createDataFrame([(0, item)], ITEMS)).count() == 0
    assert D.search(docs(spark, texts), spark.createDataFrame([], ITEMS)).where("n_hit > 0").isEmpty()

