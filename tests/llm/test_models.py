import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktile.llm import katz, language, ngram_logistic, rule_ensemble, transcripts
from sparktile.llm.common import fold, pack_array, unpack_array

from .util import EDGES, docs, prose

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=240):
    """Good prose, and bad documents of marks and shouting; every third has no label."""
    rng = random.Random(5)
    good = [k % 3 != 0 for k in range(n)]
    texts = [prose(rng, 60) + "." if g else " ".join(w.upper() + "!!" if k % 2 else w + "$$$ |" for w in prose(rng, 40).split()) for k, g in enumerate(good)]
    labels = [(k, int(g), 0) for k, g in enumerate(good)] + [(3, 0, 0), (None, 1, 0), (4, None, 0)]
    return texts, good, spark.createDataFrame(labels, LABELS)


def test_packed_arrays():
    for dtype in (np.uint8, np.int32, np.uint64, np.float64):
        x = np.random.default_rng(0).integers(0, 200, 1000).astype(dtype)
        assert (unpack_array(pack_array(x), dtype, 1000) == x).all()
    assert len(unpack_array(pack_array(np.empty(0, np.int32)), np.int32, 0)) == 0


def test_fold_is_crc32(spark):
    df = spark.createDataFrame([(0,), (17,), (None,)], "doc_id long")
    assert [r[0] for r in df.select(fold("doc_id", 5)).collect()] == [zlib.crc32(x) % 5 for x in (b"0", b"17", b"")]


def test_rule_ensemble(spark):
    texts, good, labels = labelled(spark)
    table = docs(spark, texts + EDGES).withColumn("score", F.lit("x")).withColumn("stats", F.lit(1))
    found = rule_ensemble.score(table, labels, fold("doc_id", 5) != 0).orderBy("doc_id").collect()
    held = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([found[k].predicted == good[k] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    kept = rule_ensemble.keep_good(docs(spark, texts), labels, fold("doc_id", 5) != 0)
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.predicted and r.doc_id < len(texts)}


def test_rules_compile_to_the_same_scores(spark):
    texts, good, _ = labelled(spark)
    stats = rule_ensemble.statistics_of([t.encode() for t in texts])
    x = np.stack([stats[s] for s in rule_ensemble.STATS], 1)
    model = rule_ensemble.fit(x, np.array(good, float))
    assert model.rules and max(len(r) for r in model.rules) <= rule_ensemble.DEPTH
    margin = model.bias + sum(w * rule_ensemble._holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    column = docs(spark, texts).select("doc_id", rule_ensemble.statistics("text").alias("s")).select("doc_id", model.score("s").alias("p")).orderBy("doc_id")
    assert np.allclose([r.p for r in column.collect()], 1 / (1 + np.exp(-margin)))


def test_no_labels(spark):
    empty = spark.createDataFrame([], LABELS)
    assert [r.score for r in rule_ensemble.score(docs(spark, ["a b"]), empty, F.lit(True)).collect()] == [0.5]
    assert rule_ensemble.score(docs(spark, []), empty, F.lit(True)).count() == 0
    assert ngram_logistic.judge(docs(spark, []), empty).count() == 0
    assert ngram_logistic.judge(docs(spark, ["a b"]), empty).first().base_failed


def quality_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines, seen, dup = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_quality_rules(spark):
    texts, good, labels = labelled(spark)
    texts = texts + EDGES + ["a b c d e f\n" * 3, "one two\n\n one two\none two\n" + "x y z " * 5]
    found = ngram_logistic.judge(docs(spark, texts), labels).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found] == [quality_base(t) for t in texts]
    assert np.mean([(found[k].probability >= 0.3) == good[k] for k in range(240)]) > 0.95
    assert all(not (r.kept and r.base_failed) for r in found)


def brute_katz(tokens, held, order):
    """Counts, probabilities and weights of every order, one n-gram at a time; START stands before a document."""
    grams = [Counter() for _ in range(order + 1)]
    for t, h in zip(tokens, held, strict=True):
        row = ["START"] * (order - 1) + t
        for i in range(order - 1, len(row)) if not h else ():
            for k in range(1, order + 1):
                grams[k][tuple(row[i - k + 1 : i + 1])] += 1
    of = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, katz.STATS + 1)]
    discounts = [None] + [katz.Discount(of(c)) for c in grams[1:]]
    totals = [Counter() for _ in range(order + 1)]  # of contexts, by the order of what follows them
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            totals[k][g[:-1]] += c
    n = sum(grams[1].values())
    p = [None] * (order + 1)
    for k in range(1, order + 1):
        p[k] = {g: float(discounts[k].kept(np.array([c]))[0]) / (n if k == 1 else totals[k][g[:-1]]) for g, c in grams[k].items()}
    unknown = 1 - sum(p[1].values())
    alpha = [{} for _ in range(order + 1)]
    for k in range(2, order + 1):
        kept, lower = Counter(), Counter()
        for g in grams[k]:
            kept[g[:-1]] += p[k][g]
            lower[g[:-1]] += p[k - 1][g[1:]]
        alpha[k] = {h: (1 - kept[h]) / (1 - lower[h]) for h in kept}

    def prob(g):
        k = len(g)
        if g in p[k]:
            return p[k][g]
        return unknown if k == 1 else alpha[k].get(g[:-1], 1.0) * prob(g[1:])

    return grams, alpha, prob, n


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_against_brute_force(spark, tmp_path, order):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 60), 25) for _ in range(120)] + EDGES[:6] + [" The the THE ", "new words unseen"] + ["w1 w2 w3 w4 w5 w6"] * 9
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    keep = str(tmp_path / "model")
    table = docs(spark, texts).withColumn("block", F.lit(1)).withColumn("kind", F.lit("x"))  # names that the operator uses itself
    found = katz.score(table, fold("doc_id", 7) == 2, order=order, block_bytes=4000, bucket_bytes=4000, keep=keep).orderBy("doc_id").collect()
    tokens = [(t or "").encode().lower().split() + [b""] for t in texts]
    grams, alpha, prob, n = brute_katz(tokens, held, order)
    vocabulary = [(w,) for (w,) in grams[1]]
    for k in range(2, order + 1):  # every context sums to one over all words and the unknown one
        for h in list(alpha[k])[::7]:
            assert sum(prob(h + w) for w in vocabulary) + prob((*h, "unheard")) == pytest.approx(1)
    for r, t, h in zip(found, tokens, held, strict=True):
        row = ["START"] * (order - 1) + t
        score = sum(math.log10(prob(tuple(row[i : i + order]))) for i in range(len(t)))
        base = sum(math.log10((grams[1][(w,)] + 1) / (n + len(grams[1]) + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(t), sum((w,) in grams[1] for w in t), n)
        assert r.score == pytest.approx(score) and r.base_score == pytest.approx(base)
    # The kept tables hold every n-gram once, and a weight for every context.
    kept = spark.read.parquet(f"{keep}/ngrams").collect()
    for k in range(1, order + 1):
        assert sorted(r["count"] for r in kept if r.order == k) == sorted(grams[k].values())
    if order > 1:
        weights = spark.read.parquet(f"{keep}/weights").collect()
        for k in range(2, order + 1):
            assert np.allclose(sorted(r.log_alpha for r in weights if r.order == k), sorted(np.log10(list(alpha[k].values()))))


def test_katz_counts_do_not_wrap():
    """Totals beyond 2^32, as a frequent word has in a large corpus."""
    key, most = pack_array(np.array([7, 9], np.uint64)), np.iinfo(np.uint32).max
    rows = [[1, 0, b, 2, key, pack_array(np.array([most, 1], np.uint32)), pack_array(np.array([0, 3], np.uint32)), None] for b in range(3)]
    import pyarrow as pa

    out = katz._count(pa.table(katz._arrays(katz._ASK, rows), names=list(katz._ASK))).to_pylist()
    assert [unpack_array(r["totals"], np.uint64, 2).tolist() for r in out[:3]] == [[3 * most, 3]] * 3
    assert out[3]["stats"][:2] == [3 * most + 3, 2]


def test_katz_empty_and_untrained(spark):
    assert katz.score(docs(spark, []), F.lit(False)).count() == 0
    rows = katz.score(docs(spark, ["a b", None]), F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0), (1, 0, 0)] and all(math.isfinite(r.score) for r in rows)


def test_language(spark):
    rng = random.Random(4)
    kinds = {"xx": "the and ing tion with for".split(), "yy": "der und ung keit mit für".split(), "zz": "que ción los para ñ con".split()}
    rows = []
    for k in range(300):
        lang = sorted(kinds)[k % 3]
        words = kinds[lang]
        rows.append((k, " ".join("".join(rng.choices(words, k=rng.randrange(1, 3))) for _ in range(30)), None if k % 10 == 9 else lang))
    extra = [(900 + k, t, "xx") for k, t in enumerate([None, "", "12 34 !?", "...", "ß", "漢"])]
    table = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("th", F.lit(2))
    found = {r.doc_id: r for r in language.identify(table, fold("doc_id", 5) != 0).collect()}
    assert np.mean([found[k].lang_pred == sorted(kinds)[k % 3] for k in range(300)]) > 0.98
    assert [found[900 + k].lang_pred for k in range(4)] == ["und"] * 4 and found[904].lang_pred in kinds and found[905].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.identify(docs(spark, ["a b c"]), F.lit(False)).first().lang_pred == "und"
    assert language.identify(docs(spark, []), F.lit(True)).count() == 0


def test_language_masks_are_exact_sets_and_more(spark):
    """Every n-gram that a filter took is found in it, and a verdict is that of the corrected votes."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["foo", "bar", "foobar"] if k % 2 else ["baz", "qux", "bazqux"], k=20)), k % 2) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang int")  # languages that are no strings
    filters = language.learn(table, F.lit(True), max_kept=10_000, least_share=0.0)
    assert filters.languages == ["0", "1"]
    for k, x in enumerate(("baz qux bazqux", "foo bar foobar")):
        grams, starts, ends = language.grams_of([x.encode()])
        grams = grams[: int(ends[0])]
        assert (filters.masks(grams[1:-2])[0] >> k & 1).mean() > 0.4
    found = {r.doc_id: r for r in language.identify(table, F.lit(True)).collect()}
    assert all(found[k].lang_pred == str(k % 2) for k in range(60))
    votes = []
    for _, t, _ in rows:
        grams, starts, ends = language.grams_of([t.encode()])
        grams = grams[starts[0] : ends[0]]
        masks = language.learn(table, F.lit(True)).masks(grams)[0] if not votes else masks0(grams)
        if not votes:
            own = language.learn(table, F.lit(True))
            masks0 = lambda g, own=own: own.masks(g)[0]
        n = len(grams)
        votes.append([max(((masks >> k & 1).sum() - n * own.false_rate[k]) / (1 - own.false_rate[k]), 0) for k in range(2)])
    assert [found[k].score for k in range(60)] == pytest.approx([max(v) / sum(v) for v in votes])


def test_bloom_masks_hold_what_was_put_in():
    filters = language.Filters(["a", "b"], 0, np.zeros((1, 1 << language.SLOT_BITS), np.uint8), np.zeros(2))
    grams = np.random.default_rng(0).integers(0, 1 << 32, 500, dtype=np.uint64).astype(np.uint32)
    for h in language.HASHES:
        filters.slots[0, (grams * np.uint32(h)) >> np.uint32(32 - language.SLOT_BITS)] |= np.uint8(2)
    assert (filters.masks(grams) == 2).all()


TURNS = "conv_id long, turn long, role string, text string"


def conversations(n=40):
    rng = random.Random(8)
    rows = []
    for c in range(n):
        if c % 4 == 0:
            rows.append((c, 0, "system", "You are " + prose(rng, 4)))
        for t in range(1, rng.randrange(3, 9)):
            rows.append((c, t, "user", prose(rng, 6) + "?") if t % 2 else (c, t, "assistant", prose(rng, 40) + ".\n" + prose(rng, 20)))
    return rows


def test_transcripts_and_chunks(spark):
    rows = conversations()
    table = spark.createDataFrame(rows, TURNS)
    ok = fold("conv_id", 5) != 0
    whole = {(r.conv, r.turn): r.role_pred for r in transcripts.recover(table, ok).collect()}
    assert np.mean([whole[c, t] == role for c, t, role, _ in rows]) > 0.97
    cut = {(r.conv, r.turn): r.role_pred for r in transcripts.recover(table, ok, chunk=3).collect()}
    assert np.mean([cut[k] == whole[k] for k in whole]) > 0.95  # the model lacks the moves between chunks, the decoding does not


def test_viterbi_over_chunks_equals_viterbi():
    rng = np.random.default_rng(6)
    hmm = transcripts.Hmm(["a", "b", "c"], np.log([0.5, 0.3, 0.2]), np.log(rng.dirichlet(np.ones(3), 3)), [])
    e = rng.normal(size=(9, 3))
    best = max(np.ndindex(*(3,) * 9), key=lambda s: hmm.first[s[0]] + sum(e[k, s[k]] for k in range(9)) + sum(hmm.move[s[k], s[k + 1]] for k in range(8)))
    assert hmm.decode(e, hmm.first) == list(best)
    m = [hmm.matrix(e[:4], True), hmm.matrix(e[4:], False)]
    total = (m[0][0][:, None] + m[1]).max()
    assert total == pytest.approx(hmm.first[best[0]] + sum(e[k, best[k]] for k in range(9)) + sum(hmm.move[best[k], best[k + 1]] for k in range(8)))
    assert hmm.decode(e[:4], hmm.first, best[3]) == list(best[:4]) and hmm.decode(e[4:], hmm.move[best[3]]) == list(best[4:])


def test_transcript_edges(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (1, None, None, None), (1, 2, "user", ""), (1, 2, "user", "")]
    found = transcripts.recover(spark.createDataFrame(rows, TURNS), F.lit(True)).collect()
    assert len(found) == 5 and {r.role_pred for r in found} == {"user"}
    assert transcripts.recover(spark.createDataFrame([], TURNS), F.lit(True)).count() == 0
    raw = docs(spark, ["User: what is it?\nAssistant: it is a thing.\nand more of it.\nHuman: why?", None, ""])
    taught = spark.createDataFrame([(k, t, r, x) for k in range(20) for t, r, x in ((0, "user", "User: what?"), (1, "assistant", "Assistant: it is so."))], TURNS)
    every = transcripts.parse_text(raw, taught, F.lit(True)).orderBy("doc_id", "line").collect()
    turns = [r for r in every if r.doc_id == 0]
    assert turns[0].role == "user" and turns[0].rendered == "<|user|>\nwhat is it?\n<|end|>\n" and turns[-1].rendered == "<|user|>\nwhy?\n<|end|>\n"
    assert [(r.doc_id, r.line, r.role, r.rendered) for r in every[len(turns) :]] == [(1, None, None, None), (2, None, None, None)]


def test_parsed_transcripts_lose_and_leak_nothing(spark):
    """Null, negative and shared ids, blank lines, and two turns of one speaker in a row."""
    taught = spark.createDataFrame([(-5 + k, t, r, x) for k in range(20) for t, r, x in ((0, "user", "User: what?"), (1, "assistant", "Assistant: it is so."))], TURNS)
    rows = [(-4, "\nUser: one?\n\nAssistant: two.\n\nand on"), (4, "User: three?"), (4, "User: four?\nUser: five?"), (None, "User: six?")]
    raw = spark.createDataFrame(rows, "doc_id long, text string").withColumn("conv", F.lit(9)).withColumn("turn", F.lit("x"))
    found = sorted(((r.doc_id or 0, r.line, r.rendered.split("\n", 1)[1].removesuffix("\n<|end|>\n")) for r in transcripts.parse_text(raw, taught, F.lit(True)).collect()), key=repr)
    assert found == sorted([(-4, 1, "one?"), (-4, 3, "two.\n\nand on"), (4, 0, "three?"), (4, 0, "four?"), (4, 1, "five?"), (0, 0, "six?")], key=repr)


def test_many_turns_of_one_number(spark):
    """Turns without numbers, or all of one, are cut into chunks like others, and decoded as one conversation."""
    rng = random.Random(4)
    rows = [r for r in conversations() if r[0]]
    rows += [(900, None if k % 2 else 7, None, prose(rng, 6) + "?") for k in range(60)] + [(901, 3, None, "same")] * 40
    table = spark.createDataFrame(rows, TURNS)
    whole = transcripts.recover(table, fold("conv_id", 5) != 0).collect()
    cut = transcripts.recover(table, fold("conv_id", 5) != 0, chunk=8).collect()
    key = lambda found: sorted((r.conv, r.turn is not None, r.turn or 0, r.text) for r in found)
    assert key(whole) == key(cut) == sorted((c, t is not None, t or 0, x) for c, t, _, x in rows)


def test_model_of_shared_ids_does_not_depend_on_order(spark):
    texts, good, labels = labelled(spark, 90)
    rows = [(k % 60, t, "en", "s", 1) for k, t in enumerate(texts)]  # ids 0 to 29 have two texts
    make = lambda order: spark.createDataFrame([rows[k] for k in order], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    one = {(r.doc_id, r.stats.log_bytes, r.score) for r in rule_ensemble.score(make(range(90)), labels, F.lit(True)).collect()}
    two = {(r.doc_id, r.stats.log_bytes, r.score) for r in rule_ensemble.score(make(range(89, -1, -1)), labels, F.lit(True)).collect()}
    assert one == two
    clash = make(range(90)).withColumn("stats", F.lit(1)).withColumn("__stats", F.lit(2)).withColumn("c0", F.lit(3))
    kept = rule_ensemble.keep_good(clash, labels, F.lit(True))
    assert kept.columns == clash.columns and {tuple(r)[5:] for r in kept.collect()} == {(1, 2, 3)}
    assert {(r.doc_id) for r in kept.collect()} == {d for d, _, s in one if s >= rule_ensemble.THRESHOLD}


def test_statistics_against_plain_counts():
    texts = ["One two  two\nthree! THREE\n\nx|y\nx|y", "", "é" * 5 + " $1.5", "a b a b a b", *[t for t in EDGES if t]]
    found = rule_ensemble.statistics_of([t.encode() for t in texts])
    for k, t in enumerate(texts):
        raw, words = t.encode(), t.encode().lower().split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / max(len(raw), 1)
        expected = {
            "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "word_bytes": len(raw) / max(len(words), 1),
            "symbols": share(b"#*$%&|<>{}[]=~^_\\"), "pipes": share(b"|"), "marks": share(b"!?"), "upper": share(range(65, 91)), "digits": share(range(48, 58)),
            "stops": share(b".,;:"), "newlines": share(b"\n"), "wide": share(range(192, 256)), "distinct_words": len(set(words)) / max(len(words), 1),
            "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
            "repeated_words": 1 - len(set(zip(words, words[1:]))) / (len(words) - 1) if len(words) > 1 else 0.0,
        }
        assert {s: float(found[s][k]) for s in rule_ensemble.STATS} == pytest.approx(expected)


def test_quality_rules_hold_out_and_calibrate(spark, sf_dir):
    """On documents that the model has not seen: few mistakes, and probabilities that are not far from the shares."""
    from sparktile.llm.common import table

    at = sf_dir.replace("sf0.001", "sf0.01")
    labels = table(spark, at, "labels")
    found = ngram_logistic.judge(table(spark, at, "documents"), labels.where(fold("doc_id", 5) != 0)).join(labels.where(fold("doc_id", 5) == 0).select("doc_id", "quality"), "doc_id").collect()
    right = np.mean([(r.probability >= 0.5) == (r.quality == 1) for r in found])
    assert len(found) > 50 and right > 0.93 and abs(np.mean([r.probability for r in found]) - np.mean([r.quality for r in found])) < 0.08


def test_character_runs_are_of_characters():
    """Runs of four characters, not bytes: a document's places depend on its own text only."""
    texts = ["né漢字é", "abc", "", "ABCD", "abcd" * 3, "né漢字é"]
    parsed = ngram_logistic.Parsed([t.encode() for t in texts])
    _, (places, starts, ends) = parsed.places()
    assert (ends - starts).tolist() == [max(len(t) - 3, 0) for t in texts]
    assert places[starts[0] : ends[0]].tolist() == places[starts[5] : ends[5]].tolist() and places[starts[3]] == places[starts[4]]
