import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sparktile.llm import link_graph, oracle, pii, queries

from .util import EDGES, docs, prose

PAGES = "page_id long, url string, html string"


def test_rules_and_hosts(spark):
    urls = ["http://A.Example.COM/en/1?x#y", "https://www.example.com/en/2", "ftp://b.net/fr/q?z", "http://b.net/de/", "http://c.org", "no host", None, "http://notcom/", "http://x.com", "http://com/?q"]
    found = link_graph.with_rule(spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES)).orderBy("page_id").collect()
    assert [r.host for r in found] == ["a.example.com", "www.example.com", "b.net", "b.net", "c.org", "", "", "notcom", "x.com", "com"]
    assert [r.path for r in found] == ["/en/1", "/en/2", "/fr/q", "/de/", "", "", "", "/", "", "/"]
    assert [r.rule for r in found] == ["example.com/en/", "www.example.com/en/", "net/fr/", None, None, None, None, None, None, "com/"]


def test_trust_and_distrust_follow_links(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/p">x</a><a href="/own">y</a>' for h in hosts)
    rows = [
        (1, "http://good.com/", link("near.org", "near.org")),
        (2, "http://near.org/a", link("far.org")),
        (3, "http://far.org/a", None),
        (4, "http://evil.net/es/", link("victim.org")),
        (5, "http://linker.org/", link("EVIL.net")),
        (6, "http://victim.org/", ""),
        (7, "http://evil.net/de/", None),
        (7, "http://evil.net/de/", None),
    ]
    table = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash"))
    found = {(r.page_id, r.verdict) for r in link_graph.judge(table).collect()}
    assert found == {(1, "allow"), (2, "allow"), (3, "allow"), (4, "block"), (5, "block"), (6, "allow"), (7, "block")}
    con = duckdb.connect()
    pages = table.select("page_id", "url", "html").toPandas()
    con.register("pages", pages)
    assert {(r[0], r[4]) for r in con.execute(oracle.ORACLE["op5_url_filter"]).fetchall()} == found
    assert link_graph.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_long_chains_and_cycles_settle(spark):
    link = lambda host: f'<a href="http://{host}/">x</a>'
    chain = [(k, f"http://h{k}.org/", link(f"h{k - 1}.org") if k else link("evil.net")) for k in range(16)]
    loop = [(20, "http://a.org/", link("b.org")), (21, "http://b.org/", link("a.org") + link("evil.net"))]
    table = spark.createDataFrame([*chain, *loop, (30, "http://evil.net/es/", None), (31, "http://apart.org/", link("h3.org"))], PAGES)
    found = {r.page_id: r.verdict for r in link_graph.judge(table).collect()}
    assert all(v == "block" for v in found.values()) and len(found) == 20


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or "") if kind != "email" or "@" in (text or "") else ():
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    rng = random.Random(9)
    parts = ["a.b@c.d", "x@y", "@", "%", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "0004111111111111111", "+1 (366) 555-9807", "+", "12", " ", "  ", "-", "é漢", "word", "(", ")", "5", "@m.n.o", "a@b.c%d@e.f", "255.255.255.0255"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(600)] + EDGES + ["@" * 3000, "a" * 3000 + "@", "1." * 20_000, "+1" + "-" * 20_000]
    found = pii.detect(docs(spark, texts)).select("doc_id", pii.digest(F.col("spans")).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in found] == [brute(t) for t in texts]


def test_disclosing_terms_and_sanitising(spark):
    rng = random.Random(1)
    common = [prose(rng, 20) for _ in range(60)]
    mail = "ann@mail.org"
    told = [f"{prose(rng, 8)} {mail} Zanzibarius {prose(rng, 8)}" for _ in range(6)]
    copies = [f"one passage with {mail.replace('ann', 'bob')} Unicorniana in it"] * 9  # copies prove nothing
    texts = common + told + copies + ["Only Zanzibarius is here.", "call +1 (366) 555-9807 or 1.2.3.4", None, ""]
    table = docs(spark, texts).withColumn("spans", F.lit(0))
    found = pii.detect(table).collect()
    terms = {s.value for r in found for s in r.term_spans}
    assert terms == {"Zanzibarius"} and sum(len(r.term_spans) for r in found) == 7
    clean = {r.doc_id: r for r in pii.sanitise(table).collect()}
    at = len(common) + len(told) + len(copies)
    assert len(clean) == len(texts) and clean[0].text == texts[0]
    assert clean[len(common)].text.count("[email]") == 1 and "Zanzibarius" not in clean[len(common)].text
    # One more text with the term: 1 - ln(7 / 6) / ln(79 / 6) = 0.94, which is generalised, not removed.
    assert clean[at].text == "Only [term] is here." and clean[at].n_chars == len(clean[at].text)
    alone = {r.doc_id: r.text for r in pii.sanitise(docs(spark, common + told)).collect()}
    assert alone[len(common)] == told[0].replace(mail, "[email]").replace("Zanzibarius", "")
    assert clean[at + 1].text == "call [phone] or [ip]" and clean[at + 2].text is None and clean[at + 3].text == ""
    assert pii.detect(docs(spark, [])).count() == 0 and pii.sanitise(docs(spark, [])).count() == 0


def test_rare_entities_short_terms_and_missing_ids(spark):
    filler = [f"filler text number {k} of many" for k in range(20_000)]
    rare = ["Xu: ann@mail.org 9.8.77.6", "9.8.77.6 ann@mail.org (Xu)"]  # two contexts, a term of two letters
    domain = [f"Zanzibarius {k}{k}@corp.net q{k}" for k in "abcdef"]  # no address occurs twice
    once = ["Unicorniana dan@else.org"] * 4
    table = docs(spark, filler + rare + domain + once)
    extra = spark.createDataFrame([(None, "Zanzibarius and Xu", "en", "s", 18)], table.schema)
    found = pii.detect(table.union(extra)).collect()
    terms = {s.value for r in found for s in r.term_spans}
    assert terms == {"Xu", "Zanzibarius"}
    assert [s.value for r in found if r.doc_id is None for s in r.term_spans] == ["Zanzibarius", "Xu"]
    clean = [r.text for r in pii.sanitise(table.union(extra)).where("doc_id is null").collect()]
    assert clean and "Zanzibarius" not in clean[0] and "Xu" not in clean[0]


@pytest.mark.parametrize("name", ["op2_near_dedup", "op5_url_filter", "op10_decontaminate"])
def test_queries_against_sql(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    expected = con.execute(oracle.ORACLE[name]).fetchdf()
    cols = sorted(expected.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).itertuples(index=False, name=None)))
    assert sorted(found.columns) == cols and rows(found) == rows(expected)


CLASHES = ("gone", "term_spans", "spans", "raw", "clean", "th", "__text", "__th", "_raw", "_n_words", "n_words", "hit_spans", "stats", "doc", "label", "c0", "c1", "Key")


def clashing(table):
    for k, name in enumerate(CLASHES):
        table = table.withColumn(name, F.lit(k))
    return table


def test_other_columns_keep_their_values(spark):
    """Columns that are called like the operators' own."""
    from sparktile.llm import decontaminate, stages

    texts = ["mail ann@mail.org now", "one two three four five six seven eight nine ten eleven", "plain words here", None, ""]
    table = clashing(docs(spark, texts))
    items = spark.createDataFrame([("a", "two three four five six seven eight nine ten eleven"), (None, "plain words")], "item_id string, text string")
    mine = [c for c in CLASHES if c not in ("n_words", "hit_spans")]
    for out in (pii.sanitise(table), stages.near_dedup(spark, table, ""), decontaminate.remove_spans(table, items), decontaminate.search(table, items, block_bytes=30)):
        rows = out.collect()
        assert rows and all(r[c] == CLASHES.index(c) for r in rows for c in mine)
    cut = {r.doc_id: r for r in decontaminate.remove_spans(table, items).collect()}
    assert cut[1].text == "one " and cut[2].text == " here" and cut[0].text == texts[0] and pii.sanitise(table).columns == table.columns
    found = {r.doc_id: r for r in decontaminate.search(table, items, block_bytes=30).collect()}
    assert found[2].n_hit == 2 and found[2].hit_items == [] and found[1].hit_items == ["a"]  # an item without an id is found, not named


def test_copies_do_not_make_terms(spark):
    """The number of texts counts distinct ones: repeats of one text leave the terms as they are."""
    rng = random.Random(1)
    texts = [prose(rng, 20) for _ in range(66)] + [f"{prose(rng, 8)} ann@mail.org Zanzibarius {prose(rng, 8)}" for _ in range(2)]
    terms = lambda rows: {s.value for r in pii.detect(docs(spark, rows)).collect() for s in r.term_spans}
    assert terms(texts) == terms(texts + ["said again and again"] * 3000 + [texts[0]] * 500) == set()


WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def cut_passages(text, windows):
    raw = text.encode()
    words = [(m.group(), m.span()) for m in WORDS.finditer(lower(raw))]
    hit = set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(w for w, _ in words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    if words and len(hit) == len(words):
        return None
    out, at, k = b"", 0, 0
    while k < len(words):
        if k in hit:
            end = k
            while end + 1 in hit:
                end += 1
            out, at, k = out + raw[at : words[k][1][0]], words[end][1][1], end
        k += 1
    return (out + raw[at:]).decode()


def mask(text):
    spans = sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in brute(text).split(",") if x))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline_against_brute_force(spark, sf_dir):
    """Near-duplicates, passages, personal data and packing in plain Python, over the rows that the classifier keeps."""
    pytest.importorskip("public_tokenizers")
    import zlib

    import corpus_pipeline
    import numpy as np
    from tokenizers import Tokenizer

    from sparktile.llm import rule_ensemble
    from sparktile.llm.common import fold, table

    from .test_near_dedup import brute as near_brute

    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    start = table(spark, sf_dir, "documents")
    good = rule_ensemble.keep_good(start, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    # The classifier's verdict is that of the compiled rules over plain statistics, which other tests hold.
    scored = {r.doc_id for r in rule_ensemble.score(start, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    assert {r[0] for r in rows} == scored
    kept = [row for k, (row, (_, first)) in enumerate(zip(rows, near_brute([t for _, t in rows], 5, 80), strict=True)) if first == k]
    windows = set()
    for r in table(spark, sf_dir, "benchmark").collect():
        words = [m.group() for m in WORDS.finditer(lower(r.text.encode()))]
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    cut = [(d, cut_passages(t or "", windows)) for d, t in kept]
    assert len({s.value for r in pii.detect(good).collect() for s in r.term_spans}) == 0  # so that masking is all
    t = Tokenizer.from_file(queries.tokenizer_path())
    expected = {}
    for d, text in cut:
        if text is not None:
            ids = np.array([*t.encode(mask(text), add_special_tokens=False).ids, 0], "<u4")
            for piece, at in enumerate(range(0, len(ids), 2048)):
                expected[d, piece] = (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == expected
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 1
