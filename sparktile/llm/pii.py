"""Personal data: base patterns, and terms that disclose the entities they stand with.

Only DataFrame functions are used. Base spans are found by patterns. Then the
corpus says how strongly a term reveals an entity: with n distinct texts, df(e) of
them holding entity e, df(t) holding term t and n(t, e) holding t near e, the term's
disclosure is PMI(t; e) / IC(e) = 1 - ln(df(t) / n(t, e)) / ln(n / df(e)). Terms
that reach ``GENERALISE`` are replaced by a general word and those that reach
``REMOVE`` are removed, wherever they occur. An entity is a value and also what it
backs off to, the domain of an address or the network of an IP, so that values that
occur once still add up.

No fixed count is asked of a pair. The first time a term stands near an entity only
proposes the pair; k - 1 further texts with contexts of their own must be too many for
chance: by Hoeffding's bound on the hypergeometric tail, and over all proposed pairs, at
most ``LEVEL``. Copies of one passage therefore prove nothing, and two texts are enough
where the corpus is large against the pairs in it.

Positions count code points; ends are exclusive. Terms have 1 to ``TERM_CHARS``
characters and stand within ``CONTEXT`` characters of an entity to be proposed; both
are parameters of the method, longer runs of letters being no words of a language.

Cases: null or empty text has no spans; a text of any length is searched whole; of
overlapping spans the first one's mark stands and covers the rest; repeated rows are
judged one by one, and their equal texts and contexts count once; rows are matched by
their text, so a missing or shared id changes nothing; words cut by a context's edge and
words of other entities do not count; an empty table gives no rows; other columns keep
their values, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, place, positional

#: Fixed patterns. Possessive repeats and look-behinds match as the plain forms do,
#: without their backtracking over long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
CONTEXT = 80  # characters on either side of an entity
TERM_CHARS = 40
TERM = rf"[\p{{L}}\p{{N}}]{{1,{TERM_CHARS}}}"
LEVEL = 0.01
GENERALISE, REMOVE = 0.85, 0.95
BROADCAST_ROWS = 200_000  # of terms or ids; beyond it joins are shuffled
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    last = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), last),
        F.lit(0),
        lambda acc, i: acc + _doubled(F.substr(digits, i, F.lit(1)).cast("int"), F.pmod(last - i, F.lit(2)) == 1),
    ) % 10 == 0


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(hit, F.lit(_IP_PARTS))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _found(text: Column, pattern: Column, kind: str) -> Column:
    """Every match of a pattern with its place: matches and the pieces between them add up to the text.

    Matches and pieces are made once, as the aggregate's argument; the lambda only walks them.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda piece, hit: F.struct(F.length(piece).alias("gap"), hit.alias("hit")))
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    found = F.filter(F.aggregate(pairs, state, step)["out"], lambda s: _passes(kind, s["value"]))
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by kind as listed and then by start."""
    none = F.expr(f"cast(array() as {SPAN})")
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][0-9 -]{14}[0-9 -]*[0-9]"), "phone": text.contains("+")}
    parts = [F.when(needs[k], _found(text, F.lit(p), k)).otherwise(none) for k, p in PATTERNS.items()]
    return F.coalesce(F.concat(*parts), none)


def _groups(span: Column) -> Column:
    """Keys of what a span discloses: its value, and the domain or network that it is part of."""
    value = F.lower(span["value"])
    wider = F.when(span["kind"] == "email", F.substring_index(value, "@", -1)).when(span["kind"] == "ip", F.substring_index(value, ".", 3))
    return F.array_compact(F.array(F.xxhash64(span["kind"], value), F.when(wider.isNotNull(), F.xxhash64(F.lit("in"), span["kind"], wider))))


def _contexts(docs: DataFrame) -> DataFrame:
    """One row for each entity and document: the entity and the distinct terms near it."""
    # Entities are masked anyway, so no part of one is a term of another.
    blank = F.aggregate("spans", F.col("text"), lambda acc, x: F.overlay(acc, F.repeat(F.lit(" "), x["end"] - x["start"]), x["start"] + 1, x["end"] - x["start"]))
    one = docs.where(F.size("spans") > 0).select("th", "spans", blank.alias("text")).select("th", "text", F.explode("spans").alias("s"))
    # One character more than the context tells whether its outermost word is whole.
    left = F.substr("text", F.greatest(F.col("s.start") - CONTEXT, F.lit(1)), F.least(F.lit(CONTEXT + 1), F.col("s.start")))
    right = F.substr("text", F.col("s.end") + 1, F.lit(CONTEXT + 1))
    left = F.when(F.length(left) > CONTEXT, F.regexp_replace(left, r"^(?:[\p{L}\p{N}]+|.)", "")).otherwise(left)
    right = F.when(F.length(right) > CONTEXT, F.regexp_replace(right, r"(?:(?<![\p{L}\p{N}])[\p{L}\p{N}]+|[^\p{L}\p{N}])\z", "")).otherwise(right)
    around = F.lower(F.concat(left, F.lit(" "), right))
    terms = F.array_distinct(F.regexp_extract_all(around, F.lit(rf"(?<![\p{{L}}\p{{N}}]){TERM}(?![\p{{L}}\p{{N}}])"), F.lit(0)))
    near = one.select("th", F.explode(_groups(F.col("s"))).alias("entity"), around.alias("around"), terms.alias("terms"))
    return near.select("th", "entity", F.xxhash64("around").alias("context"), "terms")


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that broadcasts the right side only when a count says that it is small."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def disclosing_terms(docs: DataFrame, found: DataFrame, n: int, scratch: Scratch, level: float = LEVEL, least: float = GENERALISE) -> DataFrame | None:
    """Terms (term, disclosure) that reveal an entity; None where no pair is beyond chance.

    ``docs`` has text, ``n`` is the number of distinct texts, ``found`` the contexts of their entities.
    """
    pairs = found.select("entity", "context", "th", F.explode("terms").alias("term"))
    counts = pairs.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("th").alias("together"))
    counts = scratch.write(counts, "pairs")
    proposed = counts.count()
    again = counts.where((F.col("contexts") > 1) & (F.col("together") > 1))
    if again.isEmpty():
        return None
    entities = found.groupBy("entity").agg(F.count_distinct("th").alias("df_e"))
    # Texts that hold an entity bound a term's frequency from below, and so its disclosure from above and
    # its chance from below: only terms that can still pass are counted over the whole corpus.
    near = pairs.groupBy("term").agg(F.count_distinct("th").alias("df_near"))
    scored = again.join(entities, "entity").join(near, "term").where(F.col("df_e") < n)

    def passes(df_t: Column) -> Column:
        return (_disclosure(df_t, n) >= least) & (_log_chance(df_t, n) + F.log(F.lit(float(proposed))) <= math.log(level))

    possible = scratch.write(scored.where(passes(F.col("df_near"))).select("term", "contexts", "together", "df_e"), "possible")
    candidates = scratch.write(possible.select("term").distinct(), "candidates")
    if candidates.isEmpty():
        return None
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\p{{L}}\p{{N}}]){TERM}(?![\p{{L}}\p{{N}}])"), F.lit(0)))
    df_t = _joined(docs.select("th", F.explode(words).alias("term")), candidates, "term", "left_semi").groupBy("term").agg(F.count_distinct("th").alias("df_t"))
    terms = possible.join(df_t, "term").where(passes(F.col("df_t"))).groupBy("term").agg(F.max(_disclosure(F.col("df_t"), n)).alias("disclosure"))
    return scratch.write(terms, "terms")


def _log_chance(df_t: Column, n: int) -> Column:
    """Upper bound on the log of the chance that, after the first, k - 1 more of the term's texts hold the entity.

    Hoeffding: -a KL(q || p) for a further texts of the term, a share q of them with the entity, p of all others.
    """
    more = (F.least("contexts", "together") - 1).cast("double")
    a = F.greatest(df_t - 1, more).cast("double")
    q, p = more / a, (F.col("df_e") - 1) / F.lit(float(n - 1))
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return F.when(q > p, -a * (q * F.log(q / p) + rest)).otherwise(0.0)


def _disclosure(df_t: Column, n: int) -> Column:
    """PMI over information content, from columns together and df_e."""
    return 1 - F.log(F.greatest(df_t / F.col("together"), F.lit(1.0))) / F.log(F.lit(float(n)) / F.col("df_e"))


def _term_spans(docs: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """(th, term_spans, gone) of the texts that hold a disclosing term."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\p{{L}}\p{{N}}]){TERM}(?![\p{{L}}\p{{N}}])"), F.lit(0)))
    rows = docs.where("text is not null").select("th", F.explode(words).alias("term"))
    by_text = _joined(rows, terms, "term").groupBy("th").agg(F.concat_ws("|", F.array_sort(F.collect_set("term"))).alias("all_terms"), F.concat_ws("|", F.array_sort(F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term"))))).alias("gone"))
    by_text = scratch.write(by_text, "by_text")
    held = _joined(docs.select("th", "text"), by_text, "th").dropDuplicates(["th"])
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.col("all_terms"), F.lit(r")(?![\p{L}\p{N}])"))
    return held.select("th", _found(F.col("text"), pattern, "term").alias("term_spans"), F.split("gone", r"\|").alias("gone"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, spans (base kinds, then disclosing terms) and gone (the terms to remove)."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    spans = texts.withColumn("spans", base_spans(F.col("text")))
    # Texts that hold an entity go along, for their contexts.
    base = scratch.write(spans.select("doc_id", "th", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")), "base")
    found = scratch.write(_contexts(base), "contexts")
    n = base.agg(F.count_distinct("th")).first()[0]
    terms = disclosing_terms(texts, found, n, scratch, **options)
    no_terms = F.expr(f"cast(array() as {SPAN})")
    if terms is None or terms.isEmpty():
        return base.select("doc_id", "th", "spans", no_terms.alias("term_spans"), F.expr("cast(array() as array<string>)").alias("gone"))
    more = scratch.write(_term_spans(texts, terms, scratch), "term_spans")
    out = _joined(base.select("doc_id", "th", "spans"), more, "th", "left")
    return out.select("doc_id", "th", "spans", F.coalesce("term_spans", no_terms).alias("term_spans"), F.coalesce("gone", F.expr("cast(array() as array<string>)")).alias("gone"))


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with entities replaced by their kind, terms by ``[term]`` or nothing; n_chars follows."""
    inner, names = positional(docs)
    text, none = place(names, text_col), F.expr(f"cast(array() as {SPAN})")
    no_words = F.expr("cast(array() as array<string>)")
    # Base spans come again from the text itself; only term spans need the corpus, and so a join.
    found = detect(docs, id_col, text_col, **options).where(F.size("term_spans") > 0)
    with_terms = Scratch(docs.sparkSession).write(found.select("th", "term_spans", "gone").dropDuplicates(["th"]), "found")
    raw = inner.withColumn("raw", F.col(text).cast("string"))
    if with_terms.isEmpty():
        joined = raw.withColumn("spans", base_spans(F.col("raw"))).withColumn("gone", no_words)
    else:
        joined = _joined(raw, with_terms, F.xxhash64("raw") == F.col("th"), "left")
        joined = joined.withColumn("spans", F.concat(base_spans(F.col("raw")), F.coalesce("term_spans", none))).withColumn("gone", F.coalesce("gone", no_words))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def step(acc: Column, s: Column) -> Column:
        put = F.when((s["kind"] == "term") & F.array_contains(F.col("gone"), F.lower(s["value"])), F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        between = F.substr(F.col("raw"), acc["at"] + 1, s["start"] - acc["at"])
        # A span that begins inside the one before it only carries that one's cut further.
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, put)).otherwise(acc["out"]).alias("out"))

    state = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = F.concat(state["out"], F.substr(F.col("raw"), state["at"] + 1, F.length("raw") - state["at"]))
    hit = F.coalesce(F.size("spans") > 0, F.lit(False))
    out = joined.withColumn("clean", F.when(hit, clean).otherwise(F.col("raw")))
    new = {text: F.col("clean")}
    if "n_chars" in names:
        n = place(names, "n_chars")
        new[n] = F.when(hit, F.length("clean").cast("bigint")).otherwise(F.col(n))
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in inner.columns]).toDF(*names)
