"""Small tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0, lang="en"):
    rows = [(start + k, t, lang, "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("w" + format(rng.randrange(vocabulary), "x") for _ in range(n))


#: Null, empty, blank, one word, repeated rows, very long, odd characters.
EDGES = [None, "", " \n\t ", "word", "same text here again", "same text here again", "x" * 300_000, "a b " * 40_000, "ÀÉ ß 漢字   \x00 end", "1 " * 5000, "." * 5000]
