import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktile.llm import packing
from sparktile.llm.queries import tokenizer_path

from .util import EDGES, docs


def tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ALPHABET = st.sampled_from(["a", "B", "'s", "'S", "!", "?", ",", ".", "é", "É", " ", "\n", "9", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "İ", "́", "ß", " ", "\x1c", "\x85", "K", "'ll", "漢", "$$$"])


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, max_size=14).map("".join))
def test_ids_equal_the_tokenizers(text):
    t = packing.ChunkTokenizer.of_worker(tokenizer_path())
    expected = np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert t.ids([text.encode()]) == [expected]


def test_latin_words_are_encoded_together(monkeypatch):
    """Accented words as those of ASCII letters, and without the normaliser, which is there again afterwards."""
    t = packing.ChunkTokenizer(tokenizer_path())
    text = "größe déjà-vu año, çà!? straße ÿ où... e\u0301t\u00e9 ÷ à÷b ÀÉ"
    expected = np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    alone, encoded = [], t._encoded
    monkeypatch.setattr(t, "_encoded", lambda words: alone.extend(words) or encoded(words))
    assert t.bare and t.ids([text.encode()]) == [expected] and t.tokenizer.normalizer is not None
    assert not {"größe", "año", "çà", "straße", "ÿ", "où"} & set(alone)
    upper = "<|endoftext|> GRÖSSE Größe größe"  # kept as written: the normaliser folds it
    assert t.ids([upper.encode()]) == [np.array(t.tokenizer.encode(upper, add_special_tokens=False).ids, "<u4").tobytes()]


def test_a_normaliser_that_changes_letters_is_used(tmp_path):
    from tokenizers import normalizers

    plain = tokenizer()
    plain.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    plain.save(f"{tmp_path}/stripped.json")
    t = packing.ChunkTokenizer(f"{tmp_path}/stripped.json")
    text = "größe année, straße"
    assert not t.bare and t.ids([text.encode()]) == [np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def best_fit(lengths, capacity):
    """Gaps left by placing one by one, longest first, into the tightest gap."""
    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - x)
    return gaps


def filled(placed, capacity):
    """Each sequence's parts, which must follow one another from 0."""
    used: dict[int, list[tuple[int, int]]] = {}
    for length, _, _, n, first, offset in placed:
        for k in range(n):
            used.setdefault(first + k, []).append((offset, length))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return used


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sweep_is_best_fit(lengths):
    runs = [(x, 0, 0, lengths.count(x)) for x in set(lengths)]
    placed, rest, left = packing.sweep(runs, [], 20, 0, None)
    used = filled(placed, 20)
    assert not rest and sum(map(len, used.values())) == len(lengths)
    gaps = best_fit(lengths, 20)
    assert len(used) <= len(gaps) and sorted(size for size, _, n in left for _ in range(n)) == sorted(20 - sum(x for _, x in p) for p in used.values() if sum(x for _, x in p) < 20)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(0, 6))
def test_sweep_opens_no_more_than_told_and_goes_on(lengths, most):
    """What finds no place is told, and a second sweep over the gaps places it."""
    runs = [(x, 3, 5, lengths.count(x)) for x in set(lengths)]
    placed, rest, left = packing.sweep(runs, [], 20, 100, most)
    assert all(100 <= p[4] and p[4] + p[3] <= 100 + most for p in placed)
    again, none, _ = packing.sweep(rest, left, 20, 1000, None)
    used = filled(placed + again, 20)
    assert not none and sum(map(len, used.values())) == len(lengths)
    members = sorted((p[0], p[2] + k) for p in placed + again for k in range(p[3]))
    assert members == sorted((x, 5 + k) for x in set(lengths) for k in range(lengths.count(x)))


def test_other_tokenizers_encode_whole_texts(spark):
    """A vocabulary whose tokens take in the space before them is found out when it is loaded."""
    t = tokenizer()
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = packing.ChunkTokenizer(path)
    assert packing.ChunkTokenizer(tokenizer_path()).chunked and not own.chunked and t
    texts = ["Two words, and  MORE.", "", "x" * 50, "a b " * 300]
    whole = [np.array(Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert own.ids([x.encode() for x in texts]) == whole


@pytest.mark.parametrize("shard_sequences", [1, 3])
def test_shards_and_supersteps(spark, shard_sequences):
    """Many shards: every piece once, gapless, and hardly more sequences than the tokens need."""
    rng = random.Random(3)
    texts = ["many words " * rng.choice([1, 3, 30, 100, 200, rng.randrange(1, 300)]) for _ in range(400)] + ["same length"] * 300
    found = packing.pack(docs(spark, texts), tokenizer_path(), capacity=256, shard_sequences=shard_sequences).collect()
    seen: dict[int, list] = {}
    for r in found:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0, *[p[1] for p in parts[:-1]]])) and sum(p[1] for p in parts) <= 256
    assert len({(r.doc_id, r.piece) for r in found}) == len(found)
    assert len(seen) <= 1.03 * len(best_fit([r.length for r in found], 256)) + 1


def test_pack_and_sequences(spark):
    t = tokenizer()
    texts = [*EDGES, *("many words " * k for k in range(1, 60))]
    found = packing.pack(docs(spark, texts), tokenizer_path()).collect()
    ids = {k: t.encode(x or "", add_special_tokens=False).ids + [0] for k, x in enumerate(texts)}
    seen: dict[int, list] = {}
    for r in found:
        cut = ids[r.doc_id][r.start : r.start + r.length]
        assert len(cut) == r.length and r.start == 2048 * r.piece and zlib.crc32(np.array(cut, "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in found) == sum(map(len, ids.values()))
    for parts in seen.values():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0, *[p[1] for p in parts[:-1]]])) and sum(p[1] for p in parts) <= 2048
    assert len(seen) <= -(-sum(map(len, ids.values())) // 2048) + 1
    whole = packing.sequences(docs(spark, texts[:6]), tokenizer_path()).collect()
    assert all(len(s.ids) == 4 * s.length for s in whole) and sum(s.length for s in whole) == sum(len(ids[k]) for k in range(6))


def test_equal_lengths_and_empty(spark):
    found = packing.pack(docs(spark, ["same words"] * 5000), tokenizer_path()).collect()
    length = found[0].length
    assert len({r.sequence_id for r in found}) == -(-5000 // (2048 // length))
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0
