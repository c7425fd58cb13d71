"""Cutting texts into units and remembering these."""

import random
import re
import time

import public_tokenizers
import pytest

from arborspark.llm import tokens

LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
MARKS = re.compile(rb"(" + LETTER + rb"|[0-9])([.,;:!?#$%&*|)]+)(?=\s|$)")


def plain(text: bytes) -> list[bytes]:
    """The units of one text by a regular expression."""
    if any(x in text for x in (b"\xcc", b"\xcd", b"<|")):
        return text.split()
    return MARKS.sub(rb"\1 \2", bytes(b + 32 if 65 <= b <= 90 else b for b in text)).split()


@pytest.fixture
def fresh_codec():
    return tokens.Codec(public_tokenizers.path("word_bpe_49k.json"))


def test_units_of_many_texts_are_those_of_each(fresh_codec):
    r = random.Random(4)
    alphabet = [*"aZ9 \t\n\x0b\x0c\r\x1c\xa0.,?)|<'-", "é", "É", "×", "÷", "Ã", "́", "<|", "。", "...", "Σ", "🙂"]
    for _ in range(2000):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(25))).encode() for _ in range(r.randrange(1, 7))]
        units, edges = fresh_codec.units(texts)
        units = units.to_pylist()
        assert [units[i:j] for i, j in zip(edges, edges[1:])] == [plain(t) for t in texts]
    assert fresh_codec.id_bytes([b"", b" \n", b""]) == [b""] * 3 and fresh_codec.count([b" ", b""]) == [0, 0]


def test_units_met_lately_stay_when_the_cache_is_full(monkeypatch):
    """When all units were dropped at once, the frequent ones went to the library again each time."""
    monkeypatch.setattr(tokens, "UNIT_CACHE", 100)
    c, given = tokens.Codec(public_tokenizers.path("word_bpe_49k.json")), []
    encode = c.encode
    c.encode = lambda texts: given.extend(w for t in texts for w in t.split()) or encode(texts)
    for i in range(40):
        rare = [f"{i}x{k}" for k in range(10)]
        assert c.count([" ".join(["often", *rare]).encode()])[0] > len(rare)
    assert given.count("often") == 1 and len(given) == 1 + 400
    assert len(c.lengths) + len(c.lengths.older) <= 100 + 2 * 11


def test_known_units_cost_less_than_a_regular_expression_over_the_text(fresh_codec):
    """By a regular expression and a Python object for each word, packing took 414 CPU seconds a GB of its budget of 400."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghié") for _ in range(r.randrange(2, 9))) + r.choice(["", "", "", ",", "."]) for _ in range(5000)]
    texts = [" ".join(r.choices(words, k=2000)).encode() for _ in range(150)]

    def least(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: fresh_codec.id_bytes(texts)) < least(lambda: [MARKS.sub(rb"\1 \2", t).split() for t in texts])
