"""Benchmarks with very many different words, and very long items."""

import random
import tracemalloc

import numpy as np
import pytest

from arborspark.llm import decontaminate as D


def words(r, n):
    return [f"{r.randrange(36**5):x}" for _ in range(n)]


def held(items, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return {(items.ids[i], d) for _, i, d in D.in_chunk(items, data, np.array([0, len(data)]))}


def test_millions_of_different_words(monkeypatch):
    r = random.Random(1)
    rows = [(i, " ".join(words(r, 100))) for i in range(21_000)]
    tracemalloc.start()
    lots = list(D.in_blocks(rows, 75))
    items = D.build(lots[0], 75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(lots, []) == rows and len(lots) > 1 and items.base > 1 << 19 and peak < 1 << 30
    own = lots[0][7][1].split()
    assert held(items, "a b " + " ".join(own) + " c") == {(7, 0)}
    for k in range(3, 100, 5):
        own[k] = "other"
    assert held(items, " ".join(own)) == {(7, 20)}
    # one table of all words is no larger than its class asks for
    assert all(len(t.first) <= 1 + (c.own > 0).sum() + 1 for c in items.classes for t in c.tables)


def test_an_item_of_a_hundred_thousand_words():
    r = random.Random(2)
    long = words(r, 100_000)
    tracemalloc.start()
    items = D.build([(0, " ".join(long)), (1, "short item here")], 75)
    copy = list(long)
    for k in r.sample(range(100_000), 20_000):
        copy[k] = f"x{k}"
    assert held(items, "q " + " ".join(copy) + " short item here") == {(0, 20_000), (1, 0)}
    assert held(items, " ".join(copy[:60_000])) == set()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30


def test_candidates_of_long_items_are_counted_alike(monkeypatch):
    r = random.Random(3)
    vocabulary = words(r, 300)
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([5, 40, 90])))) for i in range(30)]
    items = D.build(rows, 75)
    text = " ".join(" ".join(r.choices(vocabulary, k=50)) + " " + t for _, t in rows)
    want = held(items, text)
    monkeypatch.setattr(D, "LONG", 10)
    assert held(items, text) == want and {i for i, d in want if d == 0} == set(range(30))
    monkeypatch.setattr(D, "LONG", 1000)
    monkeypatch.setattr(D, "SOME", 50)
    assert held(items, text) == want


@pytest.mark.parametrize("limit", [1, 5000])
def test_blocks_hold_every_item_once(monkeypatch, limit):
    monkeypatch.setattr(D, "TABLE_BYTES", limit)
    rows = [(i, "w " * i) for i in range(20)] + [(None, None)]
    lots = list(D.in_blocks(rows, 75))
    assert sum(lots, []) == rows and len(lots) > 2
    assert list(D.in_blocks([], 75)) == [[]]
