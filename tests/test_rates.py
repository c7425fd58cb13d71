"""Site rates: climbing, clusters, categories, roll-back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborspark.functions.numerics import Mixture, equal_rates
from arborspark.plans import likelihood
from arborspark.plans.kernel import Block, root_edge
from arborspark.plans.likelihood import categorise, climb_rates, islands, log_likelihood, optimise_psr
from tests.test_search import random_tree, simulated, table_of

MODEL = equal_rates(4, categories=1)


def lnl(codes, tree, rate, model=MODEL):
    return Block(codes, np.ones(len(codes)), model, [(u, v, z**rate) for u, v, z in tree]).pattern_likelihoods(*root_edge(tree)).round(9)


@pytest.mark.parametrize("lower, upper, start", [(0.5, 1.0, 1.0), (0.25, 0.5, 3.0)])
def test_every_pattern_climbs_as_by_hand(spark, lower, upper, start):
    tree = random_tree(9, 5)
    codes = simulated(tree, 9, 60, MODEL)
    table = table_of(spark, codes, 2).withColumn("rate", F.lit(start))
    got = {r.pattern_id: (r.rate, r.lnl) for r in climb_rates(table, tree, {0: MODEL, 1: MODEL}, lower, upper, most=6.0).collect()}
    for i in range(60):
        at = lambda r: float(lnl(codes[i : i + 1], tree, r)[0])  # noqa: E731, B023
        ends = [(at(start), start)]
        for step in (-lower, upper):
            r, best = start, at(start)
            while 1e-4 < round(r + step, 9) <= 6.0 and at(round(r + step, 9)) > best:
                r = round(r + step, 9)
                best = at(r)
            ends.append((best, r))
        assert got[i] == pytest.approx(max(ends, key=lambda x: x[0])[::-1])


def test_rates_are_put_on_islands(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(p, float(x)) for p in (0, 1) for x in np.unique(np.round(np.cumsum(rng.choice([0.0004, 0.0009, 0.0011, 0.3], 200)), 6))]
    rates = spark.createDataFrame(rows, "part_id int, rate double")
    want, last = {}, {}
    for p, x in sorted(rows):
        number = want[p, last[p]] if p in last and x - last[p] < 0.001 else (want[p, last[p]] + 1 if p in last else 1)
        want[p, x], last[p] = number, x
    assert {(r.part_id, r.rate): r.island for r in islands(rates, 0.001).collect()} == want
    monkeypatch.setattr(likelihood, "is_small", lambda *_: False)
    assert {(r.part_id, r.rate): r.island for r in islands(rates.repartition(5), 0.001).collect()} == want


def test_near_rates_are_one_category(spark):
    rows = [(0, i, 1, r, l) for i, (r, l) in enumerate([(1.0, -5.0), (1.0004, -3.0), (2.0, -9.0), (0.5, -1.0), (0.5009, -1.5)])]
    got = {r.pattern_id: r for r in categorise(spark.createDataFrame(rows, "part_id int, pattern_id int, weight long, rate double, lnl double"), 2).collect()}
    mean = (1.0 * 4 + 2.0) / 5
    assert {i: r.category_rate for i, r in got.items()} == pytest.approx({0: 1 / mean, 1: 1 / mean, 2: 2 / mean, 3: 1 / mean, 4: 1 / mean})
    assert [got[i].category for i in range(5)] == [0, 0, 1, 0, 0]


def test_rates_of_sites_are_found(spark):
    tree = random_tree(30, 5)
    true = np.repeat([0.1, 0.5, 2.4], 60)  # their mean is 1, as that of categories
    codes = np.concatenate([simulated([(u, v, z**r) for u, v, z in tree], 30, 60, MODEL, seed=k) for k, r in enumerate((0.1, 0.5, 2.4))])
    table = table_of(spark, codes).repartition(3)
    before = log_likelihood(table, tree, {0: MODEL}).first().lnl
    rated, after = optimise_psr(table, tree, {0: MODEL}, 8)
    assert after > before + 50 and rated.select("rate").distinct().count() <= 8
    assert log_likelihood(rated, tree, {0: MODEL}).first().lnl == pytest.approx(after)
    found = np.array([r.rate for r in rated.orderBy("pattern_id").collect()])
    assert np.mean(found[true == 0.1]) < np.mean(found[true == 0.5]) < np.mean(found[true == 2.4]) and np.average(found) == pytest.approx(1)


def test_rates_that_lose_are_taken_back(spark, monkeypatch):
    tree = random_tree(6, 5)
    table = table_of(spark, simulated(tree, 6, 40, MODEL)).withColumn("rate", F.lit(1.0))
    before = log_likelihood(table, tree, {0: MODEL}).first().lnl
    monkeypatch.setattr(likelihood, "climb_rates", lambda now, *a, **k: now.select("part_id", "pattern_id", (F.when(F.col("pattern_id") % 2 == 0, 30.0).otherwise(0.01)).alias("rate"), F.lit(-1.0).alias("lnl")))
    rated, after = optimise_psr(table, tree, {0: MODEL})
    assert after == before and rated.where("rate <> 1").isEmpty()


def test_twenty_states_have_rates_too(spark):
    tree, model = random_tree(6, 5), equal_rates(20, categories=1)
    codes = simulated(tree, 6, 30, model)
    got = {r.pattern_id: r for r in climb_rates(table_of(spark, codes), tree, {0: model}, most=4.0).collect()}
    assert all(r.lnl == pytest.approx(float(lnl(codes[i : i + 1], tree, r.rate, model)[0]), abs=1e-8) for i, r in got.items()) and len({r.rate for r in got.values()}) > 2
    rated = table_of(spark, codes).join(spark.createDataFrame([(i, r.rate) for i, r in got.items()], "pattern_id int, rate double"), "pattern_id")
    assert log_likelihood(rated, tree, {0: model}).first().lnl == pytest.approx(sum(r.lnl for r in got.values()), abs=1e-6)
    with pytest.raises(Exception, match="one matrix"):
        log_likelihood(rated, tree, {0: Mixture.gamma((model,) * 2, 0.5)}).collect()
