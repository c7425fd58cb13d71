"""Lock-step optimisation, mixtures, automatic matrices, branches by partition."""

import math

import numpy as np
import pytest

from arborspark.functions.brent import maximise
from arborspark.functions.numerics import Mixture, Model, equal_rates, read_exchange
from arborspark.plans import blockwise, evaluate, parameters
from arborspark.plans.kernel import Block, root_edge
from arborspark.plans.likelihood import log_likelihood
from arborspark.plans.models import auto_models, fit_models, optimise_all, penalised
from arborspark.plans.reports import partition_trees
from arborspark.sources import newick
from tests.test_search import names_of, random_tree, simulated, table_of

DNA_MODEL = Model((0.1, 0.2, 0.3, 0.4), (1.0, 2.0, 0.5, 0.7, 3.0, 1.0), categories=1)


def test_many_functions_are_maximised_at_once():
    rng = np.random.default_rng(0)
    c, k = rng.uniform(-8, 8, 40), rng.uniform(0.1, 5, 40)
    for f in (lambda x: -k * (x - c) ** 2, lambda x: -np.abs(x - c) ** 1.5, lambda x: -k * np.log1p((x - c) ** 2), lambda x: k * x, lambda x: np.zeros_like(x)):
        x, value, rounds = maximise(lambda p, live: f(p), np.zeros(40), -9.2, 9.2, 1.0, 1e-5)
        grid = np.linspace(-9.2, 9.2, 40001)[:, None]
        assert np.all(value >= f(np.broadcast_to(grid, (40001, 40))).max(axis=0) - 1e-4) and np.all((x >= -9.2) & (x <= 9.2)) and rounds <= 60


def test_the_start_is_never_left_for_something_worse():
    x, value, _ = maximise(lambda p, live: np.where(np.abs(p - 1) < 1e-12, 5.0, np.sin(p)), np.array([1.0]), -3, 3, 0.5)
    assert x[0] == 1.0 and value[0] == 5.0
    x, _, _ = maximise(lambda p, live: np.where(p > 0, np.nan, p), np.array([-1.0]), -3, 3, 0.5)
    assert x[0] <= 0


def test_converged_functions_are_not_asked_for_again():
    seen = []

    def score(p, live):
        seen.append(live.copy())
        return np.stack([-((p[:, 0]) ** 2), -np.abs(p[:, 1] - 3.3) ** 1.3]).T

    maximise(score, np.zeros(2), -9, 9, 0.5, 1e-6)
    assert not seen[-1][0] and seen[-1][1]


def test_fewer_sweeps_than_a_grid():
    """A grid of nine points shrinks by four a sweep: from 18.4 wide to 1e-5 it takes eleven."""
    tree = random_tree(8, 2)
    codes = simulated(tree, 8, 300, DNA_MODEL)
    sweeps = []

    def score(tried):
        sweeps.append(len(tried))
        return {p: [Block(codes, np.ones(300), m, tree, keep=False).lnl(*root_edge(tree)) for m in ms] for p, ms in tried.items()}

    model = {p: DNA_MODEL.with_(exchange=(1.0,) * 6) for p in (0, 1, 2)}
    out = parameters.optimise(score, model, parameters.exchange_rate(4), [0, 1, 2], tolerance=1e-5)
    assert len(sweeps) < 11 and out[0].exchange[4] == out[2].exchange[4] != 1.0
    ends = [score({0: [out[0].with_(exchange=parameters.at(out[0].exchange, 4, out[0].exchange[4] * f))]})[0][0] for f in (1, 1.001, 0.999)]
    assert ends[0] >= max(ends[1:])


def test_linked_partitions_share_what_is_linked():
    tree = random_tree(6, 2)
    data = {p: simulated(tree, 6, 80, DNA_MODEL, seed=p) for p in (0, 1, 2)}

    def score(tried):
        return {p: [Block(data[p], np.ones(80), m, tree, keep=False).lnl(*root_edge(tree)) for m in ms] for p, ms in tried.items()}

    start = {p: equal_rates(4, alpha=0.5 + p) for p in data}
    models, _ = parameters.cycles(score, start, links={0: 9, 1: 9}, freqs=True, most=1)
    assert models[0].exchange == models[1].exchange != models[2].exchange and models[0].alpha == models[1].alpha
    assert models[0].freqs != models[1].freqs


def test_weights_and_rates_of_a_mixture_are_recovered(spark):
    rng = np.random.default_rng(5)
    parts = tuple(Model(tuple(rng.dirichlet(np.ones(4) * 2)), tuple(rng.gamma(1, 1, 6) + 0.1), categories=1) for _ in range(3))
    true = Mixture(parts, (0.2, 1.0, 4.0), (0.5, 0.3, 0.2))
    n, sites = 24, 4000
    tree = random_tree(n, 4)
    which = rng.choice(3, sites, p=true.weights)
    codes = np.concatenate([simulated([(u, v, z**true.rates[k]) for u, v, z in tree], n, int((which == k).sum()), parts[k], seed=k) for k in range(3)])
    table = table_of(spark, codes).repartition(4)
    start = {0: Mixture(parts, (1.0, 1.0, 1.0), (1.0, 1.0, 1.0))}
    before = log_likelihood(table, tree, start).first().lnl
    found, _, lnl = blockwise.fit(table, tree, start, epsilon=0.5, cycles=6)
    assert lnl > before + 100
    assert found[0].weights == pytest.approx(true.weights, abs=0.06)
    assert found[0].rates == pytest.approx(true.rates, rel=0.25)
    assert found[0].weights @ found[0].rates == pytest.approx(1) and found[0].weights.sum() == pytest.approx(1)
    assert Block(codes, np.ones(sites), found[0], tree).lnl(*root_edge(tree)) == pytest.approx(lnl)
    assert lnl > Block(codes, np.ones(sites), true, tree).lnl(*root_edge(tree)) - 1


def test_a_mixture_without_gain_is_left_as_it_is():
    same = Mixture((DNA_MODEL,) * 2, (1.0, 1.0), (0.4, 0.6))
    score = lambda tried: {p: [0.0] * len(ms) for p, ms in tried.items()}
    models, _ = parameters.cycles(score, {0: same}, most=1)
    assert models[0] == same


def test_a_mixture_with_a_shape_moves_its_shape_alone():
    mix = {0: Mixture.gamma((DNA_MODEL,) * 4, 0.5)}
    named = [(p, parts) for p, parts in parameters.parameters(mix, True, True, True)]
    assert [(p.place(mix[0]), parts) for p, parts in named if parts] == [(math.log(0.5), [0])]
    assert mix[0].with_(alpha=2.0).relative != mix[0].relative


def matrices():
    """Three matrices of 20 states, read from the published text form."""
    out = {}
    for k, name in enumerate(("ONE", "TWO", "THREE")):
        rng = np.random.default_rng(40 + k)
        text = " ".join(f"{x:.5f}" for x in rng.gamma(0.4, 1, 190) + 0.01) + "\n" + " ".join(f"{x:.5f}" for x in rng.dirichlet(np.ones(20) * 4))
        exchange, freqs = read_exchange(text)
        out[name] = Model(freqs, exchange, categories=1)
    return out


@pytest.mark.parametrize("criterion", ["ml", "bic"])
def test_matrices_are_chosen_by_partition(spark, criterion):
    n, tree, named = 8, random_tree(8, 9), matrices()
    codes = [simulated(tree, n, 150, named[x], seed=i) for i, x in enumerate(("TWO", "ONE", "THREE"))]
    rows = [(p, i, 1, [int(x) for x in c]) for p, part in enumerate(codes) for i, c in enumerate(part)]
    table = spark.createDataFrame(rows, "part_id int, pattern_id int, weight long, codes array<int>").repartition(3)
    far = [(u, v, 0.7) for u, v, _ in tree]
    start = {p: equal_rates(20, categories=1) for p in (0, 1, 2)}
    choice = auto_models(table, far, start, named, {0: (0.05,) * 20, 1: (0.05,) * 20}, criterion)
    assert choice.taken and choice.chosen == {0: ("TWO", "fixed"), 1: ("ONE", "fixed")}
    assert choice.models[0].exchange == named["TWO"].exchange and choice.models[2] == start[2]
    assert log_likelihood(table, choice.tree, choice.models).groupBy().sum("lnl").first()[0] == pytest.approx(choice.lnl, abs=1e-6)


def test_a_choice_that_loses_is_taken_back_as_a_whole(spark):
    n, tree, named = 6, random_tree(6, 9), matrices()
    table = table_of(spark, simulated(tree, n, 100, named["TWO"]))
    choice = auto_models(table, tree, {0: named["TWO"]}, {"ONE": named["ONE"]}, {0: named["THREE"].freqs}, rounds=3)
    assert not choice.taken and choice.models[0] == named["TWO"] and choice.tree == tree


def test_everything_is_optimised_in_cycles(spark):
    n, tree, named = 6, random_tree(6, 9), matrices()
    table = table_of(spark, simulated(tree, n, 120, named["THREE"].with_(categories=4, alpha=0.4)))
    models, new, lnl, _ = optimise_all(table, tree, {0: equal_rates(20)}, named, {0: (0.05,) * 20}, cycles=2)
    assert models[0].exchange == named["THREE"].exchange and models[0].alpha < 0.9
    assert log_likelihood(table, new, models).first().lnl == pytest.approx(lnl, abs=1e-6)


def test_criteria():
    assert penalised(-10.0, 3, 100, "ml") == -10 and penalised(-10.0, 3, 100, "aic") == -13
    assert penalised(-10.0, 3, 100, "bic") == pytest.approx(-10 - 1.5 * math.log(100)) and penalised(-10.0, 3, 100, "aicc") == pytest.approx(-13 - 12 / 96)
    with pytest.raises(ValueError):
        penalised(0.0, 1, 1, "best")


def test_one_sweep_moves_all_partitions(spark, monkeypatch):
    n, tree = 7, random_tree(7, 3)
    long = [(u, v, z**3) for u, v, z in tree]
    rows = [(p, i, 1, [int(x) for x in c]) for p, t in enumerate((tree, long)) for i, c in enumerate(simulated(t, n, 150, DNA_MODEL, seed=p))]
    table = spark.createDataFrame(rows, "part_id int, pattern_id int, weight long, codes array<int>")
    models, count = {0: DNA_MODEL, 1: DNA_MODEL}, [0]
    real = blockwise.sweep
    monkeypatch.setattr(blockwise, "sweep", lambda *a: (count.__setitem__(0, count[0] + 1), real(*a))[1])
    own = {r.part_id: r for r in partition_trees(table, tree, models, names_of(n), 12).collect()}
    both = count[0]
    count[0] = 0
    alone = {r.part_id: r for p in (0, 1) for r in partition_trees(table.where(f"part_id = {p}"), tree, {p: DNA_MODEL}, names_of(n), 12).collect()}
    assert both < count[0] and {p: r.lnl for p, r in own.items()} == pytest.approx({p: r.lnl for p, r in alone.items()}, abs=1e-6)
    assert own[1].length > 1.8 * own[0].length


def test_large_tables_are_fitted_by_sweeps_as_in_one_task(spark, monkeypatch):
    n, tree = 6, random_tree(6, 3)
    table, models = table_of(spark, simulated(tree, n, 200, DNA_MODEL)).repartition(2), {0: equal_rates(4, categories=1)}
    near = fit_models(table, tree, models, freqs=True).first()
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 0)
    far = fit_models(table, tree, models, freqs=True).first()
    assert far.lnl == pytest.approx(near.lnl, abs=0.05) and list(far.exchange) == pytest.approx(list(near.exchange), rel=0.1)
    assert newick.write(tree, names_of(n))
