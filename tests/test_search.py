"""Moves scored from directional vectors, phases of the search, and restarts."""

import itertools
import math
import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborspark.functions.numerics import Mixture, Model, as_text, equal_rates, models_of
from arborspark.plans import insertion, kernel, reports, search as plans
from arborspark.plans.evaluate import evaluate_trees, gathered
from arborspark.plans.insertion import grafts, prunings, score_moves
from arborspark.plans.kernel import Block, root_edge
from arborspark.plans.likelihood import blocks_of, log_likelihood
from arborspark.plans.search import DONE, FAST, THOROUGH, moves, run_search, spr_cycle
from arborspark.sources import newick
from arborspark.sources.newick import regraft

MODEL = Model((0.1, 0.2, 0.3, 0.4), (1.0, 2.0, 0.5, 0.7, 3.0, 1.0), alpha=0.6)


def names_of(n):
    return [f"t{i:03d}" for i in range(n)]


def random_tree(n, seed=1):
    r, names = random.Random(seed), names_of(n)
    parts = [f"{x}:{r.uniform(0.05, 0.4):.4f}" for x in names]
    while len(parts) > 3:
        a, b = (parts.pop(r.randrange(len(parts))) for _ in range(2))
        parts.append(f"({a},{b}):{r.uniform(0.03, 0.2):.4f}")
    return newick.parse("(" + ",".join(parts) + ");", {x: i for i, x in enumerate(names)}, True)


def simulated(tree, n_taxa, sites, model=MODEL, seed=3, rates=None):
    """Codes (site by taxon) that evolved along a tree."""
    rng, near = np.random.default_rng(seed), newick.neighbours(tree)
    k = rng.integers(0, len(model.rates), sites)
    states = {n_taxa: rng.choice(model.states, sites, p=np.array(model.freqs) / sum(model.freqs))}
    queue = [n_taxa]
    for n in queue:
        for c, z in near[n].items():
            if c not in states:
                p = np.stack([kernel_transition(model, z if rates is None else z**r) for r in (rates if rates is not None else [1])])
                p = p[0][k] if rates is None else p[:, 0]
                states[c] = np.array([rng.choice(model.states, p=np.maximum(p[i, s], 0) / np.maximum(p[i, s], 0).sum()) for i, s in enumerate(states[n])])
                queue.append(c)
    return np.stack([1 << states[i] for i in range(n_taxa)], axis=1)


def kernel_transition(model, z):
    return model.transition(z)


def table_of(spark, codes, parts=1, weights=None):
    rows = [(i % parts, i, int(weights[i]) if weights is not None else 1, [int(x) for x in c]) for i, c in enumerate(codes)]
    return spark.createDataFrame(rows, "part_id int, pattern_id int, weight long, codes array<int>")


def test_insertions_equal_full_scores():
    tree = random_tree(12)
    codes, w = simulated(tree, 12, 60), np.random.default_rng(0).integers(1, 4, 60)
    blocks, seen = [Block(codes[:35], w[:35], MODEL, tree), Block(codes[35:], w[35:], equal_rates(4), tree)], set()

    def visit(node, cut, a, b, graft):
        new = regraft(tree, node, cut, a, b)
        assert graft.lnl() == pytest.approx(sum(Block(x.codes, x.weights, x.model, new).lnl(*root_edge(new)) for x in blocks), abs=1e-8)
        seen.add((node, cut, a, b))
        return True

    for node, cut in prunings(tree, 12):
        grafts(blocks, node, cut, 30, lambda a, b, _, g, node=node, cut=cut: visit(node, cut, a, b, g))
    assert seen == {m for m in moves(tree, 12, 30) if regraft(tree, *m) is not tree}


def test_settled_insertions_are_optima_of_their_branches():
    tree = random_tree(9, 4)
    codes = simulated(tree, 9, 80)
    block = Block(codes, np.ones(80), MODEL, tree)

    def visit(node, cut, a, b, graft):
        before = graft.lnl()
        lnl = graft.settle(40, 1e-9)
        new = plans.with_lengths(regraft(tree, node, cut, a, b), dict(zip(((cut, a), (cut, b), (cut, node)), graft.z[0])))
        full = Block(codes, np.ones(80), MODEL, new)
        assert lnl >= before and full.lnl(*root_edge(new)) == pytest.approx(lnl, abs=1e-7)
        for x in (a, b, node):
            assert abs(full.slopes(cut, x, full.near[cut][x])[0]) < 0.1 or not 1e-5 < -math.log(full.near[cut][x]) < 30
        return True

    for node, cut in prunings(tree, 9)[::3]:
        grafts([block], node, cut, 3, lambda a, b, _, g, node=node, cut=cut: visit(node, cut, a, b, g))


def test_a_move_costs_the_same_for_any_number_of_taxa(monkeypatch):
    made = {}
    for n in (20, 200):
        tree = random_tree(n)
        block, calls, visited = Block(np.ones((2, n), int), np.ones(2), MODEL, tree), [0], [0]
        for node, cut in prunings(tree, n):
            block.toward(node, cut)
        real = insertion.joined
        monkeypatch.setattr(insertion, "joined", lambda *a: (calls.__setitem__(0, calls[0] + 1), real(*a))[1])
        made[n] = 0
        before = len(block.vectors)
        for node, cut in prunings(tree, n):
            grafts([block], node, cut, 3, lambda *a: visited.__setitem__(0, visited[0] + 1) or bool(a[3].lnl() or 1))
        monkeypatch.setattr(insertion, "joined", real)
        made[n] = calls[0] / visited[0]
        assert len(block.vectors) <= 2 * len(tree) and before <= len(block.vectors)
    assert made[20] == made[200] == 2  # the vector on the way out and the one at the graft


def test_moves_are_scored_over_blocks_as_in_one_task(spark):
    tree = random_tree(10, 2)
    table, models = table_of(spark, simulated(tree, 10, 150), 2).repartition(3), {0: MODEL, 1: equal_rates(4)}
    near = {tuple(r)[:4]: tuple(r)[5:] for r in score_moves(table, tree, models, 10, 4, local=gathered(table)).collect()}
    far = {tuple(r)[:4]: tuple(r)[5:] for r in score_moves(table, tree, models, 10, 4).collect()}
    assert near.keys() == far.keys() and len(near) > 100
    assert all(far[k] == pytest.approx(near[k], abs=1e-7) for k in near)


def test_few_blocks_are_shared_by_lots_of_subtrees(spark, monkeypatch):
    tree = random_tree(8, 2)
    table, models = table_of(spark, simulated(tree, 8, 90)).coalesce(1), {0: MODEL}
    assert score_moves(table, tree, models, 8, 3).count() == sum(regraft(tree, *m) is not tree for m in moves(tree, 8, 3))
    monkeypatch.setattr(kernel, "VECTOR_BYTES", 1 << 12)
    monkeypatch.setattr(insertion, "VECTOR_BYTES", 1 << 12)
    a = score_moves(table, tree, models, 8, 3).agg(F.sum("lnl")).first()[0]
    assert a == pytest.approx(score_moves(table, tree, models, 8, 3, local=gathered(table)).agg(F.sum("lnl")).first()[0])


def test_moves_of_a_large_tree_stay_off_the_driver(spark):
    n = 500
    tree = random_tree(n, 8)
    table = table_of(spark, np.ones((1, n), int))
    tracemalloc.start()
    began = time.time()
    count = score_moves(table, tree, {0: equal_rates(4, categories=1)}, n, 10, local=gathered(table)).count()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count > 100_000 and peak < 16 << 20 and time.time() - began < 240


@pytest.mark.parametrize("every_edge", [True, False])
def test_memory_of_a_block_does_not_grow_with_taxa(monkeypatch, every_edge):
    monkeypatch.setattr(kernel, "VECTOR_BYTES", 1 << 20)
    peaks = {}
    for n in (50, 500):
        tree = random_tree(n, 5)
        rows = pd.DataFrame({"part_id": 0, "weight": 1, "codes": list(np.random.default_rng(1).choice([1, 2, 4, 8], (60 if every_edge else 800, n)).astype(np.int32))})
        tracemalloc.start()
        for _, _, block in blocks_of(rows, tree, {0: MODEL}, every_edge):
            for u, v, _ in tree if every_edge else tree[:1]:
                block.lnl(u, v)
        peaks[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peaks[500] < 1.5 * peaks[50] + (2 << 20) and max(peaks.values()) < 10 << 20


def test_slices_give_the_same_likelihood(spark, monkeypatch):
    tree = random_tree(30, 7)
    table, models = table_of(spark, simulated(tree, 30, 200), 2), {0: MODEL, 1: Mixture.gamma((equal_rates(4, categories=1),) * 4, 0.5)}
    whole = {r.part_id: r.lnl for r in log_likelihood(table, tree, models).collect()}
    rows = table.toPandas()
    monkeypatch.setattr(kernel, "VECTOR_BYTES", 1 << 14)
    cut: dict = {}
    for part, _, block in blocks_of(rows, tree, models, False):
        cut[part] = cut.get(part, 0.0) + block.lnl(*root_edge(tree))
        assert len(block.codes) < 20 and len(block.vectors) <= 2
    assert cut == pytest.approx(whole)


def all_trees(names):
    """Every binary tree, a taxon after the other put into every edge."""
    tips = {x: i for i, x in enumerate(names)}
    shapes = [("", "")]
    trees = [f"({names[0]},{names[1]},{names[2]});"]
    for k in range(3, len(names)):
        out = []
        for t in trees:
            edges = newick.parse(t, {x: i for i, x in enumerate(names[:k])})
            for u, v, _ in edges:
                new = [e for e in edges if e[:2] != (u, v)]
                shift = lambda x: x + 1 if x >= k else x  # noqa: E731, B023
                new = [(shift(a), shift(b), z) for a, b, z in new]
                c = 2 * (k + 1) - 3
                out.append(newick.write([*new, (shift(u), c, 0.9), (shift(v), c, 0.9), (k, c, 0.9)], names[: k + 1], False))
        trees = out
    assert shapes and len(tips) == len(names)
    return trees


def test_search_finds_the_best_of_all_trees(spark):
    tree, names = random_tree(6, 11), names_of(6)
    table, models = table_of(spark, simulated(tree, 6, 120)), {0: equal_rates(4)}
    every = all_trees(names)
    assert len(set(every)) == 105
    rows = spark.createDataFrame(list(enumerate(every)), "tree_id long, newick string").repartition(4)
    best = evaluate_trees(rows, table, models, names, passes=4).orderBy(F.desc("lnl")).first()
    worst = "((t000,t005),(t001,t004),(t002,t003));"
    states = run_search(table, worst, models, names, radius=2, most=7)
    end = newick.write(newick.parse(states[-1].newick, {x: i for i, x in enumerate(names)}), names, False)
    assert states[-1].lnl == pytest.approx(best["lnl"], abs=0.01)
    assert end == newick.write(newick.parse(best["newick"], {x: i for i, x in enumerate(names)}), names, False)
    assert [k for k, _ in itertools.groupby(s.phase for s in states)] == [FAST, THOROUGH, DONE]
    assert all(a.lnl <= b.lnl for a, b in itertools.pairwise(states))


def test_the_cutoff_saves_moves(spark):
    n = 64
    tree, names = random_tree(n, 6), names_of(n)
    table, models = table_of(spark, simulated(tree, n, 150)), {0: MODEL}
    local, text = gathered(table), newick.write(tree, names)
    start = log_likelihood(table, tree, models).first().lnl
    whole = spr_cycle(table, text, models, names, 12, 5, local=local, rounds=0, start=start)
    some = spr_cycle(table, text, models, names, 12, 5, local=local, rounds=0, start=start, cutoff=whole.drop)
    some = spr_cycle(table, text, models, names, 12, 5, local=local, rounds=0, start=start, cutoff=some.drop)  # the next cycle
    assert whole.drop > some.drop > 0 and 0 < some.scored <= whole.scored / 2
    assert some.best[0][0] == pytest.approx(whole.best[0][0], abs=1e-8)


def test_a_stopped_search_ends_as_the_whole_one(spark, tmp_path):
    tree, names = random_tree(6, 3), names_of(6)
    table, models = table_of(spark, simulated(tree, 6, 80)), {0: equal_rates(4, alpha=3.0)}
    begin = "((t000,t003),(t001,t005),(t002,t004));"
    options = {"radius": 2, "most": 2, "fit_model": True, "epsilon": 3.0}
    whole = run_search(table, begin, dict(models), names, **options)
    folder = str(tmp_path / "steps")
    part = run_search(table, begin, dict(models), names, folder=folder, steps=2, **options)
    assert len(part) == 2 < len(whole) and part[-1].models[0].exchange != models[0].exchange
    (tmp_path / "steps" / "state=000002" / "_temporary").mkdir(parents=True)  # broken off while it was written
    again = run_search(table, begin, dict(models), names, folder=folder, **options)
    assert again[:2] == part and again[-1].lnl == pytest.approx(whole[-1].lnl, abs=1e-6) and again[-1].models == whole[-1].models
    own = newick.parse(again[-1].newick, {x: i for i, x in enumerate(names)}, True)
    assert log_likelihood(table, own, again[-1].models).first().lnl == pytest.approx(again[-1].lnl, abs=1e-5)
    log = reports.stored_search_log(spark, folder).collect()
    assert [r.lnl for r in log] == [s.lnl for s in again] and log[-1].phase == DONE and log[0].gain is None
    assert 0 < log[0].seconds and all(a.seconds < b.seconds for a, b in zip(log, log[1:]))
    assert sum(r.gain for r in log[1:]) == pytest.approx(log[-1].lnl - log[0].lnl)
    with pytest.raises(ValueError, match="other options"):
        run_search(table, begin, dict(models), names, folder=folder, **{**options, "radius": 3})


def test_site_rates_are_restored(spark, tmp_path):
    tree, names = random_tree(6, 3), names_of(6)
    table, models = table_of(spark, simulated(tree, 6, 40)).withColumn("rate", F.lit(1.0)), {0: equal_rates(4, categories=1)}
    begin, folder = newick.write(tree, names), str(tmp_path / "steps")
    options = {"radius": 1, "most": 1, "fit_model": True, "epsilon": 20.0}
    part = run_search(table, begin, dict(models), names, folder=folder, steps=1, **options)
    assert (tmp_path / "steps" / "rates-000000" / "_SUCCESS").exists()
    again = run_search(table, begin, dict(models), names, folder=folder, **options)
    assert again[0] == part[0] and again[-1].phase == DONE and again[-1].lnl >= part[0].lnl


def stretched(tree, factor):
    return [(u, v, z**factor) for u, v, z in tree]


def two_partitions(spark, tree, n, sites=150):
    """The second partition evolves three times as fast."""
    codes = [simulated(stretched(tree, k), n, sites, equal_rates(4, categories=1), seed=k) for k in (1, 3)]
    rows = [(p, i, 1, [int(x) for x in c]) for p, part in enumerate(codes) for i, c in enumerate(part)]
    return spark.createDataFrame(rows, "part_id int, pattern_id int, weight long, codes array<int>"), {p: equal_rates(4, categories=1) for p in (0, 1)}


def test_moves_with_lengths_by_partition(spark):
    n, tree = 8, random_tree(8, 3)
    table, models = two_partitions(spark, tree, n, 40)
    own = {0: tree, 1: stretched(tree, 3)}
    blocks = {p: (np.array([r.codes for r in table.where(f"part_id = {p}").orderBy("pattern_id").collect()]), np.ones(40)) for p in own}
    near = {tuple(r)[:4]: r.lnl for r in score_moves(table, tree, models, n, 3, local=gathered(table), own=own).collect()}
    far = {tuple(r)[:4]: r.lnl for r in score_moves(table.repartition(2), tree, models, n, 3, own=own).collect()}
    settled = {tuple(r)[:4]: r.lnl for r in score_moves(table, tree, models, n, 3, 4, local=gathered(table), own=own).collect()}
    assert near.keys() == far.keys() == settled.keys()
    for k, lnl in near.items():
        full = sum(Block(c, w, models[p], regraft(own[p], *k)).lnl(*root_edge(regraft(own[p], *k))) for p, (c, w) in blocks.items())
        assert lnl == pytest.approx(full, abs=1e-7) == far[k] and settled[k] >= lnl - 1e-9


def test_search_with_lengths_by_partition(spark, tmp_path):
    n, tree, names = 6, random_tree(6, 3), names_of(6)
    table, models = two_partitions(spark, tree, n, 80)
    begin, folder = "((t000,t003),(t001,t005),(t002,t004));", str(tmp_path / "steps")
    options = {"radius": 2, "most": 2, "by_partition": True, "epsilon": 0.5}
    part = run_search(table, begin, dict(models), names, steps=2, folder=folder, **options)
    states = run_search(table, begin, dict(models), names, folder=folder, **options)
    one = run_search(table, begin, dict(models), names, radius=2, most=2, epsilon=0.5)
    tips = {x: i for i, x in enumerate(names)}
    assert states[:2] == part and newick.tip_sets(newick.parse(states[-1].newick, tips), n) == newick.tip_sets(tree, n)
    own = {p: newick.parse(t, tips, True) for p, t in states[-1].own.items()}
    size = {p: -sum(math.log(z) for _, _, z in t) for p, t in own.items()}
    assert size[1] > 2 * size[0] and states[-1].lnl > one[-1].lnl + 10
    mean = -sum(math.log(z) for _, _, z in newick.parse(states[-1].newick, tips, True))
    assert mean == pytest.approx((size[0] + size[1]) / 2, rel=1e-6)
    lnl = sum(log_likelihood(table.where(f"part_id = {p}"), own[p], models).first().lnl for p in own)
    assert lnl == pytest.approx(states[-1].lnl, abs=1e-4)


def test_models_are_written_and_read():
    models = {0: MODEL, 3: Mixture((MODEL, equal_rates(4, categories=1)), (0.5, 2.0), (0.3, 0.7))}
    assert models_of(as_text(models)) == models
