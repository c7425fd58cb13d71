"""Trees evaluated under models that are carried over."""

import math

import pytest

from arborspark.functions.numerics import equal_rates, models_of
from arborspark.plans import evaluate
from arborspark.plans.evaluate import evaluate_with_models
from arborspark.plans.likelihood import log_likelihood
from arborspark.sources import newick
from tests.test_search import MODEL, names_of, random_tree, simulated, table_of


@pytest.fixture(scope="module")
def case(spark):
    n, tree = 6, random_tree(6, 3)
    names = names_of(n)
    table = table_of(spark, simulated(tree, n, 80, MODEL.with_(categories=1)))
    trees = spark.createDataFrame([(7, newick.write(tree, names)), (9, "((t000,t003),(t001,t005),(t002,t004));"), (11, "((t000,t001),(t002,t005),(t003,t004));")], "tree_id long, newick string")
    return table, trees, {0: equal_rates(4, categories=1)}, names


def checked(table, rows, names):
    tips = {x: i for i, x in enumerate(names)}
    for r in rows:
        tree = newick.parse(r.newick, tips, True)
        assert log_likelihood(table, tree, models_of(r.models)).first().lnl == pytest.approx(r.lnl, abs=1e-4)
        assert r.length == pytest.approx(-sum(math.log(z) for _, _, z in tree), abs=1e-6)
    return {r.tree_id: r for r in rows}


def test_models_of_the_first_tree_are_carried_over(spark, case, tmp_path, monkeypatch):
    table, trees, models, names = case
    folder = str(tmp_path / "first")
    fast = checked(table, evaluate_with_models(trees, table, models, names, folder=folder, epsilon=2.0).collect(), names)
    assert set(fast) == {7, 9, 11} and len({r.models for r in fast.values()}) == 1 and models_of(fast[9].models) != models
    monkeypatch.setattr(evaluate, "fit_anywhere", None)  # a run that goes on does not fit the first tree again
    again = {r.tree_id: r.lnl for r in evaluate_with_models(trees, table, models, names, folder=folder, epsilon=2.0).collect()}
    assert again == pytest.approx({k: r.lnl for k, r in fast.items()})
    with pytest.raises(ValueError, match="another tree or other models"):
        evaluate_with_models(trees.where("tree_id > 7"), table, models, names, folder=folder, epsilon=2.0)
    monkeypatch.undo()
    whole = checked(table, evaluate_with_models(trees, table, models, names, fast=False, epsilon=0.5).collect(), names)
    assert len({r.models for r in whole.values()}) == 3 and all(whole[k].lnl >= fast[k].lnl - 0.6 for k in fast)
    assert whole[9].lnl + whole[11].lnl > fast[9].lnl + fast[11].lnl


def test_large_alignments_are_evaluated_in_their_blocks(spark, case, monkeypatch):
    table, trees, models, names = case
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 0)
    some = trees.where("tree_id < 11")
    for fast in (True, False):
        rows = checked(table, evaluate_with_models(some, table, models, names, fast=fast, epsilon=5.0).collect(), names)
        assert set(rows) == {7, 9}


def test_no_tree_gives_no_row(spark, case):
    table, trees, models, names = case
    assert evaluate_with_models(trees.where("tree_id < 0"), table, models, names).count() == 0
