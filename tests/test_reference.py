"""The alignment and tree operators against brute force and mathematical invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborspark.functions.encoding import AA, BINARY, DNA, decode, encode
from arborspark.functions.numerics import Model, equal_rates, gamma_rates, lower_gamma
from arborspark.operators import alignment, frequencies, quartets, trees
from arborspark.plans.kernel import Block, root_edge, smooth, tree_of
from arborspark.plans import blockwise, evaluate
from arborspark.plans.evaluate import evaluate_trees, score_quartets
from arborspark.plans.likelihood import categorise, derivatives, log_likelihood, site_rates
from arborspark.plans.search import choose_radius, moves, regraft, relative_distance, search
from arborspark.queries import caterpillar
from arborspark.sources import newick, partitions, phylip, pattern_store

NAMES = list("abcde")
TIPS = {n: i for i, n in enumerate(NAMES)}
TREE = newick.parse("((a:0.1,b:0.2):0.05,c:0.3,(d:0.1,e:0.25):0.15);", TIPS, True)
MODEL = Model((0.1, 0.2, 0.3, 0.4), (1.0, 2.0, 0.5, 0.7, 3.0, 1.0), alpha=0.6)


def block(tree=TREE, model=MODEL, n=9, seed=0):
    rng = np.random.default_rng(seed)
    return Block(rng.integers(1, 1 << model.states, (n, 5)), rng.integers(1, 5, n), model, tree)


def brute(codes, model, tree):
    total = 0.0
    for k in range(len(model.rates)):
        for inner in itertools.product(range(model.states), repeat=3):
            state = dict(zip((5, 6, 7), inner))
            p = model.freqs[state[5]]
            for u, v, z in tree:
                m = model.transition(z)[k]
                p *= sum(m[state[u], x] for x in range(model.states) if codes[v] >> x & 1) if v < 5 else m[state[u], state[v]]
            total += p / len(model.rates)
    return math.log(total)


@pytest.mark.parametrize("model", [MODEL, equal_rates(2, categories=1), equal_rates(4, alpha=2.0, median=True)])
def test_likelihood_is_the_sum_over_inner_states_at_every_edge(model):
    b = block(model=model)
    want = sum(w * brute(c, model, TREE) for c, w in zip(b.codes, b.weights))
    for u, v, _ in TREE:
        assert b.lnl(u, v) == pytest.approx(want, abs=1e-9)


def test_derivatives_and_smoothing():
    b = block()
    u, v, z = TREE[0]
    t, h = -math.log(z), 1e-5
    f = lambda x: float(b.weights @ b.pattern_likelihoods(u, v, math.exp(-x)))
    d1, d2 = b.slopes(u, v, z)
    assert d1 == pytest.approx((f(t + h) - f(t - h)) / 2 / h, rel=1e-5)
    assert d2 == pytest.approx((f(t + h) - 2 * f(t) + f(t - h)) / h / h, rel=1e-3)
    before = b.lnl(u, v)
    smooth([b])
    after = tree_of(b.near)
    assert b.lnl(u, v) >= before
    assert Block(b.codes, b.weights, MODEL, after).lnl(*root_edge(after)) == pytest.approx(b.lnl(u, v), abs=1e-9)


def test_deep_trees_are_scaled():
    n = 900
    b = Block(np.tile([1, 2, 4, 8], (3, n // 4)), np.ones(3), equal_rates(4), caterpillar(n, 0.5))
    assert math.isfinite(b.lnl(*root_edge(caterpillar(n)))) and b.lnl(*root_edge(caterpillar(n))) < -1000


def test_gamma():
    assert lower_gamma(1.0, 1.0) == pytest.approx(1 - math.exp(-1), abs=1e-12)
    for a in (0.05, 0.5, 1.0, 30.0):
        for median in (False, True):
            r = gamma_rates(a, 4, median)
            assert r.mean() == pytest.approx(1) and (np.diff(r) >= 0).all()


def test_encoding(spark):
    for kind in (DNA, AA, BINARY):
        rows = spark.createDataFrame([(c,) for c in kind.characters], "c string").select("c", encode(F.col("c"), kind).alias("m"))
        assert {r["c"]: r["m"] for r in rows.collect()} == {c: kind.mask(c) for c in kind.characters}
        back = rows.select("m", decode(F.col("m"), kind).alias("d")).collect()
        assert all(kind.mask(r["d"]) == r["m"] for r in back)


def test_phylip(spark, tmp_path):
    sequential = "4 6\nalpha ACG\nTAC\nbeta ACGTAA\ngamma ACGTTT\ndelta AC GT NN\n"
    interleaved = "4 6\nalpha ACG\nbeta ACG\ngamma ACG\ndelta ACG\n\nTAC\nTAA\nTTT\nTNN\n"
    want = [(1, "alpha", "ACGTAC"), (2, "beta", "ACGTAA"), (3, "gamma", "ACGTTT"), (4, "delta", "ACGTNN")]
    for i, text in enumerate((sequential, interleaved)):
        (tmp_path / f"{i}.phy").write_text(text)
        got = phylip.read_phylip(spark, str(tmp_path / f"{i}.phy")).orderBy("taxon_id").collect()
        assert [(r["taxon_id"], r["name"], r["seq"]) for r in got] == want
    for bad in ("3 6\n", "x\n", "4 6\na AC\nb ACGTAA\nc ACGTTT\nd ACGTNN\n"):
        with pytest.raises(ValueError):
            phylip.parse_phylip(bad)
    names = spark.createDataFrame([("ok",), ("ok",), ("a b",), ("x;y",)], "name string")
    assert {r["name"] for r in phylip.bad_names(names).collect()} == {"ok", "a b", "x;y"}


def test_partitions(spark):
    p = partitions.partitions(spark, ["DNA, g1 = 1-10\\2, 20", "WAGF, g2=2-10\\2", "AUTOF, g3 = 11-19", "LGX, g4 = 30-40"])
    rows = [(r["part_id"], r["name"], r["data_type"], r["freq_mode"], r["lo"], r["hi"], r["step"]) for r in p.orderBy("part_id", "lo").collect()]
    assert rows == [
        (0, "g1", "DNA", "empirical", 1, 10, 2), (0, "g1", "DNA", "empirical", 20, 20, 1), (1, "g2", "AA", "empirical", 2, 10, 2),
        (2, "g3", None, rows[3][3], 11, 19, 1), (3, "g4", "AA", "optimised", 30, 40, 1),
    ]
    wrong = partitions.misassigned(spark.range(1, 42).selectExpr("int(id) as site"), p).collect()
    assert {r["site"] for r in wrong} == set(range(21, 30)) | {41}


def test_patterns_keep_weight_and_likelihood(spark):
    rng = np.random.default_rng(1)
    codes = rng.choice([1, 2, 4, 8, 15], (60, 5))
    codes[10:30] = codes[5]
    codes[40] = 15
    rows = [(t, s + 1, int(codes[s, t])) for s in range(60) for t in range(5)]
    cells = spark.createDataFrame(rows, "taxon_id int, site int, code int")
    parts = spark.createDataFrame([(s + 1, s // 30) for s in range(60)], "site int, part_id int")
    found = alignment.patterns(cells, parts, 15)
    loose = alignment.patterns(cells, parts, 15, compress=False)
    kept = [tuple(c) for c in codes if (c != 15).any()]
    assert found.agg({"weight": "sum"}).first()[0] == len(kept) == loose.count()
    assert found.count() == len({(s // 30, tuple(codes[s])) for s in range(60) if (codes[s] != 15).any()})
    models = {0: MODEL, 1: MODEL}
    score = lambda f: {r["part_id"]: r["lnl"] for r in log_likelihood(alignment.pattern_codes(cells, f, 5, 15), TREE, models).collect()}
    a, b = score(found), score(loose)
    want = sum(brute(c, MODEL, TREE) for c in kept)
    assert sum(a.values()) == pytest.approx(want) and a == pytest.approx(b)
    weights = {r["part_id"]: r for r in alignment.partition_weights(found).collect()}
    assert sum(r["contribution"] for r in weights.values()) == pytest.approx(1)


def test_em_frequencies(spark):
    rows = [(0, 1, 10), (0, 2, 5), (0, 15, 7), (0, 5, 3)]
    got = frequencies.em_frequencies(spark.createDataFrame(rows, "part_id int, code int, weight long"), 4).first()["freqs"]
    f = np.full(4, 0.25)
    for _ in range(8):
        new = np.zeros(4)
        for _, code, w in rows:
            mask = np.array([code >> i & 1 for i in range(4)])
            new += w * mask * f / (mask @ f)
        f = new / sum(w for *_, w in rows)
    assert got == pytest.approx(list(f))
    s = frequencies.smooth([0.0, 0.5, 0.5, 0.0])
    assert sum(s) == pytest.approx(1) and min(s) == pytest.approx(0.001)


def test_newick(spark):
    for text in ("((a,b),(c,(d,e)));", "(a,b,(c,(d,e)));", "((d,e)[x],'c',(b:0.1,a:2):1)root;"):
        assert newick.write(newick.parse(text, TIPS), NAMES, False) == "(a,b,(c,(d,e)));"
    again = newick.parse(newick.write(TREE, NAMES), TIPS, True)
    assert newick.write(again, NAMES) == newick.write(TREE, NAMES)
    for bad in ("(a,b,(c,d));", "(a,b,(c,(d,d)));", "(a,b,c,(d,e));", "((a,b),(c,(d,e));"):
        with pytest.raises(ValueError):
            newick.parse(bad, TIPS)
    rows = spark.createDataFrame([(1, "((a,b),(c,(d,e)));"), (2, "((a,c),(b,(d,e)));")], "tree_id long, newick string")
    s = newick.splits(rows, NAMES)
    assert s.where("tree_id = 1").count() == 2
    r = trees.rf_distance(s, 1, 2).first()
    assert (r["shared"], r["differing"], r["relative"]) == (1, 2, 0.5)
    assert trees.rf_distance(s, 1, 1).first()["relative"] == 0
    length = newick.to_edges(rows, NAMES).select(trees.tree_length(F.col("edges"))).first()[0]
    assert length == pytest.approx(-7 * math.log(0.9))


def simulated(spark, n=400, seed=3):
    """Patterns that evolve along TREE under equal rates."""
    rng, model = np.random.default_rng(seed), equal_rates(4, categories=1)
    states = np.zeros((n, 8), int)
    states[:, 5] = rng.integers(0, 4, n)
    for u, v, z in sorted(TREE, key=lambda e: (e[0] != 5, e)):
        p = model.transition(z)[0]
        states[:, v] = [rng.choice(4, p=p[s] / p[s].sum()) for s in states[:, u]]
    found, weight = np.unique(1 << states[:, :5], axis=0, return_counts=True)
    rows = [(0, i, int(w), [int(x) for x in c]) for i, (c, w) in enumerate(zip(found, weight))]
    return spark.createDataFrame(rows, "part_id int, pattern_id int, weight long, codes array<int>"), {0: model}


def test_trees_quartets_and_search(spark):
    table, models = simulated(spark)
    rows = spark.createDataFrame([(1, "((a,b),(c,(d,e)));"), (2, "((a,d),(c,(b,e)));")], "tree_id long, newick string")
    done = {r["tree_id"]: r for r in evaluate_trees(rows, table, models, NAMES).collect()}
    assert done[1]["lnl"] > done[2]["lnl"]
    taxa = spark.createDataFrame([(i,) for i in range(5)], "taxon_id int")
    four = quartets.all_quartets(taxa)
    assert four.count() == math.comb(5, 4)
    best = score_quartets(four.where("t1 = 0 and t2 = 1 and t3 = 3"), table, models).orderBy("lnl", ascending=False).first()
    assert best["topology"] == 0
    steps = search(table, "((a,d),(c,(b,e)));", models, NAMES, radius=2, most=2)
    assert [x for x, _ in steps] == sorted(x for x, _ in steps)
    assert newick.write(newick.parse(steps[-1][1], TIPS), NAMES, False) == "(a,b,(c,(d,e)));"


def test_large_alignments_stay_in_their_blocks(spark, monkeypatch, tmp_path):
    table, models = simulated(spark)
    table = table.repartition(3)
    rows = spark.createDataFrame([(1, "((a,b),(c,(d,e)));"), (2, "((a,d),(c,(b,e)));")], "tree_id long, newick string")
    four = quartets.all_quartets(spark.createDataFrame([(i,) for i in range(5)], "taxon_id int"))
    near = {r["tree_id"]: r["lnl"] for r in evaluate_trees(rows, table, models, NAMES).collect()}
    scores = {tuple(r)[:5]: r["lnl"] for r in score_quartets(four, table, models).collect()}
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 0)
    assert evaluate.gathered(table) is None
    far = {r["tree_id"]: r["lnl"] for r in evaluate_trees(rows, table, models, NAMES).collect()}
    assert far == pytest.approx(near, abs=0.01)
    assert {tuple(r)[:5]: r["lnl"] for r in score_quartets(four, table, models).collect()} == pytest.approx(scores, abs=0.01)
    steps = search(table, "((a,d),(c,(b,e)));", models, NAMES, radius=2, most=2, folder=str(tmp_path / "steps"))
    assert newick.write(newick.parse(steps[-1][1], TIPS), NAMES, False) == "(a,b,(c,(d,e)));"
    again = search(table, "((a,d),(c,(b,e)));", models, NAMES, radius=2, most=2, folder=str(tmp_path / "steps"))
    assert again[: len(steps)] == steps


def test_derivatives_are_summed_over_blocks(spark):
    table, models = simulated(spark)
    whole = Block(*(np.array(x) for x in zip(*((r["codes"], r["weight"]) for r in table.collect()))), models[0], TREE)
    for r in derivatives(table.repartition(3), TREE, models, [(u, v) for u, v, _ in TREE]).groupBy("u", "v").agg(*(F.sum(c).alias(c) for c in ("lnl", "d1", "d2"))).collect():
        assert (r["lnl"], r["d1"], r["d2"]) == pytest.approx((whole.lnl(r["u"], r["v"]), *whole.slopes(r["u"], r["v"], whole.near[r["u"]][r["v"]])))


def test_models_are_fitted_over_blocks_and_linked(spark):
    table, models = simulated(spark, 200)
    two = table.withColumn("part_id", (F.col("pattern_id") % 2).cast("int")).repartition(3)
    start = {p: models[0].with_(exchange=(4.0, 0.3, 2.0, 1.0, 0.5, 1.0)) for p in (0, 1)}
    before = sum(r["lnl"] for r in log_likelihood(two, TREE, start).collect())
    free, _, best = blockwise.fit(two, TREE, start, alpha=False, freqs=True, cycles=2)
    shared, _, tied = blockwise.fit(two, TREE, start, alpha=False, cycles=2, links={0: 7, 1: 7})
    assert before < tied <= best + 1e-6 and shared[0].exchange == shared[1].exchange and free[0].exchange != free[1].exchange
    assert sum(r["lnl"] for r in log_likelihood(two, TREE, free).collect()) == pytest.approx(best)
    assert all(min(m.freqs) >= 0.001 and sum(m.freqs) == pytest.approx(1) for m in free.values())


def test_radius_distance_and_deep_trees(spark):
    table, models = simulated(spark, 100)
    assert choose_radius(table, newick.write(TREE, NAMES), models, NAMES) in (5, 10)
    assert relative_distance("((a,b),(c,(d,e)));", "((a,c),(b,(d,e)));", NAMES) == 0.5
    n = 1200
    names = [f"t{i:04d}" for i in range(n)]
    text = newick.write(caterpillar(n), names)
    assert len(newick.tip_sets(newick.parse(text, {x: i for i, x in enumerate(names)}), n)) == n - 3


def test_site_rates_enter_the_likelihood(spark):
    table, models = simulated(spark, 80)
    rated = table.withColumn("rate", F.when(F.col("pattern_id") % 2 == 0, 0.5).otherwise(2.0))
    want = 0.0
    for r in rated.collect():
        want += r["weight"] * brute(r["codes"], models[0], [(u, v, z ** r["rate"]) for u, v, z in TREE])
    assert log_likelihood(rated, TREE, models).first()["lnl"] == pytest.approx(want)


@pytest.mark.parametrize("categories", [1, 2])
def test_twenty_states(categories):
    rng = np.random.default_rng(5)
    model = Model(tuple(rng.dirichlet(np.ones(20) * 5)), tuple(rng.gamma(1.0, 1.0, 190)), alpha=0.7, categories=categories)
    tree = newick.parse("(a:0.1,b:0.2,(c:0.3,d:0.1):0.4);", {n: i for i, n in enumerate("abcd")}, True)
    codes = np.array([[AA.mask(c) for c in column] for column in ("AACA", "WYFW", "B-ZX", "KRKQ")])
    got = Block(codes, np.ones(4), model, tree).pattern_likelihoods(*root_edge(tree))
    root = next(u for u, v, _ in tree if v == 0)
    other = ({u for u, _, _ in tree} | {v for _, v, _ in tree}) - {0, 1, 2, 3, root}
    (other,) = other
    z = {frozenset((u, v)): z for u, v, z in tree}
    for row, lnl in zip(codes, got):
        tip = [np.array([m >> s & 1 for s in range(20)], float) for m in row]
        total = 0.0
        for k in range(len(model.rates)):
            p = {e: model.transition(x)[k] for e, x in z.items()}
            far = (p[frozenset((other, 2))] @ tip[2]) * (p[frozenset((other, 3))] @ tip[3])
            total += np.array(model.freqs) @ ((p[frozenset((root, 0))] @ tip[0]) * (p[frozenset((root, 1))] @ tip[1]) * (p[frozenset((root, other))] @ far))
        assert lnl == pytest.approx(math.log(total / len(model.rates)))


def test_moves_give_trees():
    for node, cut, a, b in moves(TREE, 5, 3):
        new = regraft(TREE, node, cut, a, b)
        assert len(new) == 7
        assert newick.write(newick.parse(newick.write(new, NAMES), TIPS), NAMES, False)


def test_site_rates_have_mean_one(spark):
    table, models = simulated(spark, 100)
    rates = site_rates(table, TREE, models, [0.1, 0.5, 1.0, 2.0]).join(table.select("part_id", "pattern_id", "weight"), ["part_id", "pattern_id"])
    rows = categorise(rates, 3).collect()
    assert len(rows) == table.count() and len({r["category"] for r in rows}) <= 3
    assert sum(r["weight"] * r["category_rate"] for r in rows) / sum(r["weight"] for r in rows) == pytest.approx(1)


def test_placement_and_models(spark):
    parts = spark.createDataFrame([(0, "DNA", 10), (1, "DNA", 35), (2, "DNA", 7), (3, "AA", 9)], "part_id int, data_type string, width long")
    rows = trees.place(parts, 4).collect()
    for p, w in ((0, 10), (1, 35), (2, 7), (3, 9)):
        assert sum(r["width"] for r in rows if r["part_id"] == p) == w
    for kind in ({0, 1, 2}, {3}):
        load = {}
        for r in rows:
            if r["part_id"] in kind:
                load[r["rank"]] = load.get(r["rank"], 0) + r["width"]
        assert max(load.values()) <= -(-sum(load.values()) // 4)
    scored = spark.createDataFrame([(0, "WAG", "fixed", -100.0, 3, 50), (0, "WAG", "empirical", -95.0, 22, 50)], "part_id int, model string, freq_mode string, lnl double, k int, n long")
    assert trees.choose_models(scored, "ml").first()["freq_mode"] == "empirical"
    assert trees.choose_models(scored, "bic").first()["freq_mode"] == "fixed"


def test_pattern_store(spark, tmp_path):
    table, _ = simulated(spark, 50)
    taxa = spark.createDataFrame(list(enumerate(NAMES)), "taxon_id int, name string")
    pattern_store.write_patterns(table, taxa, str(tmp_path / "p"))
    assert pattern_store.read_patterns(spark, str(tmp_path / "p"), [0]).count() == table.count()
    assert pattern_store.read_patterns(spark, str(tmp_path / "p"), [1]).count() == 0
    with pytest.raises(Exception):
        pattern_store.write_patterns(table, taxa, str(tmp_path / "p"))
    assert pattern_store.latest_snapshot(spark, str(tmp_path / "s")) is None
    for i in range(2):
        pattern_store.snapshot(spark.range(i + 1), str(tmp_path / "s"), i)
    assert pattern_store.latest_snapshot(spark, str(tmp_path / "s")).count() == 2


def test_stream(spark, tmp_path):
    from arborspark.streaming.trees import evaluate_stream, tree_stream

    table, models = simulated(spark, 50)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("((a,b),(c,(d,e)));\n((a,d),(c,(b,e)));\n")
    query = evaluate_stream(tree_stream(spark, str(tmp_path / "in")), table, models, NAMES, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_models_are_fitted_and_chosen(spark):
    from arborspark.plans.models import fit_models, score_models

    table, models = simulated(spark, 150)
    start = {0: models[0].with_(exchange=(4.0, 0.3, 2.0, 1.0, 0.5, 1.0))}
    before = log_likelihood(table, TREE, start).first()["lnl"]
    got = fit_models(table, TREE, start, alpha=False, freqs=True).first()
    again = {0: start[0].with_(exchange=tuple(got["exchange"]), freqs=tuple(got["freqs"]))}
    assert got["lnl"] > before and log_likelihood(table, TREE, again).first()["lnl"] == pytest.approx(got["lnl"])
    skew = equal_rates(4, categories=1).with_(exchange=(9.0, 0.1, 0.1, 0.1, 0.1, 9.0))
    scored = score_models(table, TREE, {"equal": models[0], "skew": skew}, {0: (0.25, 0.25, 0.25, 0.25)})
    assert scored.count() == 4
    assert trees.choose_models(scored, "bic").first()["model"] == "equal"


def test_ingest(spark, tmp_path):
    from arborspark.sources.ingest import read_alignment

    (tmp_path / "a.phy").write_text("4 10\nta ACGTACRDGH\ntb ACGTAC-DXH\ntc TCGTAC?D-K\ntd TCNTAA-EGK\n")
    (tmp_path / "a.model").write_text("DNA, g1 = 1-6\\2\nDNA, g2 = 2-6\\2, 7\nWAG, p = 8-10\n")
    a = read_alignment(spark, str(tmp_path / "a.phy"), str(tmp_path / "a.model"))
    assert [r["name"] for r in a.taxa.orderBy("taxon_id").collect()] == ["ta", "tb", "tc", "td"]
    rows = {r["part_id"]: r for r in a.partitions.collect()}
    assert [(rows[p]["n_patterns"], rows[p]["weight"], rows[p]["states"], len(rows[p]["freqs"])) for p in (0, 1, 2)] == [(3, 3, 4, 4), (4, 4, 4, 4), (3, 3, 20, 20)]
    assert min(rows[2]["freqs"]) >= 0.001 - 1e-12 and sum(rows[2]["freqs"]) == pytest.approx(1)
    got = {(r["part_id"], r["pattern_id"]): (list(r["codes"]), r["weight"]) for r in a.patterns.collect()}
    assert got[1, 7] == ([5, 15, 15, 15], 1) and got[2, 9][0][1] == AA.undetermined and got[0, 3] == ([4, 4, 4, 15], 1)
    counts = alignment.state_counts(a.cells, partitions.site_map(spark.range(1, 11).selectExpr("int(id) as site"), a.ranges))
    gone = frequencies.missing_states(counts, a.ranges.select("part_id", "data_type").distinct())
    assert {r["state"] for r in gone.where("part_id = 0").collect()} == {"C"}
    pattern_store.write_patterns(a.patterns, a.taxa, str(tmp_path / "store"), a.partitions)
    assert pattern_store.read_metadata(spark, str(tmp_path / "store"))["n_patterns"] == 10
    assert pattern_store.read_partition_table(spark, str(tmp_path / "store")).count() == 3
    for model, text in (("DNA, g = 1-6", "ACGTACRDGH"), ("DNA, g = 1-10", "ACGTACRDGJ"), ("DNA, g = 1-9\\2\nDNA, h = 2-10\\2", None), ("ODD, g = 1-10", "A"), ("DNA, g = 1-9\nDNA, h = 10", "AAAAAAAAA-")):
        (tmp_path / "b.model").write_text(model + "\n")
        body = "".join(f"t{i} {text or 'ACGTACACGT'}\n" for i in range(4)) if text != "A" else "".join(f"t{i} ACGTACACGT\n" for i in range(4))
        (tmp_path / "b.phy").write_text("4 10\n" + body)
        with pytest.raises(ValueError):
            read_alignment(spark, str(tmp_path / "b.phy"), str(tmp_path / "b.model"), compress=text is not None)


def test_constraints_groups_and_random_quartets(spark):
    some = newick.constraint_splits("((a,b,c),d,e);", TIPS)
    assert some == {frozenset({3, 4})}
    for seed in range(5):
        text = newick.resolved("((a,b,c),d,e);", NAMES, seed)
        assert some <= newick.tip_sets(newick.parse(text, TIPS), 5)
    with pytest.raises(ValueError):
        newick.constraint_splits("((a,b),d,e);", TIPS)
    assert quartets.parse_groups("(a, b),(c),(d),\n(e);", NAMES) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]
    for bad in ("(a),(b),(c),(d);", "(a,b),(c),(d,e);", "(a),(b),(c),(d,e,e);"):
        with pytest.raises(ValueError):
            quartets.parse_groups(bad, NAMES)
    assert [quartets.unranked(i) for i in range(math.comb(9, 4))] == sorted(itertools.combinations(range(9), 4), key=lambda q: q[::-1])
    for count in (5, 100, 126, 500):
        got = [tuple(r) for r in quartets.random_quartets(spark, 9, count, 1).collect()]
        assert len(set(got)) == len(got) == min(count, 126) and all(a < b < c < d < 9 for a, b, c, d in got)
    assert [tuple(r) for r in quartets.random_quartets(spark, 9, 20, 1).collect()] == [tuple(r) for r in quartets.random_quartets(spark, 9, 20, 1).collect()]
    named = quartets.with_names(spark.createDataFrame([(0, 1, 2, 4)], "t1 int, t2 int, t3 int, t4 int"), NAMES).first()
    assert [named[f"n{i}"] for i in (1, 2, 3, 4)] == ["a", "b", "c", "e"]


def test_quartets_go_on_where_they_stopped(spark, tmp_path):
    table, models = simulated(spark, 60)
    four = quartets.all_quartets(spark.createDataFrame([(i,) for i in range(5)], "taxon_id int"))
    want = {tuple(r)[:5]: r["lnl"] for r in score_quartets(four, table, models).collect()}
    for _ in range(2):
        got = evaluate.score_quartets_in_lots(four, table, models, str(tmp_path / "q"), 3)
        assert {tuple(r)[:5]: r["lnl"] for r in got.collect()} == pytest.approx(want)


def test_mixtures():
    from arborspark.functions.numerics import Mixture

    rng = np.random.default_rng(2)
    parts = tuple(Model(tuple(rng.dirichlet(np.ones(4))), tuple(rng.gamma(1, 1, 6)), categories=1) for _ in range(3))
    mix = Mixture(parts, (0.3, 1.0, 2.5), (0.2, 0.5, 0.3))
    assert mix.weights @ mix.rates == pytest.approx(1) and mix.root.sum() == pytest.approx(1)
    b = block(model=mix, n=6)
    want = 0.0
    for c, w in zip(b.codes, b.weights):
        each = [math.exp(brute(c, m, [(u, v, z**r) for u, v, z in TREE])) for m, r in zip(parts, mix.rates)]
        want += w * math.log(mix.weights @ each)
    for u, v, _ in TREE:
        assert b.lnl(u, v) == pytest.approx(want, abs=1e-9)
    assert Mixture.gamma(parts, 0.7).rates == pytest.approx(gamma_rates(0.7, 3))


def test_reports(spark, tmp_path):
    from arborspark.functions.numerics import read_models
    from arborspark.plans import reports

    table, models = simulated(spark, 80)
    two = table.withColumn("part_id", (F.col("pattern_id") % 2).cast("int"))
    both = {0: models[0], 1: models[0]}
    own = {r["part_id"]: r for r in reports.partition_trees(two, TREE, both, NAMES).collect()}
    joint = blockwise.smoothed(two, both, [TREE])[0]
    assert sum(r["lnl"] for r in own.values()) >= joint[0] - 0.01
    edges = spark.createDataFrame([(p, u, v, z) for p, r in own.items() for u, v, z in newick.parse(r["newick"], TIPS, True)], "part_id int, u int, v int, z double")
    weights = alignment.partition_weights(two)
    mean = {(r["u"], r["v"]): r["length"] for r in reports.mean_branches(edges, weights).collect()}
    share = {r["part_id"]: r["contribution"] for r in weights.collect()}
    assert sum(mean.values()) == pytest.approx(sum(share[p] * r["length"] for p, r in own.items()), rel=1e-6)
    rows = reports.parameter_report(spark, 3, TREE, both).collect()
    assert len(rows) == 2 * (2 + 4 + 6) and {r["parameter"] for r in rows} >= {"alpha", "length", "freq_0", "rate_2_3"}
    scored = spark.createDataFrame([("x", -3.0), ("y", -2.0), ("x", -2.5)], "topology string, lnl double")
    reports.write_good_trees(scored, 2, str(tmp_path / "good"))
    assert [(r["rank"], r["topology"]) for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [(1, "y"), (2, "x")]
    reports.write_result(spark.createDataFrame([(2, "(b);"), (1, "(a);")], "tree_id long, newick string"), str(tmp_path / "out"))
    assert [r["newick"] for r in newick.read_trees(spark, str(tmp_path / "out")).orderBy("tree_id").collect()] == ["(a);", "(b);"]
    assert reports.search_log(spark, [(-3.0, "a"), (-2.0, "b")]).count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "own.dat").write_text(" ".join(str(1 + i % 7) for i in range(190)) + "\n" + " ".join(["0.05"] * 20))
    m = read_models(str(tmp_path / "m"), categories=1)["OWN"]
    assert max(m.exchange) == 10 and m.exchange[0] == pytest.approx(10 / 7) and m.eigen()[0].max() == pytest.approx(0, abs=1e-9)


def test_columns_are_counted_as_by_hand(spark, monkeypatch):
    from arborspark.queries import CODES, KINDS

    rng = np.random.default_rng(8)
    rows = [(rng.choice(["x", "y", "z"]), "".join(rng.choice(list("ABcdé中 -z1"), rng.integers(0, 30)))) for _ in range(60)] + [("x", None), (None, "AAA"), ("w", "")]
    counts = {}
    for taxon, text in rows:
        for site, c in enumerate(text or "", 1):
            code = 1 << ord(c) % 4 if c.isascii() and c.isalpha() else 15
            cell = counts.setdefault((taxon, site), {})
            cell[code] = cell.get(code, 0) + 1
    want = {(t, s, min(n, key=lambda c: (-n[c], c))) for (t, s), n in counts.items() if t}
    got = alignment.consensus(spark.createDataFrame([tuple(str(x) if x is not None else None for x in r) for r in rows], "source string, text string").repartition(3), "source", "text", KINDS, CODES)
    assert {(r["taxon"], r["site"], r["code"]) for r in got.collect()} == want


def test_rows_are_numbered_in_ranges(spark, monkeypatch):
    from arborspark.sources import tables

    rows = spark.createDataFrame([(f"n{i * 7919 % 5000:05d}",) for i in range(5000)], "name string").repartition(6)
    monkeypatch.setattr(tables.is_small, "__defaults__", (100,))
    got = [(r["name"], r["i"]) for r in tables.numbered(rows, "name", "i").collect()]
    assert sorted(got) == [(f"n{i:05d}", i) for i in range(5000)]


def test_lines_of_a_large_alignment(spark, tmp_path):
    (tmp_path / "a.phy").write_text("4 6\nalpha acg tac\nbeta ACGTAA\n\n gamma  ACGTTT\ndelta ACGTNN\n")
    got = {r["name"]: r["seq"] for r in phylip.read_phylip_lines(spark, str(tmp_path / "a.phy")).collect()}
    assert got == {"alpha": "ACGTAC", "beta": "ACGTAA", "gamma": "ACGTTT", "delta": "ACGTNN"}
