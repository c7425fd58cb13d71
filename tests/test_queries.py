"""Queries on a small table against their SQL, or against full scores where SQL can't say them."""

import random

import duckdb
import numpy as np
import pytest

from arborspark import queries
from arborspark.plans.kernel import Block, root_edge
from arborspark.plans.search import moves
from arborspark.sources.newick import regraft


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(4), str(tmp_path_factory.mktemp("tables"))
    base = "".join(r.choice("etaoin shrdlu cmfwyp.") for _ in range(400))
    rows = []
    for i in range(14):
        text = "".join(r.choice("etaoinshrdl ") if r.random() < 0.25 else c for c in base)[: 250 + 15 * i]
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
    rows += [(90, None, "en", "s1", 0), (91, "", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["aa_model_choice", "rates_climbed", "best_topologies", "top_insertions", "tree_loglik_gamma", "rate_categorise", "psr_loglik"])
def test_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    rows = [dict(zip((c[0] for c in want.description), r)) for r in want.fetchall()]
    plain = lambda v: v if isinstance(v, str) else round(float(v), 6)
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def test_mean_rate_where_taxa_agree(spark, tmp_path):
    """Partitions without a differing site have a mean rate of 0 and no normalised rates: 0 / 0 is NaN in SQL."""
    path = f"{tmp_path}/documents.parquet"
    last = {"s0": "aabb", "s1": "aaca", "s2": "acbt"}  # sites 1001 to 1004: all but the first differ
    rows = [(i, "acgt" * 250 + end + " " * 2996 + tail, source) for i, ((source, end), tail) in enumerate(zip(last.items(), ("gg", "g", "")))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["weighted_mean_rate"] + " ORDER BY part_id").fetchall()
    got = queries.QUERIES["weighted_mean_rate"](spark, str(tmp_path)).orderBy("part_id").collect()
    assert [r.part_id for r in got if np.isnan(r.most_normalised)] == [0, 3]
    assert [tuple(r) for r in got] == [pytest.approx(r, abs=1e-9, nan_ok=True) for r in want]


def test_moves_of_the_caterpillar(spark, folder):
    table, n = queries.pattern_table(spark, folder)
    tree, model = queries.caterpillar(n), queries.equal_models()[0]
    rows = table.collect()
    codes, weights = np.array([r.codes for r in rows]), np.array([r.weight for r in rows])
    want = []
    for move in moves(tree, n, 3):
        new = regraft(tree, *move)
        if new is not tree:
            want.append((-round(Block(codes, weights, model, new).lnl(*root_edge(new)), 3), *move))
    got = [(-r.lnl, r.node, r.cut, r.a, r.b) for r in queries.spr_moves(spark, folder).collect()]
    assert len(got) == 50 and [x[0] for x in got] == pytest.approx([x[0] for x in sorted(want)[:50]], abs=2e-3)
    assert set(x[1:] for x in got[:40]) <= set(x[1:] for x in sorted(want)[:60])
