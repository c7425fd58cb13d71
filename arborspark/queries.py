"""Queries over the given tables, and the same in SQL.

All documents are read whole. Each source is a taxon; its sequence has at each place the most
frequent code of its documents' characters there: letters stand for DNA states by code point,
all else is undetermined. Sites fall into four partitions, two of them interleaved.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions.encoding import AA, DNA, decode, encode
from arborspark.functions.numerics import Model, equal_rates
from arborspark.operators import alignment as A
from arborspark.operators import frequencies as E
from arborspark.operators import quartets as Q
from arborspark.operators import trees as T
from arborspark.plans.evaluate import evaluate_in_blocks, score_quartets
from arborspark.plans.insertion import score_moves, with_topologies
from arborspark.plans.likelihood import categorise, derivatives, log_likelihood, optimise_psr, pattern_likelihoods, site_rates
from arborspark.plans.models import score_models
from arborspark.plans.reports import partition_trees
from arborspark.sources.newick import splits, to_edges, write
from arborspark.sources.partitions import misassigned, partitions, site_map
from arborspark.sources.tables import materialise

ANY = DNA.undetermined
PARTS = ["DNA, gene1 = 1-1000", "DNA, gene2 = 1001-4000\\2", "DNA, gene3 = 1002-4000\\2", "DNA, gene4 = 4001-2000000000"]


CODES = [1, 2, 4, 8, ANY]
KINDS = np.array([b % 4 if chr(b).isalpha() and b < 128 else 4 for b in range(256)])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment, counted in one pass over the documents and stored, so that a query reads it as often as it likes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return A.number_taxa(materialise(A.consensus(docs, "source", "text", KINDS, CODES), "cells"))


def ranges(spark: SparkSession) -> DataFrame:
    return partitions(spark, PARTS)


def parts(spark: SparkSession, c: DataFrame) -> DataFrame:
    return site_map(c.select("site").distinct(), ranges(spark))


def found(spark: SparkSession, c: DataFrame, compress: bool = True) -> DataFrame:
    return A.patterns(c, parts(spark, c), ANY, compress)


def encode_alignment(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("taxon_id", "code").agg(F.count("*").alias("n"), F.min("site").alias("first_site"))


def decode_alignment(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("character", decode(F.col("code"), DNA))
    return c.groupBy("taxon_id").agg(*(F.sum((F.col("character") == x).cast("long")).alias(f"n_{n}") for x, n in (("A", "a"), ("C", "c"), ("G", "g"), ("T", "t"), ("-", "gap"))), F.max("site").alias("length"))


def gap_proportion(spark, sf_dir):
    return A.gap_proportion(cells(spark, sf_dir), ANY)


def state_counts(spark, sf_dir):
    c = cells(spark, sf_dir)
    return A.state_counts(c, parts(spark, c))


def drop_undetermined_sites(spark, sf_dir):
    c = cells(spark, sf_dir)
    kept = A.determined_sites(c, ANY).withColumn("kept", F.lit(1))
    return parts(spark, c).join(kept, "site", "left").groupBy("part_id").agg(F.count("*").alias("sites"), F.sum(F.coalesce("kept", F.lit(0))).alias("kept"))


def pattern_compression(spark, sf_dir):
    return found(spark, cells(spark, sf_dir)).drop("signature")


def pattern_compression_off(spark, sf_dir):
    return found(spark, cells(spark, sf_dir), False).groupBy("part_id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def pattern_compression_unpartitioned(spark, sf_dir):
    c = cells(spark, sf_dir)
    one = c.select("site").distinct().withColumn("part_id", F.lit(0))
    return A.patterns(c, one, ANY).agg(F.count("*").alias("n_patterns"), F.sum("weight").alias("weight"), F.max("weight").alias("most"))


def site_partition_map(spark, sf_dir):
    return parts(spark, cells(spark, sf_dir)).groupBy("part_id").agg(F.count("*").alias("sites"), F.min("site").alias("lo"), F.max("site").alias("hi"))


def partition_validation(spark, sf_dir):
    sites = cells(spark, sf_dir).select("site").distinct()
    wrong = partitions(spark, ["DNA, a = 1-900", "DNA, b = 800-2999\\3, 3100-2000000000"])
    return misassigned(sites, wrong).groupBy("n").agg(F.count("*").alias("sites"), F.min("site").alias("first_site"), F.max("site").alias("last_site"))


def base_frequencies_em(spark, sf_dir):
    c = cells(spark, sf_dir)
    f = E.em_frequencies(E.code_weights(c, found(spark, c)), 4)
    return f.select("part_id", *(F.round(F.col("freqs")[i], 6).alias(n) for i, n in enumerate(("f_a", "f_c", "f_g", "f_t"))))


def partition_weights(spark, sf_dir):
    return A.partition_weights(found(spark, cells(spark, sf_dir)))


def memory_estimate(spark, sf_dir):
    c = cells(spark, sf_dir)
    return A.memory_estimate(found(spark, c), c.select("taxon_id").distinct().count(), 4)


def pair_differences(spark, sf_dir):
    return Q.jc_distance(Q.pair_differences(cells(spark, sf_dir)))


def branch_derivatives(spark, sf_dir):
    return Q.pair_likelihood(Q.pair_differences(cells(spark, sf_dir)), 0.1)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two caterpillars over the sources: 0 by name, 1 by characters in all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return docs.selectExpr("source", "n", "row_number() over (order by source) - 1 as taxon_id").selectExpr(
        "taxon_id", "inline(array(struct(0 as tree_id, n * 0 as k), struct(1 as tree_id, n as k)))"
    ).selectExpr("tree_id", "taxon_id", "row_number() over (partition by tree_id order by k, taxon_id) - 1 as place")


def bipartitions(spark, sf_dir):
    return T.caterpillar_splits(orders(spark, sf_dir)).select("tree_id", F.concat_ws(",", "split").alias("split"))


def rf_distance(spark, sf_dir):
    return T.rf_distance(T.caterpillar_splits(orders(spark, sf_dir)), 0, 1)


def split_frequencies(spark, sf_dir):
    return T.split_frequencies(T.caterpillar_splits(orders(spark, sf_dir)))


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    return docs.selectExpr("source", "row_number() over (order by source) - 1 as taxon_id")


def quartets_all(spark, sf_dir):
    return Q.all_quartets(taxa(spark, sf_dir))


def quartets_grouped(spark, sf_dir):
    return Q.grouped_quartets(taxa(spark, sf_dir).withColumn("grp", F.col("taxon_id") % 4))


def quartets_four_point(spark, sf_dir):
    distances = Q.jc_distance(Q.pair_differences(cells(spark, sf_dir)))
    return Q.four_point(distances, Q.all_quartets(taxa(spark, sf_dir)))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each taxon pair, as a table of candidate topologies."""
    return Q.pair_likelihood(Q.pair_differences(cells(spark, sf_dir)), 0.1).select(F.concat_ws("-", "a", "b").alias("topology"), "lnl")


def best_trees_topk(spark, sf_dir):
    return T.best_trees(scored_pairs(spark, sf_dir), 20)


def top_nodes(spark, sf_dir):
    rows = Q.pair_likelihood(Q.pair_differences(cells(spark, sf_dir)), 0.1)
    ends = rows.select(F.col("a").alias("node"), "lnl").unionByName(rows.select(F.col("b").alias("node"), "lnl"))
    return ends.groupBy("node").agg(F.max("lnl").alias("lnl")).orderBy(F.desc("lnl"), "node").limit(50)


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition's composition fitted by equal and by own frequencies: lnl, k, n."""
    c = cells(spark, sf_dir)
    n = A.state_counts(c, parts(spark, c))
    total = n.groupBy("part_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    own = total.select("part_id", F.lit("DNA").alias("model"), F.lit("empirical").alias("freq_mode"), (F.col("nlogn") - F.col("n") * F.log("n")).alias("lnl"), F.lit(3).alias("k"), "n")
    equal = total.select("part_id", F.lit("DNA").alias("model"), F.lit("fixed").alias("freq_mode"), (-F.col("n") * F.log(F.lit(4.0))).alias("lnl"), F.lit(0).alias("k"), "n")
    return own.unionByName(equal)


def _select(name):
    def run(spark, sf_dir):
        return T.choose_models(model_scores(spark, sf_dir), name)

    return run


def placement(spark, sf_dir):
    widths = found(spark, cells(spark, sf_dir)).groupBy("part_id").agg(F.count("*").alias("width")).withColumn("data_type", F.lit("DNA"))
    return T.place(widths, 7)


def load_report(spark, sf_dir):
    return T.load_report(placement(spark, sf_dir))


def weighted_mean_rate(spark, sf_dir):
    """Site rates (share of taxa that differ from the commonest code) normalised to a weighted mean of 1."""
    c = cells(spark, sf_dir)
    counts = c.where(F.bit_count("code") == 1).groupBy("site", "code").agg(F.count("*").alias("n"))
    rates = counts.groupBy("site").agg((1 - F.max("n") / F.sum("n")).alias("rate"), F.sum("n").alias("weight")).join(parts(spark, c), "site")
    mean = rates.groupBy("part_id").agg((F.sum(F.col("rate") * F.col("weight")) / F.sum("weight")).alias("mean"), F.count("*").alias("sites"), F.max("rate").alias("most"))
    normalised = F.when(F.col("mean") > 0, F.col("most") / F.col("mean")).otherwise(float("nan"))  # all rates 0: no mean of 1, NaN as in SQL
    return mean.select("part_id", "sites", F.round("mean", 9).alias("mean_rate"), F.round(normalised, 6).alias("most_normalised"))


QUERIES = {
    f.__name__: f
    for f in (
        encode_alignment, decode_alignment, gap_proportion, state_counts, drop_undetermined_sites, pattern_compression, pattern_compression_off,
        pattern_compression_unpartitioned, site_partition_map, partition_validation, base_frequencies_em, partition_weights, memory_estimate,
        pair_differences, branch_derivatives, bipartitions, rf_distance, split_frequencies, quartets_all, quartets_grouped, quartets_four_point,
        best_trees_topk, top_nodes, placement, load_report, weighted_mean_rate,
    )
} | {f"model_select_{n}": _select(n) for n in ("ml", "aic", "bic", "aicc")}

_CELLS = """
    ch AS (SELECT source, generate_subscripts(string_split(text, ''), 1) AS site, unnest(string_split(text, '')) AS c FROM documents),
    k AS (SELECT source, site, CASE WHEN regexp_matches(c, '[A-Za-z]') THEN 1 << (unicode(c) % 4) ELSE 15 END AS code, count(*) AS n FROM ch WHERE c <> '' GROUP BY ALL),
    m AS (SELECT source, site, code FROM (SELECT *, row_number() OVER (PARTITION BY source, site ORDER BY n DESC, code) AS rn FROM k) WHERE rn = 1),
    ids AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS taxon_id FROM (SELECT DISTINCT source FROM m)),
    cells AS (SELECT taxon_id, site, code FROM m JOIN ids USING (source)),
    parts AS (SELECT site, CASE WHEN site <= 1000 THEN 0 WHEN site > 4000 THEN 3 WHEN site % 2 = 1 THEN 1 ELSE 2 END AS part_id FROM (SELECT DISTINCT site FROM cells))"""
_PATTERNS = """,
    sigs AS (SELECT site, string_agg(taxon_id || ':' || code, ',' ORDER BY taxon_id) AS sig FROM cells WHERE code <> 15 GROUP BY site),
    pats AS (SELECT part_id, min(site) AS first_site, count(*) AS weight FROM sigs JOIN parts USING (site) GROUP BY part_id, sig)"""
_PAIRS = """,
    sure AS (SELECT * FROM cells WHERE bit_count(code) = 1),
    pairs AS (SELECT a.taxon_id AS a, b.taxon_id AS b, sum(CASE WHEN a.code = b.code THEN 1 ELSE 0 END) AS same, sum(CASE WHEN a.code <> b.code THEN 1 ELSE 0 END) AS differ
              FROM sure a JOIN sure b ON a.site = b.site AND a.taxon_id < b.taxon_id GROUP BY ALL)"""
_LIKE = """,
    e AS (SELECT exp(-4.0 / 3.0 * 0.1) AS e),
    q AS (SELECT a, b, same, differ, 0.25 * (0.25 + 0.75 * e) AS ps, 0.25 * (0.25 - 0.25 * e) AS pd, -0.25 * e AS ds, 0.25 * e / 3 AS dd, e / 3 AS hs, -e / 9 AS hd FROM pairs, e),
    lik AS (SELECT a, b, round(same * ln(ps) + differ * ln(pd), 6) AS lnl, round(same * ds / ps + differ * dd / pd, 6) AS d1,
                   round(same * (hs / ps - (ds / ps) * (ds / ps)) + differ * (hd / pd - (dd / pd) * (dd / pd)), 6) AS d2 FROM q)"""
_ORDERS = """
    s AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source),
    t AS (SELECT row_number() OVER (ORDER BY source) - 1 AS taxon_id, n FROM s),
    o AS (SELECT 0 AS tree_id, taxon_id, taxon_id AS place FROM t UNION ALL SELECT 1, taxon_id, row_number() OVER (ORDER BY n, taxon_id) - 1 FROM t),
    inside AS (SELECT a.tree_id, a.place, b.taxon_id, b.place <= a.place AS head FROM o a JOIN o b ON a.tree_id = b.tree_id WHERE a.place >= 1 AND a.place <= (SELECT count(*) FROM t) - 3),
    side AS (SELECT tree_id, place, max(CASE WHEN taxon_id = 0 AND head THEN 1 ELSE 0 END) AS zero FROM inside GROUP BY ALL),
    splits AS (SELECT i.tree_id, string_agg(taxon_id::VARCHAR, ',' ORDER BY taxon_id) AS split FROM inside i JOIN side s ON i.tree_id = s.tree_id AND i.place = s.place WHERE (head AND zero = 0) OR (NOT head AND zero = 1) GROUP BY i.tree_id, i.place)"""
_TAXA = "t AS (SELECT row_number() OVER (ORDER BY source) - 1 AS taxon_id FROM (SELECT DISTINCT source FROM documents))"
_SCORES = """,
    st AS (SELECT part_id, code, count(*) AS n FROM cells JOIN parts USING (site) WHERE bit_count(code) = 1 GROUP BY ALL),
    tot AS (SELECT part_id, sum(n) AS n, sum(n * ln(n)) AS nlogn FROM st GROUP BY part_id),
    sc AS (SELECT part_id, 'DNA' AS model, 'empirical' AS freq_mode, nlogn - n * ln(n) AS lnl, 3 AS k, n FROM tot
           UNION ALL SELECT part_id, 'DNA', 'fixed', -n * ln(4.0), 0, n FROM tot)"""
_PLACE = """,
    w AS (SELECT part_id, count(*) AS width FROM pats GROUP BY part_id),
    l AS (SELECT part_id, width, sum(width) OVER (ORDER BY width, part_id) AS fin, CAST(ceil(sum(width) OVER () / 7.0) AS BIGINT) AS cap FROM w),
    r AS (SELECT unnest(range(7)) AS rank),
    pl AS (SELECT part_id, rank, greatest(fin - width, rank * cap) - (fin - width) AS "offset", least(fin, (rank + 1) * cap) - greatest(fin - width, rank * cap) AS width
           FROM l JOIN r ON fin > rank * cap AND fin - width < (rank + 1) * cap)"""


def _em() -> str:
    """The eight rounds as one common table expression each."""
    rounds = ["f0 AS (SELECT DISTINCT part_id, 0.25::DOUBLE AS a, 0.25::DOUBLE AS c, 0.25::DOUBLE AS g, 0.25::DOUBLE AS t FROM cw)"]
    mass = "(a * (code & 1) + c * ((code >> 1) & 1) + g * ((code >> 2) & 1) + t * ((code >> 3) & 1))"
    for i in range(8):
        each = ", ".join(f"sum(w * {x} * ((code >> {b}) & 1) / {mass}) / sum(w) AS {x}" for b, x in enumerate("acgt"))
        rounds.append(f"f{i + 1} AS (SELECT part_id, {each} FROM cw JOIN f{i} USING (part_id) GROUP BY part_id)")
    return ", cw AS (SELECT part_id, code, sum(weight)::DOUBLE AS w FROM cells JOIN pats ON site = first_site GROUP BY ALL), " + ", ".join(rounds)


def _criterion(name: str) -> str:
    score = {"ml": "-lnl", "aic": "2 * (k - lnl)", "bic": "k * ln(n) - 2 * lnl", "aicc": "CASE WHEN n - k - 1 > 0 THEN 2 * (k - lnl) + 2.0 * k * (k + 1) / (n - k - 1) END"}[name]
    return f"WITH {_CELLS}{_SCORES} SELECT part_id, model, freq_mode, score FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY score, freq_mode, model) AS rn FROM (SELECT *, round({score}, 6) AS score FROM sc) WHERE score IS NOT NULL) WHERE rn = 1"


ORACLE_SQL = {
    "encode_alignment": f"WITH {_CELLS} SELECT taxon_id, code, count(*) AS n, min(site) AS first_site FROM cells GROUP BY ALL",
    "decode_alignment": f"WITH {_CELLS} SELECT taxon_id, count(*) FILTER (WHERE code = 1) AS n_a, count(*) FILTER (WHERE code = 2) AS n_c, count(*) FILTER (WHERE code = 4) AS n_g, count(*) FILTER (WHERE code = 8) AS n_t, count(*) FILTER (WHERE code = 15) AS n_gap, max(site) AS length FROM cells GROUP BY taxon_id",
    "gap_proportion": f"WITH {_CELLS}, z AS (SELECT count(DISTINCT taxon_id) AS taxa, max(site) AS sites, count(*) FILTER (WHERE code <> 15) AS known FROM cells) SELECT taxa, sites, taxa * sites - known AS gaps, round((taxa * sites - known)::DOUBLE / (taxa * sites), 9) AS proportion FROM z",
    "state_counts": f"WITH {_CELLS} SELECT part_id, code, count(*) AS n FROM cells JOIN parts USING (site) WHERE bit_count(code) = 1 GROUP BY ALL",
    "drop_undetermined_sites": f"WITH {_CELLS}, d AS (SELECT DISTINCT site, 1 AS one FROM cells WHERE code <> 15) SELECT part_id, count(*) AS sites, count(one) AS kept FROM parts LEFT JOIN d USING (site) GROUP BY part_id",
    "pattern_compression": f"WITH {_CELLS}{_PATTERNS} SELECT part_id, first_site, weight FROM pats",
    "pattern_compression_off": f"WITH {_CELLS}{_PATTERNS} SELECT part_id, count(*) AS n, count(*) AS weight FROM sigs JOIN parts USING (site) GROUP BY part_id",
    "pattern_compression_unpartitioned": f"WITH {_CELLS}{_PATTERNS}, u AS (SELECT count(*) AS weight FROM sigs GROUP BY sig) SELECT count(*) AS n_patterns, sum(weight) AS weight, max(weight) AS most FROM u",
    "site_partition_map": f"WITH {_CELLS} SELECT part_id, count(*) AS sites, min(site) AS lo, max(site) AS hi FROM parts GROUP BY part_id",
    "partition_validation": f"WITH {_CELLS}, n AS (SELECT site, (CASE WHEN site <= 900 THEN 1 ELSE 0 END) + (CASE WHEN site BETWEEN 800 AND 2999 AND (site - 800) % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN site >= 3100 THEN 1 ELSE 0 END) AS n FROM parts) SELECT n, count(*) AS sites, min(site) AS first_site, max(site) AS last_site FROM n WHERE n <> 1 GROUP BY n",
    "base_frequencies_em": f"WITH {_CELLS}{_PATTERNS}{_em()} SELECT part_id, round(a, 6) AS f_a, round(c, 6) AS f_c, round(g, 6) AS f_g, round(t, 6) AS f_t FROM f8",
    "partition_weights": f"WITH {_CELLS}{_PATTERNS} SELECT part_id, count(*) AS n_patterns, sum(weight) AS weight, round(sum(weight) / sum(sum(weight)) OVER (), 9) AS contribution FROM pats GROUP BY part_id",
    "memory_estimate": f"WITH {_CELLS}{_PATTERNS} SELECT count(*) AS n_patterns, count(*) * any_value(4 * 8 * n + n) AS psr_bytes, count(*) * any_value(4 * 4 * 8 * n + n) AS gamma_bytes FROM pats, (SELECT count(*) AS n FROM ids)",
    "pair_differences": f"WITH {_CELLS}{_PAIRS} SELECT a, b, same, differ, CASE WHEN differ::DOUBLE / (same + differ) < 0.75 THEN round(-0.75 * ln(1 - differ::DOUBLE / (same + differ) * 4 / 3), 6) END AS distance FROM pairs",
    "branch_derivatives": f"WITH {_CELLS}{_PAIRS}{_LIKE} SELECT a, b, lnl, d1, d2 FROM lik",
    "bipartitions": f"WITH {_ORDERS} SELECT tree_id, split FROM splits",
    "rf_distance": f"WITH {_ORDERS}, c AS (SELECT split, count(DISTINCT tree_id) AS n FROM splits GROUP BY split), z AS (SELECT count(*) FILTER (WHERE n = 2) AS shared, count(*) FILTER (WHERE n = 1) AS differing FROM c) SELECT shared, differing, round(differing::DOUBLE / (2 * shared + differing), 9) AS relative FROM z",
    "split_frequencies": f"WITH {_ORDERS} SELECT split, count(DISTINCT tree_id) AS trees FROM splits GROUP BY split",
    "quartets_all": f"WITH {_TAXA} SELECT a.taxon_id AS t1, b.taxon_id AS t2, c.taxon_id AS t3, d.taxon_id AS t4 FROM t a JOIN t b ON a.taxon_id < b.taxon_id JOIN t c ON b.taxon_id < c.taxon_id JOIN t d ON c.taxon_id < d.taxon_id",
    "quartets_grouped": f"WITH {_TAXA} SELECT a.taxon_id AS t1, b.taxon_id AS t2, c.taxon_id AS t3, d.taxon_id AS t4 FROM t a, t b, t c, t d WHERE a.taxon_id % 4 = 0 AND b.taxon_id % 4 = 1 AND c.taxon_id % 4 = 2 AND d.taxon_id % 4 = 3",
    "best_trees_topk": f"WITH {_CELLS}{_PAIRS}{_LIKE} SELECT a || '-' || b AS topology, lnl FROM lik ORDER BY lnl DESC, topology LIMIT 20",
    "top_nodes": f"WITH {_CELLS}{_PAIRS}{_LIKE} SELECT node, max(lnl) AS lnl FROM (SELECT a AS node, lnl FROM lik UNION ALL SELECT b, lnl FROM lik) GROUP BY node ORDER BY lnl DESC, node LIMIT 50",
    "placement": f"WITH {_CELLS}{_PATTERNS}{_PLACE} SELECT part_id, rank, \"offset\", width FROM pl",
    "load_report": f"WITH {_CELLS}{_PATTERNS}{_PLACE} SELECT rank, count(*) AS partitions, sum(width) AS patterns FROM pl GROUP BY rank",
    "weighted_mean_rate": f"WITH {_CELLS}, n AS (SELECT site, code, count(*) AS n FROM cells WHERE bit_count(code) = 1 GROUP BY ALL), r AS (SELECT site, 1 - max(n)::DOUBLE / sum(n) AS rate, sum(n) AS weight FROM n GROUP BY site), q AS (SELECT part_id, sum(rate * weight) / sum(weight) AS mean, count(*) AS sites, max(rate) AS most FROM r JOIN parts USING (site) GROUP BY part_id) SELECT part_id, sites, round(mean, 9) AS mean_rate, round(most / mean, 6) AS most_normalised FROM q",
    "quartets_four_point": f"WITH {_CELLS}{_PAIRS}, ds AS (SELECT a, b, CASE WHEN differ::DOUBLE / (same + differ) < 0.75 THEN round(-0.75 * ln(1 - differ::DOUBLE / (same + differ) * 4 / 3), 6) END AS d FROM pairs), {_TAXA}, q AS (SELECT a.taxon_id AS t1, b.taxon_id AS t2, c.taxon_id AS t3, d.taxon_id AS t4 FROM t a JOIN t b ON a.taxon_id < b.taxon_id JOIN t c ON b.taxon_id < c.taxon_id JOIN t d ON c.taxon_id < d.taxon_id), s AS (SELECT t1, t2, t3, t4, unnest([0, 1, 2]) AS topology, unnest([round(p.d + r.d, 6), round(u.d + v.d, 6), round(x.d + y.d, 6)]) AS total FROM q JOIN ds p ON p.a = t1 AND p.b = t2 JOIN ds r ON r.a = t3 AND r.b = t4 JOIN ds u ON u.a = t1 AND u.b = t3 JOIN ds v ON v.a = t2 AND v.b = t4 JOIN ds x ON x.a = t1 AND x.b = t4 JOIN ds y ON y.a = t2 AND y.b = t3), o AS (SELECT *, row_number() OVER (PARTITION BY t1, t2, t3, t4 ORDER BY total NULLS FIRST, topology) AS rn FROM s) SELECT t1, t2, t3, t4, max(CASE WHEN rn = 1 THEN topology END) AS topology, round(max(CASE WHEN rn = 2 THEN total END) - max(CASE WHEN rn = 1 THEN total END), 6) AS support FROM o GROUP BY t1, t2, t3, t4",
} | {f"model_select_{n}": _criterion(n) for n in ("ml", "aic", "bic", "aicc")}


# Likelihoods on the caterpillar over all taxa by name, every branch exp(-t) = 0.9.
Z = 0.9
GRID = [0.05, 0.2, 0.5, 1.0, 2.0, 4.0]
PSR_CATEGORIES = 4


def pattern_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    c = cells(spark, sf_dir)
    n = c.agg(F.max("taxon_id")).first()[0] + 1
    return materialise(A.pattern_codes(c, found(spark, c), n, ANY), "patterns"), n


def caterpillar(n: int, z: float = Z) -> list[tuple[int, int, float]]:
    """The caterpillar over tips 0 to n-1 in order."""
    inner = list(range(n, 2 * n - 2))
    edges = [(inner[0], 0, z), (inner[-1], n - 1, z)] + [(inner[i - 1], i, z) for i in range(1, n - 1)]
    return edges + [(a, b, z) for a, b in zip(inner, inner[1:])]


def equal_models(alphas: list[float] | None = None) -> dict[int, Model]:
    return {p: equal_rates(4, alpha=alphas[p]) if alphas else equal_rates(4, categories=1) for p in range(len(PARTS))}


ALPHAS = [0.5 + p for p in range(len(PARTS))]


def tree_loglik(spark, sf_dir):
    """The likelihood of all sites on a caterpillar of all taxa, equal rates, by partition."""
    table, n = pattern_table(spark, sf_dir)
    return log_likelihood(table, caterpillar(n), equal_models()).select("part_id", F.round("lnl", 4).alias("lnl"), "weight")


def tree_loglik_gamma(spark, sf_dir):
    """The same under four gamma rates, of another shape for each partition."""
    table, n = pattern_table(spark, sf_dir)
    return log_likelihood(table, caterpillar(n), equal_models(ALPHAS)).select("part_id", F.round("lnl", 4).alias("lnl"), "weight")


def site_loglik(spark, sf_dir):
    """Log-likelihoods of single patterns: their number, extremes and weighted sum by partition."""
    table, n = pattern_table(spark, sf_dir)
    each = pattern_likelihoods(table, caterpillar(n), equal_models(), [1.0]).join(table.select("part_id", "pattern_id", "weight"), ["part_id", "pattern_id"])
    return each.groupBy("part_id").agg(F.count("*").alias("patterns"), F.round(F.min("lnl"), 6).alias("least"), F.round(F.max("lnl"), 6).alias("most"), F.round(F.sum(F.col("lnl") * F.col("weight")), 4).alias("lnl"))


def edge_derivatives(spark, sf_dir):
    """Log-likelihood and its two derivatives by the length of the last taxon's branch, summed over blocks of patterns."""
    table, n = pattern_table(spark, sf_dir)
    out = derivatives(table, caterpillar(n), equal_models(), [(2 * n - 3, n - 1)])
    return out.groupBy("part_id").agg(*(F.round(F.sum(c), 4).alias(c) for c in ("lnl", "d1", "d2")))


def psr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, DataFrame]:
    table, n = pattern_table(spark, sf_dir)
    rates = site_rates(table, caterpillar(n), equal_models(), GRID).join(table.select("part_id", "pattern_id", "weight"), ["part_id", "pattern_id"])
    return table, n, categorise(materialise(rates, "rates"), PSR_CATEGORIES)


def rate_categorise(spark, sf_dir):
    return psr(spark, sf_dir)[2].groupBy("part_id", "category").agg(F.count("*").alias("patterns"), F.round(F.first("category_rate"), 6).alias("rate"))


def psr_loglik(spark, sf_dir):
    """The likelihood with one rate for each pattern, that of its category."""
    table, n, rates = psr(spark, sf_dir)
    rated = table.join(rates.select("part_id", "pattern_id", F.col("category_rate").alias("rate")), ["part_id", "pattern_id"])
    return log_likelihood(rated, caterpillar(n), equal_models()).select("part_id", F.round("lnl", 4).alias("lnl"), "weight")


def newick_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The two caterpillars of `orders` as Newick text, and the taxon names."""
    names = [r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct().orderBy("source").collect()]
    places = orders(spark, sf_dir).orderBy("tree_id", "place").collect()
    rows = []
    for tree_id in (0, 1):
        order = [r["taxon_id"] for r in places if r["tree_id"] == tree_id]
        tree = [(u if u >= len(names) else order[u], v if v >= len(names) else order[v], z) for u, v, z in caterpillar(len(names))]
        rows.append((tree_id, write(tree, names)))
    return spark.createDataFrame(rows, "tree_id long, newick string"), names


def newick_bipartitions(spark, sf_dir):
    trees, names = newick_trees(spark, sf_dir)
    return splits(trees, names).select(F.col("tree_id").cast("int").alias("tree_id"), F.concat_ws(",", "split").alias("split"))


def newick_rf_distance(spark, sf_dir):
    trees, names = newick_trees(spark, sf_dir)
    return T.rf_distance(splits(trees, names), 0, 1)


def tree_lengths(spark, sf_dir):
    trees, names = newick_trees(spark, sf_dir)
    return to_edges(trees, names, lengths=True).select(F.col("tree_id").cast("int").alias("tree_id"), F.size("edges").alias("branches"), F.round(T.tree_length(F.col("edges")), 6).alias("length"))


def ranked_trees(spark, sf_dir):
    """The k-th best of scored topologies: every rank with its topology."""
    return T.ranked(scored_pairs(spark, sf_dir), 20)


def _walk(rates: str, z: float = Z) -> str:
    """Common table expressions that prune the caterpillar from taxon 0 on: ends (part_id, first_site,
    weight, rate, codes, n, likelihoods l of the states seen from the last taxon, e of a branch).
    rates: a query of part_id, first_site, rate."""

    def through(v: str) -> str:
        return f"list_transform({v}, lambda x: e * x + (1 - e) / 4 * list_sum({v}))"

    def tip(i: str) -> str:
        return f"list_transform([0, 1, 2, 3], lambda b: ((codes[{i}] >> b) & 1)::DOUBLE)"

    def times(a: str, b: str) -> str:
        return f"list_transform([1, 2, 3, 4], lambda s: ({a})[s] * ({b})[s])"

    return f""",
    nt AS (SELECT count(*) AS n FROM ids),
    cols AS (SELECT part_id, first_site, weight, list(coalesce(code, 15) ORDER BY taxon_id) AS codes FROM (SELECT p.part_id, p.first_site, p.weight, i.taxon_id, c.code FROM pats p CROSS JOIN ids i LEFT JOIN cells c ON c.site = p.first_site AND c.taxon_id = i.taxon_id) GROUP BY ALL),
    rts AS ({rates}),
    tipped AS (SELECT part_id, first_site, weight, rate, codes, n, e, {times(through(tip("1")), through(tip("2")))} AS l
               FROM (SELECT cols.*, rate, n, pow({z}, 4.0 / 3.0 * rate) AS e FROM cols JOIN rts USING (part_id, first_site), nt)),
    steps AS (SELECT *, 3 AS i FROM tipped
              UNION ALL SELECT part_id, first_site, weight, rate, codes, n, e, {times(through("l"), through(tip("i")))} AS l, i + 1 FROM steps WHERE i < n),
    ends AS (SELECT part_id, first_site, weight, rate, codes, n, e, l FROM steps WHERE i = n),
    lik AS (SELECT part_id, first_site, weight, rate, e, l, {tip("n")} AS t, list_sum({times("l", through(tip("n")))}) / 4 AS f FROM ends)"""


def _rates(values: list[float]) -> str:
    return "SELECT part_id, first_site, unnest([" + ", ".join(repr(float(v)) for v in values) + "]) AS rate FROM pats"


# Means of the four quartiles of gamma distributions of mean 1, by shape (tables in Yang 1994 have
# those of 0.5 to four digits); worked out by numerical integration of the density, not by this package.
QUARTILE_MEANS = {0.5: [0.0333877533836, 0.2519159175934, 0.8202684819737, 2.8944278470493], 1.5: [0.2253225359902, 0.5885564046306, 1.0504217020786, 2.1356993573006], 2.5: [0.3464566285465, 0.6994546629033, 1.0786276815381, 1.8754610270121], 3.5: [0.4245905223741, 0.7559256750352, 1.0840748659226, 1.735408936668]}


def _gamma_rates() -> str:
    each = (f"SELECT {p} AS part_id, unnest({QUARTILE_MEANS[a]}) AS rate" for p, a in enumerate(ALPHAS))
    return f"SELECT part_id, first_site, rate FROM pats JOIN ({' UNION ALL '.join(each)}) USING (part_id)"


_RATED = f""",
    tried AS (SELECT part_id, first_site, weight, rate, round(ln(f), 9) AS lnl FROM lik),
    best AS (SELECT part_id, first_site, weight, rate, lnl FROM (SELECT *, row_number() OVER (PARTITION BY part_id, first_site ORDER BY lnl DESC, rate DESC) AS rn FROM tried) WHERE rn = 1),
    clu AS (SELECT part_id, rate AS cluster, row_number() OVER (PARTITION BY part_id ORDER BY sum(lnl), rate) AS rn FROM best GROUP BY part_id, rate),
    kept AS (SELECT part_id, cluster, row_number() OVER (PARTITION BY part_id ORDER BY cluster) - 1 AS category FROM clu WHERE rn <= {PSR_CATEGORIES}),
    near AS (SELECT b.part_id, first_site, weight, category, cluster, row_number() OVER (PARTITION BY b.part_id, first_site ORDER BY abs(cluster - rate), cluster) AS rn FROM best b JOIN kept k ON b.part_id = k.part_id),
    mean AS (SELECT part_id, sum(cluster * weight) / sum(weight) AS mean FROM near WHERE rn = 1 GROUP BY part_id),
    psr AS (SELECT part_id, first_site, weight, category, cluster / mean AS rate FROM near JOIN mean USING (part_id) WHERE rn = 1)"""
_START = f"WITH RECURSIVE {_CELLS}{_PATTERNS}"


def recode_alignment(spark, sf_dir):
    """Codes of the characters that the codes stand for: nothing changes on the way."""
    c = cells(spark, sf_dir).withColumn("character", decode(F.col("code"), DNA)).withColumn("again", encode(F.lower("character"), DNA))
    return c.groupBy("character", "code", "again").agg(F.count("*").alias("n"))


def vanished_partitions(spark, sf_dir):
    """Partitions of a file, one of which begins behind the last site, that have no determined site."""
    c, wanted = cells(spark, sf_dir), partitions(spark, [*PARTS[:3], "DNA, rest = 4001-1000000000", "DNA, none = 1000000001-2000000000"])
    kept = site_map(A.determined_sites(c, ANY), wanted)
    return wanted.select("part_id", "name").distinct().join(kept, "part_id", "left_anti")


def missing_states(spark, sf_dir):
    """States that a source never has, by source, as for partitions."""
    c = cells(spark, sf_dir)
    counts = c.where(F.bit_count("code") == 1).groupBy(F.col("taxon_id").alias("part_id"), "code").agg(F.count("*").alias("n"))
    dims = c.select(F.col("taxon_id").alias("part_id")).distinct().withColumn("data_type", F.lit("AA"))
    return E.missing_states(counts, dims)


def tree_evaluation(spark, sf_dir):
    """Two caterpillars with all branches optimised over the blocks of the alignment."""
    table, n = pattern_table(spark, sf_dir)
    trees, names = newick_trees(spark, sf_dir)
    found = evaluate_in_blocks(trees, table, equal_models(), names, 12, False, True)
    return found.select("tree_id", F.round("lnl", 2).alias("lnl"), F.round("length", 3).alias("length"))


def quartet_likelihoods(spark, sf_dir):
    """The best topology of each quartet of one taxon from each of four groups, branches optimised."""
    table, n = pattern_table(spark, sf_dir)
    groups = spark.range(n).select(F.col("id").cast("int").alias("taxon_id"), (F.col("id") % 4).alias("grp"))
    scored = score_quartets(Q.grouped_quartets(groups).repartition(4 * spark.sparkContext.defaultParallelism), table, equal_models(), 2)
    return scored.groupBy("t1", "t2", "t3", "t4").agg(F.max_by("topology", "lnl").alias("topology"), F.round(F.max("lnl"), 3).alias("lnl"))


def partition_lengths(spark, sf_dir):
    """The caterpillar with branches of its own for each partition, and their weighted mean length."""
    table, n = pattern_table(spark, sf_dir)
    names = [f"t{i}" for i in range(n)]
    return partition_trees(table, caterpillar(n), equal_models(), names, 6).select("part_id", F.round("lnl", 2).alias("lnl"), F.round("length", 3).alias("length"))


QUERIES |= {
    f.__name__: f
    for f in (tree_loglik, tree_loglik_gamma, site_loglik, edge_derivatives, rate_categorise, psr_loglik, newick_bipartitions, newick_rf_distance, tree_lengths, ranked_trees, recode_alignment, vanished_partitions, missing_states, tree_evaluation, quartet_likelihoods, partition_lengths)
}
ORACLE_SQL |= {
    "recode_alignment": f"WITH {_CELLS} SELECT CASE code WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 4 THEN 'G' WHEN 8 THEN 'T' ELSE '-' END AS character, code, code AS again, count(*) AS n FROM cells GROUP BY ALL",
    "vanished_partitions": f"WITH {_CELLS}, beyond AS (SELECT count(*) AS n FROM cells WHERE code <> 15 AND site > 1000000000) SELECT 4 AS part_id, 'none' AS name FROM beyond WHERE n = 0",
    "missing_states": f"WITH {_CELLS}, aa AS (SELECT unnest(string_split('{AA.states}', '')) AS state, unnest(range({len(AA.states)})) AS bit), have AS (SELECT DISTINCT taxon_id, code FROM cells WHERE code IN (1, 2, 4, 8)) SELECT taxon_id AS part_id, state FROM ids CROSS JOIN aa WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.taxon_id = ids.taxon_id AND h.code = 1 << bit)",
    "tree_loglik": f"{_START}{_walk(_rates([1.0]))} SELECT part_id, round(sum(weight * ln(f)), 4) AS lnl, sum(weight) AS weight FROM lik GROUP BY part_id",
    "tree_loglik_gamma": f"{_START}{_walk(_gamma_rates())}, mixed AS (SELECT part_id, first_site, any_value(weight) AS weight, avg(f) AS f FROM lik GROUP BY part_id, first_site) SELECT part_id, round(sum(weight * ln(f)), 4) AS lnl, sum(weight) AS weight FROM mixed GROUP BY part_id",
    "site_loglik": f"{_START}{_walk(_rates([1.0]))} SELECT part_id, count(*) AS patterns, round(min(ln(f)), 6) AS least, round(max(ln(f)), 6) AS most, round(sum(weight * ln(f)), 4) AS lnl FROM lik GROUP BY part_id",
    "edge_derivatives": f"""{_START}{_walk(_rates([1.0]))},
        d AS (SELECT part_id, weight, f, -4.0 / 3.0 * e * list_sum(list_transform([1, 2, 3, 4], lambda s: l[s] * (t[s] - list_sum(t) / 4))) / 4 AS g FROM lik)
        SELECT part_id, round(sum(weight * ln(f)), 4) AS lnl, round(sum(weight * g / f), 4) AS d1, round(sum(weight * (-4.0 / 3.0 * g / f - (g / f) * (g / f))), 4) AS d2 FROM d GROUP BY part_id""",
    "rate_categorise": f"{_START}{_walk(_rates(GRID))}{_RATED} SELECT part_id, category, count(*) AS patterns, round(any_value(rate), 6) AS rate FROM psr GROUP BY part_id, category",
    "newick_bipartitions": f"WITH {_ORDERS} SELECT tree_id, split FROM splits",
    "newick_rf_distance": ORACLE_SQL["rf_distance"],
    "tree_lengths": f"SELECT tree_id, 2 * n - 3 AS branches, round((2 * n - 3) * -ln({Z}), 6) AS length FROM (SELECT count(DISTINCT source) AS n FROM documents), (SELECT unnest([0, 1]) AS tree_id)",
    "ranked_trees": f"WITH {_CELLS}{_PAIRS}{_LIKE} SELECT rank, topology, lnl FROM (SELECT row_number() OVER (ORDER BY lnl DESC, a || '-' || b) AS rank, a || '-' || b AS topology, lnl FROM lik) WHERE rank <= 20",
}


def _second_walk() -> str:
    """The names of _walk once more, for the categories that the first one gave."""
    text = _walk("SELECT part_id, first_site, rate FROM psr")
    for name in ("nt", "cols", "rts", "tipped", "steps", "ends", "lik"):
        text = re.sub(rf"\b{name}\b", f"{name}2", text)
    return text


ORACLE_SQL["psr_loglik"] = f"{_START}{_walk(_rates(GRID))}{_RATED}{_second_walk()} SELECT part_id, round(sum(weight * ln(f)), 4) AS lnl, sum(weight) AS weight FROM lik2 GROUP BY part_id"


# Twenty states: the same sources as amino-acid sequences. Letters stand for their states, all else is undetermined.
AA_CODES = [*(1 << i for i in range(len(AA.states))), AA.undetermined]
AA_KINDS = np.array([AA.states.find(chr(b).upper()) if chr(b).isalpha() and b < 128 and chr(b).upper() in AA.states else len(AA.states) for b in range(256)])


def aa_patterns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = A.number_taxa(materialise(A.consensus(docs, "source", "text", AA_KINDS, AA_CODES), "aa_cells"))
    n = c.agg(F.max("taxon_id")).first()[0] + 1
    return materialise(A.pattern_codes(c, A.patterns(c, parts(spark, c), AA.undetermined), n, AA.undetermined), "aa_patterns"), n


def aa_frequencies(patterns: DataFrame) -> dict[int, tuple[float, ...]]:
    """Shares of the states where they are certain, by partition; one is added to each count."""
    seen = patterns.select("part_id", "weight", F.explode("codes").alias("code")).where(F.bit_count("code") == 1)
    counts = {(r["part_id"], r["code"]): r["n"] for r in seen.groupBy("part_id", "code").agg(F.sum("weight").alias("n")).collect()}
    each = {p: [1 + counts.get((p, 1 << i), 0) for i in range(len(AA.states))] for p in {p for p, _ in counts}}
    return {p: tuple(x / sum(n) for x in n) for p, n in each.items()}


def aa_model_choice(spark, sf_dir):
    """Each partition of the amino-acid alignment under one matrix of 20 states, with its own frequencies and
    with the partition's, on the caterpillar; the better one by BIC, and what both give."""
    table, n = aa_patterns(spark, sf_dir)
    scored = materialise(score_models(table, caterpillar(n), {"EQUAL": equal_rates(len(AA.states), categories=1)}, aa_frequencies(table)), "aa_scores")
    best = T.choose_models(scored, "bic").select("part_id", "model", "freq_mode", "score")
    lnl = scored.groupBy("part_id").agg(*(F.round(F.max(F.when(F.col("freq_mode") == m, F.col("lnl"))), 3).alias(f"{m}_lnl") for m in ("fixed", "empirical")), F.max("n").alias("n"))
    return best.join(lnl, "part_id").select("part_id", "model", "freq_mode", F.round("score", 3).alias("score"), "fixed_lnl", "empirical_lnl", "n")


def rates_climbed(spark, sf_dir):
    """Rates of patterns climbed to from 1 by steps of 0.5 down and 1 up, in few categories; kept if the log-likelihood
    of all partitions gains by them."""
    table, n = pattern_table(spark, sf_dir)
    rated, _ = optimise_psr(table, caterpillar(n), equal_models(), PSR_CATEGORIES, (1,), PSR_MOST)
    rated = materialise(rated, "climbed")
    lnl = log_likelihood(rated, caterpillar(n), equal_models()).select("part_id", F.round("lnl", 4).alias("lnl"))
    return rated.groupBy("part_id", F.round("rate", 6).alias("rate")).agg(F.count("*").alias("patterns")).join(lnl, "part_id")


def spr_moves(spark, sf_dir):
    """The best of all prune-and-regraft moves within three edges of the caterpillar, by log-likelihood: node, cut,
    a, b and what the new tree gives, before any branch is optimised."""
    table, n = pattern_table(spark, sf_dir)
    moves = score_moves(table, caterpillar(n), equal_models(), n, 3)
    return moves.select("node", "cut", "a", "b", "depth", F.round("lnl", 3).alias("lnl")).orderBy(F.desc("lnl"), "node", "cut", "a", "b").limit(50)


def tip_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every move of a single taxon into an inner edge within REACH edges of where it stood, with the tree's topology."""
    table, n = pattern_table(spark, sf_dir)
    tree = caterpillar(n)
    rows = score_moves(table, tree, equal_models(), n, REACH).where(f"node < {n} and a >= {n} and b >= {n}")
    return with_topologies(rows, tree, n).withColumn("lnl", F.round("lnl", 3))


def best_topologies(spark, sf_dir):
    """The best trees that moving one taxon gives: each topology once, under the best lengths that a move gives it, with its rank."""
    return T.ranked(tip_moves(spark, sf_dir), 20)


def top_insertions(spark, sf_dir):
    """The taxa that gain most by a move, at most 50, by the best insertion; how many insertions were scored, and the tree."""
    best = tip_moves(spark, sf_dir).groupBy("node").agg(F.min(F.struct((-F.col("lnl")).alias("lost"), "topology")).alias("b"), F.count("*").alias("moves"))
    return best.select("node", (-F.col("b.lost")).alias("lnl"), "b.topology", "moves").orderBy(F.desc("lnl"), "node").limit(50)


PSR_MOST = 8.0
REACH = 5
QUERIES |= {f.__name__: f for f in (aa_model_choice, rates_climbed, spr_moves, best_topologies, top_insertions)}


def _aa_walk() -> str:
    """Pruning of the caterpillar with 20 states: a branch leaves a state where it is with probability e and else
    draws from the frequencies. Rows: part_id, mode, lnl, weight."""
    n, any_code = len(AA.states), AA.undetermined
    through = lambda v: f"list_transform({v}, lambda x: e * x + (1 - e) * list_dot_product({v}, pi))"
    tip = lambda i: f"list_transform(range({n}), lambda b: ((codes[{i}] >> b) & 1)::DOUBLE)"
    times = lambda a, b: f"list_transform(list_zip({a}, {b}), lambda y: y[1] * y[2])"
    cells = _CELLS.replace("CASE WHEN regexp_matches(c, '[A-Za-z]') THEN 1 << (unicode(c) % 4) ELSE 15 END", f"CASE WHEN regexp_matches(c, '[A-Za-z]') AND strpos('{AA.states}', upper(c)) > 0 THEN 1 << (strpos('{AA.states}', upper(c)) - 1) ELSE {any_code} END")
    patterns = _PATTERNS.replace("code <> 15", f"code <> {any_code}")
    return f"""WITH RECURSIVE {cells}{patterns},
    nt AS (SELECT count(*) AS n FROM ids),
    cols AS (SELECT part_id, first_site, weight, list(coalesce(code, {any_code}) ORDER BY taxon_id) AS codes FROM (SELECT p.part_id, p.first_site, p.weight, i.taxon_id, c.code FROM pats p CROSS JOIN ids i LEFT JOIN cells c ON c.site = p.first_site AND c.taxon_id = i.taxon_id) GROUP BY ALL),
    cnt AS (SELECT part_id, code, sum(weight) AS n FROM (SELECT part_id, weight, unnest(codes) AS code FROM cols) WHERE bit_count(code) = 1 GROUP BY ALL),
    own AS (SELECT p.part_id, b, 1 + coalesce(c.n, 0) AS n FROM (SELECT DISTINCT part_id FROM cnt) p CROSS JOIN (SELECT unnest(range({n})) AS b) LEFT JOIN cnt c ON c.part_id = p.part_id AND c.code = 1 << b),
    fr AS (SELECT part_id, 'empirical' AS mode, list(n::DOUBLE / total ORDER BY b) AS pi FROM (SELECT *, sum(n) OVER (PARTITION BY part_id) AS total FROM own) GROUP BY part_id
           UNION ALL SELECT DISTINCT part_id, 'fixed', list_transform(range({n}), lambda x: 1.0::DOUBLE / {n}) FROM own),
    mu AS (SELECT part_id, mode, pi, pow({Z}, 1 / (1 - list_dot_product(pi, pi))) AS e FROM fr),
    tipped AS (SELECT part_id, first_site, weight, codes, mode, pi, e, {times(through(tip("1")), through(tip("2")))} AS l FROM cols JOIN mu USING (part_id)),
    steps AS (SELECT *, 3 AS i FROM tipped
              UNION ALL SELECT part_id, first_site, weight, codes, mode, pi, e, {times(through("l"), through(tip("i")))} AS l, i + 1 FROM steps, nt WHERE i < nt.n),
    lik AS (SELECT part_id, weight, mode, list_dot_product({times("l", through(tip("n")))}, pi) AS f FROM steps, nt WHERE i = nt.n),
    sc AS (SELECT part_id, mode, sum(weight * ln(f)) AS lnl, sum(weight) AS w, any_value(2 * n - 3 + CASE WHEN mode = 'empirical' THEN {n - 1} ELSE 0 END) AS k FROM lik, nt GROUP BY ALL)"""


ORACLE_SQL |= {
    "aa_model_choice": f"""{_aa_walk()},
        b AS (SELECT *, round(k * ln(w) - 2 * lnl, 6) AS score FROM sc),
        r AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY score, mode) AS rn FROM b)
        SELECT part_id, 'EQUAL' AS model, max(CASE WHEN rn = 1 THEN mode END) AS freq_mode, round(max(CASE WHEN rn = 1 THEN score END), 3) AS score,
               round(max(CASE WHEN mode = 'fixed' THEN lnl END), 3) AS fixed_lnl, round(max(CASE WHEN mode = 'empirical' THEN lnl END), 3) AS empirical_lnl, max(w)::BIGINT AS n FROM r GROUP BY part_id""",
}
_CLIMBED = f"""{_START}{_walk(_rates([0.5, *(float(x) for x in range(1, int(PSR_MOST) + 1))]))},
    tried AS (SELECT part_id, first_site, weight, rate, round(ln(f), 9) AS lnl FROM lik),
    up AS (SELECT *, rate > 1 AND lnl <= lag(lnl) OVER (PARTITION BY part_id, first_site ORDER BY rate) AS falls FROM tried WHERE rate >= 1),
    ways AS (SELECT part_id, first_site, weight, rate, lnl FROM (SELECT *, count(*) FILTER (WHERE falls) OVER (PARTITION BY part_id, first_site ORDER BY rate) AS over FROM up) WHERE over = 0
             UNION ALL SELECT part_id, first_site, weight, rate, lnl FROM tried WHERE rate < 1),
    best AS (SELECT part_id, first_site, weight, rate, lnl FROM (SELECT *, row_number() OVER (PARTITION BY part_id, first_site ORDER BY lnl DESC, abs(rate - 1), rate) AS rn FROM ways) WHERE rn = 1),
    isl AS (SELECT part_id, rate, lnl, first, sum(CASE WHEN before IS NULL OR rate - before >= 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY part_id ORDER BY rate) AS island
            FROM (SELECT part_id, rate, sum(lnl) AS lnl, min(first_site) AS first, lag(rate) OVER (PARTITION BY part_id ORDER BY rate) AS before FROM best GROUP BY part_id, rate)),
    clu AS (SELECT part_id, arg_min(rate, first) AS cluster, sum(lnl) AS lnl FROM isl GROUP BY part_id, island),
    kept AS (SELECT part_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY lnl, cluster) AS rn FROM clu) WHERE rn <= {PSR_CATEGORIES}),
    near AS (SELECT b.part_id, first_site, weight, cluster, row_number() OVER (PARTITION BY b.part_id, first_site ORDER BY abs(cluster - rate), cluster) AS rn FROM best b JOIN kept k ON b.part_id = k.part_id),
    mean AS (SELECT part_id, sum(cluster * weight) / sum(weight) AS mean FROM near WHERE rn = 1 GROUP BY part_id),
    psr AS (SELECT part_id, first_site, weight, cluster / mean AS rate FROM near JOIN mean USING (part_id) WHERE rn = 1)"""
ORACLE_SQL["rates_climbed"] = f"""{_CLIMBED}{_second_walk()},
    was AS (SELECT part_id, sum(weight * lnl) AS lnl FROM tried WHERE rate = 1 GROUP BY part_id),
    now AS (SELECT part_id, sum(weight * ln(f)) AS lnl FROM lik2 GROUP BY part_id),
    gain AS (SELECT (SELECT sum(lnl) FROM now) >= (SELECT sum(lnl) FROM was) AS won)
    SELECT part_id, rate, patterns, round(lnl, 4) AS lnl FROM (SELECT part_id, round(rate, 6) AS rate, count(*) AS patterns FROM psr GROUP BY ALL) JOIN now USING (part_id), gain WHERE won
    UNION ALL SELECT part_id, 1.0, patterns, round(lnl, 4) FROM (SELECT part_id, count(*) AS patterns FROM pats GROUP BY part_id) JOIN was USING (part_id), gain WHERE NOT won"""


def _moved() -> str:
    """Rows (node, topology, lnl) of the caterpillar with a taxon moved along its spine. Vectors `l` of the spine's nodes are
    walked to from the left in the caterpillar (side 0) and in its mirror image (side 1), so a move to the left is one to the
    right in the mirror. A taxon `i` taken out leaves the vector behind it; that is carried on over the taxa `t` it passes."""
    e = {x: f"pow({Z}, {4 * x / 3!r})" for x in (0.5, 1.0, 2.0)}

    def through(v: str, x: float) -> str:
        return f"list_transform({v}, lambda x: {e[x]} * x + (1 - {e[x]}) / 4 * list_sum({v}))"

    def tip(i: str) -> str:
        return f"list_transform([0, 1, 2, 3], lambda b: ((codes[({i}) + 1] >> b) & 1)::DOUBLE)"

    def times(*v: str) -> str:
        return "list_transform([1, 2, 3, 4], lambda s: " + " * ".join(f"({x})[s]" for x in v) + ")"

    end = through(tip("i"), 1.0)
    return f""",
    cols AS (SELECT first_site, weight, list(coalesce(code, 15) ORDER BY taxon_id) AS codes FROM (SELECT p.first_site, p.weight, i.taxon_id, c.code FROM pats p CROSS JOIN ids i LEFT JOIN cells c ON c.site = p.first_site AND c.taxon_id = i.taxon_id) GROUP BY ALL),
    sides AS (SELECT first_site, weight, 0 AS side, codes, len(codes) AS n FROM cols UNION ALL SELECT first_site, weight, 1, list_reverse(codes), len(codes) FROM cols),
    spine AS (SELECT first_site, side, codes, n, 1 AS pos, {times(through(tip("0"), 1.0), through(tip("1"), 1.0))} AS l FROM sides
              UNION ALL SELECT first_site, side, codes, n, pos + 1, {times(through("l", 1.0), through(tip("pos + 1"), 1.0))} FROM spine WHERE pos < n - 2),
    back AS (SELECT first_site, 1 - side AS side, n - 1 - pos AS pos, l AS r FROM spine),
    out AS (SELECT first_site, weight, side, codes, n, unnest([0, 1]) AS i, 2 AS t FROM sides UNION ALL SELECT first_site, weight, side, codes, n, unnest(range(2, n - 3)), -1 FROM sides),
    begun AS (SELECT o.first_site, weight, o.side, o.codes, o.n, o.i, CASE WHEN o.t = 2 THEN 2 ELSE o.i + 1 END AS t, CASE WHEN o.t = 2 THEN {tip("1 - o.i").replace("codes[", "o.codes[")} ELSE l END AS behind
              FROM out o LEFT JOIN spine s ON s.first_site = o.first_site AND s.side = o.side AND s.pos = o.i - 1 AND o.t < 0),
    walk AS (SELECT first_site, weight, side, codes, n, i, t, 1 AS depth, {times(through("behind", 2.0), through(tip("t"), 1.0))} AS l FROM begun WHERE t <= n - 3
             UNION ALL SELECT first_site, weight, side, codes, n, i, t + 1, depth + 1, {times(through("l", 1.0), through(tip("t + 1"), 1.0))} FROM walk WHERE t < n - 3 AND depth < {REACH}),
    scored AS (SELECT w.side, w.i, w.t, any_value(w.n) AS n, round(sum(weight * ln(list_sum({times(through("l", 0.5), through("r", 0.5), end)}) / 4)), 3) AS lnl
               FROM walk w JOIN back b ON b.first_site = w.first_site AND b.side = w.side AND b.pos = w.t + 1 GROUP BY w.side, w.i, w.t),
    turned AS (SELECT CASE WHEN side = 0 THEN i ELSE n - 1 - i END AS node, lnl, n, list_transform(list_concat(list_filter(range(t + 1), lambda x: x <> i), [i], list_filter(range(t + 1, n), lambda x: x <> i)), lambda x: CASE WHEN side = 0 THEN x ELSE n - 1 - x END) AS q FROM scored),
    moved AS (SELECT node, lnl, md5(array_to_string(list_sort(list_transform(range(2, n - 1), lambda k: array_to_string(list_sort(CASE WHEN list_contains(q[1:k], 0) THEN q[k + 1:] ELSE q[1:k] END), ','))), '|')) AS topology FROM turned)"""


ORACLE_SQL |= {
    "best_topologies": f"{_START}{_moved()}, once AS (SELECT topology, max(lnl) AS lnl FROM moved GROUP BY topology) SELECT rank, topology, lnl FROM (SELECT row_number() OVER (ORDER BY lnl DESC, topology) AS rank, topology, lnl FROM once) WHERE rank <= 20",
    "top_insertions": f"{_START}{_moved()} SELECT node, max(lnl) AS lnl, arg_min(topology, {{'a': -lnl, 'b': topology}}) AS topology, count(*) AS moves FROM moved GROUP BY node ORDER BY lnl DESC, node LIMIT 50",
}
