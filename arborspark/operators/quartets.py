"""Quartets of taxa: enumeration by theta joins and closed-form likelihoods under equal rates."""

from __future__ import annotations

import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.sources.tables import broadcast_if_small, materialise


def all_quartets(taxa: DataFrame) -> DataFrame:
    """Every t1 < t2 < t3 < t4. The taxa of a tree are few; the result has C(n, 4) rows by nature."""
    t = [taxa.select(F.col("taxon_id").alias(f"t{i}")) for i in (1, 2, 3, 4)]
    out = t[0]
    for i in (1, 2, 3):
        out = out.join(broadcast_if_small(t[i]), F.col(f"t{i}") < F.col(f"t{i + 1}"))
    return out


def grouped_quartets(groups: DataFrame) -> DataFrame:
    """One taxon of each of four groups (grp 0 to 3), which are disjoint."""
    t = [groups.where(F.col("grp") == i).select(F.col("taxon_id").alias(f"t{i + 1}")) for i in range(4)]
    return reduce(lambda a, b: a.join(broadcast_if_small(b), F.lit(True)), t)


def random_quartets(spark: SparkSession, n_taxa: int, count: int, seed: int) -> DataFrame:
    """`count` different quartets of taxa 0 to n_taxa - 1, or all if there are no more: numbers are drawn by a
    hash and turned into quartets one by one, so not all quartets are ever listed."""
    total = math.comb(n_taxa, 4)
    if count >= total:
        numbers = spark.range(total).select(F.col("id").alias("number"))
    else:
        tries = count + int(2 * count * count / total) + 16 if 4 * count < total else 8 * total
        drawn = spark.range(tries).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("number"))
        numbers = drawn.groupBy("number").agg(F.min("id").alias("id")).orderBy("id").limit(count).select("number")

    def run(batches):
        for b in batches:
            yield pd.DataFrame([unranked(int(x)) for x in b["number"]], columns=["t1", "t2", "t3", "t4"])

    return numbers.mapInPandas(run, "t1 int, t2 int, t3 int, t4 int")


def unranked(number: int) -> tuple[int, int, int, int]:
    """The quartet of this number in the order of its greatest taxon, then the next, and so on."""
    out = []
    for k in (4, 3, 2, 1):
        t = k - 1
        step = 1 << max(0, int((number * math.factorial(k) + 1) ** (1 / k)).bit_length())
        while step:
            if math.comb(t + step, k) <= number:
                t += step
            else:
                step //= 2
        out.append(t)
        number -= math.comb(t, k)
    return tuple(reversed(out))


def parse_groups(text: str, names: list[str]) -> list[tuple[int, int]]:
    """(taxon_id, grp) of a grouping `(a,b),(c),(d),(e,f);`: four groups that hold every taxon once."""
    body = "".join(text.split())
    if not re.fullmatch(r"\([^()]+\)(,\([^()]+\)){3};", body):
        raise ValueError("a grouping has the form (a,b),(c),(d),(e,f);")
    number = {n: i for i, n in enumerate(names)}
    rows = [(t, g) for g, part in enumerate(re.findall(r"\(([^()]+)\)", body)) for t in part.split(",")]
    if sorted(t for t, _ in rows) != sorted(names):
        raise ValueError("every taxon must be in one group")
    return [(number[t], g) for t, g in rows]


def with_names(quartets: DataFrame, names: list[str]) -> DataFrame:
    """Scored quartets with the names of their taxa, n1 to n4."""
    table = F.array(*(F.lit(n) for n in names))
    return quartets.select("*", *(F.get(table, F.col(f"t{i}")).alias(f"n{i}") for i in (1, 2, 3, 4)))


def pair_differences(cells: DataFrame) -> DataFrame:
    """Sites where two taxa are both unambiguous: a, b, same, differ. A join on the site."""
    sure = cells.where(F.bit_count("code") == 1)
    left, right = (sure.select("site", F.col("taxon_id").alias(n), F.col("code").alias(f"c{n}")) for n in "ab")
    pairs = left.join(right, "site").where("a < b")
    same = (F.col("ca") == F.col("cb")).cast("long")
    return pairs.groupBy("a", "b").agg(F.sum(same).alias("same"), F.sum(1 - same).alias("differ"))


def jc_distance(pairs: DataFrame) -> DataFrame:
    """Maximum likelihood distance of each pair under equal rates, null when they differ too much."""
    p = F.col("differ") / (F.col("same") + F.col("differ"))
    return pairs.withColumn("distance", F.round(F.when(p < 0.75, -0.75 * F.log(1 - p * 4 / 3)), 6))


def pair_likelihood(pairs: DataFrame, t: float) -> DataFrame:
    """Log-likelihood of each pair at branch length t and its two derivatives by t, closed form."""
    e = F.exp(F.lit(-4.0 / 3.0 * t))
    ps, pd = 0.25 * (0.25 + 0.75 * e), 0.25 * (0.25 - 0.25 * e)
    ds, dd = -0.25 * e, 0.25 * e / 3
    hs, hd = e / 3, -e / 9
    s, d = F.col("same"), F.col("differ")
    lnl = s * F.log(ps) + d * F.log(pd)
    first = s * ds / ps + d * dd / pd
    second = s * (hs / ps - (ds / ps) ** 2) + d * (hd / pd - (dd / pd) ** 2)
    return pairs.select("a", "b", F.round(lnl, 6).alias("lnl"), F.round(first, 6).alias("d1"), F.round(second, 6).alias("d2"))


def four_point(distances: DataFrame, quartets: DataFrame) -> DataFrame:
    """The topology of each quartet with the least sum of two distances: t1..t4, topology (0: t1 t2 | t3 t4,
    1: t1 t3 | t2 t4, 2: t1 t4 | t2 t3), support (second least minus least sum)."""
    out, distances = quartets, broadcast_if_small(materialise(distances, "distances"))
    for x, y in ((1, 2), (3, 4), (1, 3), (2, 4), (1, 4), (2, 3)):
        d = distances.select(F.col("a").alias("l"), F.col("b").alias("r"), F.col("distance").alias(f"d{x}{y}"))
        at = (F.least(out[f"t{x}"], out[f"t{y}"]) == d["l"]) & (F.greatest(out[f"t{x}"], out[f"t{y}"]) == d["r"])
        out = out.join(d, at).drop("l", "r")
    sums = F.sort_array(F.array(*(F.struct(F.round(F.col(a) + F.col(b), 6).alias("s"), F.lit(i).alias("i")) for i, (a, b) in enumerate((("d12", "d34"), ("d13", "d24"), ("d14", "d23"))))))
    out = out.withColumn("sums", sums)
    return out.select("t1", "t2", "t3", "t4", F.col("sums")[0]["i"].alias("topology"), F.round(F.col("sums")[1]["s"] - F.col("sums")[0]["s"], 6).alias("support"))
