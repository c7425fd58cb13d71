"""Base frequencies of ambiguous data by expectation-maximisation, as one expression a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.functions.encoding import TYPES

ROUNDS = 8
FLOOR = 0.001


def code_weights(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Weight of each code in each partition: part_id, code, weight. All that the rounds need."""
    return cells.join(found.select("part_id", "first_site", "weight"), F.col("site") == F.col("first_site")).groupBy("part_id", "code").agg(F.sum("weight").alias("weight"))


def em_frequencies(weights: DataFrame, states: int, rounds: int = ROUNDS) -> DataFrame:
    """part_id, freqs: each round spreads a code's weight over its states in proportion to the last
    round's frequencies, from equal ones. A partition has no more rows than codes occur in it."""
    rows = weights.groupBy("part_id").agg(F.sort_array(F.collect_list(F.struct("code", F.col("weight").cast("double").alias("weight")))).alias("rows"))
    index = F.sequence(F.lit(0), F.lit(states - 1))

    def allowed(code: Column, s: Column) -> Column:
        return (code.cast("long").bitwiseAND(F.pow(F.lit(2.0), s).cast("long")) > 0).cast("double")

    def one_round(freqs: Column, _: Column) -> Column:
        def share(s: Column) -> Column:
            def add(total: Column, r: Column) -> Column:
                mass = F.aggregate(index, F.lit(0.0), lambda m, t: m + allowed(r["code"], t) * F.get(freqs, t))
                return total + allowed(r["code"], s) * r["weight"] * F.get(freqs, s) / mass

            return F.aggregate("rows", F.lit(0.0), add)

        raw = F.transform(index, share)
        return F.transform(raw, lambda x: x / F.aggregate("rows", F.lit(0.0), lambda t, r: t + r["weight"]))

    start = F.transform(index, lambda s: F.lit(1.0 / states))
    return rows.select("part_id", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one_round).alias("freqs"))


def smooth(freqs: list[float], floor: float = FLOOR, rounds: int = 100) -> list[float]:
    """Raise frequencies below the floor to it and scale the others to a sum of 1."""
    freqs = [f / sum(freqs) for f in freqs]
    for _ in range(rounds):
        low = [f <= floor for f in freqs]
        if not any(f < floor for f in freqs):
            break
        rest = sum(f for f, x in zip(freqs, low) if not x)
        freqs = [floor if x else f * (1 - floor * sum(low)) / rest for f, x in zip(freqs, low)]
    return freqs


def frequencies_by_type(weights: DataFrame, dims: DataFrame) -> DataFrame:
    """part_id, freqs of partitions of any kind: the fixed rounds by the kind's states, raised to the floor
    for the kinds that ask for it. A few numbers a partition, so the floor is applied on the driver.
    weights: part_id, code, weight; dims: part_id, data_type."""
    rows = []
    for kind in TYPES.values():
        own = weights.join(dims.where(F.col("data_type") == kind.name).select("part_id"), "part_id")
        rows += [(r["part_id"], smooth(r["freqs"]) if kind.smooth_frequencies else list(r["freqs"])) for r in em_frequencies(own, len(kind.states)).collect()]
    return weights.sparkSession.createDataFrame(rows, "part_id int, freqs array<double>")


def missing_states(counts: DataFrame, dims: DataFrame) -> DataFrame:
    """part_id, state: states that a partition never has unambiguously, a warning sign. counts: part_id, code, n."""
    each = F.coalesce(*(F.when(F.col("data_type") == t.name, F.array(*(F.struct(F.lit(s).alias("state"), F.lit(t.mask(s)).alias("code")) for s in t.states))) for t in TYPES.values()))
    wanted = dims.select("part_id", F.explode(each).alias("s")).select("part_id", "s.state", "s.code")
    return wanted.join(counts, ["part_id", "code"], "left_anti").select("part_id", "state")
