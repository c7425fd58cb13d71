"""Alignments in long form: cells (taxon_id, site, code). What a taxon has no cell for is undetermined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.sources.tables import broadcast_if_small, numbered

ROWS = 1 << 16  #: rows handed out at once
CELLS = 4 << 20  #: sites of all taxa that a task counts before it hands out sums
RANGE = 1 << 16  #: sites that are counted in one array


def column_counts(texts: DataFrame, taxon: str, text: str, kinds: np.ndarray, n: int) -> DataFrame:
    """How often each of n kinds of characters stands at each site of each taxon's texts: taxon, site
    (from 1), n0 to n(n-1). kinds: the kind by a character's first UTF-8 byte. One pass over the
    texts: a task counts in arrays, by taxon and range of sites, and hands out sums whenever its arrays hold
    CELLS sites, so that no character becomes a row and neither many taxa nor a long text need
    more memory. Null texts and taxa count for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def take() -> Iterator[pa.RecordBatch]:
            for (name, part), sites in sums.items():
                at = np.flatnonzero(sites.any(axis=1))
                for i in range(0, len(at), ROWS):
                    some = at[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array((some + part * RANGE + 1).astype(np.int32)), *(pa.array(sites[some, k]) for k in range(n))], names=["taxon", "site", *(f"n{k}" for k in range(n))])
            sums.clear()

        held = 0
        for b in batches:
            names, bodies = b.column(0).to_pylist(), b.column(1)
            offsets = np.frombuffer(bodies.buffers()[1], np.int32 if pa.types.is_binary(bodies.type) else np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
            data = np.frombuffer(bodies.buffers()[2], np.uint8) if bodies.buffers()[2] else np.zeros(0, np.uint8)
            for i, name in enumerate(names):
                site = 0
                for lo in range(offsets[i], offsets[i + 1], RANGE):
                    body = data[lo : min(lo + RANGE, offsets[i + 1])]
                    first = kinds[body[(body & 0xC0) != 0x80]]  # a character's first byte
                    while len(first):
                        part, at = divmod(site, RANGE)
                        here, first = first[: RANGE - at], first[RANGE - at :]
                        old = sums.get((name, part))
                        if old is None or len(old) < at + len(here):
                            grown = np.zeros((min(RANGE, max(at + len(here), 2 * len(old) if old is not None else 0)), n), np.int64)
                            if old is not None:
                                grown[: len(old)] = old
                            held += len(grown) - (len(old) if old is not None else 0)
                            old = sums[name, part] = grown
                        old.ravel()[(at + np.arange(len(here))) * n + here] += 1
                        site += len(here)
                    if held > CELLS:
                        yield from take()
                        held = 0
        yield from take()

    rows = texts.where(F.col(taxon).isNotNull() & F.col(text).isNotNull()).select(F.col(taxon).cast("string"), F.col(text).cast("binary"))
    counted = rows.mapInArrow(run, "taxon string, site int, " + ", ".join(f"n{k} long" for k in range(n)))
    return counted.groupBy("taxon", "site").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(n)))


def consensus(texts: DataFrame, taxon: str, text: str, kinds: np.ndarray, codes: list[int]) -> DataFrame:
    """Cells (taxon, site, code) of one consensus sequence a taxon: at each site the most frequent
    code, ties to the smallest. codes: ascending, by kind of character."""
    counts = column_counts(texts, taxon, text, kinds, len(codes))
    n = [F.col(f"n{k}") for k in range(len(codes))]
    most = F.greatest(*n)
    return counts.select("taxon", "site", F.coalesce(*(F.when(x == most, F.lit(c)) for x, c in zip(n, codes))).alias("code"))


def number_taxa(cells: DataFrame) -> DataFrame:
    """taxon_id by name order from 0, for cells that are stored."""
    names = numbered(cells.select("taxon").distinct(), "taxon", "taxon_id")
    return cells.join(broadcast_if_small(names), "taxon").select("taxon_id", "site", "code")


def gap_proportion(cells: DataFrame, undetermined: int) -> DataFrame:
    """Share of undetermined cells among all taxa times all sites: taxa, sites, gaps, proportion."""
    size = cells.agg(F.count_distinct("taxon_id").alias("taxa"), F.max("site").cast("long").alias("sites"), F.sum((F.col("code") != undetermined).cast("long")).alias("known"))
    total = F.col("taxa") * F.col("sites")
    return size.select("taxa", "sites", (total - F.col("known")).alias("gaps"), F.round((total - F.col("known")) / total, 9).alias("proportion"))


def state_counts(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Unambiguous states of each partition: part_id, code, n."""
    return cells.where(F.bit_count("code") == 1).join(parts, "site").groupBy("part_id", "code").agg(F.count("*").alias("n"))


def determined_sites(cells: DataFrame, undetermined: int) -> DataFrame:
    """Sites where some taxon is not undetermined; the others carry no weight."""
    return cells.where(F.col("code") != undetermined).select("site").distinct()


def patterns(cells: DataFrame, parts: DataFrame, undetermined: int, compress: bool = True) -> DataFrame:
    """Site patterns: part_id, first_site, weight, signature.

    A site's signature is a sum of hashes over its determined cells, so columns are compared
    without gathering them: the sum is partial before the shuffle, whatever the number of taxa.
    Undetermined cells add nothing, so all-undetermined sites have no pattern.
    """
    known = cells.where(F.col("code") != undetermined)
    two = [F.sum(F.xxhash64("taxon_id", "code", F.lit(seed)).cast("decimal(20,0)")).cast("string") for seed in (1, 2)]
    sites = known.groupBy("site").agg(F.concat_ws("/", *two, F.count("*")).alias("signature")).join(parts, "site")
    if not compress:
        return sites.select("part_id", F.col("site").alias("first_site"), F.lit(1).cast("long").alias("weight"), "signature")
    return sites.groupBy("part_id", "signature").agg(F.min("site").alias("first_site"), F.count("*").alias("weight")).select("part_id", "first_site", "weight", "signature")


def pattern_codes(cells: DataFrame, found: DataFrame, taxa: int, undetermined: int) -> DataFrame:
    """The pattern table: part_id, pattern_id (the pattern's first site), weight, codes (one for each taxon)."""
    known = cells.join(found.select("part_id", "first_site", "weight"), F.col("site") == F.col("first_site"))
    columns = known.groupBy("part_id", "first_site", "weight").agg(F.map_from_entries(F.collect_list(F.struct("taxon_id", "code"))).alias("m"))
    codes = F.transform(F.sequence(F.lit(0), F.lit(taxa - 1)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(undetermined)).cast("int"))
    return columns.select("part_id", F.col("first_site").alias("pattern_id"), "weight", codes.alias("codes"))


def partition_weights(found: DataFrame) -> DataFrame:
    """part_id, n_patterns, weight, contribution (share of all weight)."""
    sums = found.groupBy("part_id").agg(F.count("*").alias("n_patterns"), F.sum("weight").alias("weight"))
    return sums.withColumn("contribution", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0))), 9))


def memory_estimate(found: DataFrame, taxa: int, states: int) -> DataFrame:
    """Bytes that likelihood vectors would take: one rate a site (psr), four rates (gamma)."""
    n = F.count("*")
    return found.agg(n.alias("n_patterns"), (n * (states * taxa * 8 + taxa)).alias("psr_bytes"), (n * (4 * states * taxa * 8 + taxa)).alias("gamma_bytes"))
