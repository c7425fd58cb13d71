"""From text files to the tables of an alignment: taxa, ranges, cells, patterns and partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions.encoding import TYPES
from arborspark.operators import alignment as A
from arborspark.operators.frequencies import frequencies_by_type
from arborspark.sources.partitions import check_ranges, misassigned, partitions, read_partitions, site_map
from arborspark.sources.phylip import bad_names, read_interleaved, read_phylip
from arborspark.sources.tables import materialise

ROWS = 1 << 16


@dataclass
class Alignment:
    taxa: DataFrame  #: taxon_id (from 0), name
    ranges: DataFrame  #: part_id, name, model, data_type, freq_mode, lo, hi, step
    cells: DataFrame  #: taxon_id, site, code, without undetermined ones
    patterns: DataFrame  #: part_id, pattern_id, weight, codes
    partitions: DataFrame  #: part_id, name, model, data_type, states, n_patterns, weight, contribution, freqs


def alphabets() -> dict[str, tuple[np.ndarray, int]]:
    """By kind of data: the code of each byte, 0 where the alphabet lacks it, and the code of no knowledge."""
    tables = {}
    for kind in TYPES.values():
        table = np.zeros(256, np.int32)
        for c in kind.characters:
            table[[ord(c), ord(c.lower())]] = kind.mask(c)
        tables[kind.name] = table, kind.undetermined
    return tables


def inside(begin: int, size: int, lo: int, hi: int, step: int) -> slice:
    """Where the sites of a range are in a piece of a sequence that begins at a site."""
    first = lo + max(0, -(-(begin - lo) // step)) * step
    return slice(min(first - begin, size), max(0, min(hi - begin + 1, size)), step)


def encoded(pieces: DataFrame, ranges: list) -> DataFrame:
    """Cells of sequences (taxon_id, begin, seq): each site by the alphabet of its partition, in arrays."""
    tables = alphabets()

    def run(batches):
        for b in batches:
            for taxon, begin, seq in zip(b["taxon_id"], b["begin"], b["seq"]):
                body = np.frombuffer(seq.encode("ascii"), np.uint8)
                code, known = np.zeros(len(body), np.int32), np.zeros(len(body), bool)
                for kind, lo, hi, step in ranges:
                    table, undetermined = tables[kind]
                    at = inside(begin, len(body), lo, hi, step)
                    code[at] = table[body[at]]
                    known[at] = code[at] != undetermined
                sites = np.flatnonzero(known)
                for i in range(0, len(sites), ROWS):
                    some = sites[i : i + ROWS]
                    yield pd.DataFrame({"taxon_id": taxon, "site": some + begin, "code": code[some]})

    return pieces.select("taxon_id", "begin", "seq").mapInPandas(run, "taxon_id int, site int, code int")


def bad_characters(pieces: DataFrame, ranges: list) -> DataFrame:
    """name, site, character, kind: the first character of each piece that its partition's alphabet lacks."""
    tables = alphabets()

    def run(batches):
        for b in batches:
            rows = []
            for name, begin, seq in zip(b["name"], b["begin"], b["seq"]):
                body = np.frombuffer(seq.encode("utf-32-le"), "<u4")  # a character each, ASCII or not
                found = []
                for kind, lo, hi, step in ranges:
                    at = inside(begin, len(body), lo, hi, step)
                    wrong = np.flatnonzero((body[at] > 127) | (tables[kind][0][body[at] & 127] == 0))
                    if len(wrong):
                        found.append((at.start + int(wrong[0]) * step, kind))
                if found:
                    i, kind = min(found)
                    rows.append((name, begin + i, seq[i], kind))
            yield pd.DataFrame(rows, columns=["name", "site", "character", "kind"])

    return pieces.select("name", "begin", "seq").mapInPandas(run, "name string, site long, character string, kind string")


def read_alignment(spark: SparkSession, path: str, partition_path: str | None = None, kind: str = "DNA", compress: bool = True, splits: bool = False) -> Alignment:
    """An alignment with its partition file, or as one partition of a kind. Names that a tree can't hold,
    characters that a partition's alphabet lacks, sites without a partition or with several, partitions of
    which no site is determined, and interleaved partitions without compression are errors. splits: the file
    has blocks of one line a taxon and is read in splits, whatever its size; else a task reads a file."""
    rows = read_interleaved(spark, path) if splits else read_phylip(spark, path).withColumn("begin", F.lit(1).cast("long"))
    text = materialise(rows.select((F.col("taxon_id") - 1).cast("int").alias("taxon_id"), "name", "begin", "seq"), "alignment")
    taxa = text.where("begin = 1").select("taxon_id", "name").distinct()
    if wrong := bad_names(taxa).limit(3).collect():
        raise ValueError(f"names that a tree can't hold, or twice: {[r['name'] for r in wrong]}")
    n_taxa, n_sites = (lambda r: (r[0], r[1]))(text.agg(F.count_distinct("taxon_id"), F.max(F.col("begin") + F.length("seq") - 1)).first())
    ranges = materialise(read_partitions(spark, partition_path) if partition_path else partitions(spark, [f"{kind}, all = 1-{n_sites}"]), "ranges")
    check_ranges(ranges)
    sites = spark.range(1, n_sites + 1).select(F.col("id").cast("int").alias("site"))
    if wrong := misassigned(sites, ranges).limit(3).collect():
        raise ValueError(f"sites without a partition or with several: {[r['site'] for r in wrong]}")
    if not compress and not ranges.where("step > 1").isEmpty():
        raise ValueError("partitions with a step need compression")
    rows = ranges.select("data_type", "lo", "hi", "step").collect()
    if {r["data_type"] for r in rows} - set(TYPES):
        raise ValueError(f"data of these kinds are not supported: {sorted({r['data_type'] for r in rows} - set(TYPES))}")
    if bad := bad_characters(text, [tuple(r) for r in rows]).orderBy("site", "name").first():
        raise ValueError(f"taxon {bad['name']!r} has {bad['character']!r} at site {bad['site']}, which {bad['kind']} data can't have")
    cells = materialise(encoded(text, [tuple(r) for r in rows]), "cells")
    parts = site_map(sites, ranges)
    found = materialise(A.patterns(cells, parts, 0, compress), "found")
    dims = ranges.select("part_id", "name", "model", "data_type", "freq_mode").distinct()
    if gone := dims.join(found.select("part_id"), "part_id", "left_anti").collect():
        raise ValueError(f"partitions without a determined site: {sorted(r['name'] for r in gone)}")
    full = F.coalesce(*(F.when(F.col("data_type") == t.name, F.lit(t.undetermined)) for t in TYPES.values()))
    patterns = A.pattern_codes(cells, found, n_taxa, 0).join(dims.select("part_id", full.alias("any")), "part_id")
    patterns = patterns.select("part_id", "pattern_id", "weight", F.transform("codes", lambda c: F.when(c == 0, F.col("any")).otherwise(c)).alias("codes"))
    patterns = materialise(patterns, "patterns")
    freqs = frequencies_by_type(code_weights_of(patterns), dims)
    states = F.coalesce(*(F.when(F.col("data_type") == t.name, F.lit(len(t.states))) for t in TYPES.values()))
    table = dims.join(A.partition_weights(found), "part_id").join(freqs, "part_id").withColumn("states", states)
    return Alignment(taxa, ranges, cells, patterns, table)


def code_weights_of(patterns: DataFrame) -> DataFrame:
    """Weight of each code in each partition, undetermined ones included."""
    return patterns.select("part_id", "weight", F.explode("codes").alias("code")).groupBy("part_id", "code").agg(F.sum("weight").alias("weight"))
