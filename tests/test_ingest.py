"""Alignments read in splits, checks by partition, columns counted in bounded memory, known alignments."""

import os
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborspark.operators import alignment
from arborspark.operators.frequencies import em_frequencies
from arborspark.sources import phylip
from arborspark.sources.ingest import code_weights_of, inside, read_alignment


def interleaved(taxa, sites, width, seed=0, gap="\n"):
    r = random.Random(seed)
    names = [f"taxon{i}" for i in range(taxa)]
    seqs = ["".join(r.choice("ACGTacgt-N") for _ in range(sites)) for _ in names]
    blocks = [[s[i : i + width] for s in seqs] for i in range(0, sites, width)]
    first = "\n".join(f"{n}   {p[: width // 2]} {p[width // 2 :]}" for n, p in zip(names, blocks[0]))
    return f" {taxa} {sites}\n" + first + "\n" + "".join(gap + "\n".join(b) + "\n" for b in blocks[1:])


@pytest.mark.parametrize("size", [64, 101, 333, 1 << 20])
def test_splits_give_what_one_task_gives(spark, tmp_path, size):
    text = interleaved(7, 95, 10, gap="\n  \n\t\n" if size == 101 else "\n")
    (tmp_path / "a.phy").write_text(text)
    (tmp_path / "b.phy").write_text(interleaved(4, 30, 30, 1))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        rows = phylip.read_interleaved(spark, f"{tmp_path}/*.phy").collect()
        splits = spark.read.text(f"{tmp_path}/*.phy").select(F.spark_partition_id()).distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert size > 1000 or splits > 2
    for name in ("a", "b"):
        mine = sorted((r.taxon_id, r.begin, r.name, r.seq) for r in rows if r.file.endswith(f"{name}.phy"))
        got = {}
        for taxon, begin, n, seq in mine:
            assert begin == len(got.get((taxon, n), "")) + 1
            got[taxon, n] = got.get((taxon, n), "") + seq
        assert [(t, n, s) for (t, n), s in sorted(got.items())] == phylip.parse_phylip((tmp_path / f"{name}.phy").read_text())


@pytest.mark.parametrize("text, message", [("a b\n", "first line"), ("3 4\na A\nb A\nc A\n", "four taxa"), ("4 4\na ACGT\nb ACGT\nc ACGT\n", "numbers of lines"), ("4 4\na ACGT\nb ACGT\nc ACGT\nd ACG\n", "another length than 4: \\['d'\\]"), ("4 4\n", "numbers of lines")])
def test_faults_of_files_read_in_splits(spark, tmp_path, text, message):
    (tmp_path / "a.phy").write_text(text)
    with pytest.raises(ValueError, match=message):
        phylip.read_interleaved(spark, str(tmp_path / "a.phy"))


def test_an_alignment_read_in_splits_is_the_same(spark, tmp_path):
    (tmp_path / "a.phy").write_text(interleaved(6, 61, 8, 4))
    (tmp_path / "a.model").write_text("DNA, g1 = 1-40\\3, 50-61\nDNA, g2 = 2-40\\3, 3-40\\3, 41-49\n")
    a, b = (read_alignment(spark, str(tmp_path / "a.phy"), str(tmp_path / "a.model"), splits=x) for x in (False, True))
    for name in ("taxa", "cells", "patterns", "partitions"):
        assert sorted(map(repr, getattr(a, name).collect())) == sorted(map(repr, getattr(b, name).collect()))


@pytest.mark.parametrize("begin, size", [(1, 10), (4, 5), (7, 3), (11, 4), (30, 5)])
def test_ranges_inside_pieces(begin, size):
    for lo, hi, step in ((1, 12, 3), (5, 9, 1), (8, 100, 4), (2, 3, 7)):
        at = inside(begin, size, lo, hi, step)
        assert [begin + i for i in range(size)[at]] == [s for s in range(lo, hi + 1, step) if begin <= s < begin + size]


@pytest.mark.parametrize("splits", [False, True])
def test_bad_characters_of_several_kinds_are_errors(spark, tmp_path, splits):
    (tmp_path / "a.model").write_text("DNA, g = 1-4\nWAG, p = 5-8\n")
    for column, bad, kind in ((2, "E", "DNA"), (6, "1", "AA"), (3, "é", "DNA")):
        seqs = ["ACGTARND"] * 4
        seqs[2] = seqs[2][: column - 1] + bad + seqs[2][column:]
        (tmp_path / "a.phy").write_text("4 8\n" + "".join(f"t{i} {s}\n" for i, s in enumerate(seqs)))
        with pytest.raises(ValueError, match=f"'t2' has '{bad.upper()}' at site {column}, which {kind} data"):
            read_alignment(spark, str(tmp_path / "a.phy"), str(tmp_path / "a.model"), splits=splits)
    (tmp_path / "a.phy").write_text("4 8\n" + "".join(f"t{i} ACGTEFIL\n" for i in range(4)))
    assert read_alignment(spark, str(tmp_path / "a.phy"), str(tmp_path / "a.model"), splits=splits).patterns.count() == 8


def test_columns_of_many_taxa_take_bounded_memory(spark, monkeypatch):
    """The function that runs in a task, on a batch of many sources and on one long text."""
    monkeypatch.setattr(alignment, "CELLS", 1 << 16)
    monkeypatch.setattr(alignment, "RANGE", 1 << 12)
    caught = {}

    class Rows:
        def where(self, *_):
            return self

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            caught["run"] = run
            return spark.createDataFrame([], schema)

    kinds = np.arange(256) % 3
    alignment.column_counts(Rows(), "a", "b", kinds, 3)
    texts = [bytes([65 + i % 7]) * 2000 for i in range(400)]
    for names, bodies in (([f"s{i}" for i in range(400)], texts), (["one", "one"], [b"ab\xc3\xa9" * 400_000, b"x" * 10])):
        batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(bodies, pa.binary())], names=["t", "x"])
        tracemalloc.start()
        total, sites = 0, set()
        for out in caught["run"](iter([batch])):
            total += sum(pa.compute.sum(out.column(k)).as_py() for k in (2, 3, 4))
            sites.update(out.column(1).to_pylist()[:5])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total == sum(len(b.decode()) for b in bodies) and min(sites) == 1 and peak < 24 << 20


def test_ranges_of_columns_meet(spark, monkeypatch):
    rows = [("a", "abcé" * 300), ("a", "ba"), ("b", None), (None, "x"), ("b", "")]
    kinds = np.array([b % 4 for b in range(256)])
    want = {}
    for taxon, text in rows:
        for i, c in enumerate(text or "") if taxon else ():
            k = kinds[c.encode()[0]]
            want[taxon, i + 1, k] = want.get((taxon, i + 1, k), 0) + 1
    docs = spark.createDataFrame(rows, "source string, text string")
    got = {(r.taxon, r.site, k): r[f"n{k}"] for r in alignment.column_counts(docs, "source", "text", kinds, 4).collect() for k in range(4) if r[f"n{k}"]}
    assert got == want


# Known alignments: taxa and sites, and by partition how many sites, patterns, their weights and the greatest
# weight; frequencies of A, C, G, T. They are looked for in the folder that PHYLIP_FIXTURES names.
KNOWN = {
    (49, 1200): [(300, 151, 300, 49), (600, 310, 600, 80), (200, 137, 200, 14), (100, 44, 49, 3)],
    (140, 1104): [(399, 384, 399, 4), (300, 299, 300, 2), (405, 376, 405, 10)],
}
KNOWN_FREQUENCIES = {(49, 1200): [(0.297816, 0.290672, 0.129074, 0.282439), (0.276935, 0.297466, 0.134461, 0.291138), (0.306410, 0.284036, 0.105381, 0.304173), (0.444245, 0.205085, 0.093593, 0.257077)]}
FOLDER = os.environ.get("PHYLIP_FIXTURES")


@pytest.mark.skipif(not FOLDER, reason="PHYLIP_FIXTURES names no folder")
def test_known_alignments(spark):
    seen = set()
    for model in sorted(Path(FOLDER or ".").glob("*.model")):
        text = model.with_suffix("")
        size = tuple(int(x) for x in text.read_text().split(None, 2)[:2])
        if size not in KNOWN:
            continue
        seen.add(size)
        a = read_alignment(spark, f"file://{text}", f"file://{model}")
        rows = a.patterns.groupBy("part_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("weight").alias("most")).orderBy("part_id").collect()
        sites = {r.part_id: r.n for r in a.ranges.groupBy("part_id").agg(F.sum(F.expr("(hi - lo) div step + 1")).alias("n")).collect()}
        assert [(sites[r.part_id], r.n, r.w, r.most) for r in rows] == KNOWN[size]
        if size in KNOWN_FREQUENCIES:
            got = em_frequencies(code_weights_of(a.patterns), 4).orderBy("part_id").collect()
            assert np.allclose([r.freqs for r in got], KNOWN_FREQUENCIES[size], atol=2e-6)
    assert seen == set(KNOWN)
