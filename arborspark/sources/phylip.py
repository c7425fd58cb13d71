"""PHYLIP alignments as DataFrames (taxon_id, name, seq)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborspark.sources.tables import broadcast_if_small, materialise

BAD_NAME = r"[\t\r\n :,()\[\];]"


def parse_phylip(text: str) -> list[tuple[int, str, str]]:
    """Sequential or interleaved text: names stand once, before the first block of each taxon. Lines after the
    last of the taxa, once all are complete, are not read."""
    lines = [x for x in text.splitlines() if x.strip()]
    try:
        taxa, sites = (int(x) for x in lines[0].split()[:2])
    except (ValueError, IndexError):
        raise ValueError("the first line must hold the numbers of taxa and sites") from None
    if taxa < 4 or sites < 1:
        raise ValueError("an alignment needs four taxa and one site at least")
    names, seqs, body = [], [], [x.split() for x in lines[1:]]
    sequential = len(body) != taxa
    if sequential:  # a taxon's lines stand together: each takes lines until it is complete
        at = 0
        for _ in range(taxa):
            if at >= len(body):
                break
            name, seq = body[at][0], "".join(body[at][1:])
            at += 1
            while len(seq) < sites and at < len(body):
                seq += "".join(body[at])
                at += 1
            names.append(name)
            seqs.append(seq)
        sequential = all(len(s) == sites for s in seqs) and len(seqs) == taxa
    if not sequential:  # interleaved: blocks of one line a taxon
        if len(body) % taxa:
            raise ValueError("blocks differ in their numbers of lines")
        names = [x[0] for x in body[:taxa]]
        seqs = ["".join(body[i][1:] + [p for b in range(taxa + i, len(body), taxa) for p in body[b]]) for i in range(taxa)]
    wrong = [n for n, s in zip(names, seqs) if len(s) != sites]
    if wrong:
        raise ValueError(f"sequences of another length than {sites}: {wrong[:3]}")
    return [(i + 1, n, s.upper()) for i, (n, s) in enumerate(zip(names, seqs))]


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """One row for each taxon of each file under path: file, taxon_id (from 1), name, seq."""

    def run(batches):
        for b in batches:
            rows = [(f, *r) for f, t in zip(b["file"], b["value"]) for r in parse_phylip(t)]
            yield pd.DataFrame(rows, columns=["file", "taxon_id", "name", "seq"])

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.mapInPandas(run, "file string, taxon_id int, name string, seq string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files that are not blank, numbered from 0 in each file: file, line, value.

    Files are read in splits. A row knows its split's place in the file, and rows of a split are numbered by
    the task that reads it; the lines of the splits before are counted and added. Only these counts meet."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    lines = materialise(lines.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "").withColumn("row", F.monotonically_increasing_id()), "lines")
    splits = lines.groupBy("file", "split").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")  # over a row a split
    splits = broadcast_if_small(materialise(splits.withColumn("before", before).drop("n"), "splits"))
    return lines.join(splits, ["file", "split"]).select("file", (F.col("row") - F.col("first") + F.col("before")).alias("line"), "value")


def read_interleaved(spark: SparkSession, path: str) -> DataFrame:
    """Alignments in blocks of one line a taxon, or of a single block, of any size: file, taxon_id (from 1), name,
    begin (site of the first character), seq (what one line holds). No task reads a whole file. Blocks of
    different numbers of lines, and taxa of another length than the first line says, are errors."""
    lines = materialise(numbered_lines(spark, path), "numbered")
    head = lines.where("line = 0").select("file", F.regexp_extract("value", r"^\s*(\d+)\s+(\d+)", 1).alias("taxa"), F.regexp_extract("value", r"^\s*(\d+)\s+(\d+)", 2).alias("sites"))
    if not head.where("taxa = '' or sites = ''").isEmpty():
        raise ValueError("the first line must hold the numbers of taxa and sites")
    head = broadcast_if_small(materialise(head.select("file", F.col("taxa").cast("long").alias("taxa"), F.col("sites").cast("long").alias("sites")), "heads"))
    body = lines.where("line > 0").join(head, "file").withColumn("taxon_id", ((F.col("line") - 1) % F.col("taxa") + 1).cast("int"))
    body = body.withColumn("block", F.expr("(line - 1) div taxa"))
    text, named = F.regexp_replace("value", r"^\s+", ""), F.col("block") == 0
    name = F.when(named, F.regexp_extract(text, r"^\S+", 0))
    seq = F.upper(F.regexp_replace(F.when(named, F.regexp_replace(text, r"^\S+", "")).otherwise(text), r"\s", ""))
    parts = body.select("file", "line", "taxa", "sites", "taxon_id", "block", name.alias("name"), seq.alias("seq"))
    # where the first block holds all sites of all taxa, it is the last
    whole = parts.where("block = 0 and length(seq) = sites").groupBy("file", "taxa").agg(F.count("*").alias("n")).where("n = taxa").select("file", F.lit(True).alias("whole"))
    parts = materialise(parts.join(broadcast_if_small(materialise(whole, "whole")), "file", "left").where("whole is null or block = 0"), "parts")
    sizes = head.join(parts.groupBy("file").agg(F.max("line").alias("n")), "file", "left")
    if not head.where("taxa < 4 or sites < 1").isEmpty():
        raise ValueError("an alignment needs four taxa and one site at least")
    if not sizes.where("n is null or n % taxa != 0").isEmpty():
        raise ValueError("blocks differ in their numbers of lines")
    line = Window.partitionBy("file", "taxon_id").orderBy("block")
    end = F.sum(F.length("seq")).over(line)
    out = parts.select("file", "sites", "taxon_id", F.first("name").over(line).alias("name"), (end - F.length("seq") + 1).cast("long").alias("begin"), "seq")
    out = materialise(out, "pieces")
    wrong = out.groupBy("file", "taxon_id", "name", "sites").agg(F.sum(F.length("seq")).alias("n")).where("n != sites").orderBy("taxon_id").limit(3).collect()
    if wrong:
        raise ValueError(f"sequences of another length than {wrong[0]['sites']}: {[r['name'] for r in wrong]}")
    return out.drop("sites")


def read_phylip_lines(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of one line a taxon, read in splits: name, seq. For files too large for one task."""
    line = F.trim("value")
    parts = F.split(line, r"\s+", 2)
    rows = spark.read.text(path).where((line != "") & ~line.rlike(r"^\d+\s+\d+$"))
    return rows.select(parts[0].alias("name"), F.upper(F.regexp_replace(parts[1], r"\s", "")).alias("seq"))


def bad_names(taxa: DataFrame) -> DataFrame:
    """Taxa whose names a tree file cannot hold, or that occur twice."""
    twice = taxa.groupBy("name").agg(F.count("*").alias("n"))
    return twice.where((F.col("n") > 1) | F.col("name").rlike(BAD_NAME) | (F.length("name") > 256))


def cells(alignment: DataFrame) -> DataFrame:
    """Long form: taxon_id, site (from 1), character."""
    letters = F.posexplode(F.split("seq", "")).alias("place", "character")
    return alignment.select("taxon_id", letters).where("character <> ''").select("taxon_id", (F.col("place") + 1).alias("site"), "character")
