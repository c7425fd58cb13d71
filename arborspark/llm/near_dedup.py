"""Operator 10: MinHash near-duplicates by an LSH forest.

Every distinct shingle set gets one signature. Each tree of the forest reads the signature's
values in an order of its own; rows with the same first DEPTH values are a region, sorted by
the values that follow, and neighbours in that order, which share the longest prefixes, are
candidates. A region too dense for one task is cut at deeper values. What is linked already
needs no more comparing, so a large group costs about one confirmed link for each row. In
regions with more rows than a row has neighbours, what the neighbours have left in different
components is compared again, region by region: a region of too many rows is first cut at more
values, in several ways at once, so that each row is sent a bounded number of times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.graph import components
from arborspark.llm.store import documents, has_plain_ids, materialise, without
from arborspark.llm.textops import chunks, mix, release, shingle_sets
from arborspark.sources.tables import broadcast_if_small

VALUES = 128  #: MinHash values of a signature
TREES = 32
DEPTH = 4  #: values that a region shares: at similarity 0.75 all trees miss a pair with probability 5e-6
NEIGHBOURS = 4
CELL = 50_000  #: rows of a region beyond which it is cut at deeper values
BLOCK = 512  #: rows on either side of a block that is compared all against all
SKETCH_MATCH = 96  #: equal bits of 128; at similarity 0.75 fewer have probability 1e-5
SIGNATURE_MATCH = 72  #: equal values of 128; at similarity 0.75 fewer have probability 1e-6
DENSE = 4096  #: rows of a cell beyond which it is cut at more values before its components are compared
STEP, SUBTREES, LEVELS = 4, 8, 2  #: of such cuts: values, cells of each row, and how often
HOT = 1000  #: rows of one key that a join leaves in one task, at least
ROUNDS = 2  #: best-first rounds of confirming at most; then all the rest is confirmed
FEW = 6  #: when rows have no more open pairs than this on average, all are confirmed at once
_A = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, VALUES + 1001, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(out, ((shingles[i : i + 1024, None] * _A + _B) >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(np.uint32)


def orders() -> np.ndarray:
    """For each tree the places of the signature values it reads, first to last."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(VALUES)[: DEPTH + 4] for _ in range(TREES)])


def _set_column(batch: pa.RecordBatch, k: int):
    for i, j, data, offsets in chunks(batch.column(1)):
        yield from shingle_sets(data, offsets, k)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """id, n (shingles), digest (of the whole set), sig."""

    def run(batches):
        for b in batches:
            n, digest, sig = [], [], []
            for s in _set_column(b, k):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "digest", "sig"])
        release()

    return docs.mapInArrow(run, f"id {docs.schema[0].dataType.simpleString()}, n long, digest binary, sig binary")


def forest(reps: DataFrame) -> DataFrame:
    """A row for each tree and signature: region, label (the next values), two words of sketch bits."""

    def run(batches):
        order = orders()
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)
            bits = np.packbits((sig & 1).astype(bool), axis=1).view(np.int64)
            read = sig[:, order].astype(np.uint64)  # rows, trees, values
            region = np.broadcast_to(np.arange(TREES, dtype=np.uint64), read.shape[:2])
            for d in range(DEPTH):
                region = mix(region * np.uint64(0x9E3779B97F4A7C15) + read[:, :, d])
            label = np.zeros(read.shape[:2], np.uint64)
            for d in range(DEPTH, DEPTH + 4):
                label = label << np.uint64(16) | read[:, :, d] & np.uint64(0xFFFF)
            again = np.repeat(np.arange(b.num_rows), TREES)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(again)), *(pa.array(x.ravel().view(np.int64)) for x in (region, label)), *(pa.array(bits[again, c]) for c in (0, 1))],
                names=["id", "region", "label", "s0", "s1"],
            )
        release()

    return reps.select("id", "sig").mapInArrow(run, f"id {reps.schema['id'].dataType.simpleString()}, region long, label long, s0 long, s1 long")


def _equal_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 128 - np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs of rows that stand within NEIGHBOURS places of each other in one region's order.
    rows must be partitioned by cell and sorted by cell and label."""

    def run(batches):
        kept = None
        for b in batches:
            b = pa.Table.from_batches([b])
            t = pa.concat_tables([kept, b]).combine_chunks() if kept is not None else b
            old = len(t) - len(b)
            cell, ids = t.column("cell").to_numpy(), t.column("id").to_numpy()
            bits = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")], axis=1)
            left, right, match = [], [], []
            for j in range(1, NEIGHBOURS + 1):
                hi = np.arange(max(old, j), len(t))
                lo = hi - j
                keep = (cell[lo] == cell[hi]) & (ids[lo] != ids[hi])
                lo, hi = lo[keep], hi[keep]
                m = _equal_bits(bits[lo], bits[hi])
                near = m >= SKETCH_MATCH
                left.append(ids[lo[near]])
                right.append(ids[hi[near]])
                match.append(m[near])
            x, y = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.concatenate(match), pa.int32())], names=["a", "b", "match"])
            kept = t.slice(max(0, len(t) - NEIGHBOURS))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}, match int")


def views(column: pa.Array):
    """Sets of a binary column, read where they are."""
    return (np.frombuffer(x.as_buffer(), np.uint64) for x in column)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(views(b.column(2)), views(b.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()
        release()

    kind = pairs.schema["a"].dataType.simpleString()
    x, y = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    x, y = (comp.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    joined = pairs.join(x, "a", "left").join(y, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(pairs.columns)


def deepened(cells: DataFrame, hot: DataFrame) -> DataFrame:
    """Cells of hot regions cut at two more values, then at four, then by salt, where they stay too large."""
    keys = {"six": F.xxhash64("region", F.shiftright("label", 32)), "eight": F.xxhash64("region", "label")}
    for name, key in keys.items():
        cells = cells.withColumn(name, key)
    inner = cells.join(hot, "region", "left_semi")
    out = cells.join(hot.withColumn("is_hot", F.lit(True)), "region", "left")
    for name in keys:
        large = inner.groupBy(name).agg(F.count("*").alias(f"n_{name}")).where(f"n_{name} > {CELL}")
        out = out.join(large, name, "left")
    salted = F.xxhash64("eight", F.pmod(F.xxhash64("id"), F.ceil(F.col("n_eight") / CELL)))
    cut = F.when(F.col("n_six").isNull(), F.col("six")).when(F.col("n_eight").isNull(), F.col("eight")).otherwise(salted)
    return out.withColumn("cell", F.when(F.col("is_hot"), cut).otherwise(F.col("region")))


def salted_join(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """left join right, which has one row a key and the number of left's rows of it. The rows of a
    frequent key are dealt to several tasks by their ids, and its row on the right is repeated for each."""
    limit = max(HOT, total // 100_000)
    salts = F.ceil(F.col(size) / limit)
    hot = broadcast_if_small(right.where(F.col(size) > limit).select(key, salts.alias("salts")))
    left = left.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))).drop("salts")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [key, "salt"]).drop("salt", size)


def deeper(cells: DataFrame, heads: DataFrame, level: int) -> DataFrame:
    """Rows (cell, id) under SUBTREES cells of STEP more signature values each: of two rows at similarity
    0.75 that share a cell, all of these part them with probability 0.05."""
    at = np.stack([np.random.default_rng((21, level, k)).permutation(VALUES)[:STEP] for k in range(SUBTREES)])

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, VALUES)
            cell = np.repeat(b.column(0).to_numpy().view(np.uint64)[:, None], SUBTREES, axis=1) ^ mix(np.arange(1, SUBTREES + 1, dtype=np.uint64))
            for d in range(STEP):
                cell = mix(cell * np.uint64(0x9E3779B97F4A7C15) + sig[:, at[:, d]])
            again = np.repeat(np.arange(b.num_rows), SUBTREES)
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().view(np.int64)), b.column(1).take(pa.array(again))], names=["cell", "id"])

    kind = cells.schema["id"].dataType.simpleString()
    return cells.join(heads.select("id", "sig"), "id").select("cell", "id", "sig").mapInArrow(run, f"cell long, id {kind}")


def dense_links(cells: DataFrame, comp: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Links between the components that share a cell (cell, id): cells of several components are
    compared in blocks, those of more than DENSE rows after they have been cut at more values. What is
    still larger after LEVELS cuts is compared as it is, so nothing is left out."""
    links = []
    for level in range(LEVELS + 1):
        own = materialise(cells.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")), "cells")
        sizes = own.groupBy("cell", "component").agg(F.count("*").alias("n"))
        sizes = sizes.groupBy("cell").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
        sizes = materialise(sizes.select("cell", F.col("top.component").alias("main"), (F.col("all") - F.col("top.n")).alias("others"), "all"), "several")
        total = sizes.agg(F.sum("all")).first()[0]
        if not total:
            break
        small = sizes if level == LEVELS else sizes.where(f"all <= {DENSE}")
        links.append(blocks(salted_join(own, small.withColumn("size", F.col("all")), "cell", "size", total), heads, sets, percent))
        large = sizes.where(f"all > {DENSE}").select("cell", "all")
        if level == LEVELS or large.isEmpty():
            break
        cells = deeper(salted_join(own.select("cell", "id"), large, "cell", "all", total), heads, level)
    return links


def blocks(own: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a cell: the rows outside a cell's largest component
    against all its rows of other components, in blocks of about BLOCK rows on either side.
    Signatures tell which pairs are worth a look, full sets decide, and only links leave the task,
    one at most for two components. own: cell, id, component, main, others, all."""
    own = own.withColumn("rights", F.ceil(F.col("all") / BLOCK)).withColumn("lefts", F.ceil(F.col("others") / BLOCK))
    own = own.join(heads.select("id", "sig"), "id").join(sets, "id")
    cols = ["cell", "id", "component", "sig", "shingles"]
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = own.where("component <> main").select(*cols, F.lit(True).alias("is_left"), number("lefts").alias("i"), each("rights").alias("j"))
    right = own.select(*cols, F.lit(False).alias("is_left"), each("lefts").alias("i"), number("rights").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        ids, part = t.column("id").to_pylist(), t.column("component").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
        full = list(views(t.column("shingles")))
        is_left = t.column("is_left").to_numpy()
        rights, joined, a, b = np.flatnonzero(~is_left), set(), [], []
        for x in np.flatnonzero(is_left):
            near = rights[((sig[rights] == sig[x]).sum(axis=1) >= SIGNATURE_MATCH) & (part[rights] != part[x])]
            for y in near:
                pair = frozenset((part[x], part[y]))
                if pair in joined:
                    continue
                both = len(np.intersect1d(full[x], full[y], assume_unique=True))
                if 100 * both >= percent * (len(full[x]) + len(full[y]) - both):
                    joined.add(pair)
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
        return pa.table({"a": pa.array(a, t.schema.field("id").type), "b": pa.array(b, t.schema.field("id").type)})

    kind = own.schema["id"].dataType.simpleString()
    return left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Rows are linked when 100 * intersection >= percent * union of their distinct k-word shingles
    (A-Z lowered, words between characters of [\\x20\\x09-\\x0D]); a text with fewer words is one
    shingle. Null and empty texts have none and are linked with nothing. A long text's set is made
    whole, in one task. Ids are integers; rows that share a doc_id are one document. A null doc_id is linked with nothing and kept, its component null.
    An empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sigs = materialise(signatures(rows, k), "signatures")
    some = sigs.where("n > 0 and id is not null")
    heads = some.groupBy("digest").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    heads = materialise(heads, "heads")
    trees = forest(heads)

    total = TREES * heads.count()
    counts = materialise(trees.groupBy("region").agg(F.count("*").alias("size")).where(f"size > {NEIGHBOURS + 1}"), "dense")
    hot = counts.where(f"size > {CELL}").select("region")
    cells = trees.withColumn("cell", F.col("region"))
    if not hot.isEmpty():
        cells = deepened(cells, hot)
    cells = cells.select("id", "cell", "label", "s0", "s1").repartition("cell").sortWithinPartitions("cell", "label", "id")
    pairs = materialise(neighbours(cells).groupBy("a", "b").agg(F.max("match").alias("match")), "pairs")

    def one_set(batches):
        for b in batches:
            for i, j, data, offsets in chunks(b.column(1)):  # handed out chunk by chunk, so that a batch's sets are never all in memory
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([s.tobytes() for s in shingle_sets(data, offsets, k)], pa.binary())], names=["id", "shingles"])
            pa.default_memory_pool().release_unused()
        release()

    dense = materialise(salted_join(trees.select("id", "region"), counts, "region", "size", total).select(F.col("region").alias("cell"), "id"), "members")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(dense.select("id")).distinct()
    # where these are few, no text is shuffled
    wanted = broadcast_if_small(materialise(wanted, "wanted"))
    sets = rows.join(wanted, "id", "left_semi").mapInArrow(one_set, "id long, shingles binary")
    sets = materialise(sets if has_plain_ids(some, "id") else sets.dropDuplicates(["id", "shingles"]), "sets")

    links, comp, left = None, None, pairs
    for r in range(ROUNDS + 1):
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "match"))
        best = ends.groupBy("a").agg(F.max(F.struct("match", "b")).alias("top"), F.count("*").alias("n"))
        n = best.agg(F.sum("n").alias("pairs"), F.count("*").alias("rows")).first()
        last = r == ROUNDS or (n["pairs"] or 0) <= FEW * n["rows"]
        asked = left if last else materialise(best.select(F.least("a", "top.b").alias("a"), F.greatest("a", "top.b").alias("b")).distinct(), "asked")
        found = materialise(confirm(asked, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        comp = materialise(components(links), "components")
        if last:
            break
        left = materialise(across(left.join(asked, ["a", "b"], "left_anti"), comp), "left")
    for found in dense_links(dense, comp, heads, sets, percent):
        links = links.unionByName(materialise(found, "links"))
    comp = materialise(components(links), "components")

    group = some.groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("n")).join(comp, F.col("head") == comp["id"], "left").select("digest", F.coalesce("component", "head").alias("component_id"), "n")
    own = salted_join(some.select("id", "digest"), materialise(group, "groups"), "digest", "n", total).groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = sigs.join(own, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_near(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay, with their columns as they are: one of each component, that of the
    least doc_id. Where a doc_id is null or shared, rows are numbered first and the least number
    stays, so that exactly one row of a component does. Rows without a word all stay."""
    if has_plain_ids(docs, doc_id):
        return without(docs, doc_id, near_duplicates(docs, doc_id=doc_id, **options).where("not kept").select("doc_id"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("place"), F.col(options.get("text", "text")).alias("text"))
    rows = materialise(rows, "rows")
    gone = near_duplicates(rows, **options | {"doc_id": "place", "text": "text"}).where("not kept").select("doc_id")
    return without(rows, "place", gone).select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
