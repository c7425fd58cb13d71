"""Operator 9: Grace hash deduplication.

One pass normalises every text and collapses equal ones inside each partition; what is left
is spilled, one content per record, to a table in the shared folder. Buckets of that table are
the records whose content hashes begin with the same bits. A bucket that does not fit an
open-addressing table is spilled again and cut at more bits, as often as it takes. Where one
hash alone is too much, because one content recurs in many partitions, its records collapse in
parts, whose survivors meet again. Tables compare complete contents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.store import documents, has_plain_ids, materialise, without
from arborspark.llm.textops import release
from arborspark.sources.tables import broadcast_if_small

WHITE = b" \t\n\x0b\x0c\r"
BITS = 63  #: of a content's hash


class OpenTable:
    """Open addressing with linear probing; an entry is found by comparing complete contents."""

    def __init__(self, slots: int = 1024):
        self.slots, self.hashes, self.contents, self.best = [-1] * slots, [], [], []
        self.bytes = 0

    def place(self, h: int, content: bytes) -> int:
        """Index of the entry with this content, which is made if there is none."""
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                return i
            at = (at + 1) & mask
        self.slots[at] = i = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append(None)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self.grow()
        return i

    def grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for i, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def better(x: tuple, y: tuple) -> bool:
    """Rows as (code points, doc_id, row): more code points, then the smaller doc_id, nulls last, then the earlier row."""
    return (-x[0], x[1] is None, 0 if x[1] is None else x[1], x[2]) < (-y[0], y[1] is None, 0 if y[1] is None else y[1], y[2])


#: A spilled content: its row, the rows it stands for, the best of them; hash bits choose its bucket.
SPILL = "row long, parent long, doc_id {kind}, points long, rows long, sha binary, bits long, content binary, best_row long"


def collapse(limit: int):
    """An Arrow function: one record for each row, and one with the content for each distinct text.
    A table that holds `limit` bytes is spilled and a new one begun."""

    def spilled(t: OpenTable, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(b[0], None, b[2], b[3], b[1], b[4], h, c, b[5]) for b, h, c in zip(t.best, t.hashes, t.contents)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t, schema = TaskContext.get().partitionId() << 33, OpenTable(), None
        for b in batches:
            schema = schema or pa.schema([("row", pa.int64()), ("parent", pa.int64()), ("doc_id", b.schema.field(0).type), ("points", pa.int64()), ("rows", pa.int64()), ("sha", pa.binary()), ("bits", pa.int64()), ("content", pa.binary()), ("best_row", pa.int64())])
            out = []
            for doc, text, points in zip(*(c.to_pylist() for c in b.columns)):
                content = (text or b"").translate(None, WHITE)
                sha = hashlib.sha256(content).digest()
                h = int.from_bytes(sha[:8], "big") >> 1
                i = t.place(h, content)
                old = t.best[i]  # (row of the record, rows, best doc_id, best points, sha, best row)
                if old is None:
                    t.best[i] = (n, 1, doc, points, sha, n)
                else:
                    won = better((points, doc, n), (old[3], old[2], old[5]))
                    t.best[i] = (old[0], old[1] + 1, doc, points, sha, n) if won else (old[0], old[1] + 1, *old[2:])
                out.append((n, t.best[i][0], doc, points, 1, sha, h, None, None))
                n += 1
                if t.bytes > limit:
                    yield spilled(t, schema)
                    t = OpenTable()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if t.contents:
            yield spilled(t, schema)
        t = None
        release()

    return run


def meet(table: pa.Table) -> pa.Table:
    """The records of one part of a bucket, joined by complete content: parent is the record that
    stands for each; that one alone keeps its content and carries the group's rows and best row."""
    t, rows = OpenTable(), table.select(["row", "doc_id", "points", "rows", "sha", "bits", "content", "best_row"]).to_pylist()
    for r in rows:
        i = r["at"] = t.place(r["bits"], r["content"])
        old = t.best[i]
        if old is None:
            t.best[i] = dict(r)
        else:
            total = old["rows"] + r["rows"]
            if better((r["points"], r["doc_id"], r["best_row"]), (old["points"], old["doc_id"], old["best_row"])):
                old |= {k: r[k] for k in ("doc_id", "points", "best_row")}
            old["rows"] = total
    out = []
    for r in rows:
        g = t.best[r["at"]]
        first = g["row"] == r["row"]
        out.append(g | {"parent": None, "row": r["row"]} if first else {"row": r["row"], "parent": g["row"]})
    return pa.Table.from_pylist(out, schema=table.schema)


def exact_dedup(docs: DataFrame, bucket_bytes: int = 12 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]; null counts
    as empty, and all empty texts are one group. Of a group the row with the most code points
    stays, then the smallest doc_id (null last); of repeated rows exactly one stays. An empty
    table gives an empty one; other columns are not read. Any length of text works: only the
    texts of one bucket are in memory at once.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).cast("binary").alias("text"),
        F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long").alias("points"),
    )
    schema = SPILL.format(kind=rows.schema["doc_id"].dataType.simpleString())
    table = materialise(rows.mapInArrow(collapse(bucket_bytes), schema), "grace")
    members = table.where("content is null").select("row", "parent", "doc_id", "points", "sha")
    size = F.sum(F.length("content") + 200)
    rest = table.where("content is not null")
    total = rest.agg(size.alias("n")).first()["n"] or 0
    depth = max(0, (2 * total // bucket_bytes).bit_length())
    rest, met, round_ = rest.withColumn("depth", F.lit(depth)), [], 0
    while True:
        rest = rest.withColumn("bucket", F.expr(f"shiftright(bits, {BITS} - depth)"))
        sizes = rest.groupBy("depth", "bucket").agg(size.alias("n"), F.count("*").alias("records"), (F.min("bits") < F.max("bits")).alias("differ"))
        large = broadcast_if_small(materialise(sizes.where((F.col("n") > bucket_bytes) & (F.col("records") > 1)), "large"))
        if large.isEmpty():
            met.append(meet_in(rest, F.lit(0), schema, last=True))
            break
        rest = rest.join(large, ["depth", "bucket"], "left")
        met.append(meet_in(rest.where("n is null"), F.lit(0), schema, last=True))
        # one hash alone: four records or more a part, so that few survive
        parts = F.least(F.ceil(F.col("n") / bucket_bytes), F.ceil(F.col("records") / 4))
        same = meet_in(rest.where("not differ"), F.pmod(F.xxhash64("row", F.lit(round_)), parts), schema, last=False)
        met.append(same.where("parent is not null"))
        more = F.least(F.col("depth") + F.ceil(F.log2(F.col("n") / bucket_bytes)).cast("int") + 1, F.lit(BITS))
        again = rest.where("differ").select(*table.columns, more.alias("depth"))
        rest = materialise(again.unionByName(same.where("parent is null").withColumn("depth", F.lit(BITS))), "spilled")
        round_ += 1
    # what stands for a content is known for the last survivors first, then for what they took in
    final = reduce(DataFrame.unionByName, met)
    heads = final.where("parent is null").select("row", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"), "best_row")
    known = heads
    for m in reversed(met):
        links = m.where("parent is not null").select(F.col("row").alias("from"), F.col("parent").alias("to"))
        known = known.unionByName(links.join(known, links["to"] == known["row"]).select(F.col("from").alias("row"), "keep_id", "group_size", "best_row"))
    known = known.withColumnRenamed("row", "head")
    return members.join(known, members["parent"] == known["head"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("best_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("points").alias("n_points"),
    )


def meet_in(records: DataFrame, part: Column, schema: str, last: bool) -> DataFrame:
    """The records after those of each part of each bucket have met; contents are dropped at the last time."""
    keyed = records.withColumn("part", part).select("depth", "bucket", "part", *(c for c in records.columns if c not in ("depth", "bucket", "n", "records", "differ")))
    out = keyed.groupBy("depth", "bucket", "part").applyInArrow(lambda t: meet(t.drop_columns(["depth", "bucket", "part"])), schema)
    return materialise(out.withColumn("content", F.lit(None).cast("binary")) if last else out, "met")


def keep_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with their columns as they are: exactly one of each group of equal
    texts, null texts being empty. Where doc_ids are null or shared, rows are told apart by their
    texts as well, and of rows alike in both any one stays."""
    verdict = exact_dedup(docs, doc_id=doc_id, text=text, **options)
    if has_plain_ids(docs, doc_id):
        return without(docs, doc_id, verdict.where("not kept").select("doc_id"))
    stays = F.col("kept").cast("int")
    verdict = verdict.groupBy("doc_id", "text_sha256").agg(F.max(F.when(F.col("kept"), F.col("n_points"))).alias("n_points"), F.sum(stays).alias("n_kept")).where("n_kept > 0")
    body = F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(body, 256).alias("sha"), F.coalesce(F.char_length(text), F.lit(0)).alias("points"))
    same = keyed["row"][doc_id].eqNullSafe(verdict["doc_id"]) & (keyed["sha"] == verdict["text_sha256"]) & (keyed["points"] == verdict["n_points"])
    return keyed.join(verdict, same).withColumn("id", F.col(f"row.{doc_id}")).dropDuplicates(["id", "sha"]).select("row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_points")
