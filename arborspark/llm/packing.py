"""Operator 5: bounded-space online packing of token sequences.

A partition keeps a fixed number of open windows. What is left of a document after its full
windows goes best-fit into an open one; when none fits and none is free, the fullest window
is filled up by a cut and emitted. What is open at a partition's end is merged, first within
the partition, then among groups of partitions, so that no task gathers more than a bounded
number of windows. The last open window of a group is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.store import documents, in_batches_of, materialise
from arborspark.llm.textops import release
from arborspark.llm.tokens import by_bytes, codec

MERGED_ID = 1 << 62  #: sequence ids from here on belong to merged windows
Piece = tuple[object, int, bytes, int]  #: doc_id, start, ids as bytes, tokens of the document


class Window:
    """An open sequence: its pieces and how many tokens they hold."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces: list[Piece] = []
        self.used = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece[2]) // 4


def cut(piece: Piece, tokens: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * tokens], total), (doc, start + tokens, ids[4 * tokens :], total)


class Packer:
    """Pieces in, full windows out; `rest()` gives what is still open, merged."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows, self.open = size, windows, []

    def put(self, piece: Piece) -> Iterator[Window]:
        while (n := len(piece[2]) // 4) >= self.size:
            full = Window()
            head, piece = cut(piece, self.size)
            full.add(head)
            yield full
        while n := len(piece[2]) // 4:
            fits = [w for w in self.open if self.size - w.used >= n]
            if fits:
                best = max(fits, key=lambda w: w.used)
                best.add(piece)
            elif len(self.open) < self.windows:
                best = Window()
                best.add(piece)
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w.used)
                head, piece = cut(piece, self.size - best.used)
                best.add(head)
            if best.used == self.size:
                self.open.remove(best)
                yield best
            if best.pieces[-1] is piece:
                return

    def rest(self) -> Iterator[Window]:
        """Merge the open windows: the emptiest fills the fullest; at most one stays below the size."""
        left = sorted(self.open, key=lambda w: w.used)
        self.open = []
        while left:
            w = left.pop()
            while w.used < self.size and left:
                for piece in left.pop(0).pieces:
                    room = self.size - w.used
                    if room == 0:
                        yield w
                        w, room = Window(), self.size
                    head, tail = cut(piece, room)
                    w.add(head)
                    if tail[2]:
                        yield w
                        w = Window()
                        w.add(tail)
            yield w


def powers(window: Window) -> Iterator[Window]:
    """A window in parts whose lengths are powers of two, longest first."""
    pieces = list(window.pieces)
    for bit in reversed(range(window.used.bit_length())):
        if window.used >> bit & 1:
            part = Window()
            while room := (1 << bit) - part.used:
                head, tail = cut(pieces.pop(0), room)
                part.add(head)
                if tail[2]:
                    pieces.insert(0, tail)
            yield part


class Rows:
    """Collects pieces as columns of the result; `ids` is set while a window is open."""

    NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids")

    def __init__(self, doc_type: pa.DataType):
        self.types = (doc_type, *[pa.int64()] * 7, pa.binary())
        self.columns: tuple[list, ...] = tuple([] for _ in self.NAMES)

    def add(self, window: Window, sequence_id: int, part: int, still_open: bool = False) -> None:
        at = 0
        for doc, start, ids, total in window.pieces:
            n = len(ids) // 4
            for c, v in zip(self.columns, (doc, start, n, zlib.crc32(ids), total, sequence_id, at, part, ids if still_open else None)):
                c.append(v)
            at += n

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, self.types)], names=list(self.NAMES))
        for c in self.columns:
            c.clear()
        return out


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    size: int = 4096,
    windows: int = 32,
    end_id: int = 2,
    merge: int = 64,
    keep_units: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs is one document, repeated doc_ids included; a null text is empty and
    gives the end id alone; a null doc_id stays null; an empty table gives no pieces; other
    columns are not read. Long texts fill windows of their own. `windows` bounds what is
    open in a partition, `merge` how many partitions' last windows one task merges. Workers remember
    the units they have met; without keep_units only to the end of a task, which takes less memory.
    """
    path, tail = public_tokenizers.path(tokenizer), end_id.to_bytes(4, "little")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"

    def first(batches):
        c, packer, part, seq, out = codec(path), Packer(size, windows), TaskContext.get().partitionId(), 0, None
        for b in batches:
            out = out or Rows(b.schema.field(0).type)
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in by_bytes(texts):
                for doc, ids in zip(names[i:j], c.id_bytes([t or b"" for t in texts[i:j]])):
                    ids += tail
                    for w in packer.put((doc, 0, ids, len(ids) // 4)):
                        out.add(w, part << 32 | seq, part)
                        seq += 1
            yield out.take()
        if out:
            for w in packer.rest():
                out.add(w, part << 32 | seq, part, still_open=w.used < size)
                seq += 1
            yield out.take()
        if not keep_units:
            c.forget()
        release()

    def again(table: pa.Table) -> pa.Table:
        group = table.column("part")[0].as_py() // merge
        packer, seq, out = Packer(size, windows), MERGED_ID | group << 32, Rows(table.schema.field("doc_id").type)
        table = table.sort_by([("part", "ascending"), ("offset", "ascending")])
        full: list[Window] = []
        for doc, start, total, ids in zip(*(table.column(x).to_pylist() for x in ("doc_id", "start", "doc_tokens", "ids"))):
            full += packer.put((doc, start, ids, total))
        for w in (*full, *packer.rest()):
            for p in (w,) if w.used == size else powers(w):
                out.add(p, seq, group)
                seq += 1
        return pa.Table.from_batches([out.take()])

    placed = materialise(rows.mapInArrow(first, schema), "packed")
    merged = placed.where("ids is not null").groupBy(F.expr(f"part div {merge}")).applyInArrow(again, schema)
    return placed.where("ids is null").unionByName(merged).drop("part", "ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_batches_of(spark)
    return pack(documents(spark, sf_dir))
