"""Operator 13: how the tokens of two tokenizers lie over each other, counted across the corpus.

A link is a token of A and a token of B whose bytes overlap. Tasks write what pairs of ids occur in
which of their documents as sorted runs, radix-partitioned by B's id and compressed. A heap merges
the runs of a partition block by block and counts each pair; partial counts of several merges are
summed, B's id first, which gives each B id's highest count in one pass. Then the runs are read
again and every document gets the counts of its own links back.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.store import documents, materialise
from arborspark.llm.textops import chunks

BUCKETS = 64  #: radix partitions of the pairs, by B's id
LOT = 32  #: tasks whose runs are merged together
RUN_RECORDS = 1_000_000  #: pair-document records a task holds before it writes runs
CHUNK_BYTES = 2 << 20  #: text worked on at once; a longer text is cut at units
AT_ONCE = 8000  #: units that go to the libraries together
BLOCK = 1 << 16  #: records compressed together
KEPT_UNITS = 80_000  #: units whose ids a Python worker remembers, and as many of those it met before
_aligners: dict[tuple[str, str], "Aligner"] = {}


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others, in order, for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers of one length, each in the narrowest type, compressed."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        width = next(w for w in (1, 2, 4, 8) if not len(c) or int(c.max()) < 1 << 8 * w)
        parts += [bytes([width]), c.astype(f"<u{width}").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    while at < len(data):
        width = data[at]
        out.append(np.frombuffer(data, f"<u{width}", n, at + 1).astype(np.int64))
        at += 1 + n * width
    return out


def sums_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of each value by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


class Vocabulary:
    """The bytes of a tokenizer's ids: one array, and each id's place and size in it."""

    def __init__(self, words: list[bytes]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)][:-1]
        self.data = np.frombuffer(b"".join(words), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids] - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(n.sum())]


class Aligner:
    """Both tokenizers in one Python worker, and the ids of units they have met."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = byte_values()
        words = [b""] * self.a.get_vocab_size()
        for word, i in self.a.get_vocab(with_added_tokens=True).items():
            words[i] = bytes(value[c] for c in word) if all(c in value for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.words_a = Vocabulary(words)
        self.words_b = Vocabulary([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.digits = pa.array([b"%d" % i for i in range(max(len(words), len(pieces)))], pa.large_binary())
        self.space = self.b.piece_to_id("▁")
        #: B's merges stay within a unit if no piece holds a space after another character, or a line end.
        self.splits = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}

    def units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of units: texts (each with its space), cut before a space or line end that follows a
        character that is no white space for certain. Neither tokenizer joins anything across such a place."""
        if not self.splits:
            return offsets[:-1][np.diff(offsets) > 0]
        plain = (data > 0x20) & (data < 0x7F)
        plain[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = plain[:-1] & ((data[1:] == 0x20) | (data[1:] == 0x0A))
        cut[offsets[:-1]] = True
        return np.flatnonzero(cut[:-1])

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """B puts a space before what it reads: it stands for a unit's own, or is taken off again before a
        line end. It gives nothing for an empty text, so a lone space is looked up."""
        ids = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1) if units else []
        return [[self.space] if u == " " else x if u[0] == " " else x[1:] for u, x in zip(units, ids)]

    def encoded(self, units: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of each tokenizer the ids of all units, one after the other, and how many each unit has. Units not
        met before go to both libraries."""
        cells = [self.known.get(u) or self.older.get(u) for u in units]
        for some in itertools.batched([i for i, c in enumerate(cells) if c is None], AT_ONCE):
            texts = [units[i].decode() for i in some]
            for i, e, b in zip(some, self.a.encode_batch_fast(texts, add_special_tokens=False), self.ids_b(texts)):
                cells[i] = array("I", e.ids).tobytes(), array("I", b).tobytes()
        if len(self.known) > KEPT_UNITS:  # what is still in use comes back from the older ones
            self.known, self.older = {}, dict(itertools.islice(self.known.items(), KEPT_UNITS))
        room = max(0, 2 * KEPT_UNITS - len(self.known))
        self.known.update(itertools.islice(((u, c) for u, c in zip(units, cells) if len(u) <= 64), room))
        return tuple((np.frombuffer(b"".join([c[k] for c in cells]), "<u4").astype(np.int64), np.array([len(c[k]) // 4 for c in cells], np.int64)) for k in (0, 1))


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that are not empty with a space before each; empty ones stay empty."""
    full = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][full], 0x20), offsets + np.r_[0, np.cumsum(full)]


def lists(sizes: np.ndarray, values: pa.Array, mark: bytes) -> pa.Array:
    """Runs of values of the given sizes, joined by a mark."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int64()), values), pa.scalar(mark, pa.large_binary()))


class Units:
    """Distinct units: do their tokens' bytes give the unit (`fits`), how many tokens of A and B, groups and
    links they have (`counts`), their groups as text, and their links (pair: b << 32 | a)."""

    def __init__(self, with_: Aligner, units: pa.Array):
        (a, n_a), (b, n_b) = with_.encoded(units.to_pylist())
        size = pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(units.buffers()[2], np.uint8)
        one = np.arange(len(size))
        fits = np.ones(len(size), bool)
        for ids, n, words in ((a, n_a, with_.words_a), (b, n_b, with_.words_b)):
            fits &= np.bincount(np.repeat(one, n), words.size[ids], len(size)) == size
        at = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(size)]
        for ids, n, words in ((a, n_a, with_.words_a), (b, n_b, with_.words_b)):
            own = words.spelled(ids[np.repeat(fits, n)])
            there = np.repeat(at[fits] - np.r_[0, np.cumsum(size[fits])][:-1], size[fits]) + np.arange(size[fits].sum())
            wrong = np.zeros(len(size), bool)
            wrong[np.repeat(one[fits], size[fits])[own != data[there]]] = True
            fits = fits & ~wrong
        a, b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)]
        end_a, end_b, end = np.cumsum(with_.words_a.size[a]), np.cumsum(with_.words_b.size[b]), np.cumsum(np.where(fits, size, 0))
        # between neighbouring ends of either side lies one link
        ends = np.union1d(end_a, end_b)
        i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        self.pairs = b[j] << 32 | a[i]
        unit = np.searchsorted(end, ends)
        both = (end_a[i] == ends) & (end_b[j] == ends)
        links, groups = np.bincount(unit, minlength=len(size)), np.bincount(unit[both], minlength=len(size))
        self.fits, self.counts = fits, np.stack([np.where(fits, n_a, 0), np.where(fits, n_b, 0), groups, links], axis=1)
        self.first_link = np.r_[0, np.cumsum(links)]
        sides = [lists(np.diff(k[both] + 1, prepend=0), with_.digits.take(pa.array(ids)), b",") for k, ids in ((i, a), (j, b))]
        self.text = lists(groups, pc.binary_join_element_wise(*sides, pa.scalar(b"|", pa.large_binary())), b";")


class Found:
    """What texts gave, each with its space before it: by text whether its tokens fit, the four counts and its
    groups as text; and records of pair, text, times, sorted."""

    def __init__(self, with_: Aligner, data: np.ndarray, offsets: np.ndarray):
        starts = with_.units(data, offsets)
        docs = len(offsets) - 1
        cells = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(cells)
        unit, kinds = coded.indices.to_numpy().astype(np.int64), Units(with_, coded.dictionary)
        first = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(docs), np.diff(first))
        self.fits = np.ones(docs, bool)
        self.fits[doc[~kinds.fits[unit]]] = False
        good = self.fits[doc]
        unit, doc = unit[good], doc[good]
        per_doc = np.bincount(doc, minlength=docs)
        self.counts = np.stack([np.bincount(doc, kinds.counts[unit, c], docs).astype(np.int64) for c in range(4)], axis=1)
        self.text = lists(per_doc, kinds.text.take(pa.array(unit)), b";")
        key, times = sums_by(unit * docs + doc, np.ones(len(unit), np.int64))
        unit, doc = key // docs, key % docs
        n = np.diff(kinds.first_link)[unit]
        at = np.repeat(kinds.first_link[unit] - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(n.sum())
        distinct, place = np.unique(kinds.pairs, return_inverse=True)
        key, times = sums_by(place[at] * docs + np.repeat(doc, n), np.repeat(times, n))
        self.records = distinct[key // docs], key % docs, times


def found(with_: Aligner, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
    """Of each text the four counts and the digest of its groups, and records of pair, text, times. A long
    text, alone in its chunk, is worked on in parts that begin with units."""
    data, offsets = spaced(data, offsets)
    if not len(data):
        return np.zeros((len(offsets) - 1, 4), np.int64), [""] * (len(offsets) - 1), tuple(np.zeros(0, np.int64) for _ in range(3))
    if len(offsets) > 2 or len(data) <= 2 * CHUNK_BYTES:
        x = Found(with_, data, offsets)
        texts = np.frombuffer(x.text.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(x.text.buffers()[1], np.int64)[: len(offsets)]
        whole = x.fits & (x.counts[:, 0] > 0)
        return x.counts, [hashlib.sha256(texts[i:j]).hexdigest() if w else "" for i, j, w in zip(ends[:-1], ends[1:], whole)], x.records
    starts = with_.units(data, offsets)
    cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, starts[-1] + 1, CHUNK_BYTES))])
    counts, digest, pair, times, fits = np.zeros((1, 4), np.int64), hashlib.sha256(), *(np.zeros(0, np.int64) for _ in range(2)), True
    for i, j in zip(cuts, [*cuts[1:], len(data)]):
        x = Found(with_, data[i:j], np.array([0, j - i]))
        fits = fits and bool(x.fits[0])
        counts += x.counts
        digest.update((b";" if i else b"") + x.text[0].as_py())
        pair, times = sums_by(np.r_[pair, x.records[0]], np.r_[times, x.records[2]])
    if not fits:
        return np.zeros((1, 4), np.int64), [""], tuple(np.zeros(0, np.int64) for _ in range(3))
    return counts, [digest.hexdigest()], (pair, np.zeros(len(pair), np.int64), times)


def runs(held: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """bucket, block, payload: records of pair, document, times, sorted by bucket (B's id modulo their
    number), pair and document, in blocks with differences of pairs. What is held is in the order of
    documents and sorted by pair, document, so a stable sort by pair is enough."""
    pair, doc, times = (np.concatenate(c) for c in zip(*held))
    bucket = (pair >> 32) % buckets
    order = np.argsort(bucket * (int(pair.max(initial=0)) + 1) + pair, kind="stable")
    pair, doc, times, bucket = pair[order], doc[order], times[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for number, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        for block, i in enumerate(range(lo, hi, BLOCK)):
            j = min(i + BLOCK, hi)
            yield number, block, pack(np.diff(pair[i:j], prepend=0), doc[i:j], times[i:j])


def read_run(blocks: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for blob in blocks:
        step, doc, times = unpack(blob)
        yield np.cumsum(step), doc, times


def merged(sources: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted streams of (pair, times) as one, with each pair once and summed. A heap holds a block of each
    stream by its last pair; what is not beyond the least of these is complete and leaves all blocks."""
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def push(k: int, rest: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        block = rest if rest is not None and len(rest[0]) else next(sources[k], None)
        if block is not None:
            heapq.heappush(heap, (int(block[0][-1]), k, *block))

    for k in range(len(sources)):
        push(k)
    carried = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    while heap:
        bound, taken = heap[0][0], [carried]
        for _, k, pair, times in [heapq.heappop(heap) for _ in range(len(heap))]:
            cut = int(np.searchsorted(pair, bound, "right"))
            taken.append((pair[:cut], times[:cut]))
            push(k, (pair[cut:], times[cut:]))
        pair, times = sums_by(*(np.concatenate(c) for c in zip(*taken)))
        last = 1 if heap else 0  # the next block of a stream may begin with the same pair
        carried = pair[len(pair) - last :], times[len(times) - last :]
        yield pair[: len(pair) - last], times[: len(times) - last]


def by_run(table: pa.Table) -> list[list[bytes]]:
    """The blocks of each run of a table (task, run, block, payload)."""
    table = table.sort_by([("task", "ascending"), ("run", "ascending"), ("block", "ascending")])
    out: dict[tuple[int, int], list[bytes]] = {}
    for task, run, blob in zip(*(table[c].to_pylist() for c in ("task", "run", "payload"))):
        out.setdefault((task, run), []).append(blob)
    return list(out.values())


def count_lot(table: pa.Table) -> pa.Table:
    """bucket, b, a, n of the runs of one bucket and lot."""
    streams = [((pair, times) for pair, _, times in read_run(blocks)) for blocks in by_run(table)]
    parts = [pa.table({"b": pa.array(pair >> 32, pa.int32()), "a": pa.array(pair & 0xFFFFFFFF, pa.int32()), "n": times}) for pair, times in merged(streams)]
    out = pa.concat_tables(parts)
    return out.add_column(0, "bucket", pa.array([table["bucket"][0].as_py()] * out.num_rows, pa.int32()))


def bucket_counts(table: pa.Table) -> pa.Table:
    """bucket, payload: the counts of a bucket's pairs in the order of B's id, with a mark at each B id's highest."""
    pair = table["b"].to_numpy().astype(np.int64) << 32 | table["a"].to_numpy().astype(np.int64)
    order = np.argsort(pair)
    pair, n = pair[order], table["n"].to_numpy()[order]
    b = pair >> 32
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(n)]))
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "counts": [pack(np.diff(pair, prepend=0), n, (n == most).astype(np.int64))]})


def give_back(left: pa.Table, right: pa.Table) -> pa.Table:
    """task, payload: by document of a task, its links in a bucket with their B id's highest count, and the
    sum of counts over its links."""
    step, n, best = unpack(right["counts"][0].as_py())
    pair = np.cumsum(step)
    out = []
    for task in sorted(set(left["task"].to_pylist())):
        mine = left.filter(pc.equal(left["task"], task))
        doc, *sums = (np.zeros(0, np.int64) for _ in range(3))
        for blocks in by_run(mine):
            for p, d, times in read_run(blocks):
                at = np.searchsorted(pair, p)
                doc, *sums = sums_by(np.r_[doc, d], np.r_[sums[0], times * best[at]], np.r_[sums[1], times * n[at]])
        out.append((task, pack(np.diff(doc, prepend=0), *sums)))
    return pa.table({"task": pa.array([t for t, _ in out], pa.int32()), "payload": pa.array([x for _, x in out], pa.binary())})


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """A task's documents with what its buckets gave back."""
    sums = np.zeros((2, (pc.max(left["number"]).as_py() or 0) + 1), np.int64)
    for blob in right["payload"].to_pylist():
        step, *values = unpack(blob)
        at = np.cumsum(step)  # each document once
        for s, v in zip(sums, values):
            s[at] += v
    number = left["number"].to_numpy()
    out = left.select(["doc_id", *COUNTS, "groups_sha256"])
    return out.append_column("n_best", pa.array(sums[0][number])).append_column("count_sum", pa.array(sums[1][number]))


def token_links(docs: DataFrame, tokenizer_a: str = "byte_bpe_50k.json", tokenizer_b: str = "piece_bpe_32k.model", buckets: int = BUCKETS, lot: int = LOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads a space and the text, B the text (it adds the space itself); special strings in a text are
    plain text. A null or empty text, or one whose tokens' bytes are not the space and the text, has
    zeros and ''. Repeated rows count each, null ids stay null, other columns are not read, an empty
    table gives an empty result. Texts are encoded whole, in units that neither tokenizer joins (tried
    on load); a long text is a chunk of its own. Counts are exact while they stay below 2^63.
    """
    paths = public_tokenizers.path(tokenizer_a), public_tokenizers.path(tokenizer_b)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, number long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, task int, bucket int, run int, block int, payload binary"

    def write_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_, task, number, run, held, types = aligner(*paths), TaskContext.get().partitionId(), 0, 0, [], None

        def written() -> pa.RecordBatch:
            blocks = list(runs(held, buckets))
            none = [pa.nulls(len(blocks), t) for t in (types, *[pa.int64()] * 5, pa.string())]
            cells = [pa.array([x] * len(blocks), pa.int32()) for x in (task, run)]
            bucket, block, payload = zip(*blocks) if blocks else ((), (), ())
            return pa.RecordBatch.from_arrays([*none, cells[0], pa.array(bucket, pa.int32()), cells[1], pa.array(block, pa.int32()), pa.array(payload, pa.binary())], names=names)

        names = ["doc_id", "number", *COUNTS, "groups_sha256", "task", "bucket", "run", "block", "payload"]
        for b in batches:
            types = b.schema.field(0).type
            for i, j, data, offsets in chunks(b.column(1), CHUNK_BYTES):
                counts, digests, (pair, doc, times) = found(with_, data, offsets)
                held.append((pair, doc + number, times))
                n, none = j - i, [pa.nulls(j - i, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(np.arange(number, number + n)), *map(pa.array, counts.T.copy()), pa.array(digests, pa.string()), pa.array([task] * n, pa.int32()), *none], names=names)
                number += n
                if sum(len(h[0]) for h in held) > RUN_RECORDS:
                    yield written()
                    held, run = [], run + 1
        if held:
            yield written()

    stored = materialise(rows.mapInArrow(write_runs, schema), "token_runs")
    of_lot = stored.where("bucket is not null").select("bucket", F.expr(f"task div {lot}").cast("int").alias("lot"), "task", "run", "block", "payload")
    counts = of_lot.groupBy("bucket", "lot").applyInArrow(count_lot, "bucket int, b int, a int, n long")
    counts = counts.groupBy("bucket", "b", "a").agg(F.sum("n").alias("n"))
    counts = materialise(counts.groupBy("bucket").applyInArrow(bucket_counts, "bucket int, counts binary"), "pair_counts")
    asked = of_lot.select(F.col("bucket").alias("of_bucket"), F.col("lot").alias("of_lot")).distinct().join(counts, F.col("of_bucket") == F.col("bucket")).drop("bucket")
    given = of_lot.groupBy("bucket", "lot").cogroup(asked.groupBy("of_bucket", "of_lot")).applyInArrow(give_back, "task int, payload binary")
    mine = stored.where("bucket is null").select("task", "doc_id", "number", *COUNTS, "groups_sha256")
    out = mine.groupBy("task").cogroup(given.groupBy("task")).applyInArrow(finish, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(documents(spark, sf_dir))
