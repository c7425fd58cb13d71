"""Operator 6: benchmark decontamination by CGK embedding and bit-sampling LSH.

A CGK walk over a word sequence writes the word it stands on at each step and moves on when a
random bit of that word and step says so; sequences a few edits apart fall into step again, so
their embeddings are close in Hamming distance. Items are embedded whole, and also without as many
first words as may be missing; documents in windows of the items' sizes that begin at every word. A table samples a few steps of one walk; item and
window are a candidate when the sampled words agree. For each class of lengths there are as many
tables, of several walks, as it takes to find TARGET of random copies with the most edits
allowed. Only windows that hold enough words of items are embedded, which loses nothing.
Candidates are confirmed by the exact edit distance of the whole item, in words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arborspark.llm.store import documents, materialise
from arborspark.llm.textops import BASE as HASH_BASE
from arborspark.llm.textops import chunks, mix, release, word_hashes, word_spans

TARGET = 0.99  #: share of copies with the most edits allowed that the tables of a class find, at least
COPIES, COPIED_WORDS = 1000, 1_000_000  #: random copies on which that is measured, fewer for long items
TABLES = 5  #: of one walk
WALKS = 31  #: two bits of a word's hash for each; if their tables do not reach the target, building fails
GROWTH = 1.4  #: lengths of a class, longest by shortest
REACH = 0.65  #: rounds that are sampled, for each word of an item; a walk takes 0.7 rounds a word on average
SOME = 2_000_000  #: words of candidates that are counted at once
LONG = 1000  #: words of items whose candidates are counted by prefix sums
BLOCK_BYTES = 16 << 20  #: items are brought to the driver in parts of this much text
TABLE_BYTES = 128 << 20  #: items are held against all documents in blocks whose tables take about this much

BASE = np.uint64(HASH_BASE)

#: What separates words: every ASCII byte but letters and digits.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def most_edits(n: int, percent: int) -> int:
    """Edits within which a run of words is a copy of an item of n words."""
    return n * (100 - percent) // 100


def length_class(n: int) -> tuple[int, int]:
    """Shortest and longest item of the class that items of n words are in."""
    lo, hi = 1, 1
    while hi < n:
        lo = hi + 1
        hi = int(lo * GROWTH) if lo > 3 else lo
    return lo, hi


def sampled_rounds(lo: int, number: int) -> tuple[int, ...]:
    """The rounds that a class's table of this number samples: two, or the first for up to three words; for longer
    items also the one after the first, which mostly agrees if that one does and tells many windows apart."""
    rng, most = np.random.default_rng((6, lo, number)), lo if lo < 10 else int(REACH * lo)
    if lo < 4:
        return (0,)
    rounds = set(rng.choice(most, 2, replace=False).tolist())
    return tuple(sorted(rounds | {min(rounds) + 1} if lo >= 10 else rounds))


class Walk:
    """Walks from every word of a sequence. The bits of a step depend on the word and on whether the step
    is odd or even; a round is two steps, of which at least one moves on if the word stays the same.
    Places after 1, 2, 4, ... rounds make any round a few look-ups away."""

    def __init__(self, hashes: np.ndarray, walk: int):
        bits = (hashes >> np.uint64(2 * walk)).astype(np.int8) & 3
        bits[bits == 0] = 3
        bits = np.append(bits, np.int8(0))  # a walk stays behind the last word
        place = np.arange(len(bits), dtype=np.int32)
        after = place + (bits & 1)
        self.jumps = [after + (bits >> 1)[after]]

    def go(self, at: np.ndarray, rounds: int) -> np.ndarray:
        for level in range(rounds.bit_length()):
            if len(self.jumps) <= level:
                self.jumps.append(self.jumps[-1][self.jumps[-1]])
            if rounds >> level & 1:
                at = self.jumps[level][at]
        return at


@dataclass
class Table:
    walk: int
    rounds: tuple[int, ...]
    first: np.ndarray  #: by word of the class: is it the first sampled word of an item
    keys: np.ndarray  #: sorted: hashes of the sampled words of the items
    entries: np.ndarray  #: of each key: item, and the word of it at which the walk begins
    marks: np.ndarray  #: by the first bits of a mixed key: is there such a key; most windows end here


@dataclass
class Class:
    lo: int
    hi: int
    own: np.ndarray  #: by word of the block: its number among the words of the class, from 1; 0 if it is not one
    tables: list[Table]


def make_table(lo: int, number: int, members: np.ndarray, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, percent: int, base: int) -> Table:
    """A table of the items `members`, whose words (numbers below base) stand from starts to ends. An item's walks begin at each
    word that may be the first one left of it; they are in the table if the sampled rounds lie inside the item."""
    rounds, walk = sampled_rounds(lo, number), Walk(hashes, number // TABLES)
    many = most_edits(ends - starts, percent) + 1
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin, end, item = np.repeat(starts, many) + offset, np.repeat(ends, many), np.repeat(members, many)
    ids, key = np.append(ids, 0), np.zeros(len(begin), np.uint64)
    for r in rounds:
        at = walk.go(begin, r)
        key = key * BASE + ids[at].astype(np.uint64)
        first = ids[at] if r == rounds[0] else first
    inside = at < end
    order = np.flatnonzero(inside)[np.argsort(key[inside], kind="stable")]
    flags = np.zeros(base, bool)
    flags[first[inside]] = True
    marks = np.zeros(1 << (len(order).bit_length() + 4), bool)
    marks[leading(key[order], marks)] = True
    return Table(number // TABLES, rounds, flags, key[order], np.stack([item[order], offset[order]], axis=1).astype(np.int32), marks)


def leading(key: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return (key * BASE) >> np.uint64(64 - (len(marks).bit_length() - 1))


def look_up(table: Table, walk: Walk, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries, and starts of the windows that agree with them in all sampled words, or, once in 2**64, in their
    hash alone: the edit distance decides. ids: numbers among the words of the class, one more at the end."""
    at = walk.go(starts, table.rounds[0])
    hit = np.flatnonzero(table.first[ids[at]])
    at, starts = at[hit], starts[hit]
    key = ids[at].astype(np.uint64)
    for r, s in zip(table.rounds, table.rounds[1:]):
        at = walk.go(at, s - r)
        key = key * BASE + ids[at].astype(np.uint64)
    hit = np.flatnonzero(table.marks[leading(key, table.marks)])
    key, starts = key[hit], starts[hit]
    lo = np.searchsorted(table.keys, key)
    hit = np.flatnonzero(table.keys[np.minimum(lo, len(table.keys) - 1)] == key) if len(table.keys) else lo[:0]
    lo, many = lo[hit], np.searchsorted(table.keys, key[hit], "right") - lo[hit]
    which = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
    return table.entries[which], np.repeat(starts[hit], many)


@cache
def tables_needed(lo: int, size: int, percent: int) -> int:
    """How many tables of the class from lo find TARGET of random copies of items of some size with the
    most edits, which may begin or end their document."""
    k, rng, kinds = most_edits(size, percent), np.random.default_rng((7, lo)), 1 << 20
    n = min(COPIES, max(20, COPIED_WORDS // size))
    if k == 0:
        return 1
    words, texts = rng.integers(1, kinds, (n, size)), []
    for w in words:
        change = np.full(size, 3)  # of a word: 0 another before it, 1 another in its place, 2 gone
        change[rng.choice(size, k, replace=False)] = rng.integers(0, 3, k)
        copy = np.repeat(w, np.array([2, 1, 0, 1])[change])
        begin = (np.cumsum(np.array([2, 1, 0, 1])[change]) - np.array([2, 1, 0, 1])[change])[change < 2]
        copy[begin] = rng.integers(1, kinds, len(begin))
        around = [rng.integers(1, kinds, 6 * rng.integers(0, 2)) for _ in range(2)]
        texts.append(np.concatenate([around[0], copy, around[1]]))
    text, row, found = np.concatenate(texts), np.repeat(np.arange(n), [len(t) for t in texts]), np.zeros(n, bool)
    hashes, ids, starts = mix(text), np.append(text, 0), np.arange(len(text), dtype=np.int32)
    begin = np.arange(n) * size
    for number in range(WALKS * TABLES):
        table = make_table(lo, number, np.arange(n), words.ravel(), mix(words.ravel()), begin, begin + size, percent, kinds)
        entries, window = look_up(table, Walk(hashes, table.walk), ids, starts)
        item = entries[:, 0]
        found[item[row[window] == item]] = True
        if found.mean() >= TARGET:
            return number + 1
    raise ValueError(f"{WALKS} walks find {found.mean():.3f} of items of {size} words at {percent} percent")


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]  #: numbers of the words of each item, from 1; 0 is any other word
    vocabulary: np.ndarray
    classes: list[Class]
    bags: np.ndarray  #: sorted: item times the base, plus each of its words
    percent: int

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1

    def edits(self, item: int) -> int:
        return most_edits(len(self.words[item]), self.percent)


def build(items: list[tuple[object, str | None]], percent: int) -> Items:
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    texts = pa.array([t or "" for _, t in items], pa.large_string())
    hashes: list[np.ndarray] = []
    for i, j, data, offsets in chunks(texts):
        h, first = word_hashes(data, offsets, NOT_WORD)
        hashes += [h[a:b] for a, b in zip(first[:-1], first[1:])]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    words = [np.searchsorted(vocabulary, h).astype(np.int64) + 1 for h in hashes]
    base, members, classes = len(vocabulary) + 1, {}, []
    for i, w in enumerate(words):
        if len(w):
            members.setdefault(length_class(len(w)), []).append(i)
    for (lo, hi), m in sorted(members.items()):
        ends = np.cumsum([len(words[i]) for i in m])
        starts = ends - [len(words[i]) for i in m]
        ids, h = np.concatenate([words[i] for i in m]), np.concatenate([hashes[i] for i in m])
        kinds, ids = np.unique(ids, return_inverse=True)
        own, ids = np.zeros(base, np.int32), ids + 1
        own[kinds] = np.arange(1, len(kinds) + 1)
        tables, missing, needed = [], set(m), max(tables_needed(lo, size, percent) for size in {lo, hi})
        # beyond the target, every item stands in a table, so that its exact copies are always found
        while len(tables) < needed or missing:
            tables.append(make_table(lo, len(tables), np.array(m), ids, h, starts, ends, percent, len(kinds) + 1))
            missing -= set(tables[-1].entries[:, 0].tolist())
        classes.append(Class(lo, hi, own, tables))
    bags = np.unique(np.concatenate([np.zeros(0, np.int64), *(i * base + w for i, w in enumerate(words))]))
    return Items([i for i, _ in items], words, vocabulary, classes, bags, percent)


def candidates(items: Items, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start of the window, its place in the item) for a chunk's words, each once."""
    known, n = np.concatenate([[0], np.cumsum(ids > 0)]).astype(np.int32), len(ids)
    at, ids = np.arange(n, dtype=np.int32), np.append(ids, 0).astype(np.int32)
    starts = []
    for c in items.classes:
        k = most_edits(c.hi, items.percent)
        starts.append(np.flatnonzero(known[np.minimum(at + (c.hi + 3 * k + 1), n)] - known[np.maximum(at - k, 0)] >= c.lo - most_edits(c.lo, items.percent)).astype(np.int32))
    owns = [c.own[ids] for c in items.classes]
    found, windows = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    for w in range(1 + max(c.tables[-1].walk for c in items.classes)):
        walk = Walk(hashes, w)
        for c, s, own in zip(items.classes, starts, owns):
            for t in c.tables:
                if t.walk == w and len(s):
                    entries, window = look_up(t, walk, own, s)
                    found.append(entries)
                    windows.append(window)
    entries, most = np.concatenate(found), np.int64(1 + max(most_edits(c.hi, items.percent) for c in items.classes))
    each = np.unique((entries[:, 0].astype(np.int64) * n + np.concatenate(windows)) * most + entries[:, 1])
    return each // most // n, each // most % n, each % most


def enough_words(items: Items, ids: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each candidate region lo to hi: does it hold as many words of the item as are needed? Regions of
    long items are counted by prefix sums, those of short ones word by word, some at a time."""
    out, length = np.zeros(len(item), bool), np.array([len(w) for w in items.words])[item]
    for one in np.unique(item[length > LONG]):
        at = np.flatnonzero(item == one)
        inside = np.r_[0, np.cumsum(np.isin(ids, items.words[one]) & (ids > 0))]
        out[at] = inside[hi[at]] - inside[lo[at]] >= need[at]
    short = np.flatnonzero(length <= LONG)
    size = hi[short] - lo[short]
    parts = np.searchsorted(np.cumsum(size), np.arange(SOME, size.sum(), SOME)) if len(short) else []
    for at in np.split(short, np.unique(parts)) if len(short) else []:
        size = hi[at] - lo[at]
        each = np.repeat(np.arange(len(at)), size)
        word = ids[np.repeat(lo[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        key = item[at][each] * items.base + word
        found = items.bags[np.minimum(np.searchsorted(items.bags, key), len(items.bags) - 1)] == key
        out[at] = np.bincount(each[found], minlength=len(at)) >= need[at]
    return out


def best_edits(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance, in words, between the item and any run of words of text (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    m, full = len(item), (1 << len(item)) - 1
    up, down, score = full, 0, len(item)
    best = score
    for w in text.tolist():
        eq = masks.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | ~(diag | up) & full, up & diag
        if rise >> (m - 1) & 1:
            score += 1
        elif fall >> (m - 1) & 1:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(diag | rise) & full, rise & diag
        best = min(best, score)
    return best


def in_chunk(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, item, edits) of the chunk's texts."""
    hashes, first = word_hashes(data, offsets, NOT_WORD)
    if not len(hashes) or not items.classes:
        return []
    ids = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    ids = np.where(items.vocabulary[ids] == hashes, ids + 1, 0)
    item, window, offset = candidates(items, hashes, ids)
    if not len(item):
        return []
    # the window begins in its text, also where the item's first words, and so its place, would not
    rows = np.searchsorted(first, window, "right") - 1
    length = np.array([len(w) for w in items.words])[item]
    k = np.array([items.edits(i) for i in range(len(items.words))])[item]
    place = window - offset
    lo, hi = np.maximum(place - k, first[rows]), np.minimum(place + length + 3 * k + 1, first[rows + 1])
    order = np.flatnonzero(enough_words(items, ids, item, lo, hi, length - k))
    order = order[np.lexsort((lo[order], rows[order], item[order]))]
    out: dict[tuple[int, int], int] = {}
    i = 0
    while i < len(order):
        # overlapping regions of one item and text are read as one
        c = order[i]
        pair, a, b = (int(rows[c]), int(item[c])), int(lo[c]), int(hi[c])
        i += 1
        while i < len(order) and (rows[order[i]], item[order[i]]) == pair and lo[order[i]] <= b:
            b = max(b, int(hi[order[i]]))
            i += 1
        if out.get(pair) != 0 and (d := best_edits(items.words[pair[1]], ids[a:b])) <= items.edits(pair[1]):
            out[pair] = min(d, out.get(pair, d))
    return [(r, it, d) for (r, it), d in out.items()]


def table_bytes(words: int, percent: int) -> int:
    """About what an item takes in the tables of its class."""
    lo, hi = length_class(max(1, words))
    return max(tables_needed(lo, size, percent) for size in {lo, hi}) * (most_edits(words, percent) + 1) * 16 + 100 * words


def in_blocks(rows: list[tuple[object, str | None]], percent: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in lots whose tables take about TABLE_BYTES, however many different words they have."""
    lot, size = [], 0
    for item_id, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        n = table_bytes(len(word_spans(data, np.array([0, len(data)]), NOT_WORD)[0]), percent)
        if lot and size + n > TABLE_BYTES:
            yield lot
            lot, size = [], 0
        lot.append((item_id, text))
        size += n
    yield lot


def item_blocks(benchmark: DataFrame, percent: int, item_id: str, item_text: str) -> Iterator[Broadcast]:
    """The benchmark's items, ready to be looked up, in blocks of bounded tables that are sent to every task."""
    right = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text"))
    size = right.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0
    parts = max(1, -(-size // BLOCK_BYTES))
    for part in range(parts):
        rows = right.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts)) == part).collect()
        for lot in in_blocks([(r[0], r[1]) for r in rows], percent):
            yield benchmark.sparkSession.sparkContext.broadcast(build(lot, percent))


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document and item that it holds: doc_id, item_id, edits, n_words (of the item), similarity.

    Words are runs of ASCII letters, digits and any other than ASCII characters, A-Z lowered.
    A document holds an item of n words when a run of its words is at most
    n * (100 - percent) // 100 edits away; of several such runs found the one of fewest edits counts.
    Copies with the most edits are found at the rate TARGET at least, exact copies always. Null
    and empty texts, and items without a word, match nothing. Any length of text or item works: a
    long text is read alone, whole. Of repeated rows each is reported; null ids stay null; an empty
    table on either side gives an empty one; other columns are not read.
    """
    left = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = [left.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()]
    out, item_type = None, to_arrow_type(benchmark.schema[item_id].dataType)
    for block in item_blocks(benchmark, percent, item_id, item_text):

        def run(batches, shared=block):
            items = shared.value
            for b in batches:
                rows = [(i + r, it, d) for i, _, data, offsets in chunks(b.column(1)) for r, it, d in in_chunk(items, data, offsets)]
                n = [len(items.words[it]) for _, it, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([r for r, _, _ in rows], pa.int64())),
                        pa.array([items.ids[it] for _, it, _ in rows], item_type),
                        pa.array([d for _, _, d in rows], pa.int64()),
                        pa.array(n, pa.int64()),
                    ],
                    names=["doc_id", "item_id", "edits", "n_words"],
                )

        found = left.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("similarity", F.round(1 - F.col("edits") / F.col("n_words"), 6))


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = 75, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with their columns as they are. Every row
    is judged by its own text where it stands, so null and shared ids make no difference and no
    text is shuffled. Null and empty texts stay."""
    place, out = docs.columns.index(text), docs
    for number, block in enumerate(item_blocks(benchmark, percent, item_id, item_text)):
        if number:  # one block's worker a task, not a chain of them
            out = materialise(out, "clean")

        def run(batches, shared=block):
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for i, _, data, offsets in chunks(b.column(place)):
                    clean[[i + r for r, _, _ in in_chunk(shared.value, data, offsets)]] = False
                yield b.filter(pa.array(clean))
            release()

        out = out.mapInArrow(run, docs.schema)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
