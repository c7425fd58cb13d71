"""Operator 4: byte-exact substring deduplication by a hash-compared suffix sort.

Every WINDOW-byte string of a document belongs to one anchor, the least of the hashes of the
GRAM-byte strings inside it, so equal strings have equal anchors wherever they stand. Runs of
consecutive strings with one anchor are the unit of work:

1. each group of documents sends its distinct anchors to buckets, which answer which of them
   occur in two documents or more; most runs end here;
2. the bytes of the remaining runs, each distinct content once, go to their anchor's bucket.
   There the strings' suffixes are sorted by a mergesort whose comparisons find the common
   extension of two suffixes by binary search over prefix hashes; neighbours that agree on
   WINDOW bytes, checked byte by byte, are one string, and the least doc_id of each goes back.
   Strings of an anchor that is in very many groups go to buckets by their own hashes;
3. each group removes what a document with a smaller doc_id has as well.

Groups and buckets grow in number, not in size, and texts are shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.store import documents
from arborspark.llm.textops import BASE, chunks, mix, powers, prefix_hashes, range_hash

WINDOW = 50
GRAM = 20
GROUP_BYTES = 4 << 20
PIECE_BYTES = 1 << 19  #: of a group or bucket worked on at once
BUCKET_BYTES = 16 << 20  #: of all texts, for each bucket of anchors
SLICE = 100_000  #: suffixes sorted at once
HOT_GROUPS = 256  #: groups in which an anchor may stand before its strings are dealt out one by one
NOBODY = np.iinfo(np.int64).max


def running_min(v: np.ndarray, w: int) -> np.ndarray:
    n, s = len(v) - w + 1, 1
    if n <= 0:
        return v[:0]
    while 2 * s <= w:
        v = np.minimum(v[:-s], v[s:])
        s *= 2
    return np.minimum(v[:n], v[w - s : w - s + n])


class Runs:
    """Runs of WINDOW-byte strings of a group's documents: doc (row), start and end (first bytes of
    the first string and after the last one's first byte, within the row), back (from start to the
    anchor), mark (the anchor's hash), and two hashes of the content."""

    NAMES = ("doc", "start", "end", "back", "mark", "c0", "c1")

    def __init__(self, texts: pa.Array):
        parts = [self._of(i, data, offsets) for i, _, data, offsets in chunks(texts, PIECE_BYTES)]
        for k, name in enumerate(self.NAMES):
            setattr(self, name, np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64 if k > 3 else np.int64))

    @staticmethod
    def _of(first_row: int, data: np.ndarray, offsets: np.ndarray) -> tuple:
        n = len(data) - WINDOW + 1
        if n <= 0:
            return tuple(np.zeros(0, t) for t in (*[np.int64] * 4, *[np.uint64] * 3))
        p = prefix_hashes(data)
        at = np.arange(len(data) - GRAM + 1)
        h = mix((p[GRAM:] - p[:-GRAM]) * powers(len(p))[1][: len(at)])
        bits = np.uint64(max(1, len(data).bit_length()))
        v = running_min(h >> bits << bits | at.astype(np.uint64), WINDOW - GRAM + 1)
        row = np.searchsorted(offsets, np.arange(n), "right") - 1
        whole = np.arange(n) + WINDOW <= offsets[row + 1]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (v[1:] != v[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        stop = whole & np.append(~whole[1:] | new[1:], True)
        end = np.flatnonzero(stop) + 1
        anchor = (v[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        c0 = range_hash(p, start, end + WINDOW - 1)
        q = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(77)) * powers(len(data))[0][: len(data)], out=q[1:])
        back = anchor - start
        size = ((end - start).astype(np.uint64) << np.uint64(8) | back.astype(np.uint64)) * np.uint64(BASE)
        r = row[start]
        return r + first_row, start - offsets[r], end - offsets[r], back, h[anchor], mix(c0 ^ size), mix(range_hash(q, start, end + WINDOW - 1) + size)


def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Array]:
    """A group's documents in an order that every pass finds again; ids with null as NOBODY; texts."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    ids = table.column("doc_id").fill_null(NOBODY).to_numpy()
    texts = table.column("text")
    return table, ids, pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary())


def bucket_of(marks: np.ndarray, buckets: int) -> np.ndarray:
    return ((marks >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(marks: np.ndarray, buckets: int):
    """Bucket numbers with the places of their marks, in the order of sorted marks."""
    b = bucket_of(marks, buckets)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order], prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(b))):
        yield int(b[order[lo]]), order[lo:hi]


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.int64(len(a)).tobytes() + a.tobytes() for a in arrays))


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for t in types:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return out


MAIL = "bucket long, grp long, kind int, body binary"


def mail(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "grp", "kind", "body"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))})


def send_marks(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        _, ids, texts = ordered(table)
        r = Runs(texts)
        marks, inverse = np.unique(r.mark, return_inverse=True)
        least, most = np.full(len(marks), NOBODY), np.full(len(marks), np.iinfo(np.int64).min)
        np.minimum.at(least, inverse, ids[r.doc])
        np.maximum.at(most, inverse, ids[r.doc])
        twice = least < most
        return mail([(b, grp, 0, pack(marks[at], np.packbits(twice[at]))) for b, at in by_bucket(marks, buckets)])

    return run


def answer_marks(hot_groups: int):
    """For each letter two bits a mark: is it in two documents or more, and in more than hot_groups groups."""
    return lambda table: _answer_marks(table, hot_groups)


def _answer_marks(table: pa.Table, hot_groups: int) -> pa.Table:
    table = table.sort_by("grp")
    letters = [unpack(b, np.uint64, np.uint8) for b in table.column("body").to_pylist()]
    sizes = [len(m) for m, _ in letters]
    marks = np.concatenate([m for m, _ in letters])
    twice = np.concatenate([np.unpackbits(t)[: len(m)] for m, t in letters]).astype(bool)
    _, inverse, count = np.unique(marks, return_inverse=True, return_counts=True)
    shared = (count > 1) | (np.bincount(inverse[twice], minlength=len(count)) > 0)
    flags = np.split(shared[inverse] + 2 * (count > hot_groups)[inverse], np.cumsum(sizes)[:-1])
    return mail([(b, g, 1, np.packbits(f & 1).tobytes() + np.packbits(f >> 1).tobytes()) for b, g, f in zip(table.column("bucket").to_pylist(), table.column("grp").to_pylist(), flags)])


class Shared:
    """The runs of a group whose anchors are shared, and their distinct contents. Runs of an anchor that
    is in very many groups are cut into single strings, which go to buckets by their own hashes, so
    that no bucket gets all of a frequent anchor's contents."""

    def __init__(self, docs: pa.Table, answers: pa.Table, buckets: int):
        self.table, self.ids, self.texts = ordered(docs)
        texts = self.texts.fill_null(b"")
        self.offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        r = Runs(self.texts)
        marks, inverse = np.unique(r.mark, return_inverse=True)
        flag, hot = np.zeros(len(marks), bool), np.zeros(len(marks), bool)
        bits = {b: x for b, k, x in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "body"))) if k == 1}
        for b, at in by_bucket(marks, buckets):
            both = np.frombuffer(bits[b], np.uint8).reshape(2, -1)
            flag[at], hot[at] = (np.unpackbits(x)[: len(at)] for x in both)
        plain, cut = (np.flatnonzero(flag[inverse] & x) for x in (~hot[inverse], hot[inverse]))
        columns = [np.concatenate([getattr(r, n)[plain], x]) for n, x in zip(Runs.NAMES, self.strings(r, cut))]
        self.doc, self.start, self.end, self.back, self.route, c0, c1 = columns
        order = np.lexsort((c1, c0, self.route))
        key = np.stack([self.route, c0, c1], axis=1)[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        self.content = np.empty(len(order), np.int64)  # number of each run's content
        self.content[order] = np.cumsum(new) - 1
        self.sample = order[new]  # a run of each content
        self.least = np.full(len(self.sample), NOBODY)
        np.minimum.at(self.least, self.content, self.ids[self.doc])

    def strings(self, r: Runs, cut: np.ndarray) -> tuple[np.ndarray, ...]:
        """The strings of some runs as runs of one, each with its own hash in the anchor's place."""
        count = r.end[cut] - r.start[cut]
        doc, inner = np.repeat(r.doc[cut], count), ranges(count)
        start, back = np.repeat(r.start[cut], count) + inner, np.repeat(r.back[cut], count) - inner
        at, c = self.offsets[doc] + start, np.empty((2, len(doc)), np.uint64)
        i = 0
        while i < len(at):  # runs stand in the order of the texts
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE_BYTES)))
            data, own = self.data[at[i] : at[j - 1] + WINDOW], at[i:j] - at[i]
            c[0, i:j] = range_hash(prefix_hashes(data), own, own + WINDOW)
            c[1, i:j] = range_hash(prefix_hashes(mix_bytes(data)), own, own + WINDOW)
            i = j
        return doc, start, start + 1, back, mix(c[0] ^ np.uint64(BASE)), c[0], c[1]


def mix_bytes(data: np.ndarray) -> np.ndarray:
    """Other bytes in one-to-one correspondence, for a second hash."""
    return np.random.default_rng(4).permutation(256).astype(np.uint8)[data]


def send_contents(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return mail([])
        grp, s = docs.column("grp")[0].as_py(), Shared(docs, answers, buckets)
        out = []
        for b, k in by_bucket(s.route[s.sample], buckets):
            at = s.sample[k]
            size = s.end[at] - s.start[at] + WINDOW - 1
            begin = s.offsets[s.doc[at]] + s.start[at]
            body = s.data[np.repeat(begin, size) + ranges(size)]
            out.append((b, grp, 2, pack(body, size, s.back[at].astype(np.uint8), s.least[k])))
        return mail(out)

    return run


class Suffixes:
    """Suffixes of one byte array, compared by prefix hashes up to WINDOW bytes."""

    def __init__(self, data: np.ndarray):
        self.data, self.p = data, prefix_hashes(data)
        self.pow = powers(len(data) + 1)[0]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search."""
        same, px, py, wx, wy = np.zeros(len(x), np.int64), self.p[x], self.p[y], self.pow[x], self.pow[y]
        for step in (32, 16, 8, 4, 2, 1):
            n = same + step
            n[n > WINDOW] = WINDOW
            ok = (self.p[x + n] - px) * wy == (self.p[y + n] - py) * wx
            same = np.where(ok, n, same)
        return same

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.common(x, y)
        end = n >= WINDOW
        n[end] = WINDOW - 1
        return np.where(end, or_equal, self.data[x + n] < self.data[y + n])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes inside each group (group is ascending), all groups at once:
        an element's place in a merged block is its own place plus its rank in the other block."""
        first = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(first, len(at)))
        base, length = np.repeat(first, size), np.repeat(size, size)
        place = np.arange(len(at)) - base
        width = 1
        while width < (size.max() if len(size) else 0):
            active = np.flatnonzero(length > width)
            other = (place[active] // width) ^ 1  # the block to merge with
            lo, hi = np.minimum(other * width, length[active]), np.minimum((other + 1) * width, length[active])
            start, right = lo.copy(), other % 2 == 0  # right: the element is of the right block
            x = at[active]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                y, mine = at[base[active[open_]] + mid], x[open_]
                # left block's elements come first among equals
                less = np.where(right[open_], ~self.before(mine, y, False), self.before(y, mine, False))
                lo[open_], hi[open_] = np.where(less, mid + 1, lo[open_]), np.where(less, hi[open_], mid)
            pair = np.minimum(place[active] // width, other) * width
            target = base[active] + pair + place[active] % width + (lo - start)
            out = at.copy()
            out[target] = x
            at, width = out, 2 * width
        return at


def ranges(size: np.ndarray) -> np.ndarray:
    """0 to n-1 for each n of size, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def pieces(size: np.ndarray, limit: int):
    """Ranges of items whose sizes add up to about limit; a larger item stands alone."""
    load, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def content_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each content's anchor, and of the content with the anchor's place in it."""
    mark, whole = np.empty(len(size), np.uint64), np.empty(len(size), np.uint64)
    for i, j in pieces(size, PIECE_BYTES):
        lo, n = start[i], size[i:j]
        p, at = prefix_hashes(data[lo : start[j - 1] + size[j - 1]]), start[i:j] - lo
        mark[i:j] = range_hash(p, at + back[i:j], at + back[i:j] + GRAM)
        whole[i:j] = mix(range_hash(p, at, at + n) + n.astype(np.uint64) * np.uint64(BASE)) ^ mix(back[i:j].astype(np.uint64))
    return mark, whole


def equal_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Is data[x:x+n] the same as data[y:y+n], byte by byte? n > 0."""
    out = np.empty(len(n), bool)
    for i, j in pieces(n, PIECE_BYTES):
        step = ranges(n[i:j])
        same = data[np.repeat(x[i:j], n[i:j]) + step] == data[np.repeat(y[i:j], n[i:j]) + step]
        out[i:j] = np.logical_and.reduceat(same, np.cumsum(n[i:j]) - n[i:j])
    return out


def string_classes(data: np.ndarray, start: np.ndarray, windows: np.ndarray, back: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Numbers of the strings of some contents, content by content: equal strings of one family have
    equal numbers. The strings of a family that have their anchor at the same place are sorted as
    suffixes; neighbours of the order that share WINDOW bytes are equal."""
    size = windows + WINDOW - 1
    own = data[np.repeat(start, size) + ranges(size)]
    begin, inner = np.cumsum(size) - size, ranges(windows)
    at = np.repeat(begin, windows) + inner
    group = np.repeat(family, windows) * WINDOW + np.repeat(back, windows) - inner
    order = np.argsort(group, kind="stable")
    group, s = group[order], Suffixes(own)
    found = s.sort(at[order], group)
    x, y = found[:-1], found[1:]
    equal = (group[1:] == group[:-1]) & (s.common(x, y) >= WINDOW)
    k = np.flatnonzero(equal)
    equal[k] = equal_bytes(own, x[k], y[k], np.full(len(k), WINDOW))
    number = np.empty(len(own), np.int64)
    number[found] = np.cumsum(np.append(True, ~equal)) - 1
    return number[at]


def answer_contents(table: pa.Table) -> pa.Table:
    """For each content, runs of its strings with the least doc_id that has them."""
    table = table.sort_by("grp")
    letters = [unpack(b, np.uint8, np.int64, np.uint8, np.int64) for b in table.column("body").to_pylist()]
    many = [len(x[1]) for x in letters]
    data, size, back, least = (np.concatenate(c) for c in zip(*letters))
    back, start = back.astype(np.int64), np.cumsum(size) - size
    mark, whole = content_hashes(data, start, size, back)
    # equal contents become one; bytes decide whether they are equal
    order = np.lexsort((start, whole, mark))
    a, b = order[:-1], order[1:]
    same = (mark[a] == mark[b]) & (whole[a] == whole[b]) & (size[a] == size[b]) & (back[a] == back[b])
    k = np.flatnonzero(same)
    same[k] = equal_bytes(data, start[a[k]], start[b[k]], size[a[k]])
    new = np.append(True, ~same)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    own = order[new]  # one content of each kind, in the order of marks
    doc = np.full(len(own), NOBODY)
    np.minimum.at(doc, kind, least)

    windows = size[own] - WINDOW + 1
    begin = np.cumsum(windows) - windows
    result = np.repeat(doc, windows)
    family = np.cumsum(np.append(True, mark[own][1:] != mark[own][:-1])) - 1
    members = np.bincount(family)
    several = np.flatnonzero(members > 1)
    first = np.cumsum(members) - members
    strings = np.add.reduceat(windows, first)[several] if len(several) else several
    for i, j in pieces(strings, SLICE):
        rows = np.repeat(first[several[i:j]], members[several[i:j]]) + ranges(members[several[i:j]])
        number = string_classes(data, start[own[rows]], windows[rows], back[own[rows]], family[rows])
        slot = np.repeat(begin[rows], windows[rows]) + ranges(windows[rows])
        best = np.full(number.max() + 1, NOBODY)
        np.minimum.at(best, number, result[slot])
        result[slot] = best[number]

    out, at = [], 0
    for bucket, grp, m in zip(table.column("bucket").to_pylist(), table.column("grp").to_pylist(), many):
        k = kind[at : at + m]
        w = windows[k]
        inner = ranges(w)
        docs = result[np.repeat(begin[k], w) + inner]
        new = (inner == 0) | np.append(True, docs[1:] != docs[:-1])
        content = np.repeat(np.arange(m), w)
        out.append((bucket, grp, 3, pack(content[new].astype(np.uint32), inner[new].astype(np.uint32), docs[new])))
        at += m
    return mail(out)


def cut_out(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        s = Shared(docs, answers, buckets) if docs.num_rows else None
        rows = []
        if s:
            segments = {b: unpack(x, np.uint32, np.uint32, np.int64) for b, k, x in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "body"))) if k == 3}
            content, inner, doc = [], [], []
            for b, k in by_bucket(s.route[s.sample], buckets):
                c, i, d = segments[b]
                content.append(k[c])
                inner.append(i.astype(np.int64))
                doc.append(d)
            content, inner, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (content, inner, doc))
            order = np.lexsort((inner, content))
            content, inner, doc = content[order], inner[order], doc[order]
            lo = np.searchsorted(content, np.arange(len(s.sample)))
            count = np.diff(np.append(lo, len(content)))[s.content]
            which = np.repeat(lo[s.content], count) + ranges(count)
            run_of = np.repeat(np.arange(len(s.doc)), count)
            begin = s.start[run_of] + inner[which]
            last = np.append(run_of[1:] != run_of[:-1], True) if len(run_of) else np.zeros(0, bool)
            end = np.where(last, s.end[run_of], np.append(begin[1:], 0))
            hit = doc[which] < s.ids[s.doc[run_of]]
            row, begin, end = s.doc[run_of][hit], begin[hit], end[hit] + WINDOW - 1
            order = np.argsort(row, kind="stable")
            row, begin, end = row[order], begin[order], end[order]
            bounds = np.searchsorted(row, np.arange(docs.num_rows + 1))
            for i, (doc_id, text) in enumerate(zip(s.table.column("doc_id").to_pylist(), s.table.column("text").to_pylist())):
                text = text or b""
                a, b = bounds[i], bounds[i + 1]
                if a == b:
                    rows.append((doc_id, len(text), 0, 0, text))
                    continue
                delta = np.zeros(len(text) + 1, np.int64)
                np.add.at(delta, begin[a:b], 1)
                np.add.at(delta, end[a:b], -1)
                gone = np.cumsum(delta[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((doc_id, len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept"), cols, (*[pa.int64()] * 4, pa.binary()))})

    return run


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes left).

    Removed is each byte that lies in a WINDOW-byte string which also starts in a document with a
    smaller doc_id (an integer). Strings never cross documents and are judged on the input. A null
    or short text loses nothing; rows that share a doc_id don't remove from each other; a null
    doc_id counts as greater than all. A long text is a group of its own and worked on piece by piece. An empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 1
    groups, buckets = -(-size // group_bytes), -(-size // bucket_bytes)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))  # null and shared ids are spread as well
    by_group = rows.groupBy("grp")
    first = by_group.applyInArrow(send_marks(buckets), MAIL)
    shared = first.groupBy("bucket").applyInArrow(answer_marks(hot_groups), MAIL)
    second = by_group.cogroup(shared.groupBy("grp")).applyInArrow(send_contents(buckets), MAIL)
    least = second.groupBy("bucket").applyInArrow(answer_contents, MAIL)
    return by_group.cogroup(shared.unionByName(least).groupBy("grp")).applyInArrow(cut_out(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
