"""Operator 7: substring deduplication by sliding spans of sentences.

Every run of SPAN consecutive sentences is hashed; runs with equal hashes anywhere in the
corpus are the same passage, and the sentences of all its occurrences but the first, by
doc_id and place, are removed. A sentence ends at a mark or line break, commas included, so
that a passage put into another sentence still has whole sentences inside; one of more than
LONG words is cut further, after words that their hash picks. A run of short sentences goes on
until it has MIN_WORDS.

Marks are no guide to a passage that stands elsewhere without or with other ones. So runs of
2 * MIN_WORDS words are hashed too, wherever they begin at the word whose pair with the next has
the least hash of WINDOW in a row. Such places depend on the words around them alone and are
WINDOW words apart at most, so every 36 common words hold a common run, and long passages are
covered without a gap. Runs are compared with runs, spans of sentences with spans of sentences;
what either finds is removed.

Spans are shuffled by their hashes' first bits, in compressed blocks: of each batch one for each
bucket, in which the hashes are sorted and texts are named once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.decontaminate import NOT_WORD
from arborspark.llm.store import documents, in_batches_of, materialise
from arborspark.llm.textops import BASE, IS_WHITE, LOWER, chunks, mix, powers, prefix_hashes, range_hash, release, word_spans
from arborspark.llm.token_links import pack, unpack

SPAN = 3  #: consecutive sentences of a span
MIN_WORDS = 10  #: words of a span at least
LAST = 1 << 32  #: number of the span that ends a text
LONG = 20  #: words of a sentence at most, about; beyond, every eighth word or so and every repeat of one ends it
WINDOW = 16  #: words, of which the one of least hash begins a run
RUNS = 1 << 33  #: added to the numbers of runs
TEXT_BITS = 28  #: of a text's hash, above the number: a place is a doc_id, a text and a number
LAST_DOC = np.iinfo(np.int64).max  #: a null doc_id stands after all others
BUCKET_BYTES = 4 << 20  #: of text, about, whose spans meet in one group
BATCH_BYTES = 64 << 20  #: of text in which repeats are settled before the shuffle
HALF = np.uint64(32)
_MARK = np.zeros(256, bool)
_MARK[list(b".!?;:,|#$%&*")] = True


def run_starts(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words that begin a run: the first of each text, and the last least one of each WINDOW words of a text."""
    begins = np.zeros(len(words), bool)
    begins[first[:-1][first[:-1] < len(words)]] = True
    order = mix(words[:-1] * np.uint64(BASE) + words[1:])
    n = max(0, len(order) - WINDOW + 1)
    least, at = order[:n].copy(), np.zeros(n, np.int64)
    for s in range(1, WINDOW):
        lower = order[s : s + n] <= least
        np.copyto(least, order[s : s + n], where=lower)
        at[lower] = s
    inside = np.repeat(first[1:], np.diff(first))[:n] > np.arange(n) + WINDOW
    begins[(at + np.arange(n))[inside]] = True
    return np.flatnonzero(begins)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word, number of the first word of each text (one more at the end), number of
    the first word of each sentence (one more at the end) and the hashes of all words."""
    starts, ends, first = word_spans(data, offsets, NOT_WORD)
    words = mix(range_hash(prefix_hashes(LOWER[data]), starts, ends))
    stop = data == 10
    if len(data):
        stop[:-1] |= _MARK[data[:-1]] & IS_WHITE[data[1:]]
    seen = np.concatenate([[0], np.cumsum(stop)])
    begins = np.ones(len(starts), bool)
    begins[1:] = seen[starts[1:]] > seen[ends[:-1]]
    begins[first[:-1][first[:-1] < len(starts)]] = True
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(starts)))
    long = np.repeat(size > LONG, size)
    begins[1:] |= long[:-1] & ((words[:-1] & np.uint64(7) == 0) | (words[1:] == words[:-1]))
    return starts, first, np.append(np.flatnonzero(begins), len(starts)), words


def span_bounds(at: np.ndarray, first: np.ndarray, n: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Spans as (text, first sentence, sentence after), and where those of ends begin: from each sentence n sentences on, or as many
    as min_words take, inside its text; and for each text the shortest such span that ends it, if that is another."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    begin = np.arange(len(row))
    end = np.maximum(begin + n, np.searchsorted(at, at[:-1] + min_words, "left"))
    inside = end <= first[row + 1]
    tail = np.minimum(first[1:] - n, np.searchsorted(at, at[first[1:]] - min_words, "right") - 1)
    texts = np.flatnonzero(tail >= first[:-1])
    texts = texts[end[tail[texts]] != first[1:][texts]]
    return np.concatenate([row[inside], texts]), np.concatenate([begin[inside], tail[texts]]), np.concatenate([end[inside], first[1:][texts]]), int(inside.sum())


def run_bounds(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Runs as (text, first word, word after), and where those of ends begin; as span_bounds."""
    begin = run_starts(words, first)
    row = np.searchsorted(first, begin, "right") - 1
    inside = begin + length <= first[row + 1]
    row, begin = row[inside], begin[inside]
    texts = np.flatnonzero(np.diff(first) >= length)
    tail = first[1:][texts] - length
    other = ~np.isin(tail, begin)
    begins = np.concatenate([begin, tail[other]])
    return np.concatenate([row, texts[other]]), begins, begins + length, len(begin)


def numbered(at: np.ndarray, first: np.ndarray, words: np.ndarray, n: int, min_words: int) -> list[tuple[np.ndarray, ...]]:
    """Row, number, first word and word after of every span of sentences, and of every run. What ends a text has the number LAST."""
    of = np.searchsorted(at, first)
    row, lo, hi, last = span_bounds(at, of, n, min_words)
    number = lo - of[row]
    number[last:] = LAST
    out = [(row, number, at[lo], at[hi])]
    row, lo, hi, last = run_bounds(words, first, 2 * min_words)
    number = RUNS + lo - first[row]
    number[last:] = RUNS + LAST
    return [*out, (row, number, lo, hi)]


def spans(data: np.ndarray, offsets: np.ndarray, n: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Row, number and two hashes of every span and run."""
    _, first, at, words = sentences(data, offsets)
    out = []
    for kind, (row, number, begin, end) in enumerate(numbered(at, first, words, n, min_words)):
        hashes = []
        for seed in (2 * kind, 2 * kind + 1):
            p = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(mix(words + np.uint64(seed)) * powers(len(words))[0][: len(words)], out=p[1:])
            hashes.append(mix(range_hash(p, begin, end) + (end - begin).astype(np.uint64) * np.uint64(BASE)).view(np.int64))
        out.append((row, number, *hashes))
    return tuple(np.concatenate(x) for x in zip(*out))


def repeats(doc: np.ndarray, number: np.ndarray, h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Of spans sorted by hashes and place: is it another place than the first with these hashes?"""
    new = np.ones(len(doc), bool)
    new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(doc) else np.zeros(0, np.int64)
    return (doc != doc[lead]) | (number != number[lead])


def packed(bits: int, doc: np.ndarray, own: np.ndarray, row: np.ndarray, number: np.ndarray, h0: np.ndarray, h1: np.ndarray, later: np.ndarray) -> tuple[list, list, list]:
    """Spans as blocks: buckets (of the first bits of h0), spans, texts. doc and own are of the texts, row is a span's text."""
    order = np.argsort(h0, kind="stable")
    row, number, h0, h1, later = row[order], number[order], h0[order], h1[order].view(np.uint64), later[order]
    shift = np.uint64(64 - bits)
    bucket = h0 >> shift
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    spans_, texts = [], []
    for i, j in zip(starts, np.append(starts[1:], len(h0))):
        gap = np.diff(h0[i:j], prepend=bucket[i] << shift)
        which, at = np.unique(row[i:j], return_inverse=True)
        low, high = (x & np.uint64(0xFFFFFFFF) for x in (gap, h1[i:j])), (x >> HALF for x in (gap, h1[i:j]))
        spans_.append(pack(*low, *high, at, number[i:j] & 0xFFFFFFFF, number[i:j] >> 32 << 1 | later[i:j]))
        texts.append(pack(np.diff(doc[which].view(np.uint64), prepend=np.uint64(0)), own[which]))
    return bucket[starts].tolist(), spans_, texts


def unpacked(bits: int, bucket: int, spans_: bytes, texts: bytes) -> tuple[np.ndarray, ...]:
    """Of a block's spans: doc, own, number, h0, h1, later."""
    gap, low, gap_high, high, at, number, kind = unpack(spans_)
    gap_, own = unpack(texts)
    doc = np.cumsum(gap_.view(np.uint64)).view(np.int64)
    h0 = np.cumsum((gap | gap_high << 32).view(np.uint64)) + (np.uint64(bucket) << np.uint64(64 - bits))
    return doc[at], own[at], number | kind >> 1 << 32, h0, low | high << 32, (kind & 1).astype(bool)


def bucket_bits(rows: DataFrame) -> int:
    """Buckets take about BUCKET_BYTES of text, and are some times as many as the session's partitions of a shuffle."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES).bit_length()


def substring_dedup(docs: DataFrame, n: int = SPAN, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_sentences, n_removed (sentences that are removed whole), n_bytes, n_bytes_removed, kept (the text left).

    Words are compared without marks and with A-Z lowered; hashes have 99 bits. A repeat inside
    one document counts as well. The first place is that of the least doc_id, null being the
    greatest; of different texts under one doc_id each is a document of its own, in the order of
    their hashes; rows that repeat doc_id and text are one place, so they don't remove each other
    and lose the same. Null and empty texts, and texts of fewer than min_words words, keep all they
    have (kept is empty for null). A long text is worked on alone, whole. doc_id is an integer. An
    empty table gives an empty one; other columns are not read.

    What a batch of documents repeats itself is settled there, so a passage in a third of all rows
    is shuffled once a batch, not once a row.
    """
    own = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << TEXT_BITS))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST_DOC))).alias("doc"), own.alias("own"))

    def emit(batches):
        for b in batches:
            parts = [(*spans(data, offsets, n, min_words), i) for i, _, data, offsets in chunks(b.column(0))]
            row, number, h0, h1 = (np.concatenate([p[k] + p[4] if k == 0 else p[k] for p in parts]) for k in range(4))
            docs_, owns = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            place, h0 = number | owns[row] * (2 * RUNS), h0.view(np.uint64)
            order = np.lexsort((place, docs_[row], h1 := (h1.view(np.uint64) >> np.uint64(29)).view(np.int64), h0))
            row, number, h0, h1 = row[order], number[order], h0[order], h1[order]
            later = repeats(docs_[row], place[order], h0, h1)
            # a settled span needs no partner: it stands in a bucket of its text
            h0, h1 = np.where(later, mix(docs_[row].view(np.uint64)), h0), np.where(later, 0, h1)
            bucket, spans_, texts = packed(bits, docs_, owns, row, number, h0, h1, later)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(spans_, pa.binary()), pa.array(texts, pa.binary())], names=["bucket", "spans", "texts"])
        release()

    def meet(t: pa.Table) -> pa.Table:
        blocks = [unpacked(bits, *x) for x in zip(*(t.column(c).to_pylist() for c in ("bucket", "spans", "texts")))]
        doc, own, number, h0, h1, settled = (np.concatenate(x) for x in zip(*blocks))
        place = number | own * (2 * RUNS)
        order = np.lexsort((place, doc, h1, h0))
        order = order[~settled[order]]
        gone = np.concatenate([np.flatnonzero(settled), order[repeats(doc[order], place[order], h0[order], h1[order])]])
        return pa.table({"doc": doc[gone], "own": own[gone], "number": number[gone]})

    bits = bucket_bits(rows)
    blocks = rows.select("text", "doc", "own").mapInArrow(emit, "bucket long, spans binary, texts binary")
    later = blocks.groupBy("bucket").applyInArrow(meet, "doc long, own long, number long")
    gone = materialise(later.groupBy("doc", "own").agg(F.collect_set("number").alias("gone")), "gone")

    def cut(batches):
        for b in batches:
            out = []
            for i, j, data, offsets in chunks(b.column(1)):
                starts, first, at, words = sentences(data, offsets)
                texts_, number, begin, end = (np.concatenate(x) for x in zip(*numbered(at, first, words, n, min_words)))
                key = texts_ * (2 * RUNS) + number
                order = np.argsort(key)
                gone = b.column(2)[i:j]
                row = np.repeat(np.arange(j - i), pc.list_value_length(gone).fill_null(0).to_numpy(zero_copy_only=False))
                want = row * (2 * RUNS) + gone.flatten().to_numpy(zero_copy_only=False)
                which = order[np.minimum(np.searchsorted(key, want, sorter=order), len(order) - 1)] if len(order) else order
                which = which[key[which] == want] if len(order) else order
                depth = np.bincount(begin[which], minlength=len(starts) + 1) - np.bincount(end[which], minlength=len(starts) + 1)
                drop = np.cumsum(depth)[:-1] > 0
                of = np.searchsorted(at, first)
                left = np.concatenate([[0], np.cumsum(~drop)])
                whole = np.concatenate([[0], np.cumsum(left[at[1:]] == left[at[:-1]])])
                # a word goes with what follows it, up to the next word or the end of its text
                ends = np.append(starts[1:], len(data))[: len(starts)]
                ends[first[1:][np.diff(first) > 0] - 1] = offsets[1:][np.diff(first) > 0]
                edge = np.bincount(starts[drop], minlength=len(data) + 1) - np.bincount(ends[drop], minlength=len(data) + 1)
                keep = np.cumsum(edge)[:-1] == 0
                for r in range(j - i):
                    lo, hi = offsets[r], offsets[r + 1]
                    kept = data[lo:hi][keep[lo:hi]]
                    out.append((int(of[r + 1] - of[r]), int(whole[of[r + 1]] - whole[of[r]]), int(hi - lo), int(hi - lo) - len(kept), kept.tobytes().decode("utf-8", "replace")))
            cols = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 4, pa.string()]))], names=["doc_id", "n_sentences", "n_removed", "n_bytes", "n_bytes_removed", "kept"])

    both = rows.join(gone, ["doc", "own"], "left").select("doc_id", "text", "gone")
    return both.mapInArrow(cut, f"doc_id long, n_sentences long, n_removed long, n_bytes long, n_bytes_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_batches_of(spark, BATCH_BYTES)
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_sentences", "n_removed", "n_bytes", "n_bytes_removed", F.sha2("kept", 256).alias("kept_sha256"))
