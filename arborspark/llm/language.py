"""Operator 3: language by rank-order profiles.

A profile is the list of the most frequent character n-grams of a language, best first. A
document's own list is compared to each: every n-gram counts the places it is away from its
place in the profile, or the profile's whole length if it is missing there; the language at
the least distance wins.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from arborspark.llm.store import documents
from arborspark.llm.textops import mix

LENGTH = 300  #: n-grams of a profile
SAMPLE = 2000  #: documents of each language that its profile is counted on, about
SLICE = 1 << 20  #: characters of a text that are worked on at once
LANGUAGES = 20_000  #: profiles that may be sent to every task (about 100 MB); with more, learning fails
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: the lower-case letter's code point, 0 for all else."""
    if not _letters:
        table = np.zeros(sys.maxunicode + 1, np.uint64)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def letter_grams(c: np.ndarray) -> np.ndarray:
    """Hashes of the 1-, 2- and 3-grams around each letter of c but its first and last place; 0 is no
    letter. The end of a word counts as a letter of 2- and 3-grams."""
    at = np.flatnonzero(c[1:-1]) + 1
    one, before, after = c[at], c[at - 1], c[at + 1]
    two = np.concatenate([one << np.uint64(21) | after, one[before == 0]])
    three = before << np.uint64(42) | one << np.uint64(21) | after
    return mix(np.concatenate([one, two | np.uint64(1 << 62), three | np.uint64(1 << 63)]))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a text with their counts, in slices of SLICE characters; each slice sees the
    character before and after it, so slices may end anywhere."""
    parts = []
    for i in range(0, len(text), SLICE):
        lo, hi = max(0, i - 1), min(len(text), i + SLICE + 1)
        c = letters()[np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)]
        edges = np.zeros(1, np.uint64)
        c = np.concatenate([edges[: int(lo == i)], c, edges[: int(hi <= i + SLICE)]])
        parts.append(np.unique(letter_grams(c), return_counts=True))
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counted n-grams."""
    if len(parts) == 1:
        return parts[0]
    kinds, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)]), return_inverse=True)
    counts = np.zeros(len(kinds), np.int64)
    np.add.at(counts, at, np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))
    return kinds, counts


def ranked(kinds: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent of sorted n-grams, best first; ties go by hash."""
    return kinds[np.argsort(-counts, kind="stable")[:k]]


@dataclass
class Profiles:
    names: list[str]
    grams: np.ndarray  #: of all profiles, sorted, each once
    bounds: np.ndarray  #: of each gram's entries
    entries: np.ndarray  #: (language, its place in that profile)

    @classmethod
    def of(cls, top: list[tuple[str, int, int]]) -> "Profiles":
        """From rows (language, n-gram, place)."""
        names = sorted({lang for lang, _, _ in top})
        number = {x: i for i, x in enumerate(names)}
        every = np.array([g for _, g, _ in top], np.int64).view(np.uint64)
        order = np.argsort(every, kind="stable")
        grams = np.unique(every)
        entries = np.array([(number[lang], place) for lang, _, place in top], np.int64).reshape(-1, 2)[order]
        return cls(names, grams, np.append(np.searchsorted(every[order], grams), len(every)), entries)

    def guess(self, text: str) -> tuple[str, float]:
        """Language and 1 - distance / greatest distance."""
        own = ranked(*counted(text), LENGTH)
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == own)
        at = at[place]
        many = self.bounds[at + 1] - self.bounds[at]
        which = np.repeat(self.bounds[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        lang, there = self.entries[which].T
        # a missing n-gram is LENGTH away; one that is there is nearer by the rest
        nearer = LENGTH - np.abs(there - np.repeat(place, many))
        distance = LENGTH * len(own) - np.bincount(lang, nearer, len(self.names))
        best = int(np.argmin(distance))
        return self.names[best], float(1 - distance[best] / (LENGTH * len(own)))


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Profiles:
    """Profiles of all languages in docs.lang, counted on the whole texts of about `sample` documents
    of each, chosen by a hash of their ids among those whose crc32(doc_id) % folds is not held_out.
    Rows with a null doc_id, lang or text are left out. Ties in counts go by the n-gram's hash.
    Counts are summed in Spark, so long texts cost the driver nothing; it gets LENGTH rows a language."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    if sizes.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: their profiles are too many to be sent to every task")
    rate = F.ceil(F.lit(1_000_000) * sample / F.col("n"))
    picked = known.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate)

    def count(batches):
        for b in batches:
            parts: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts.setdefault(lang, []).append(counted(text))
            for lang, of_texts in parts.items():
                kinds, counts = merged(of_texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds)), pa.array(kinds.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    totals = picked.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < LENGTH).select("lang", "gram", "place")
    return Profiles.of([tuple(r) for r in top.collect()])


def language(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1, of the least distance).

    Texts that are null or have no letter, and all texts if nothing was learned, are `und` with
    score 0. Long texts are counted whole, slice by slice. Ties go to the first language by name. Repeated rows get equal results; a null
    doc_id stays null; an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for b in batches:
            out = [shared.value.guess(t or "") for t in b.column(1).to_pylist()]
            lang, score = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    return language(docs, learn(docs)).select("doc_id", held_out, "lang_pred", "score")
