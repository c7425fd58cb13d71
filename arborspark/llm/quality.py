"""Operator 2: document quality from a linear-chain conditional random field over lines.

Each line is good or bad; its evidence is its own features and those of the lines before and
after. Weights are fitted on a bounded sample of labelled documents whose lines take the
document's label. A document's quality is the mean probability that a line is good, by
forward-backward marginals weighted by line length, calibrated by a logistic curve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.store import documents
from arborspark.llm.textops import BASE, LOWER, chunks, mix, prefix_hashes, range_hash, release, word_spans

SAMPLE = 3000  #: labelled documents that the weights are fitted on at most
SAMPLE_BYTES, SAMPLE_LINES = 1 << 16, 512  #: texts of more bytes or lines are not among them, so the sample takes 170 MB at most
STEPS = 200

#: Kinds of bytes whose shares are features.
KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), b".,;:'\"-()?", b"!", b"#$%&*@^~=+_", b"|<>[]{}\\/", range(128, 256)), 1):
    KIND[list(_bytes)] = _kind
KINDS = 10
WIDTH = 2 * KINDS + 7  #: features of one line


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and length of each line of a chunk, and the number of the first line of each text.
    An empty text is one empty line."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, breaks, "right") - 1
    inner = breaks + 1 < offsets[of + 1]
    starts = np.concatenate([offsets[:-1], breaks[inner] + 1])
    text = np.concatenate([np.arange(n), of[inner]])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    first = np.searchsorted(text, np.arange(n + 1))
    ends = np.append(starts[1:], offsets[-1])
    last = first[1:] - 1
    ends[last] = offsets[1:]
    length = ends - starts
    line = np.repeat(np.arange(len(starts)), length)
    counts = np.bincount(line * KINDS + KIND[data], minlength=len(starts) * KINDS).reshape(-1, KINDS)
    share = counts / np.maximum(length, 1)[:, None]
    words = counts[:, 4] + 1
    hashes = mix(range_hash(prefix_hashes(data), starts, ends) ^ text.astype(np.uint64))
    _, place = np.unique(hashes, return_index=True)
    again = np.ones(len(starts))
    again[place] = 0
    begin, end, _ = word_spans(data, offsets)
    word = mix(range_hash(prefix_hashes(LOWER[data]), begin, end))
    word_line = np.searchsorted(starts, begin, "right") - 1
    n_words = np.bincount(word_line, minlength=len(starts))
    near = np.zeros(len(word), bool)
    for back in (1, 2, 3):
        near[back:] |= (word[back:] == word[:-back]) & (word_line[back:] == word_line[:-back])
    near = np.bincount(word_line, near, len(starts)) / np.maximum(n_words, 1)
    _, place = np.unique(word + word_line.astype(np.uint64) * np.uint64(BASE), return_index=True)
    distinct = np.bincount(word_line[place], minlength=len(starts)) / np.maximum(n_words, 1)
    plain = np.stack([np.log1p(length) / 8, np.minimum(length / words / 12, 3), again, near, np.minimum(3 * near, 1), 1 - distinct, np.ones(len(starts))], axis=1)
    return np.concatenate([share, np.minimum(share * 20, 1), plain], axis=1), length, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after in the same text (zeros at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def marginals(scores: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once. scores: of states bad, good for each line; move:
    of each pair of states. Gives P(state) for each line, the expected pairs and the log partition sum."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # chains longer than t
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    for t, k in enumerate(active):
        at = start[:k] + t
        if t == 0:
            alpha[at] = scores[at]
        else:
            alpha[at] = np.logaddexp(alpha[at - 1, :1] + move[0], alpha[at - 1, 1:] + move[1]) + scores[at]
    for t in range(len(active) - 1, 0, -1):
        at = start[: active[t]] + t
        out = beta[at] + scores[at]
        beta[at - 1] = np.logaddexp(move[:, 0] + out[:, :1], move[:, 1] + out[:, 1:])
    ends = first[1:] - 1
    total = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z = np.repeat(total, np.diff(first))
    p = np.exp(alpha + beta - z[:, None])
    inner = np.setdiff1d(np.arange(len(scores)), first[:-1])
    pair = alpha[inner - 1][:, :, None] + move + (scores[inner] + beta[inner])[:, None, :] - z[inner, None, None]
    return p, np.exp(pair).sum(axis=0), float(total.sum())


@dataclass
class Model:
    weights: np.ndarray  #: features to the score of good minus bad
    move: np.ndarray  #: state to state
    slope: float
    bias: float

    def line_goodness(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        s = with_neighbours(x, first) @ self.weights
        return marginals(np.stack([-s, s], axis=1) / 2, self.move, first)[0][:, 1]

    def raw(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean probability that a line is good."""
        w = np.maximum(length, 1)
        good = np.add.reduceat(self.line_goodness(x, first) * w, first[:-1]) / np.add.reduceat(w, first[:-1])
        good = np.clip(good, 1e-4, 1 - 1e-4)
        return np.log(good / (1 - good))

    def scores(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x, length, first) + self.bias)))


def fit(x: np.ndarray, length: np.ndarray, first: np.ndarray, good: np.ndarray) -> Model:
    """Maximum likelihood with a small ridge, by Adam; good: label of each document. Documents of
    the rarer label count for more, up to equal shares."""
    n, model = len(good), Model(np.zeros(3 * x.shape[1] if x.ndim == 2 else 3 * WIDTH), np.zeros((2, 2)), 1.0, 0.0)
    if n == 0 or good.min() == good.max():
        share = (good.sum() + 1) / (n + 2)
        return Model(model.weights, model.move, 0.0, float(np.log(share / (1 - share))))
    full = with_neighbours(x, first)
    label = np.repeat(good, np.diff(first))
    inner = np.setdiff1d(np.arange(len(x)), first[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    theta = np.zeros(full.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        s, move = full @ theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs, _ = marginals(np.stack([-s, s], axis=1) / 2, move, first)
        grad = np.concatenate([full.T @ (label - p[:, 1]), (seen - pairs).ravel()]) / len(x) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    r = np.clip(model.raw(x, length, first), -8, 8)
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton's method with a ridge on the calibration curve
        p = 1 / (1 + np.exp(-(a * r + b)))
        w, e = p * (1 - p) + 1e-9, good - p
        g = np.array([e @ r - 0.1 * (a - 1), e.sum() - 0.1 * b])
        h = np.array([[w @ r**2 + 0.1, w @ r], [w @ r, w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
    model.slope, model.bias = float(max(a, 0.05)), float(b)
    return model


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents, by a hash of their ids, leaving out those whose
    crc32(doc_id) % folds is 0. Of conflicting labels the greatest counts; rows that share a doc_id
    are all examples of its label; null labels and ids are left out."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    # the sample's table is bounded by `sample`, so it may be broadcast
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    body = F.coalesce(F.col("text"), F.lit(""))
    breaks = F.octet_length(body) - F.octet_length(F.translate(body, "\n", ""))
    rows = docs.select("doc_id", "text").where((F.octet_length(body) <= SAMPLE_BYTES) & (breaks < SAMPLE_LINES)).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")

    def run(batches):
        for b in batches:
            out = []
            for _, _, data, offsets in chunks(b.column(1)):
                x, length, first = line_features(data, offsets)
                out += [(x[i:j].astype(np.float32).tobytes(), length[i:j].tobytes()) for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2).cast(pa.int64()), *(pa.array(c, pa.binary()) for c in (zip(*out) if out else ((), ())))], names=["doc_id", "quality", "x", "length"])

    got = sorted(rows.mapInArrow(run, "doc_id string, quality long, x binary, length binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    x = np.concatenate([np.zeros((0, WIDTH)), *(np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got)])
    length = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["length"], np.int64) for r in got)])
    first = np.concatenate([[0], np.cumsum([len(r["length"]) // 8 for r in got])]).astype(np.int64)
    return fit(x, length, first, np.array([int(r["quality"] == 1) for r in got], np.int64))


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher: better), predicted (1 if score >= threshold), n_lines.

    Null and empty texts are one empty line and get a score; a long text is scored alone, whole;
    repeated rows get equal scores; a null doc_id stays null; an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            score, lines = [], []
            for _, _, data, offsets in chunks(b.column(1)):
                x, length, first = line_features(data, offsets)
                score.append(model.scores(x, length, first))
                lines.append(np.diff(first))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *score])), pa.array(np.concatenate([np.zeros(0, np.int64), *lines]))], names=["doc_id", "score", "n_lines"])

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_lines long")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def line_labels(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per line: doc_id, line (from 0), p_good."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            for i, _, data, offsets in chunks(b.column(1)):
                x, _, first = line_features(data, offsets)
                count = np.diff(first)
                row = np.repeat(np.arange(len(count)), count)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + i)), pa.array(np.arange(len(row)) - first[row]), pa.array(model.line_goodness(x, first))], names=["doc_id", "line", "p_good"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line long, p_good double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier does not reject; scored row by row, nothing is joined, so
    null and shared ids make no difference. Null and empty texts are judged as one empty line."""
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches):
        for b in batches:
            good = [model.scores(*line_features(data, offsets)) >= threshold for _, _, data, offsets in chunks(b.column(place))]
            yield b.filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))
        release()

    return docs.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return quality_scores(docs, model).select("doc_id", held_out, "score", "predicted", "n_lines")
