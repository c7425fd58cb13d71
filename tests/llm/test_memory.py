"""What workers hold, and what is handed to them at once."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from arborspark.llm import substrings, tokens

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_pipeline_hands_out_small_batches_and_forgets_units(spark):
    import corpus_pipeline

    before = spark.conf.get(LIMIT)
    try:
        rows = spark.createDataFrame([(i, f"w{i} " * 250_000) for i in range(24)], "doc_id long, text string").repartition(1)
        assert corpus_pipeline.packing(spark, rows, "").agg({"length": "sum"}).first()[0] > 24 * 250_000

        def look(batches):
            for b in batches:
                known = max((len(c.bytes) for c in tokens._codecs.values()), default=0)
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([known])], names=["size", "known"])

        got = rows.mapInArrow(look, "size long, known long").collect()
        assert max(r["size"] for r in got) < 8 << 20 and max(r["known"] for r in got) == 0
    finally:
        spark.conf.set(LIMIT, before)


def test_texts_without_white_space_are_not_kept():
    c = tokens.Codec(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(20):
        long = b"%d" % i + b"ab" * 5000
        n = c.count([long + b" some words", long])
        assert n[0] > n[1] > 0 and c.id_bytes([long])[0]
    assert sum(map(len, c.lengths)) < 100 and not any(c.bytes)


def test_spans_are_shuffled_in_few_bytes():
    """A row of four 64-bit columns took 32.7 bytes a span in the shuffle."""
    r, n, texts, bits = np.random.default_rng(3), 100_000, 500, 4
    doc, own = np.sort(r.integers(-(1 << 40), 1 << 40, texts)), r.integers(0, 1 << substrings.TEXT_BITS, texts)
    row, later = r.integers(0, texts, n), r.random(n) < 0.1
    number = r.integers(0, 300, n) + r.integers(0, 2, n) * substrings.RUNS + (r.random(n) < 0.01) * substrings.LAST
    h0, h1 = r.integers(0, 1 << 64, n, dtype=np.uint64), r.integers(0, 1 << 35, n)
    blocks = list(zip(*substrings.packed(bits, doc, own, row, number, h0, h1, later)))
    assert len(blocks) == 1 << bits and sum(len(x) + len(y) for _, x, y in blocks) < 18 * n
    got = [np.concatenate(x) for x in zip(*(substrings.unpacked(bits, *b) for b in blocks))]
    order = np.argsort(h0)
    assert all(np.array_equal(a, b[order]) for a, b in zip(got, (doc[row], own[row], number, h0, h1, later)))
