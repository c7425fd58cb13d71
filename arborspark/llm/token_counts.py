"""Operator 1: token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.store import documents, in_batches_of
from arborspark.llm.textops import release
from arborspark.llm.tokens import by_bytes, codec, safe_pieces


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Begin, end and added special tokens are left out; special strings inside a text are
    handled as the library does by default. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows give repeated results, a null doc_id stays null, an empty table gives an
    empty one and other columns are not read. Texts over a batch's bytes are cut at white
    space, if the tokenizer drops white space; else they are encoded whole.
    """
    path = public_tokenizers.path(tokenizer)

    def lengths(batches):
        c = codec(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = []
            for i, j in by_bytes(texts):
                part = [t or b"" for t in texts[i:j]]
                if len(part) == 1 and c.splits:
                    n.append(sum(c.count([p])[0] for p in safe_pieces(part[0])))
                else:
                    n += c.count(part)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        release()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(lengths, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_batches_of(spark)
    return token_counts(documents(spark, sf_dir))
