"""Token counts of documents under a public tokenizer, whose file is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default vocabulary file; it has to be readable on every executor.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def token_count(text: Column, model: str = MODEL) -> Column:
    """Tokens of the whole text; null and empty texts have none."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for texts in batches:
            yield pd.Series([len(x) for x in sp.encode(texts.fillna("").tolist(), num_threads=1)], dtype="int64")

    return count.asNondeterministic()(text)  # not to be evaluated again for a filter on the counts


def sized(docs: DataFrame, id_col: str, text: str, *keep: str, model: str = MODEL) -> DataFrame:
    """``id, text_hash, n_tokens`` and the kept columns, repeated rows once."""
    rows = docs.where(F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), token_count(F.col(text), model).alias("n_tokens"), *keep)
    return rows.distinct()
