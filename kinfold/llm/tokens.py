"""Sizes of texts in tokens of a public tokenizer, and a quality weight from the same pass."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Encoder of a rank file; a bare name is looked up in the installed public vocabularies."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    place = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
    with open(place, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("kinfold", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def line_quality(text: str) -> float:
    """Weight in [0.05, 1]: the share of distinct lines, lower for very long lines.

    Repetitive (generated) and minified texts weigh little, ordinary sources close to 1.
    """
    lines = text.splitlines() or [""]
    distinct = len(set(lines)) / len(lines)
    width = len(text) / len(lines)
    return max(0.05, min(1.0, distinct * (1.0 if width <= 120 else 120 / width)))


def measured(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_tokens, quality): the whole text of every row, measured once.

    A null text counts as empty: 0 tokens, quality 0.05.  Rows repeat as they do in the input.
    """

    @F.pandas_udf("n_tokens long, quality double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for texts in batches:
            sizes, weights = [], []
            for text in texts:
                sizes.append(len(encode(text)) if text else 0)
                weights.append(line_quality(text) if text else 0.05)
            yield pd.DataFrame({"n_tokens": sizes, "quality": weights})

    return documents.select(id_column, *keep, measure("text").alias("m")).select(id_column, *keep, "m.n_tokens", "m.quality")
