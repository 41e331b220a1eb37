import public_tokenizers
import pytest

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Texts that every operator on documents must take: null, empty, blank, tied, repeated, long, odd.
ODD = [
    None, "", " \n\t", "a", "word", "Word word WORD", "same text twice here now", "same text twice here now", "x" * 50_000, "ab " * 20_000,
    "é 😀 ǘ K İ", "﻿mark", "nul\x00inside", "tab\tand\x0bmore", "mit license", "a@b.co, +1 (555) 123-4567 1.2.3.4", "9" * 3000, "\\ <s> [INST]",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with ids (one null, one twice) and extra columns whose names operators use themselves."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (4, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", "'x' AS id", "1 AS n_tokens", "'y' AS spans", "0.5D AS score", "'z' AS row", "2 AS label", "3 AS n", "'q' AS key")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
