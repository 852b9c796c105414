"""Tokens of the word-and-punctuation pattern, counted JVM-side and in Python alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, digits and underscores, or a run of other characters that aren't white space.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: The same for Java: its own word class would take in combining marks, its white space would leave out four separators.
JAVA_TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]+"


def token_count(text: Column) -> Column:
    """Tokens of a text; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(JAVA_TOKEN)), F.lit(0)).cast("long")


def tokenizer_count(path: str, kind: str = "tokenizers"):
    """A column function that counts tokens of a public tokenizer's vocabulary file; ``kind`` names its library.

    ``tokenizers`` reads a JSON file, ``sentencepiece`` a model. The file must lie at ``path`` on every executor. Null
    counts 0. Use it in place of ``token_count`` where sizes are to be a model's.
    """
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def load():
        if kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]

    kept: list = []

    @pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        if not kept:
            kept.append(load())
        return pd.Series(kept[0](text.fillna("").tolist()), index=text.index, dtype="int64")

    return count
