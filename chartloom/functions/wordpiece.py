"""WordPiece ids over a given vocabulary (VEC-09)."""

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def load_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """A JSON object of piece -> id (SRC-13); a vocabulary is small by nature (some 30,000 entries)."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def pieces(text: str, vocabulary: dict[str, int], unknown: int) -> list[int]:
    """Lower-cased, cut at spaces, letters, digits, - and ' kept; a word whole, else greedy longest prefixes ("##" inside);
    where no prefix fits, the unknown id stands for one character."""
    out: list[int] = []
    for raw in text.lower().split(" "):
        word = "".join(c for c in raw if c.isalnum() or c in "-'")
        if not word:
            continue
        if word in vocabulary:
            out.append(vocabulary[word])
            continue
        at = 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in vocabulary:
                    out.append(vocabulary[piece])
                    at = end
                    break
            else:
                out.append(unknown)
                at += 1
    return out


def wordpiece(spark: SparkSession, vocabulary: dict[str, int], unknown: int = 100):
    """A function of a text column giving its ids."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else pieces(t, shared.value, unknown))

    return ids
