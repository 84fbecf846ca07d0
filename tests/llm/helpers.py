"""Small inputs for the tests of the training-data operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    """Made-up words, different for each seed."""
    rng = random.Random(seed)
    out = ["w" + format(rng.randrange(vocabulary) * 7919 + 13, "x") for _ in range(words)]
    return ". ".join(" ".join(out[i : i + 12]) for i in range(0, words, 12)) + "."


def documents(spark, texts, clashing=False):
    """doc_id counts from 0; ``clashing`` adds columns named like those the operators make."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        for name in ("held_out", "score", "kept", "key", "n", "component_id", "starts", "features", "rank", "carried", "row"):
            docs = docs.withColumn(name, F.lit("x"))
    return docs


def by_id(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}
