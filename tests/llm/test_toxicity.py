import zlib

import numpy as np
from helpers import SCHEMA, by_id, documents, prose

from weblake.llm.toxicity import FEATURES, Lexicon, Marks, features_of, is_obfuscated, learn_toxicity, revealed_form, toxicity

BAD = ["grumbly", "snarkish", "vilefolk"]


def corpus():
    texts = [prose(i, 60) for i in range(240)]
    for i in range(0, 240, 4):
        words = texts[i].split(" ")
        words[10], words[30], words[45] = f"you {BAD[i % 3]}!", BAD[(i + 1) % 3], BAD[(i + 2) % 3].upper()
        texts[i] = " ".join(words)
    return texts


def labels(spark, n=240):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def test_learns_the_lexicon_and_holds_out_a_fold(spark):
    texts = [*corpus(), None, "", "x " * 50_000]
    docs = documents(spark, texts, clashing=True)
    model = learn_toxicity(docs, labels(spark), trees=5)
    assert {w.encode() for w in BAD} <= set(model.lexicon.words)
    got = by_id(toxicity(docs, model), "held_out", "score", "predicted")
    assert set(got) == set(range(len(texts)))
    for i, (held, score, predicted) in got.items():
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == int(score >= 0.5)
    right = [got[i][2] == int(i % 4 == 0) for i in range(240) if got[i][0]]
    assert np.mean(right) > 0.95
    assert got[240] [1:] == got[241][1:]  # null and empty


def test_held_out_labels_are_never_used(spark):
    docs = documents(spark, corpus())
    flipped = [(i, 1, int(i % 4 == 0) ^ int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(240)]
    other = spark.createDataFrame(flipped, "doc_id bigint, quality int, toxic int")
    scores = [by_id(toxicity(docs, learn_toxicity(docs, x, trees=3)), "score") for x in (labels(spark), other)]
    assert scores[0] == scores[1]


def test_without_labels_of_both_kinds(spark):
    docs = documents(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert by_id(toxicity(docs, learn_toxicity(docs, none)), "score", "predicted") == {0: (0.0, 0), 1: (0.0, 0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity(empty, learn_toxicity(empty, labels(spark))).count() == 0


def test_features():
    marks = Marks(Lexicon({b"grumbly": 3.0}, {b"snar": 2.0}))
    got = dict(zip(FEATURES, features_of("You are GRUMBLY!! gr*mbly gr.umbly snarkle", marks)))
    assert got["word_hits"] == 1 and got["start_hits"] == 1 and got["hits"] == 2 and got["hit_weight"] == 5.0
    assert got["person_near"] == 1 / 3 and got["capitals"] > 0.2
    assert is_obfuscated(b"gr*mbly") and not is_obfuscated(b"grumbly") and revealed_form(b"gr*umb1y") == b"grumbiy"
    assert features_of("", marks) == [0.0] * len(FEATURES)
