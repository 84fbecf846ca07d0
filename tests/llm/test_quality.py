import re
from collections import Counter
from itertools import product

import numpy as np
from helpers import SCHEMA, by_id, documents, prose

from weblake.llm.quality import FEATURES, LineField, fit_field, learn_field, line_features, line_quality, worded_lines

JUNK = " | ".join(f"link{i}" for i in range(30))


def good(seed):
    return "\n".join(prose(seed * 10 + i, 30) for i in range(4))


def corpus():
    texts = [good(i) for i in range(40)] + [f"{prose(900 + i, 12)}\n{JUNK}\nCALL!! NOW!! {i}!! BUY!!\n{JUNK} {i}" for i in range(20)]
    return texts + [None, "", "few words only", "same words again " * 60, "\n \n\t\n", "x " * 30_000, f"{good(1)}\n{good(1)}", "a\x0bb\x0cc d"]


def labels(spark, texts):
    rows = [(i, int(i < 40), 0) for i in range(60)] + [(None, 0, 0), (61, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
            n < 10 or 100 * len(inside) > 20 * n)


def test_base_counts_match_brute_force_and_verdicts_follow_labels(spark):
    texts = corpus()
    docs = documents(spark, texts, clashing=True)
    field = learn_field(docs, labels(spark, texts))
    got = by_id(line_quality(docs, field), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, text in enumerate(texts):
        assert got[i][:6] == base(text)
        if got[i][5]:
            assert not got[i][6]
    assert all(got[i][6] for i in range(40)) and not any(got[i][6] for i in range(40, 60))


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5):
        field = LineField(rng.normal(size=(2, len(FEATURES))), rng.normal(size=(2, 2)), 0.5)
        x = rng.integers(0, 2, size=(n, len(FEATURES)))
        scores = x @ field.weights.T

        def score(labels):
            return sum(scores[t, s] for t, s in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))

        assert tuple(field.decode(x)) == max(product((0, 1), repeat=n), key=score)


def test_fit_separates_lines():
    rows = [line_features(worded_lines(good(i))) for i in range(10)] + [line_features([JUNK, JUNK + "x"]) for _ in range(10)]
    weights, moves = fit_field(rows, np.array([0] * 10 + [1] * 10))
    field = LineField(weights, moves, 0.5)
    assert not field.decode(rows[0]).any() and field.decode(rows[-1]).all()


def test_without_labels_and_empty_table(spark):
    docs = documents(spark, [JUNK, good(1)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert by_id(line_quality(docs, learn_field(docs, none)), "kept") == {0: (True,), 1: (True,)}
    empty = spark.createDataFrame([], SCHEMA)
    assert line_quality(empty, learn_field(empty, none)).count() == 0
