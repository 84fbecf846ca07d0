import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from helpers import SCHEMA, by_id, documents, prose

from weblake.llm import hmm
from weblake.llm.hmm import Chain, baum_welch, expected_counts, first_chain, hmm_scores, log_likelihood

TEXTS = [None, "", "a", "A a b", *(prose(s, 40 + s, 60) for s in range(60)), prose(99, 1500, 60), prose(7, 47, 60), "only here"]


def expected(texts):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in texts]
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    counts = Counter(x for own, held in zip(tokens, out) if not held for x in own)
    total, distinct = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in own) for own in tokens]
    return {i: (out[i], len(own), sum(counts[x] > 0 for x in own), total, base[i]) for i, own in enumerate(tokens)}


def compare(spark, texts):
    got = by_id(hmm_scores(documents(spark, texts, clashing=True)), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for doc, want in expected(texts).items():
        assert got[doc][:4] == want[:4]
        assert math.isclose(got[doc][4], want[4], rel_tol=1e-9)
        assert math.isfinite(got[doc][5]) and got[doc][5] < 0
    return {k: v[5] for k, v in got.items()}


def test_base_score_with_and_without_cold_words(spark, monkeypatch):
    whole = compare(spark, TEXTS)
    monkeypatch.setattr(hmm, "HOT_WORDS", 10)
    monkeypatch.setattr(hmm, "SYMBOLS", 5)
    compare(spark, TEXTS)
    assert whole[69 - 3] == whole[66] and set(whole) == set(range(len(TEXTS)))


def chain(states=3, symbols=5):
    rng = np.random.default_rng(1)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(sequence, c):
    for path in itertools.product(range(len(c.start)), repeat=len(sequence)):
        p = c.start[path[0]] * c.emit[sequence[0], path[0]]
        for t in range(1, len(sequence)):
            p *= c.move[path[t - 1], path[t]] * c.emit[sequence[t], path[t]]
        yield path, p


def test_forward_and_expected_counts_match_all_paths():
    c = chain()
    sequences = [np.array(x) for x in ([0], [1, 2], [4, 4, 0, 3], [2, 1, 0], [3, 3])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for i, s in enumerate(sequences):
        total = sum(p for _, p in paths(s, c))
        assert math.isclose(log_likelihood(sequences, c)[i], math.log10(total), rel_tol=1e-9)
        for path, p in paths(s, c):
            start[path[0]] += p / total
            for t, state in enumerate(path):
                emit[s[t], state] += p / total
                if t:
                    move[path[t - 1], state] += p / total
    a, b, used, e, probability = expected_counts(sequences, c)
    assert math.isclose(probability, sum(log_likelihood(sequences, c)), rel_tol=1e-9)
    whole = np.zeros((5, 3))
    whole[used] = e
    assert np.allclose(a, start) and np.allclose(b, move) and np.allclose(whole, emit)


def test_blocks_give_the_counts_of_whole_sequences(monkeypatch):
    c, rng = chain(), np.random.default_rng(2)
    sequences = [rng.integers(0, 5, n) for n in (1, 40, 7, 333, 40, 2, 90)]
    whole = expected_counts(sequences, c)
    assert math.isclose(whole[0].sum(), 7) and math.isclose(whole[1].sum(), sum(len(s) - 1 for s in sequences))
    for block in (1, 5, 50):
        monkeypatch.setattr(hmm, "BLOCK", block)
        assert all(np.allclose(a, b) for a, b in zip(whole, expected_counts(sequences, c)))


def test_training_counts_starts_and_moves_of_whole_documents(spark):
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 5, n) for n in (257, 1500, 3, 256, 700)]
    encoded = spark.createDataFrame([(False, bytearray(s.astype("<u2").tobytes())) for s in sequences], "held_out boolean, symbols binary")
    (got, course), want = baum_welch(encoded, 5, 3, 1), expected_counts(sequences, first_chain(5, 3))
    assert math.isclose(course[0], want[4], rel_tol=1e-9)
    assert math.isclose(want[0].sum(), len(sequences))
    start, move = want[0] + 1e-3, want[1] + 1e-3
    assert np.allclose(got.start, start / start.sum(), rtol=1e-9) and np.allclose(got.move, move / move.sum(1, keepdims=True), rtol=1e-9)


def test_probabilities_of_one_token_texts_sum_to_one():
    c = chain()
    assert math.isclose(sum(10 ** log_likelihood([np.array([s]) for s in range(5)], c)), 1.0, rel_tol=1e-9)


def test_empty_table_and_no_training_documents(spark):
    assert hmm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = hmm_scores(spark.createDataFrame([(held, "a b", None, None, None)], SCHEMA)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in only] == [(3, 0, 0)]
    assert math.isfinite(only[0]["score"]) and math.isfinite(only[0]["base_score"])


def test_states_scaled_now_and_then_give_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    c, sequences = chain(4, 6), [rng.integers(0, 6, n) for n in (1, 7, 8, 9, 16, 3000, 40)]
    c.emit[3] *= 1e-9
    monkeypatch.setattr(hmm, "RESCALE", 1)
    counts, scores = expected_counts(sequences, c), log_likelihood(sequences, c)
    for steps in (3, 8):
        monkeypatch.setattr(hmm, "RESCALE", steps)
        assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(counts, expected_counts(sequences, c)))
        assert np.allclose(scores, log_likelihood(sequences, c), rtol=1e-12)
