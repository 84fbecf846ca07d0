import numpy as np
import pytest

from weblake.llm import neighbours
from weblake.llm.neighbours import calibrate, fit_tree, nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=10, step=100):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any() and len(v) == 8]
    out = {}
    for i, v in good:
        if i % step == 0:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in good if j != i)
            out[i] = [(rank + 1, j, d) for rank, (d, j) in enumerate(found[:k])]
    return out


def searched(spark, rows):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    out = {}
    for r in nearest(frame).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(found) for q, found in out.items()}


def table(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 50])
def test_recall_and_exact_scores(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rows = table()
    got, want = searched(spark, rows), brute(rows)
    assert set(got) == set(want)
    hits = sum(len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    scores = {(q, j): d for q, found in want.items() for _, j, d in found}
    assert all(scores.get((q, j), d) == d for q, found in got.items() for _, j, d in found)


def test_odd_vectors_copies_and_ties(spark):
    same = [1.0] * 8
    rows = [(i, same) for i in range(0, 260)] + [(1000, [2.0] * 8), (1001, None), (1002, [0.0] * 8), (1003, [float("nan")] * 8)]
    rows += [(1004, [float("inf")] + same[1:]), (1005, [None] + same[1:]), (None, same), (1100, [1.0, 2.0])]
    got = searched(spark, rows)
    assert got == brute(rows)
    assert [j for _, j, _ in got[100]] == list(range(10)) and [j for _, j, _ in got[0]] == list(range(1, 11))


def test_few_candidates_and_empty_table(spark):
    assert searched(spark, [(0, [1.0] * 8), (5, [2.0] * 8)]) == {0: [(1, 5, float(np.sqrt(8.0)))]}
    assert searched(spark, [(0, [1.0] * 8)]) == {}
    assert searched(spark, []) == {}


def test_every_leaf_is_reached_once_and_visits_widen():
    sample = np.array([v for _, v in table(800)])
    tree = fit_tree(sample)
    tree.weight = np.bincount(tree.assign(sample), minlength=tree.leaves) / len(sample)
    assert tree.leaves > 5
    assert sorted(tree.best_bins(sample[3], 2.0)) == list(range(tree.leaves))
    assert len(tree.best_bins(sample[3], 0.01)) < len(tree.best_bins(sample[3], 0.5)) < tree.leaves
    assert calibrate(tree, sample, 10, 0.5) <= calibrate(tree, sample, 10, 0.99) <= 1.0


def test_recall_that_is_calibrated_for(spark, monkeypatch):
    wanted = []
    monkeypatch.setattr(neighbours, "learn_tree", lambda vectors, k, recall: wanted.append(recall))
    assert neighbours.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert wanted == [0.97]
