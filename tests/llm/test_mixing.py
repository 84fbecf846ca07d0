import numpy as np
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from weblake.llm import mixing
from weblake.llm.mixing import _draw, mixed_documents, mixed_texts, mixture, permuted, planned, shard_quotas, split_node


def corpus(spark, sizes, clashing=False):
    """``sizes``: source -> sizes of its documents."""
    rows = [(s, n) for s, counts in sizes.items() for n in counts]
    docs = documents(spark, [None if n is None else prose(i, n) if n else " " for i, (_, n) in enumerate(rows)], clashing)
    names = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "doc_id long, source string")
    return docs.drop("source").join(names, "doc_id"), rows


def targets(sizes):
    """Sources share by weight; those above twice their size stop there and the rest is shared again."""
    totals = {s: sum(n or 0 for n in counts) for s, counts in sizes.items()}
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), 1.5 * sum(totals.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * totals[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * totals[s] for s in above}
        left -= sum(2 * totals[s] for s in above)
        open_ -= above
    return out


SIZES = {
    "b": [300, 40, 1, None, 0, 700, 1200] * 3,
    "a": [30, 60],
    "B": [2500, 10] * 4,
    "é": [90] * 60,
    None: [20, 5000, 3],
    "z": [0, None],
    "c": [1],
}


def test_targets_sizes_and_limits(spark):
    docs, rows = corpus(spark, SIZES, clashing=True)
    got = mixed_documents(docs).collect()
    want = targets(SIZES)
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    taken = dict.fromkeys(SIZES, 0)
    for r in got:
        source, size = rows[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size or 0, sum(n or 0 for n in SIZES[source]))
        assert r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for source in SIZES:
        assert abs(taken[source] - want[source]) <= 2 + 0.002 * want[source], source


def test_reruns_agree_in_any_order(spark):
    docs, _ = corpus(spark, SIZES)
    runs = [sorted(map(tuple, mixed_documents(d).collect())) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")))]
    assert runs[0] == runs[1] == runs[2]


def test_shards_are_even_and_blocks_disjoint(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "LEVELS", 2)
    docs, rows = corpus(spark, SIZES)
    placed, quotas = planned(docs)
    runs = shard_quotas(quotas, 40).collect()
    sizes, ends = {}, {}
    for r in sorted(runs, key=lambda r: r["shard"]):
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["hi"] - r["lo"]
        assert r["lo"] == ends.get(r["source_id"], 0)
        ends[r["source_id"]] = r["hi"]
    assert len(sizes) > 20 and max(sizes.values()) - min(sizes.values()) <= 1
    wanted = {q["source_id"]: q["full"] + (q["rest"] > 0) for q in quotas.collect()}
    assert {s: n for s, n in wanted.items() if n} == ends
    pieces = mixture(placed, quotas, 40).collect()
    held = {(r["source_id"], p): r["shard"] for r in runs for p in range(r["lo"], r["hi"])}
    spans = {}
    for p in pieces:
        assert held[p["source_id"], p["at"]] == p["shard"]
        spans.setdefault((p["doc_id"], p["epoch"]), []).append((p["begin"], p["begin"] + p["words"]))
    for parts in spans.values():
        parts.sort()
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    taken = {(r["doc_id"], r["taken"]) for r in mixed_documents(docs).collect()}
    assert taken == {(i, sum(p["words"] for p in pieces if p["doc_id"] == i)) for i in range(len(rows))}


def test_texts_of_the_mix(spark):
    docs, _ = corpus(spark, {"a": [700, 3], "b": [90]})
    placed, quotas = planned(docs)
    pieces = mixture(placed, quotas)
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    spans = {(p["doc_id"], p["epoch"], p["block"]): (p["begin"], p["words"]) for p in pieces.collect()}
    out = mixed_texts(docs, pieces).collect()
    assert len(out) == len(spans)
    for r in out:
        begin, n = spans[r["doc_id"], r["epoch"], r["block"]]
        assert r["text"].split() == texts[r["doc_id"]][begin : begin + n]


def test_splits_follow_the_hypergeometric_law():
    quotas = {1: 300, 2: 100, 3: 7}
    means = np.zeros(3)
    for first in range(2000):
        parts = list(split_node(first * 2, 2, quotas, (407, 2), 1))
        assert {s: sum(p[2].get(s, 0) for p in parts) for s in quotas} == quotas
        means += [parts[0][2].get(s, 0) for s in quotas]
    assert np.allclose(means / 2000, [150, 50, 3.5], rtol=0.05)
    rng = np.random.default_rng(1)
    big = [_draw(rng, 3 * 10**10, 10**10, 4 * 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 3e6) < 500 and 400 < np.std(big) < 1400


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation(n):
    out = permuted(np.arange(n), np.full(n, n), np.full(n, 7, dtype=np.uint64))
    assert sorted(out) == list(range(n))
    assert n < 64 or list(out) != list(range(n))


def test_one_source_repeated_rows_empty_and_long(spark):
    docs, _ = corpus(spark, {"a": [10, 20, 100_000]})
    got = {r["doc_id"]: r for r in mixed_documents(docs.union(docs)).collect()}
    assert len(got) == 3 and got[0]["target"] == 1.5 * 100_030
    assert abs(sum(r["taken"] for r in got.values()) - 150_045) < 100
    assert mixed_documents(docs.where("false")).count() == 0
    none, _ = corpus(spark, {"a": [None, 0], None: [0]})
    assert [(r["size"], r["target"], r["taken"]) for r in mixed_documents(none).collect()] == [(0, 0.0, 0)] * 3
