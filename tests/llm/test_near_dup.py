import random
from itertools import combinations

from helpers import SCHEMA, by_id, documents, prose

from weblake.llm import near_dup
from weblake.llm.common import ASCII_LOWER
from weblake.llm.near_dup import connected, near_duplicates


def shingles(text, width):
    words = tuple((text or "").encode().translate(ASCII_LOWER).split())
    if len(words) < width:
        return {words} if words else set()
    return {words[i : i + width] for i in range(len(words) - width + 1)}


def expected(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def edited(text, seed, changes):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    base = prose(1, 200)
    texts = [prose(s, 120) for s in range(2, 20)] + [base] * 4
    texts += [edited(base, s, 1 + s % 9) for s in range(30)]  # a chain of copies on both sides of the threshold
    texts += [None, "", " \n\t ", "one", "One", "two words", "TWO words", "two  words x", "Ä ä", "ä ä"]
    return texts + [base.upper(), prose(3, 120) + " tail"]


def test_matches_brute_force(spark):
    for width, percent in ((3, 85), (5, 80)):
        texts = corpus()
        got = by_id(near_duplicates(documents(spark, texts, clashing=True), width, percent), "n_shingles", "component_id", "kept")
        assert got == expected(texts, width, percent)


def test_large_group_of_near_copies_needs_few_comparisons(spark, monkeypatch):
    base = prose(5, 300)
    texts = [edited(base, s, 2) for s in range(150)]
    compared = []
    original = near_dup._alike
    monkeypatch.setattr(near_dup, "_alike", lambda pairs, *rest: compared.append(pairs.count()) or original(pairs, *rest))
    got = by_id(near_duplicates(documents(spark, texts), 3, 85), "component_id")
    assert set(got.values()) == {(0,)}
    assert sum(compared) < 150 * 149 / 4


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(None, "a b c d", "en", "s", 1), (1, "a b c d", "en", "s", 1), (1, "a b c d", "en", "s", 1), (2, "A b c d", None, None, None)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (2, 1, False)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["doc"]: r["component"] for r in connected(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
