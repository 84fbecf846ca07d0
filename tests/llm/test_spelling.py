import random
from collections import Counter

import pytest
from helpers import documents
from pyspark.sql import functions as F

from weblake.llm import spelling
from weblake.llm.spelling import damaged_counts, near_words, roots, spelling_variants, vocabulary

COLUMNS = ["form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def expected(texts):
    counts = Counter()
    for i, text in enumerate(texts):
        for word, n in damaged_counts(i, text or ""):
            counts[word] += n
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(((-words[x], x) for x in others), default=None)
        if best and -best[0] >= 10 * words[w]:
            forms[w] = best[1]
    out = {}
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out[w] = (form, root, words[w], len(near[w]), words[form] if form else None)
    return out


def by_word(frame):
    return {r["word"]: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def edited(rng, word):
    i, letter = rng.randrange(len(word) + 1), rng.choice("abéÿ×")
    return rng.choice([word[:i] + letter + word[i:], word[:i] + word[i + 1 :], word[:i] + letter + word[i + 1 :]])


def corpus(seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 13))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    texts = []
    for _ in range(40):
        words = []
        for base in bases:
            words += [base] * rng.choice([0, 1, 5])
            words += [edited(rng, base) for _ in range(2)]
            words += [edited(rng, edited(rng, base))]
        rng.shuffle(words)
        texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words) + " É 12ab_cd")
    return texts + [None, "", " \n", "short words only", texts[0]]


def test_matches_brute_force(spark):
    texts = corpus(1)
    got = by_word(spelling_variants(documents(spark, texts, clashing=True)))
    assert got == expected(texts)
    assert sum(v[0] is not None for v in got.values()) > 20


@pytest.mark.parametrize("longest", [8, 10])
def test_long_words_by_their_deletions(spark, monkeypatch, longest):
    monkeypatch.setattr(spelling, "LONG", longest)
    texts = corpus(2)
    assert by_word(spelling_variants(documents(spark, texts))) == expected(texts)


def test_words_of_any_length(spark):
    long = "ab" * 20_000
    texts = [" ".join([long] * 30), " ".join([long[:-1], long + "b", "x" + long[1:], "y" + long[1:]] * 2), "a" * 63 + " " + "a" * 64] * 6
    got = by_word(spelling_variants(documents(spark, texts)))
    assert got == expected(texts)
    assert got[long][3] >= 4 and got["a" * 63][3] >= 1


def test_links_are_whole_and_once(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(400)}
    frame = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    got = [(r["word"], r["near"]) for r in near_words(frame).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(21)] + [("x", "w20")]
    got = {r["word"]: r["root"] for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w21" for w, _ in chain}


def test_damage_hashes_the_lowered_run_with_its_document():
    seen = {tuple(damaged_counts(i, "Reading, READING x")) for i in range(200)}
    # A seven-letter run that loses a letter is no word any more.
    assert seen == {(("reading", 2),), ()}
    assert dict(damaged_counts(None, "ÉÉÉÉÉÉÉ")) in ({"ÉÉÉÉÉÉÉ": 1}, {})


def test_empty_table(spark):
    docs = documents(spark, ["x"]).where("false")
    assert spelling_variants(docs).count() == 0
    assert vocabulary(docs.withColumn("word", F.lit(1))).count() == 0
