import hashlib

from helpers import SCHEMA, by_id, documents, prose

from weblake.llm import substring_dedup
from weblake.llm.substring_dedup import without_repeats


def expected(texts, width=20):
    seen, out = set(), {}
    for doc, text in enumerate(texts):
        words = (text or "").encode().split()
        drop = set()
        for start in range(len(words) - width + 1):
            window = tuple(words[start : start + width])
            if window in seen:
                drop.update(range(start, start + width))
            seen.add(window)
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        out[doc] = (len(words), len(drop), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    passage, other = prose(50, 60), prose(51, 25)
    texts = [None, "", prose(1, 100), f"{prose(2, 40)} {passage} {prose(3, 30)}", f"{passage} {prose(4, 30)}"]
    texts += [f"{prose(5, 10)} {passage} {prose(6, 19)} {other}", other, other + " x", prose(1, 100)]
    texts += [" ".join(["same"] * 60), "same same " * 20, f"{other}\n\n{other} {other}", "short text", "short text", prose(1, 19)]
    return texts + [f"{passage} {prose(60 + i, 20)}" for i in range(40)]


def test_matches_brute_force(spark):
    texts = corpus()
    got = by_id(without_repeats(documents(spark, texts, clashing=True)), "n_words", "n_removed", "kept_sha256")
    assert got == expected(texts)


def test_repeats_within_one_document(spark):
    """Short periods, whose windows all share one leader, and long ones."""
    words = prose(77, 200).split()
    texts = [" ".join((words[9 * p : 9 * p + p] * 60)[: 20 + 2 * p]) for p in range(1, 19)]
    texts += [" ".join(w for w in words[100:110] for _ in range(12)), " ".join(words[120:170] + words[120:150])]
    got = by_id(without_repeats(documents(spark, texts)), "n_words", "n_removed", "kept_sha256")
    assert got == expected(texts)


def test_groups_that_do_not_fit(spark, monkeypatch):
    """Every repeated group dealt out: the longer prefix gives the same result."""
    monkeypatch.setattr(substring_dedup, "GROUP_WORDS", 3)
    texts = corpus()
    got = by_id(without_repeats(documents(spark, texts)), "n_words", "n_removed", "kept_sha256")
    assert got == expected(texts)


def test_text_keeps_its_own_white_space(spark):
    passage = prose(7, 30)
    docs = documents(spark, [passage, f"Before  it.\n{passage}\nAfter\tit.", "a  b\n c"])
    got = by_id(without_repeats(docs, with_text=True), "text", "n_removed")
    assert got == {0: (passage, 0), 1: ("Before  it.\nAfter\tit.", 30), 2: ("a  b\n c", 0)}


def test_null_ids_and_empty_table(spark):
    rows = [(None, prose(1, 50), "en", "s", 1), (1, prose(1, 50), "en", "s", 1)]
    assert by_id(without_repeats(spark.createDataFrame(rows, SCHEMA)), "n_removed") == {1: (0,)}
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
