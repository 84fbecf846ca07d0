import re
import time

from helpers import SCHEMA, by_id, documents, prose

from weblake.llm.licenses import BASE_PHRASES, TEMPLATES, LicenseIndex, learn_weights, scan_licenses, scan_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i : i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    prose(1, 200),
    "MIT License",
    "cc by cc by CC-BY",
    "ccby mit licensed apache licenses",
    f"{prose(2, 50)}\nLicensed under the Apache License, Version 2.0.\n{prose(3, 50)}",
    f"Licensed under CC BY-NC 4.0. {prose(4, 10)}",
    "GNU GENERAL PUBLIC LICENSE gnu General_Public License",
    "É cc by É",
    "version 2.0 of something licensed apart, and far away the apache tribe's license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met:",
    " ".join(["mit license"] * 500),
]


def test_base_result_matches_brute_force(spark):
    docs = documents(spark, TEXTS, clashing=True)
    got = by_id(scan_licenses(docs, learn_weights(docs)), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {i: expected(t) for i, t in enumerate(TEXTS)}


def test_templates_and_scores(spark):
    docs = documents(spark, TEXTS)
    got = by_id(scan_licenses(docs, learn_weights(docs)), "labels", "score")
    assert got[6][0] == "apache,apache-2.0"
    assert got[7][0] == "cc-by,cc-by-nc"
    assert got[11][0] == "bsd"
    assert got[10] == ("", 0.0) and got[0] == ("", 0.0) and got[2] == ("", 0.0)
    assert all(0 <= score <= 1 for _, score in got.values()) and got[6][1] == 1.0


def test_empty_table_and_repeated_rows(spark):
    assert learn_weights(spark.createDataFrame([], SCHEMA))
    docs = spark.createDataFrame([(1, "the MIT License", None, None, None)] * 3, SCHEMA)
    assert [r["labels"] for r in scan_licenses(docs, learn_weights(docs)).collect()] == ["mit"] * 3
    assert scan_licenses(spark.createDataFrame([], SCHEMA), learn_weights(docs)).count() == 0


def over_all_words(text, weight, min_share=0.6):
    """Labels of all alignments that gather the share and hold the key phrases, by trying every offset."""
    words, labels = scan_words(text), set()
    for label, template, phrases in TEMPLATES:
        wanted = template.encode().split()
        whole = sum(weight[w] for w in wanted)
        for offset in range(-len(wanted), len(words)):
            same = sum(weight[w] for i, w in enumerate(wanted) if 0 <= offset + i < len(words) and words[offset + i] == w)
            window = b" %b " % b" ".join(words[max(0, offset) : max(0, offset + len(wanted))])
            if same >= min_share * whole - 1e-9 and all(b" %b " % p.encode() in window for p in phrases):
                labels.add(label)
    return labels


def test_many_notices_in_one_document_match_brute_force_over_all_words(spark):
    apache, by_sa = "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-SA 4.0."
    notices = [f"{template}." for _, template, _ in TEMPLATES]
    five = f"{apache} {notices[3]} {notices[10]} {notices[13]} {by_sa}"
    near = " ".join(f"{prose(i, 9)} {n.replace('the ', 'the x ', 1) if i % 2 else n}" for i, n in enumerate(notices))
    texts = [five, f"{prose(1, 90)} {' '.join(notices)} {prose(2, 90)}", near, *[f"{apache} {by_sa} {prose(i, 9)}" for i in range(40)]]
    docs = documents(spark, texts)
    weight = learn_weights(docs)
    index = LicenseIndex(weight)
    for text in texts:
        assert index.labels(scan_words(text))[0] == over_all_words(text, weight)
    got = by_id(scan_licenses(docs, weight), "labels")
    assert got[0] == ("apache,apache-2.0,bsd,cc-by,cc-by-sa,mit,mpl-2.0",)
    assert set(got[1][0].split(",")) == {label for label, _, _ in TEMPLATES} | {"apache"}


def test_headers_of_source_files(spark):
    texts = ["// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "# SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: unknown", "gpl 2.0 or later"]
    docs = documents(spark, texts)
    got = by_id(scan_licenses(docs, learn_weights(docs)), "labels")
    assert [got[i][0] for i in range(4)] == ["gpl-2.0", "bsd-3-clause", "", ""]


def test_very_long_texts_take_linear_time(spark):
    texts = ["cc by " * 80_000, "the software is provided under the license " * 20_000 + "SPDX-License-Identifier: MIT"]
    docs = documents(spark, texts)
    weight = learn_weights(docs)
    start = time.perf_counter()
    labels = [LicenseIndex(weight).labels(scan_words(t))[0] for t in texts]
    assert time.perf_counter() - start < 10
    got = by_id(scan_licenses(docs, weight), "n_base", "first_word", "last_word", "base_labels")
    assert got == {0: (80_000, 0, 159_998, "cc-by"), 1: (0, None, None, "")}
    assert labels[1] == {"mit"}
