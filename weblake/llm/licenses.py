"""License scans with a positional index of rare license words.

Templates of license notices are posted under their words, and found by the rarest word of their key phrases. Every document is reduced to its license words, with
their places. An alignment is a template and an offset (place in the document minus place in the template);
it gathers the weight (inverse document frequency over all documents) of the template's words that are in
place. Each template looks up its own rarest words, so many that what is left of its weight is below
``min_share``: any alignment with that share has one of them in place. The alignments found are weighed
over all words of the template; one with ``min_share`` of the weight is verified: the template's mandatory
key phrases must stand within it. Verified alignments give labels beside those of the base phrases.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case.

Defined results: null or empty text: no words, null places, empty labels, score 0; labels are sorted and
distinct; repeated rows get equal rows; an empty table gives an empty result; very long texts are read
whole; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.llm.common import map_rows, texts_of

# Phrases and labels of the base result.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public notices: label, template, and the key phrases that must stand in the document.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("mit", "licensed under the mit license", ["the mit license"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("gpl", "licensed under the gnu general public license", ["gnu general public license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "conditions are met"]),
    ("bsd", "licensed under the bsd license", ["bsd license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "to the extent possible under law the author has dedicated all copyright to the public domain cc0", ["public domain"]),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ["cc by nc sa"]),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ["cc by nc nd"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["creative commons attribution noncommercial sharealike"]),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("odbl-1.0", "made available under the open database license any rights in individual contents of the database are licensed under the database contents license", ["open database license"]),
    ("eupl-1.2", "licensed under the european union public licence version 1 2", ["european union public licence"]),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    ("artistic-2.0", "you may use modify and distribute this package under the terms of the artistic license version 2 0", ["artistic license"]),
    ("wtfpl", "do what the fuck you want to public license", ["what the fuck you want"]),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    ("psf-2.0", "licensed under the python software foundation license version 2", ["python software foundation license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3", ["gnu free documentation license"]),
    # Whole paragraphs of short licenses.
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included", "portions of the software"]),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["without restriction including without limitation", "sell copies of the software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee", "appear in all copies"]),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code", "this list of conditions"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products", "prior written permission"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["must not be misrepresented"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["anyone is free to copy", "by any means"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["unless required by applicable law", "on an as is basis"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["gnu general public license", "in the hope that it will be useful"]),
]

# Public identifiers of licenses in source file headers; the label is the identifier without its last word, if that is "only" or "or later".
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0"
    " CDDL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later"
    " LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 OFL-1.1 Unlicense WTFPL Zlib"
).split()


def _identifier(name: str) -> tuple[str, str, list[str]]:
    line = "spdx license identifier " + " ".join(re.split("[-.]", name.lower()))
    return re.sub("-(only|or-later)$", "", name.lower()), line, [line]


TEMPLATES += [_identifier(name) for name in SPDX]

# Everything but letters, digits and non-ASCII bytes parts words; A-Z becomes a-z.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def scan_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def phrase_places(spaced: bytes, phrase: bytes) -> list[int]:
    """Word places of a phrase in words joined and enclosed by spaces; the phrase is enclosed, too."""
    places, at, counted, place = [], spaced.find(phrase), 0, 0
    while at >= 0:
        # Counted on from the last place, so that all places together cost one pass.
        place += spaced.count(b" ", counted, at)
        places.append(place)
        at, counted = spaced.find(phrase, at + 1), at
    return places


@dataclass
class LicenseIndex:
    """The templates' words, rarest first, with their positions and weights (inverse document frequency)."""

    weight: dict[bytes, float]
    min_share: float = 0.6
    templates: list[list[bytes]] = field(default_factory=list)
    needed: list[frozenset[bytes]] = field(default_factory=list)  # the words of a template's key phrases
    asking: dict[bytes, list[int]] = field(default_factory=dict)  # word -> templates whose rarest key word it is
    rarest: list[list[tuple[bytes, list[int], float]]] = field(default_factory=list)  # word, positions, weight at all of them

    def __post_init__(self):
        for _, template, phrases in TEMPLATES:
            words = template.encode().split()
            self.templates.append(words)
            self.needed.append(frozenset(" ".join(phrases).encode().split()))
            rarest = min(self.needed[-1], key=lambda w: (-self.weight[w], w))
            self.asking.setdefault(rarest, []).append(len(self.needed) - 1)
            at: dict[bytes, list[int]] = {}
            for place, word in enumerate(words):
                at.setdefault(word, []).append(place)
            order = sorted(at, key=lambda w: (-self.weight[w], w))
            self.rarest.append([(w, at[w], self.weight[w] * len(at[w])) for w in order])

    def alignments(self, words: list[bytes], places: dict[bytes, list[int]]) -> dict[tuple[int, int], float]:
        """(template, offset) -> share of the template's weight in place, where it is ``min_share`` or more.

        A template is looked at only if the document has the rarest word of its key phrases, and then their other words.
        """
        out = {}
        for number in (number for word in self.asking.keys() & places.keys() for number in self.asking[word]):
            if not self.needed[number] <= places.keys():
                continue
            template = self.templates[number]
            whole = sum(self.weight[w] for w in template)
            least = self.min_share * whole - 1e-9
            # Words that the document lacks are in place nowhere.
            left = sum(weight for w, _, weight in self.rarest[number] if w in places)
            offsets: set[int] = set()
            for word, positions, weight in self.rarest[number]:
                if left < least:
                    break
                if word in places:
                    offsets.update(place - at for place in places[word] for at in positions)
                    left -= weight
            for offset in offsets:
                lo = max(0, -offset)
                here = words[offset + lo : offset + len(template)]
                gathered = sum(self.weight[w] for w, found in zip(template[lo:], here) if w == found)
                if gathered >= least:
                    out[number, offset] = gathered / whole
        return out

    def labels(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of verified alignments, and the largest share of a template in place."""
        places: dict[bytes, list[int]] = {}
        for i, word in enumerate(words):
            if word in self.weight:
                places.setdefault(word, []).append(i)
        found, best = set(), 0.0
        for (number, offset), _ in self.alignments(words, places).items():
            template = self.templates[number]
            window = words[max(0, offset) : max(0, offset + len(template))]
            spaced = b" %b " % b" ".join(window)
            label, _, phrases = TEMPLATES[number]
            if all(b" %b " % p.encode() in spaced for p in phrases):
                found.add(label)
                same = sum(0 <= offset + i < len(words) and words[offset + i] == w for i, w in enumerate(template))
                best = max(best, same / len(template))
        return found, best


def learn_weights(docs: DataFrame) -> dict[bytes, float]:
    """Inverse document frequency of every license word, from all documents."""
    known = {w for _, template, _ in TEMPLATES for w in template.encode().split()}

    def make():
        def step(cols: dict) -> dict:
            seen: Counter = Counter({b"": len(cols["text"])})
            for text in cols["text"]:
                seen.update(known.intersection(scan_words(text)))
            return {"word": list(seen), "n": list(seen.values())}

        return step

    counts = map_rows(texts_of(docs).select("text"), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # One row for each license word: bounded by the templates.
    seen = {bytes(r["word"]): r["n"] for r in counts.collect()}
    return {w: math.log((1 + seen.get(b"", 0)) / (1 + seen.get(w, 0))) + 0.01 for w in known}


def scan_licenses(docs: DataFrame, weights: dict[bytes, float]) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def make():
        index = LicenseIndex(weights)
        phrases = [(b" %b " % p.encode(), label) for p, label in BASE_PHRASES.items()]

        def step(cols: dict) -> dict:
            out: dict = {k: [] for k in names}
            for text in cols["text"]:
                words = scan_words(text)
                spaced = b" %b " % b" ".join(words)
                places, base = [], set()
                for phrase, label in phrases:
                    if phrase in spaced:
                        places += phrase_places(spaced, phrase)
                        base.add(label)
                labels, share = index.labels(words)
                row = (
                    len(words),
                    len(places),
                    min(places, default=None),
                    max(places, default=None),
                    ",".join(sorted(base)),
                    ",".join(sorted(base | labels)),
                    max(share, 0.5 * bool(base)),
                )
                for name, value in zip(names, row):
                    out[name].append(value)
            return {"doc_id": cols["doc_id"], **out}

        return step

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " score double"
    )
    return map_rows(texts_of(docs), make, schema)
