"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities and weights of a lexicon, closeness of its words to second-person words,
capitals, punctuation and obfuscated spellings. The lexicon (words and word beginnings that toxic
documents hold far oftener than others) is learned from the same labelled rows as the trees: at most
``max_rows`` of them, chosen by a hash of the id, and never a row whose crc32(doc_id) mod 5 is 0.
Of the rest, remainder 4 calibrates and 1 to 3 fit the lexicon and the trees.

Defined results: null or empty text is scored by its (zero) features like any other; long texts are
read whole; repeated rows score alike; without labels of both kinds every score is the share of label
1 (0 without labels); columns other than doc_id and text are ignored; a null doc_id is not held out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.llm.common import ASCII_LOWER, MEMO_WORDS, held_out, map_rows, stage, texts_of

FOLDS = 5
MAX_TERMS = 3000
# Lengths of word beginnings, in characters; the word goes on.
STARTS = (4, 5, 6, 7, 8)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos"
    " ti usted ustedes vosotros tus su".split()
)
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Characters that stand for letters in obfuscated spellings.
_LEET = bytes.maketrans(b"@4310!57$8", b"aaeioistsb")
_INNER = b"*.-_~^|+="
_UPPER = bytes(b for b in range(256) if chr(b).isupper())
_LETTERS = bytes(b for b in range(256) if chr(b).isalpha())
_NOT_UPPER = bytes(set(range(256)) - set(_UPPER))
_NOT_LETTER = bytes(set(range(256)) - set(_LETTERS))
_NOT_PUNCTUATION = bytes(set(range(256)) - set(b"!?.,;:*#@$%&"))

FEATURES = [
    "log_words", "word_hits", "word_density", "word_weight", "word_best", "start_hits", "start_density",
    "start_weight", "start_best", "person_rate", "person_near", "capitals", "exclaims", "punctuation",
    "obfuscated_rate", "obfuscated_hits", "hits", "hit_weight",
]


def starts_of(core: bytes) -> list[bytes]:
    """The beginnings of a word, shorter than the word itself."""
    word = core.decode("utf-8", "replace")
    return [word[:n].encode("utf-8", "replace") for n in STARTS if len(word) > n]


def plain_form(token: bytes) -> bytes:
    """A lower-cased token without the punctuation around it."""
    return token.strip(_EDGES)


def revealed_form(core: bytes) -> bytes:
    """The word an obfuscated spelling stands for: letters for look-alikes, no signs between letters."""
    return core.translate(_LEET, _INNER)


def is_obfuscated(core: bytes) -> bool:
    """Letters with a look-alike or a sign among them."""
    if core.isalpha() or not core.isascii():
        return False
    inside = core[1:-1]
    return core[:1].isalpha() and any(c in b"@4310!57$8*_~^|+" for c in inside) and core[-1:].isalnum()


@dataclass
class Lexicon:
    """Log-odds of words and of word beginnings."""

    words: dict[bytes, float]
    starts: dict[bytes, float]


class Marks(dict):
    """Token -> 0 for a plain one, else the number of its entry in ``info`` (word weight, start weight,
    second person, obfuscated, hit through the obfuscation)."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.info, self.known = lexicon, [(0.0, 0.0, 0, 0, 0)], {}

    def __missing__(self, token: bytes) -> int:
        core = plain_form(token)
        word = self.lexicon.words.get(core, 0.0)
        start = max((self.lexicon.starts.get(x, 0.0) for x in starts_of(core)), default=0.0)
        hidden, through = is_obfuscated(core), 0
        if hidden and not word:
            word = self.lexicon.words.get(revealed_form(core), 0.0)
            through = int(word > 0)
        found = (word, start, int(core.decode("utf-8", "replace") in SECOND_PERSON), int(hidden), through)
        mark = 0
        if any(found):
            mark = self.known.setdefault(found, len(self.info))
            if mark == len(self.info):
                self.info.append(found)
        if len(self) < MEMO_WORDS:
            self[token] = mark
        return mark


def features_of(text: str, marks: Marks) -> list[float]:
    """The values of FEATURES for one text."""
    tokens = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.fromiter(map(marks.__getitem__, tokens), dtype=np.int32, count=n)
    at = np.flatnonzero(codes)
    info = np.array([marks.info[c] for c in codes[at]]).reshape(len(at), 5)
    word, start, person, hidden, through = info.T
    hits = at[(word > 0) | (start > 0)]
    people = at[person > 0]
    near = 0.0
    if len(hits) and len(people):
        right = np.searchsorted(people, hits)
        gap = np.minimum(
            np.abs(people[np.minimum(right, len(people) - 1)] - hits), np.abs(hits - people[np.maximum(right - 1, 0)])
        )
        near = float((1.0 / (1.0 + gap)).max())
    latin = text.encode("latin-1", "replace")
    letters = len(latin.translate(None, _NOT_LETTER))
    return [
        math.log1p(n),
        float((word > 0).sum()),
        100.0 * float((word > 0).sum()) / n,
        float(word.sum()) / math.sqrt(n),
        float(word.max(initial=0.0)),
        float((start > 0).sum()),
        100.0 * float((start > 0).sum()) / n,
        float(start.sum()) / math.sqrt(n),
        float(start.max(initial=0.0)),
        100.0 * len(people) / n,
        near,
        len(latin.translate(None, _NOT_UPPER)) / max(1, letters),
        100.0 * text.count("!") / n,
        len(latin.translate(None, _NOT_PUNCTUATION)) / max(1, len(latin)),
        100.0 * float(hidden.sum()) / n,
        float(through.sum()),
        float(len(hits)),
        float(np.maximum(word, start).sum()),
    ]


def text_features(texts: DataFrame, lexicon: Lexicon, also: str = "") -> DataFrame:
    """``features`` (array of double) for each row; ``also``: further columns to keep, as DDL."""

    def make():
        marks = Marks(lexicon)

        def step(cols: dict) -> dict:
            kept = {k: v for k, v in cols.items() if k != "text"}
            return {**kept, "features": [features_of(t, marks) for t in cols["text"]]}

        return step

    return map_rows(texts, make, f"doc_id long{also}, features array<double>")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From (text, toxic): terms in at least three, and one in a hundred, toxic documents whose log-odds are
    high and sure."""

    def make():
        def step(cols: dict) -> dict:
            counts: dict[tuple, Counter] = {}
            for text, toxic in zip(cols["text"], cols["toxic"]):
                cores = {plain_form(t) for t in text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()}
                counts.setdefault(("word", toxic), Counter()).update(cores)
                counts.setdefault(("start", toxic), Counter()).update({x for c in cores for x in starts_of(c)})
                counts.setdefault(("all", toxic), Counter()).update([b""])
            out: dict = {"kind": [], "term": [], "toxic": [], "n": []}
            for (kind, toxic), found in counts.items():
                for term, n in found.items():
                    for name, value in zip(out, (kind, term, toxic, n)):
                        out[name].append(value)
            return out

        return step

    parts = map_rows(rows.select("text", "toxic"), make, "kind string, term binary, toxic int, n long")
    counts = parts.groupBy("kind", "term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"),
    )
    counts = stage(counts, "toxic-terms")
    totals = counts.where("kind = 'all'").first()
    toxic, clean = totals["t"], totals["c"]
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    sure = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = (
        counts.where("kind <> 'all' and length(term) > 0")
        .where(F.col("t") >= max(3, 0.01 * toxic))
        .select("kind", "term", odds.alias("odds"), sure.alias("sure"))
        .where("odds > 1.5 and sure > 3.5")
        .orderBy(F.desc("sure"), "kind", "term")
        .limit(MAX_TERMS)
        .collect()
    )
    return Lexicon(*({bytes(r["term"]): r["odds"] for r in best if r["kind"] == kind} for kind in ("word", "start")))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Model | None
    curve: Model | None
    share: float  # of label 1, for lack of a model


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 20) -> ToxicityModel:
    """Fit lexicon, trees and calibration on at most ``max_rows`` labelled rows outside the held-out fold."""
    spark: SparkSession = docs.sparkSession
    chosen = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(~held_out("doc_id", FOLDS))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    # The sample is at most max_rows rows of two numbers: a proven bound for the broadcast.
    rows = stage(texts_of(docs).join(F.broadcast(chosen), "doc_id").withColumn("fold", fold.cast("int")), "toxic-rows")
    kinds = {(r["last"], r["toxic"]): r["count"] for r in rows.groupBy((F.col("fold") == 4).alias("last"), "toxic").count().collect()}
    total = sum(kinds.values())
    share = sum(n for (_, toxic), n in kinds.items() if toxic) / total if total else 0.0
    if not (kinds.get((False, 0)) and kinds.get((False, 1))):
        return ToxicityModel(Lexicon({}, {}), None, None, share)
    lexicon = learn_lexicon(rows.where("fold <> 4"))
    found = text_features(rows, lexicon, ", toxic int, fold int")
    found = stage(found.coalesce(spark.sparkContext.defaultParallelism), "toxic-features").select(
        array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), "fold"
    )
    fit = GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.2, seed=7, minInstancesPerNode=5).fit(found.where("fold <> 4"))
    apart = found.where("fold = 4") if kinds.get((True, 0)) and kinds.get((True, 1)) else found
    margins = fit.transform(apart).select(vector_to_array("probability")[1].alias("margin"), "label")
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="level").fit(margins)
    return ToxicityModel(lexicon, fit, curve, share)


def toxicity(docs: DataFrame, model: ToxicityModel, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.5); ``carry``:
    columns of ``docs`` to keep in a struct ``carried``."""
    texts, kept = texts_of(docs, carry), ["carried"] if carry else []
    if model.trees is None:
        scored = texts.select("doc_id", F.lit(model.share).alias("score"), *kept)
    else:
        features = text_features(texts, model.lexicon).withColumn("features", array_to_vector("features"))
        margins = model.trees.transform(features).select("doc_id", vector_to_array("probability")[1].alias("margin"), *kept)
        # The curve is flat in places; a thousandth of the trees' own probability orders those.
        score = 0.999 * F.col("level") + 0.001 * F.col("margin")
        scored = model.curve.transform(margins).select("doc_id", score.alias("score"), *kept)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out("doc_id", FOLDS).alias("held_out"), "score", predicted.alias("predicted"), *kept)
