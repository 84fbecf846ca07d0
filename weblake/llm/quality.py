"""Quality rules: a linear-chain conditional random field marks each line content or boilerplate.

Each line with a word gets binary features; Viterbi decoding finds the likeliest sequence of the two
labels over the whole document, and the share of the document's characters in content lines decides.

Training: a bounded sample of documents labelled for quality (``max_docs``, chosen by a hash of the
id) with all of their lines, in sequences of at most ``SEQUENCE``. Lines start with the label of
their document; after a first fit, lines of bad documents that the field finds to be content are
relabelled and it is fitted again. The threshold of the share is fitted on the same sample.
Without labels of both kinds no line is boilerplate.

Defined results: null or empty text has no words and base-fails; very long texts are decoded whole;
repeated rows are judged alike; an empty table gives an empty result; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.llm.common import HASHES, map_rows, texts_of, window_hashes, words

SYMBOLS = "#*$%&|<>"
_LATIN = bytes(range(256))
_UPPER = bytes(b for b in _LATIN if chr(b).isupper())
_LETTER = bytes(b for b in _LATIN if chr(b).isalpha())
_NOT_UPPER = bytes(set(_LATIN) - set(_UPPER))
_NOT_LETTER = bytes(set(_LATIN) - set(_LETTER))
_NOT_SYMBOL = bytes(set(_LATIN) - set(SYMBOLS.encode()))
_NOT_DIGIT = bytes(set(_LATIN) - set(b"0123456789"))
_CLOSERS = (".", "!", "?", ":", ";", '"', "'", "»", "”", ")")

FEATURES = [
    "bias", "first", "last", "few_words", "many_words", "closed", "some_symbols", "many_symbols", "half_upper",
    "all_upper", "pipes", "exclaims", "digits", "half_distinct", "few_distinct", "repeated_line", "opens_lower",
    "address", "long_words", "no_letters",
]


def line_features(lines: list[str]) -> np.ndarray:
    """One row of FEATURES (0 or 1) for each line; every line has a word."""
    out = np.zeros((len(lines), len(FEATURES)), dtype=np.uint8)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        latin = line.encode("latin-1", "replace")
        tokens = line.split()
        n, chars = max(1, len(tokens)), max(1, len(latin))
        letters = len(latin.translate(None, _NOT_LETTER))
        upper = len(latin.translate(None, _NOT_UPPER))
        symbols = len(latin.translate(None, _NOT_SYMBOL))
        distinct = len(set(tokens)) / n
        out[i] = (
            1,
            i == 0,
            i == len(lines) - 1,
            n < 4,
            n >= 20,
            line.rstrip().endswith(_CLOSERS),
            symbols * 50 > chars,
            symbols * 8 > chars,
            upper * 2 > letters,
            upper * 10 > letters * 9,
            line.count(" | ") * 4 >= n,
            line.count("!") * 3 > n,
            len(latin.translate(None, _NOT_DIGIT)) * 5 > chars,
            n >= 6 and distinct < 0.6,
            n >= 6 and distinct < 0.3,
            line in seen,
            line.lstrip()[:1].islower(),
            "@" in line or "://" in line or "www." in line,
            chars > 14 * n,
            letters == 0,
        )
        seen.add(line)
    return out


def worded_lines(text: str) -> list[str]:
    """The lines (parted at \\n) that hold a word."""
    return [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]


@dataclass
class LineField:
    """A linear-chain CRF with the labels 0 content, 1 boilerplate."""

    weights: np.ndarray  # label x feature
    moves: np.ndarray  # label x label
    min_share: float  # of characters in content lines

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest label of each line, ties to content."""
        scores = features @ self.weights.T
        best, back = scores[0], np.zeros((len(scores), 2), dtype=np.int8)
        for t in range(1, len(scores)):
            paths = best[:, None] + self.moves
            back[t] = paths.argmax(0)
            best = paths.max(0) + scores[t]
        labels = np.empty(len(scores), dtype=np.int8)
        labels[-1] = int(best[1] > best[0])
        for t in range(len(scores) - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels

    def content_share(self, lines: list[str]) -> float:
        """Share of the lines' characters that is content; no lines: 0."""
        if not lines:
            return 0.0
        size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        return float(size[self.decode(line_features(lines)) == 0].sum() / size.sum())


def _expected(scores: np.ndarray, moves: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label posteriors and expected moves of padded sequences (document x line x label)."""
    docs, longest, _ = scores.shape
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, longest):
        forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1]) + scores[:, t]
    for t in range(longest - 2, -1, -1):
        ahead = scores[:, t + 1] + backward[:, t + 1]
        new = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
        backward[:, t] = np.where((t + 1 < length)[:, None], new, 0.0)
    last = forward[np.arange(docs), length - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])[:, None, None]
    inside = np.arange(longest)[None, :] < length[:, None]
    posterior = np.exp(np.minimum(forward + backward - total, 0.0)) * inside[:, :, None]
    pair = forward[:, :-1, :, None] + moves + (scores + backward)[:, 1:, None, :] - total[..., None]
    return posterior, (np.exp(np.minimum(pair, 0.0)) * inside[:, 1:, None, None]).sum((0, 1))


# Lines of a training sequence: nearly all documents are one.
SEQUENCE = 256


def _by_length(features: list[np.ndarray], bad: np.ndarray) -> list[tuple]:
    """(features, line labels, document marks, is a line, lengths) of whole documents, padded to twice their lines at most."""
    groups: dict[int, list[int]] = {}
    for i, f in enumerate(features):
        groups.setdefault(max(len(f), 4).bit_length(), []).append(i)
    out = []
    for _, of in sorted(groups.items()):
        length = np.array([len(features[i]) for i in of])
        x = np.zeros((len(of), length.max(), len(FEATURES)))
        for row, i in enumerate(of):
            x[row, : length[row]] = features[i]
        inside = np.arange(x.shape[1])[None, :] < length[:, None]
        out.append((x, np.where(inside, bad[of][:, None], 0).astype(np.int8), bad[of], inside, length))
    return out


def fit_field(features: list[np.ndarray], bad: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> tuple:
    """Weights and moves by gradient ascent on the likelihood of the lines' labels, twice (see above)."""
    batches = _by_length(features, bad)
    lines = sum(int(length.sum()) for _, _, _, _, length in batches)
    weights, moves = np.zeros((2, len(FEATURES))), np.zeros((2, 2))
    for fit in range(2):
        hot = [np.eye(2)[y] * inside[:, :, None] for _, y, _, inside, _ in batches]
        seen_w = sum(np.einsum("dtl,dtf->lf", h, x) for h, (x, *_) in zip(hot, batches))
        seen_m = sum(np.einsum("dti,dtj->ij", h[:, :-1], h[:, 1:]) for h in hot)
        params, grad1, grad2 = np.concatenate([weights.ravel(), moves.ravel()]), 0.0, 0.0
        for step in range(1, steps + 1):
            weights, moves = params[:-4].reshape(2, -1), params[-4:].reshape(2, 2)
            gap_w, gap_m = seen_w, seen_m
            for x, _, _, _, length in batches:
                posterior, pairs = _expected(x @ weights.T, moves, length)
                gap_w, gap_m = gap_w - np.einsum("dtl,dtf->lf", posterior, x), gap_m - pairs
            gap = np.concatenate([gap_w.ravel(), gap_m.ravel()]) / lines - ridge * params
            grad1, grad2 = 0.9 * grad1 + 0.1 * gap, 0.99 * grad2 + 0.01 * gap**2
            params = params + 0.1 * (grad1 / (1 - 0.9**step)) / (np.sqrt(grad2 / (1 - 0.99**step)) + 1e-9)
        weights, moves = params[:-4].reshape(2, -1), params[-4:].reshape(2, 2)
        if fit == 0:
            # Without the moves: what a line of a bad document looks like by itself.
            for batch in batches:
                x, y, marked, inside, _ = batch
                alone = x @ (weights[1] - weights[0])
                y[:] = np.where(inside & (marked[:, None] == 1) & (alone > 0), 1, 0)
    return weights, moves


def learn_field(docs: DataFrame, labels: DataFrame, max_docs: int = 2500) -> LineField:
    """Fit the field and its threshold on all lines of at most ``max_docs`` documents with a label ``quality``."""
    sample = (
        labels.where("quality is not null and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )

    def lines_of():
        def step(cols: dict) -> dict:
            out: dict = {"bad": [], "features": [], "sizes": []}
            for text, bad in zip(cols["text"], cols["bad"]):
                if lines := worded_lines(text):
                    out["bad"].append(bad)
                    out["features"].append(line_features(lines).tobytes())
                    out["sizes"].append(np.array([len(x) for x in lines], dtype="<i4").tobytes())
            return out

        return step

    # The sample is at most max_docs rows of two numbers: a proven bound for the broadcast.
    joined = texts_of(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "bad")
    found = map_rows(joined, lines_of, "bad int, features binary, sizes binary").toPandas()
    if found["bad"].nunique() < 2:
        return LineField(np.zeros((2, len(FEATURES))), np.zeros((2, 2)), 0.0)
    features = [np.frombuffer(f, dtype=np.uint8).reshape(-1, len(FEATURES)) for f in found["features"]]
    bad = found["bad"].to_numpy()
    # Longer documents train as several sequences.
    parts = [(f[at : at + SEQUENCE], b) for f, b in zip(features, bad) for at in range(0, len(f), SEQUENCE)]
    field = LineField(*fit_field([f for f, _ in parts], np.array([b for _, b in parts])), 0.0)
    sizes = [np.frombuffer(s, dtype="<i4") for s in found["sizes"]]
    share = np.array([s[field.decode(f) == 0].sum() / s.sum() for f, s in zip(features, sizes)])
    field.min_share = _threshold(share, bad)
    return field


def _threshold(share: np.ndarray, bad: np.ndarray) -> float:
    """The share under which documents are rejected: fewest errors, a lost good document counting twice."""
    cuts = np.linspace(0.02, 0.9, 45)
    cost = [2 * ((share < c) & (bad == 0)).mean() + ((share >= c) & (bad == 1)).mean() for c in cuts]
    best = np.flatnonzero(np.isclose(cost, min(cost)))
    return float(cuts[best[len(best) // 2]])


def repeat_words(tokens: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    grams = window_hashes(HASHES.of(tokens), width)
    if len(grams) < 2:
        return 0
    _, where, counts = np.unique(grams, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def line_quality(docs: DataFrame, field: LineField, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share and kept; ``carry``: columns of ``docs`` to keep in a struct ``carried``."""

    def judge():
        def step(cols: dict) -> dict:
            out: dict = {k: [] for k in names}
            for text in cols["text"]:
                tokens, lines = words(text), worded_lines(text)
                repeats, n = repeat_words(tokens), len(tokens)
                failed = n < 10 or 100 * repeats > 20 * n
                share = field.content_share(lines)
                spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
                row = (n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats,
                       failed, share, not failed and share >= field.min_share)
                for name, value in zip(names, row):
                    out[name].append(value)
            return {"doc_id": cols["doc_id"], **out}

        return step

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, content_share double, kept boolean"
    )
    return map_rows(texts_of(docs, carry), judge, schema)
