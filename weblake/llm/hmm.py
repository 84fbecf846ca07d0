"""LM scoring with a hidden Markov model over words.

Tokens are the words of a text, A-Z in lower case, and one end. All counts are over the training
documents, those whose crc32(doc_id) mod 10 is not 0; all of them are used.

* Word counts are shuffled sums, kept by 60-bit hashes of words. Words at or above a count threshold,
  at most ``HOT_WORDS`` of them, are sent to the tasks (a bounded table); the occurrences of rarer ones
  are joined with their counts by a shuffle, so no task needs the vocabulary.
* The ``SYMBOLS`` most frequent words and the end are symbols of the model; every other word is emitted
  in two steps: one of ``CLASSES`` classes (by its last character) as the symbol, then the word within its
  class by its smoothed count, with room for one unknown word in each class.
* Baum-Welch: each task adds up expected counts over whole documents (of long ones forward states are kept
  at the edges of blocks of ``BLOCK`` tokens and computed again inside them, so memory is bounded), the sums by
  symbol are aggregated over the partitions, and the new parameters, of fixed size, go into the next pass.
* The score is exact: the scaled forward recursion runs over the whole sequence of each document,
  many documents side by side.

Defined results: null or empty text is the end alone; a null doc_id is a training document; repeated
rows count each time; without training documents every probability falls back to its smoothing; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.llm.common import MEMO_WORDS, held_out, lower_words, map_batches, map_rows, stage, texts_of

FOLDS = 10
HOT_WORDS = 400_000
SYMBOLS = 20_000
CLASSES = 32
STATES = 8
# Tokens whose forward states are held at once, and tokens of documents that are sorted by length together.
BLOCK = 500_000
SORTED = 8_000_000
# Training ends when a pass gains less than this share of the log-likelihood; the bound is generous.
GAIN = 0.01
MOST_PASSES = 50
SMOOTH = 0.1
# Steps after which forward states are scaled; unscaled ones lose under 12 digits of range in a step, of 300.
RESCALE = 8
# The end's hash: no word has it, as words' hashes end in a class below CLASSES.
END = 63


class Hashes(dict):
    """Word -> hash whose low 6 bits are the word's class."""

    def __missing__(self, word: bytes) -> int:
        h = (xxhash.xxh3_64_intdigest(word) & ~63 & 0x7FFFFFFFFFFFFFFF) | (word[-1] * 7 + (word[0] > 127)) % CLASSES
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


_HASHES = Hashes()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[cuts], np.add.reduceat(counts[order], cuts) if len(keys) else counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c) of the tokens of training documents; each task sends a word once a batch of documents."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    def run(batches):
        for batch in batches:
            keys, counts = [], []
            for at in range(0, batch.num_rows, 512):
                found = [_HASHES.of(lower_words(t)) for t in batch.slice(at, 512).column(0).to_pylist()]
                places, own = pd.factorize(np.concatenate([*found, np.full(len(found), END)]))
                keys.append(own)
                counts.append(np.bincount(places))
            if keys:
                sums = _summed(np.concatenate(keys), np.concatenate(counts))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums], schema=schema)

    parts = map_batches(texts.where("not held_out").select("text"), run, "h long, c long")
    return parts.groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks need of the counts: bounded, whatever the size of the corpus."""

    tokens: int  # N
    distinct: int  # V
    ends: int  # occurrences of the end
    hashes: np.ndarray  # of hot words, sorted
    counts: np.ndarray
    symbol: np.ndarray  # of hot words; CLASSES or more: a symbol of its own
    symbols: int
    class_mass: np.ndarray  # smoothed count of the words of each class that have no symbol of their own
    cold_below: int  # words with fewer occurrences aren't hot

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is hot, count if hot, symbol) of word hashes."""
        cls = h & 63
        if not len(self.hashes):
            return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64), cls
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hot = self.hashes[at] == h
        return hot, np.where(hot, self.counts[at], 0), np.where(hot, self.symbol[at], cls)


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    ends = F.sum(F.when(F.col("h") == END, F.col("c")))
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), ends.alias("ends")).first()
    # How many words have at least so many occurrences, by twelfths of doublings.
    step = F.floor(F.log2("c") * 12).cast("int")
    levels = counts.groupBy(step.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level"))
    have, below = 0, None
    for row in levels.collect():  # a few hundred rows
        if have + row["n"] > HOT_WORDS:
            break
        have, below = have + row["n"], row["least"]
    hot = counts.where(F.col("c") >= (below if below is not None else F.lit(0))) if have else counts.limit(0)
    table = hot.toPandas().sort_values("h")  # at most HOT_WORDS rows
    hashes, n = table["h"].to_numpy(np.int64), table["c"].to_numpy(np.int64)
    order = np.lexsort((hashes, -n))
    own = order[: SYMBOLS]
    own = own[hashes[own] != END]
    symbol = (hashes & 63).copy()
    symbol[own] = CLASSES + 1 + np.arange(len(own))
    symbol[hashes == END] = CLASSES
    mass = counts.where(F.col("h") != END).groupBy(F.col("h").bitwiseAND(63).alias("k")).agg(F.sum(F.col("c") + SMOOTH).alias("m"))
    class_mass = np.full(CLASSES, SMOOTH)
    for row in mass.collect():
        class_mass[row["k"]] += row["m"]
    np.subtract.at(class_mass, hashes[own] & 63, n[own] + SMOOTH)
    class_mass = np.maximum(class_mass, SMOOTH)
    return Vocabulary(
        totals["n"] or 0, totals["v"], totals["ends"] or 0, hashes, n, symbol.astype(np.int32), CLASSES + 1 + len(own), class_mass,
        below if below is not None else 1 << 62,
    )


def encode(texts: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base, inner, symbols, cold) with the hot part of the sums.

    ``symbols``: packed 16-bit numbers; ``cold``: hashes of words whose count isn't at hand;
    ``inner``: the log10 probability of hot words within their classes.
    """
    sent = texts.sparkSession.sparkContext.broadcast(words)
    scale = np.log10(words.tokens + SMOOTH * (words.distinct + 1))

    def make():
        table = sent.value

        def step(cols: dict) -> dict:
            found = [np.append(_HASHES.of(lower_words(t)), END) for t in cols["text"]]
            ends = np.cumsum([len(f) for f in found])
            h = np.concatenate(found)
            back, unique = pd.factorize(h)
            hot, count, symbol = (x[back] for x in table.look_up(unique))
            symbol, count = np.where(h == END, CLASSES, symbol), np.where(h == END, table.ends, count)
            base = np.log10(count + SMOOTH) - scale
            in_class = hot & (symbol < CLASSES)
            inner = np.where(in_class, np.log10(count + SMOOTH) - np.log10(table.class_mass[np.minimum(symbol, CLASSES - 1)]), 0.0)
            # The end's count is always at hand.
            cold = ~hot & (h != END)
            out: dict = {k: [] for k in ("n_tokens", "n_known", "base", "inner", "symbols", "cold")}
            for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends):
                here, mask = slice(lo, hi), cold[lo:hi]
                out["n_tokens"].append(int(hi - lo))
                out["n_known"].append(int((count[here] > 0).sum()))
                out["base"].append(float(base[here][~mask].sum()))
                out["inner"].append(float(inner[here].sum()))
                out["symbols"].append(symbol[here].astype("<u2").tobytes())
                out["cold"].append(h[here][mask].tolist())
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], **out}

        return step

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, symbols binary, cold array<long>"
    return map_rows(texts, make, schema)


def cold_sums(encoded: DataFrame, counts: DataFrame, words: Vocabulary) -> DataFrame:
    """(row, n_known, base, inner) of the words that had no count at hand."""
    scale = float(np.log10(words.tokens + SMOOTH * (words.distinct + 1)))
    mass = F.array([F.lit(float(m)) for m in words.class_mass])
    rare = encoded.select("row", F.explode("cold").alias("h"))
    known = counts.where(F.col("c") < words.cold_below)
    c = F.coalesce("c", F.lit(0))
    log_count = F.log10(c + SMOOTH)
    within = log_count - F.log10(F.get(mass, F.col("h").bitwiseAND(63).cast("int")))
    return rare.join(known, "h", "left").groupBy("row").agg(
        F.sum((c > 0).cast("long")).alias("more_known"),
        F.sum(log_count - scale).alias("more_base"),
        F.sum(within).alias("more_inner"),
    )


@dataclass
class Chain:
    start: np.ndarray  # state
    move: np.ndarray  # state x state
    emit: np.ndarray  # symbol x state


def first_chain(symbols: int, states: int) -> Chain:
    """States that last, and symbols that lean to some of them by fixed chance; from a more even start the first passes
    gain little and look like the end."""
    lean = np.random.default_rng(11).random((symbols, states)) ** 4 + 0.02
    move = np.full((states, states), 1.0 / states) + 4 * np.eye(states)
    return Chain(np.full(states, 1.0 / states), move / move.sum(1, keepdims=True), lean / lean.sum(0))


def _side_by_side(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents in descending length, and how many of them are still going at each step."""
    order = np.argsort(-lengths, kind="stable")
    running = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
    return order, running


def _by_step(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols step after step over sequences in descending length; also that order and the running counts."""
    lengths = np.array([len(s) for s in sequences])
    order, running = _side_by_side(lengths)
    flat, starts = np.concatenate(sequences), np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    step = np.repeat(np.arange(len(running)), running)
    within = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(running)[:-1]]), running)
    return flat[starts[within] + step], order, running


def _unit_rows(chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of each symbol that sum to 1 over the states, and the sums."""
    sums = chain.emit.sum(1)
    return chain.emit / sums[:, None], sums


def _scaled_from(running: np.ndarray) -> list[int]:
    """The row of each step from which on states are scaled: all of every ``RESCALE``th step, else what ends there."""
    ends = np.append(running[1:], 0)
    ends[RESCALE - 1 :: RESCALE] = 0
    return ends.tolist()


def log_likelihood(sequences: list[np.ndarray], chain: Chain) -> np.ndarray:
    """log10 probability of each sequence by the scaled forward recursion."""
    symbols, order, running = _by_step(sequences)
    unit, sums = _unit_rows(chain)
    emit, logs = unit[symbols], np.log10(sums)[symbols]
    total = np.zeros(len(sequences))
    state, at = np.broadcast_to(chain.start, (len(sequences), len(chain.start))), 0
    for t, (n, scaled) in enumerate(zip(running.tolist(), _scaled_from(running))):
        state = (state[:n] if t == 0 else state[:n] @ chain.move) * emit[at : at + n]
        total[:n] += logs[at : at + n]
        if scaled < n:
            scale = state[scaled:].sum(1)
            state[scaled:] /= scale[:, None]
            total[scaled:n] += np.log10(scale)
        at += n
    out = np.empty(len(sequences))
    out[order] = total
    return out


def _blocks(running: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of steps with at most ``BLOCK`` tokens each, or of one step."""
    edges, out, lo = np.concatenate([[0], np.cumsum(running)]), [], 0
    while lo < len(running):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BLOCK, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def expected_counts(sequences: list[np.ndarray], chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Start, move and emission counts by forward-backward (emissions for the distinct symbols returned), and the
    log10 probability of all sequences."""
    symbols, _, running = _by_step(sequences)
    edges, states = np.concatenate([[0], np.cumsum(running)]), len(chain.start)
    blocks = _blocks(running)
    unit, sums = _unit_rows(chain)
    seen = np.bincount(symbols, minlength=len(unit))
    used, back = np.flatnonzero(seen), (np.cumsum(seen > 0) - 1)[symbols]
    moves, emissions = np.zeros_like(chain.move), np.zeros((len(used), states))
    scaled = _scaled_from(running)

    def forward(first: int, last: int, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
        """Emissions over scales and scaled forward states of the steps, from the state before them; the sum of log10 scales."""
        base, logs = edges[first], 0.0
        emit = unit[symbols[base : edges[last]]]
        alpha = np.empty_like(emit)
        for t in range(first, last):
            here, own = alpha[edges[t] - base : edges[t + 1] - base], emit[edges[t] - base : edges[t + 1] - base]
            if state is None:
                np.multiply(chain.start, own, out=here)
            else:
                np.matmul(state[: len(here)], chain.move, out=here)
                here *= own
            if scaled[t] < len(here):
                scale = here[scaled[t] :].sum(1)
                here[scaled[t] :] /= scale[:, None]
                own[scaled[t] :] /= scale[:, None]
                logs += float(np.log10(scale).sum())
            state = here
        return emit, alpha, logs

    # The state before each block; the last block's forward states are used as they are.
    before: list[np.ndarray | None] = [None]
    for first, last in blocks[:-1]:
        alpha = forward(first, last, before[-1])[1]
        before.append(alpha[edges[last - 1] - edges[first] :].copy())
    beta = np.ones((running[-1], states))  # of the step at hand, without what ends there
    likelihood = float((seen[used] * np.log10(sums[used])).sum())
    for (first, last), state in zip(reversed(blocks), reversed(before)):
        base = edges[first]
        emit, gamma, logs = forward(first, last, state)
        likelihood += logs
        for t in range(last - 1, -1 if first == 0 else first - 1, -1):
            n, lo = running[t], edges[t] - base
            # A step's forward states were used for the moves from it; now they become its posterior.
            gamma[lo : lo + n] *= beta
            if t == 0:
                break
            next_ = emit[lo : lo + n] * beta
            ahead = gamma[edges[t - 1] - base :][:n] if t > first else state[:n]
            moves += ahead.T @ next_
            beta = np.empty((running[t - 1], states))
            np.matmul(next_, chain.move.T, out=beta[:n])
            beta[n:] = 1.0
        here = back[base : edges[last]]
        for s in range(states):
            emissions[:, s] += np.bincount(here, gamma[:, s], len(used))
    return gamma[: running[0]].sum(0), moves * chain.move, used, emissions, likelihood


def _unpacked(cells: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(c, dtype="<u2").astype(np.int32) for c in cells]


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Documents of like lengths together, about ``BLOCK`` tokens at a time; a longer one is alone."""

    def dealt(cells: list[bytes]) -> Iterator[list[np.ndarray]]:
        pending, size = [], 0
        for cell in sorted(cells, key=len, reverse=True):
            if pending and 2 * BLOCK < size + len(cell):
                yield _unpacked(pending)
                pending, size = [], 0
            pending.append(cell)
            size += len(cell)
        if pending:
            yield _unpacked(pending)

    cells, size = [], 0
    for batch in batches:
        for cell in batch.column(0):
            cells.append(cell.as_py())
            size += len(cells[-1])
            if size > 2 * SORTED:
                yield from dealt(cells)
                cells, size = [], 0
    yield from dealt(cells)


def baum_welch(encoded: DataFrame, symbols: int, states: int = STATES, passes: int = MOST_PASSES, gain: float = GAIN) -> tuple[Chain, list[float]]:
    """The chain after passes over all training documents, and their log10 likelihood before each pass.

    Symbol -1 carries the starts, -2 - s the moves from state s, the next lower one the likelihood.
    """
    names = [f"s{i}" for i in range(states)]
    schema = pa.schema([("symbol", pa.int32()), *((n, pa.float64()) for n in names)])
    ddl = "symbol int, " + ", ".join(f"{n} double" for n in names)
    training = encoded.where("not held_out").select("symbols")
    context = encoded.sparkSession.sparkContext
    chain, course = first_chain(symbols, states), []
    for _ in range(passes):
        sent = context.broadcast(chain)

        def run(batches, sent=sent):
            chain = sent.value
            start, move, emit, any_ = np.zeros(states), np.zeros((states, states)), np.zeros_like(chain.emit), False
            likelihood = np.zeros(states)
            for group in _whole_documents(batches):
                a, b, used, c, probability = expected_counts(group, chain)
                start, move, any_ = start + a, move + b, True
                likelihood[0] += probability
                emit[used] += c
            if any_:
                seen = np.flatnonzero(emit.any(1))
                rows = np.concatenate([start[None], move, likelihood[None], emit[seen]])
                keys = np.concatenate([[-1], -2 - np.arange(states + 1), seen]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(rows[:, s].copy()) for s in range(states))], schema=schema)

        sums = map_batches(training, run, ddl).groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names))
        found = sums.toPandas().set_index("symbol")  # a row for each symbol: bounded by SYMBOLS
        if not len(found):
            break
        course.append(float(found.at[-2 - states, "s0"]))
        whole = found.reindex([*range(-1 - states, 0), *range(symbols)], fill_value=0.0).to_numpy()
        start, move, emit = whole[states], whole[:states][::-1], whole[states + 1 :]
        start, move, emit = start + 1e-3, move + 1e-3, emit + SMOOTH / states
        chain = Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        if len(course) > 1 and course[-1] - course[-2] < gain * -course[-2]:
            break
    return chain, course


def hmm_scores(docs: DataFrame, states: int = STATES, passes: int = MOST_PASSES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = texts_of(docs).withColumn("held_out", held_out("doc_id", FOLDS))
    counts = stage(word_counts(texts), "word-counts")
    words = learn_vocabulary(counts)
    encoded = stage(encode(texts, words).withColumn("row", F.monotonically_increasing_id()), "symbols")
    chain, _ = baum_welch(encoded, words.symbols, states, passes)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, row long, chain double"

    def make():
        def step(cols: dict) -> dict:
            chain = log_likelihood(_unpacked(cols.pop("symbols")), sent.value).tolist()
            return {**cols, "chain": chain}

        return step

    plain = encoded.select("doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "row", "symbols")
    scored = map_rows(plain, make, schema, slice_rows=4000)
    joined = scored.join(cold_sums(encoded, counts, words), "row", "left").fillna(0)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"),
        (F.col("chain") + F.col("inner") + F.col("more_inner")).alias("score"),
    )
