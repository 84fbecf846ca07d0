"""Spelling variants: near words by a relational trie frontier, grouped under their frequent form.

1. Count the runs of letters of all texts (partial counts per task, then a shuffled sum); words occurring
   ``MIN_COUNT`` times or more are the vocabulary.
2. Two tries as one edge table: a node is a prefix of a word (mark ``>``) or of a reversed word (``<``); its edges, the letters
   that may follow, are grouped by the letter after them and by how many letters words go on with.
3. States (word, position, node, edited) move down, level by level, by joining them with the edges, until none
   is left. An edit spares one half of a word: the frontier of ``>`` starts at the node of a word's
   first half, that of ``<`` at the node of its reversed second half, so crowded nodes near the root are never met.
   An unedited state follows its word, replaces its letter by a greater one of the node, or leaves it
   out; an edited one must follow. Only edges are met that lead on by the word's next letter to the length it needs.
   One that ends where a word ends has found a near word. Insertion and
   replacement by a smaller letter are the same links seen from the other word, so links are read both ways.
4. A word's form is its near word of largest count, if large enough; roots follow forms by pointer doubling
   (counts grow at least by ``RATIO`` a step, so few rounds).

Levels are as many as half of the longest word has letters. Words of ``LONG`` letters or more don't go through
the trie: the rolling 127-bit hashes of their one-letter deletions are joined instead, which finds the same links.

No join has more than one row a key on the side of the edges or of the counts, so a crowded node is only a
large run of states, which Spark splits.

Defined results: null or empty text: no words; a row without doc_id counts with an empty doc_id in the hash; repeated
rows count each time; very long texts and words count whole; ties go to the smallest in code-point order; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.llm.common import map_batches, stage, texts_of
from weblake.session import discard, scratch_path, stage_table

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
LONG = 64
DAMAGE = 31

# States above which a level's join is by shuffle in any case.
SHUFFLED_STATES = 200_000

# Words that a task counts before it hands the counts on, and documents it reads at a time.
HELD_WORDS = 200_000
SLICE = 64

_LOWER = {c: c + 32 for c in range(65, 91)}
_PRIME = (1 << 127) - 1
_BASE = 0x5DEECE66D1B54A32D192ED03


def damaged_counts(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """The words of one document and how often they occur, every 31st (by hash) with a letter gone."""
    runs = Counter(m.group() for m in re.finditer(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}", text.translate(_LOWER)))
    prefix = f"{'' if doc_id is None else doc_id}:"
    for run, n in runs.items():
        h = zlib.crc32((prefix + run).encode())
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LENGTH:
            yield run, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n: the words of ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences or more."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for word, n in damaged_counts(doc_id, text):
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield given()
        yield given()

    parts = map_batches(texts_of(docs), counts, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _oriented(words: DataFrame) -> DataFrame:
    """Each word as it is and reversed, with the mark of its trie and the position where its frontier starts."""
    half = F.length("word").cast("int")
    forms = F.array(
        F.struct(F.lit(">").alias("mark"), F.col("word").alias("word"), F.floor(half / 2).cast("int").alias("pos")),
        F.struct(F.lit("<").alias("mark"), F.reverse("word").alias("word"), F.ceil(half / 2).cast("int").alias("pos")),
    )
    return words.select(F.inline(forms))


# What an edge is looked up by: the node it leaves, how many letters come after it, and the first of them. As a number, which
# joins fast; a clash only lets a state live that finds no word in the end.
_KEY = "xxhash64({node}, {to_come}, {then})"


def trie_edges(words: DataFrame) -> DataFrame:
    """key, depth, and letters, in order: the edges of a node that lead on by a given letter to a word of a given length.

    A word's last node is a key with -1 letters to come and no edges.
    """
    shallowest = F.when(F.col("mark") == ">", MIN_LENGTH // 2).otherwise(MIN_LENGTH - MIN_LENGTH // 2)
    depths = F.explode(F.sequence(shallowest, F.length("word"))).alias("depth")
    prefixes = _oriented(words).select("mark", "word", depths)
    parts = {"to_come": "length(word) - depth - 1", "then": "substring(word, depth + 2, 1)", "node": "concat(mark, substring(word, 1, depth))"}
    edges = prefixes.select(F.expr(_KEY.format(**parts)).alias("key"), "depth", F.expr("substring(word, depth + 1, 1)").alias("letter"))
    letters = F.array_join(F.array_sort(F.collect_set("letter")), "").alias("letters")
    return edges.groupBy("key").agg(F.max("depth").alias("depth"), letters)


# What a state does, one character each: follow its word (>), leave its letter out (-), or replace it by that letter.
_DEEDS = """case
 when edited then if(here = '' or instr(letters, here) > 0, '>', '')
 else concat(if(after = '', '', '>'), if(here = after, '', '-'), substring(letters, instr(letters, here) + 1)) end"""


def _moved(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level on, ``found`` being those that have come to the end of a word with their edit.

    The key has looked one letter ahead, so an edited state has two letters behind it.
    """
    near = [F.expr(f"substring(word, pos + {i}, 1)").alias(name) for i, name in ((1, "here"), (2, "after"))]
    asked = frontier.select("word", "pos", "node", "edited", *near)
    key = F.expr(_KEY.format(to_come="length(word) - pos - 1", then="after", node="node")).alias("key")
    met = asked.select("*", key).join(edges, "key").withColumn("deeds", F.expr(_DEEDS)).where("deeds <> ''")
    each = met.select("word", "pos", "node", "edited", "here", "after", "deeds", F.explode(F.expr("sequence(1, length(deeds))")).alias("i"))
    deeds = each.select("word", "pos", "node", "edited", "here", "after", F.expr("substring(deeds, i, 1)").alias("deed"))
    return deeds.select(
        "word",
        F.expr("if(deed = '-' or (deed = '>' and not edited), pos + 1, least(pos + 2, length(word)))").alias("pos"),
        F.expr(
            "case when deed = '-' then node when deed = '>' and not edited then concat(node, here)"
            " when deed = '>' then concat(node, here, after) else concat(node, deed, after) end"
        ).alias("node"),
        F.expr("edited or deed <> '>'").alias("edited"),
        F.expr("deed <> '-' and (edited or deed <> '>') and pos + 2 >= length(word)").alias("found"),
    )


def trie_links(words: DataFrame) -> DataFrame:
    """Links (word, near) between words, each once or more, in one direction."""
    spark = words.sparkSession
    edges = stage(trie_edges(words), "trie")
    frontier = _oriented(words).select(
        "word", "pos", F.expr("concat(mark, substring(word, 1, pos))").alias("node"), F.lit(False).alias("edited")
    )
    links, before, depth = None, None, 0
    while states := frontier.count():
        level = scratch_path(spark, "frontier")
        # A state's node grows with each level but one, so edges further up are not asked for any more.
        below = edges.where(F.col("depth") >= MIN_LENGTH // 2 - 1 + depth).drop("depth")
        # Edges have one row a key, so they are hashed and neither side is sorted; few states are sent to the edges
        # if Spark measures them as small.
        below = below.hint("shuffle_hash") if states > SHUFFLED_STATES else below
        moved = stage_table(_moved(frontier, below), level)
        found = stage(moved.where("found").select("word", "node"), "found")
        links = found if links is None else links.unionByName(found)
        if before:
            discard(spark, before)
        frontier, before, depth = moved.where("not found").drop("found"), level, depth + 1
    if before:
        discard(spark, before)
    if links is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    turned = F.startswith("node", F.lit("<"))
    return links.select(
        F.when(turned, F.reverse("word")).otherwise(F.col("word")).alias("word"),
        F.expr("if(startswith(node, '<'), reverse(substring(node, 2)), substring(node, 2))").alias("near"),
    )


def _deletion_hashes(word: str) -> Iterator[int]:
    """Hashes of the word without its letter 0, 1, ... by one pass from either side."""
    ahead = [0]
    for c in word:
        ahead.append((ahead[-1] * _BASE + ord(c)) % _PRIME)
    rest, power, out = 0, 1, []
    for i in range(len(word) - 1, -1, -1):
        out.append((ahead[i] * power + rest) % _PRIME)
        rest = (rest + ord(word[i]) * power) % _PRIME
        power = power * _BASE % _PRIME
    yield from reversed(out)
    yield ahead[-1]


def long_links(words: DataFrame) -> DataFrame:
    """Links (word, near) between long words, by the hashes of their one-letter deletions."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column("word").to_pylist():
                keys = [f"{h:032x}" for h in _deletion_hashes(word)]
                own = keys.pop()
                for at in range(0, len(keys), 100_000):
                    part = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({"id": [own] * len(part), "at": range(at, at + len(part)), "key": part})

    rows = stage(map_batches(words.select("word"), hashes, "id string, at long, key string"), "deletions")
    own = rows.select("id").distinct()
    shorter = rows.join(own.withColumnRenamed("id", "other"), F.col("key") == F.col("other")).select("id", "other")
    right = rows.select(F.col("id").alias("other"), "at", "key")
    replaced = rows.join(right, ["at", "key"]).where("id < other").select("id", "other")

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            ids = [f"{_own_hash(word):032x}" for word in names]
            yield pa.RecordBatch.from_pydict({"id": ids, "word": names})

    named = stage(map_batches(words.select("word"), identified, "id string, word string"), "long-words")
    near = named.select(F.col("id").alias("other"), F.col("word").alias("near"))
    pairs = shorter.unionByName(replaced).distinct()
    return pairs.join(named, "id").join(near, "other").select("word", "near")


def _own_hash(word: str) -> int:
    h = 0
    for c in word:
        h = (h * _BASE + ord(c)) % _PRIME
    return h


def near_words(words: DataFrame) -> DataFrame:
    """Links (word, near, near_n), every one in both directions and once."""
    links = trie_links(words.where(F.length("word") < LONG))
    long = words.where(F.length("word") >= LONG - 1)
    if not long.isEmpty():
        # Links between two words just below the limit are the trie's.
        links = links.unionByName(long_links(long).where(F.length("word") + F.length("near") >= 2 * LONG - 1))
    links = links.distinct()
    both = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return links.select(F.inline(both)).join(counts, "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each word that has a form."""
    reached = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = reached.join(further, "root", "left")
        moved = stage(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of the vocabulary."""
    words = stage(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near"))).alias("best")
    near = stage(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best), "near-words")
    joined = words.join(near, "word", "left")
    large = -F.col("best.minus_n") >= RATIO * F.col("n")
    out = joined.select(
        "word",
        F.when(large, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(large, -F.col("best.minus_n")).alias("form_n"),
    )
    found = roots(out.where("form is not null"))
    return out.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
