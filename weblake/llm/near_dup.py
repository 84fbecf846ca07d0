"""MinHash near-dedup: an inverted join over the coordinates of the signatures.

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased); a shorter document
has its whole sequence as the one shingle, a document without words none. Documents with equal sets
form a class and are represented by the smallest doc_id; only representatives go on.

1. Each representative is posted under each of its 64 (coordinate, value) pairs. A link needs M equal
   coordinates, the most that all but 5 in 10^6 links have whose similarity is at the very threshold
   (40 at 0.85, 36 at 0.8; more similar ones are safer). So postings of a value that no other document
   has are dropped, and so are documents with fewer than M shared values.
2. Prefix: in one global order, rarest value first, two documents with M equal coordinates share one
   of the first 64 - M + 1. Only those are merged, so values of very common passages hardly appear.
3. Skip merging: documents of long lists are posted anew by their rarest shingles, as many as the sizes
   of the sets ask for, with what two sets can still have in common from there on; this skips
   documents and pairs that can't link. Then every document of a list is compared with a pivot of the list (the one with the fewest shingles of
   its own). Links found so are joined into components, lists within one component are skipped, and
   in the others only documents outside the commonest component are compared, with those of other
   components. Large groups of near copies thus cost a few comparisons a document, and no link
   between components is lost.
4. Compared pairs must have M equal coordinates and are then confirmed on their full shingle sets.

Components come from minimum labels with pointer jumping, as joins of written tables.

Defined results: null or empty text: an empty set, linked with nothing, kept; rows without doc_id take
no part; of rows repeating a doc_id one counts; ties go to the smallest doc_id; an empty table gives
an empty result; very long texts count whole; other columns are ignored. Sets are compared by 64-bit
hashes of shingles.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.llm.common import HASHES, hold, keyed_texts, lower_words, map_batches, map_rows, mix, stage, window_hashes

COORDINATES = 64
# Share of links at the threshold that may have fewer equal coordinates than are asked for.
MISSED = 5e-6
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_FACTORS = mix(_SEEDS + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
# Lists up to this length are compared without counting shared shingles first.
LONG = 32
# Shingles that are put through all coordinates together.
_BLOCK = 2048


def matches_needed(percent: int) -> int:
    """The most equal coordinates that all but ``MISSED`` of the links at the threshold have."""
    p, missed, needed = percent / 100, 0.0, 0
    while True:
        missed += comb(COORDINATES, needed) * p**needed * (1 - p) ** (COORDINATES - needed)
        if missed > MISSED:
            return max(1, needed)
        needed += 1


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = HASHES.of(lower_words(text))
    if not len(h):
        return h
    if len(h) < width:
        return window_hashes(h, len(h)) ^ np.uint64(len(h))
    return np.unique(window_hashes(h, width))


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the smallest 32-bit value of the shingles."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        np.minimum(out, ((shingles[None, at : at + _BLOCK] ^ _SEEDS) * _FACTORS).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    def make():
        hold(HASHES)

        def step(cols: dict) -> dict:
            sets = [shingle_set(t, width) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "signature": [signature(s).tobytes() for s in sets],
            }

        return step

    return map_rows(texts, make, "doc_id long, n_shingles long, digest binary, signature binary")


def _postings(reps: DataFrame) -> DataFrame:
    """(doc, key) for each coordinate of each representative; key holds coordinate and value."""
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64())])

    def run(batches):
        base = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                values = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
                docs = np.repeat(part.column(0).to_numpy(), COORDINATES)
                keys = (values.astype(np.int64) + base).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(keys)], schema=schema)

    return map_batches(reps.select("doc", "signature"), run, "doc long, key long")


def _prefixes(reps: DataFrame, needed: int) -> DataFrame:
    """(key, doc, n): the lists that are merged."""
    postings = _postings(reps)
    shared = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # At most 64 entries a document.
    live = postings.join(shared, "key").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("own"))
    rare = live.where(F.size("own") >= needed).select(
        "doc", F.explode(F.slice("own", F.lit(1), F.size("own") - (needed - 1))).alias("entry")
    )
    return rare.join(reps.select("doc", "n"), "doc").select(F.col("entry.key").alias("key"), "doc", "n")


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """(doc, shared, own): how many shingles of each doc another doc of ``sets`` has, and those, rarest first."""
    schema = pa.schema([("doc", pa.int64()), ("shingle", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.frombuffer(s, dtype=np.int64) for s in part.column(1).to_pylist()]
                docs = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(np.concatenate(found))], schema=schema)

    rows = map_batches(sets.select("doc", "shingles"), run, "doc long, shingle long")
    common = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    own = rows.join(common, "shingle").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    return own.select("doc", F.size("own").alias("shared"), "own")


def _may_link(percent: int, n1: str, n2: str, cap1: str, cap2: str):
    """Whether sets of these sizes, of which at most ``cap`` shingles can be common, may be similar enough."""
    return F.least(n1, n2, cap1, cap2) * (100 + percent) >= (F.col(n1) + F.col(n2)) * percent


def _lists(posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, doc, n, cap, lone): the lists to compare.

    Lists of up to ``LONG`` documents stay. Documents of longer ones are posted anew, by shingles, rarest
    first: sets of n and m shingles that are similar enough share so many that they meet in one of the
    first few of both, and what stands before it in either order they can't have in common: cap is
    what is left, lone the shingles that no other document of long lists has.
    """
    sizes = posts.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1")
    listed = stage(posts.join(sizes, "key"), "list-sizes")
    short = listed.where(F.col("size") <= LONG).select("key", "doc", "n", F.col("n").alias("cap"), F.lit(0).cast("long").alias("lone"))
    # The smallest set that a document could meet in its long lists.
    long = listed.where(F.col("size") > LONG).groupBy("doc").agg(F.min("n").alias("n"), F.min("least").alias("least"))
    rare = long.join(_rare_shingles(sets.join(long.select("doc"), "doc", "left_semi")), "doc")
    lone = F.col("n") - F.col("shared")
    needed = F.ceil((F.col("n") + F.col("least")) * percent / (100 + percent))
    reach = F.greatest(F.lit(0), F.col("n") - needed + 1 - lone).cast("int")
    rare = rare.select("doc", "n", lone.alias("lone"), F.posexplode(F.slice("own", F.lit(1), reach)).alias("at", "entry"))
    cap = F.col("n") - F.col("lone") - F.col("at")
    return short.unionByName(rare.select(F.col("entry.shingle").alias("key"), "doc", "n", cap.alias("cap"), "lone"))


def _pivot_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Every document of a list with the list's pivot: the one with the smallest share of lone shingles."""
    best = F.struct((F.col("lone") / F.col("n")).alias("rank"), F.col("doc").alias("pivot"), F.col("n").alias("m"), F.col("cap").alias("most"))
    pivots = posts.groupBy("key").agg(F.min(best).alias("p")).select("key", "p.pivot", "p.m", "p.most")
    both = posts.join(pivots, "key").where("doc <> pivot").where(_may_link(percent, "n", "m", "cap", "most"))
    return both.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()


def _cross_pairs(posts: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Documents of one list that are in different components: those outside the list's commonest
    component with all others."""
    named = posts.join(components, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    lists = named.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component").alias("main")
    )
    named = named.join(lists.where("low <> high").select("key", "main"), "key")
    one = named.where("component <> main").select("key", "doc", "n", "cap", "component")
    other = named.select(
        "key",
        F.col("doc").alias("doc2"),
        F.col("n").alias("m"),
        F.col("cap").alias("most"),
        F.col("component").alias("component2"),
    )
    open_ = (F.col("component") != F.col("component2")) & _may_link(percent, "n", "m", "cap", "most")
    both = one.join(other, "key").where(open_)
    return both.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def _alike(pairs: DataFrame, reps: DataFrame, needed: int) -> DataFrame:
    """The pairs with enough equal coordinates."""

    def make():
        def step(cols: dict) -> dict:
            one, two = (np.frombuffer(b"".join(cols[k]), dtype="<u4").reshape(-1, COORDINATES) for k in ("s", "t"))
            good = np.flatnonzero((one == two).sum(axis=1) >= needed)
            return {k: [cols[k][i] for i in good] for k in ("a", "b")}

        return step

    one = reps.select(F.col("doc").alias("a"), F.col("signature").alias("s"))
    two = reps.select(F.col("doc").alias("b"), F.col("signature").alias("t"))
    return map_rows(pairs.join(one, "a").join(two, "b"), make, "a long, b long", slice_rows=2048)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def make():
        def step(cols: dict) -> dict:
            out: dict = {"a": [], "b": []}
            for a, b, s, t in zip(cols["a"], cols["b"], cols["s"], cols["t"]):
                one, two = np.frombuffer(s, dtype="<u8"), np.frombuffer(t, dtype="<u8")
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return step

    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("t"))
    return map_rows(pairs.join(one, "a").join(two, "b"), make, "a long, b long", slice_rows=64)


def connected(links: DataFrame) -> DataFrame:
    """(doc, component): the smallest doc reachable, for each doc with a link."""
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "doc"), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("doc", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(seen, labels.doc == seen.a).select("doc", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("doc").alias("next"), F.col("component").alias("far"))
        moved = stage(
            nearer.join(jump, "next").select("doc", F.least("next", "far").alias("component"), (F.col("component") > F.least("next", "far")).alias("moved")),
            "labels",
        )
        labels = moved.select("doc", "component")
        if moved.where("moved").limit(1).count() == 0:
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept."""
    needed = matches_needed(percent)
    texts = keyed_texts(docs)
    sketches = stage(_sketches(texts, width), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("digest")
    reps = classes.agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("r"))
    reps = stage(
        reps.select("digest", F.col("r.doc_id").alias("doc"), F.col("r.n_shingles").alias("n"), F.col("r.signature").alias("signature")),
        "representatives",
    )
    posts = stage(_prefixes(reps, needed), "prefixes")

    sets = _shingle_sets(texts, posts.select("doc").distinct(), width)
    posts = stage(_lists(posts, sets, percent), "lists")
    first = stage(_alike(_pivot_pairs(posts, percent), reps, needed), "pivot-pairs")
    links = stage(_confirmed(first, sets, percent), "links")
    second = _cross_pairs(posts, connected(links), percent).join(first, ["a", "b"], "left_anti")
    second = stage(_alike(second, reps, needed), "cross-pairs")
    more = stage(_confirmed(second, sets, percent), "more-links")
    components = connected(links.union(more))

    named = reps.select("digest", "doc").join(components, "doc", "left")
    named = named.select("digest", F.coalesce("component", "doc").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", alone.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _shingle_sets(texts: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc, shingles) of the documents that are in a merged list."""

    def make():
        def step(cols: dict) -> dict:
            return {"doc": cols["doc_id"], "shingles": [shingle_set(t, width).astype("<u8").tobytes() for t in cols["text"]]}

        return step

    own = texts.join(docs.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    return stage(map_rows(own, make, "doc long, shingles binary"), "shingle-sets")
