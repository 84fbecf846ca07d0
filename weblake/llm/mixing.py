"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: sources in code-point order (null last) weigh ``WEIGHTS``, repeating, and share ``SHARE`` of all words;
   what exceeds ``EPOCHS`` times a source's size is shared anew by weight until none is above.
2. A source's documents, in the order of a hash of their ids, are one sequence of words, cut into equal blocks of about
   ``BLOCK`` words. Its quota is a number of blocks (the last one in part): all blocks once for each full
   pass, then a part of a further pass.
3. The quotas of all sources are the root of a binary tree over the output shards. Each node gives its left half of
   shards as many blocks of each source as a multivariate hypergeometric draw of the left half's size from the node's
   blocks; the rest goes right. Shards so have equal sizes, and their quotas add up to the sources' exactly.
4. Every pass permutes a source's blocks (a keyed Feistel permutation, computed where it is needed). Shards take
   disjoint runs of the permuted blocks, as many as their quota, and order theirs by a hash.

All draws are seeded by what they are for, so reruns agree. Running sums are taken in chunks of ``CHUNK`` documents, so
a source may hold any share of them. Tree nodes hold one number for each source with blocks left, and are
split by Spark ``LEVELS`` levels at a time. Above 10^9 blocks a draw uses the normal law with the same mean and variance.

Defined results: null or empty text: size 0, never taken; null source: a source of its own; rows without
doc_id take no part; of rows repeating a doc_id one counts (the smallest text); an empty table gives an empty result; very
long texts count whole, and blocks may cut them; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblake.llm.common import keyed_texts, map_batches, mix, stage
from weblake.operators.numbering import dense_ids
from weblake.session import scratch_path

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = 13

BLOCK = 512
SHARD_BLOCKS = 1 << 15
CHUNK = 1_000
LEVELS = 8
CELL = 1 << 12

# Slice of documents whose blocks are listed together; a document's own blocks are bounded by its size.
SLICE = 2_000
EXACT_DRAW = 10**9

_WORD = "[^\\x20\\x09-\\x0D]+"
PIECES = "doc_id long, source_id long, epoch int, block long, at long, begin long, words long"


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of every document."""
    return keyed_texts(docs, ["source"]).select("doc_id", "carried.source", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("size"))


def source_targets(sized: DataFrame) -> DataFrame:
    """One row a source: source, source_id (from 1, in order), docs, source_size, target."""
    spark = sized.sparkSession
    totals = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources")
    named = dense_ids(
        totals.where("source is not null").withColumn("scope", F.lit("source")), "scope", "source", {"source": 0}, scratch_path(spark, "ranks"), "source_id"
    ).drop("scope")
    last = totals.where("source is null").withColumn("source_id", F.lit(totals.where("source is not null").count() + 1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("source_id") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = stage(named.unionByName(last).withColumn("weight", weight), "weights")
    most = EPOCHS * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, above = 0.0, -1
    while True:
        # Sources above their limit at this level of words a weight keep the limit; the others share what is left.
        full = F.lit(level) * F.col("weight") > most
        row = ranked.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, most)).alias("words"), F.sum(F.when(~full, F.col("weight"))).alias("weights")
        ).first()
        if row["n"] == above or not row["weights"]:
            break
        above, level = row["n"], (SHARE * total - (row["words"] or 0)) / row["weights"]
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), most.cast("double"))).drop("weight")


def source_quotas(targets: DataFrame) -> DataFrame:
    """``source_targets`` with blocks (of a pass), full (whole blocks to take) and rest (words of one block more)."""
    size = F.col("source_size")
    blocks = F.greatest(F.round(size / BLOCK).cast("long"), F.lit(1))
    width = size / F.col("blocks")
    full = F.when(size > 0, F.floor(F.round("target") / width)).otherwise(0).cast("long")
    rest = F.when(size > 0, F.round("target") - F.round(F.col("full") * width)).otherwise(0).cast("long")
    return targets.withColumn("blocks", blocks).withColumn("full", full).withColumn("rest", F.greatest(rest, F.lit(0)))


def _draw(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric number of good ones among ``draws``."""
    total = good + bad
    if good == 0 or draws == 0:
        return 0
    if total < EXACT_DRAW:
        return int(rng.hypergeometric(good, bad, draws))
    mean = draws * (good / total)
    spread = np.sqrt(mean * (bad / total) * ((total - draws) / max(1, total - 1)))
    return int(min(max(round(rng.normal(mean, spread)), max(0, draws - bad)), min(good, draws)))


def split_node(first: int, shards: int, quotas: dict[int, int], shard_sizes: tuple[int, int], levels: int) -> Iterator[tuple[int, int, dict[int, int]]]:
    """The nodes ``levels`` levels below one of the tree, or its leaves. ``shard_sizes``: all blocks and all shards."""
    if shards == 1 or levels == 0:
        yield first, shards, quotas
        return
    blocks, of = shard_sizes
    left = shards // 2
    cut = first + left
    want = (cut * blocks) // of - (first * blocks) // of
    rng = np.random.default_rng([SEED, first, shards])
    there, here, remaining = {}, {}, sum(quotas.values())
    for source, n in quotas.items():
        remaining -= n
        taken = _draw(rng, n, remaining, want)
        want -= taken
        if taken:
            here[source] = taken
        if n - taken:
            there[source] = n - taken
    yield from split_node(first, left, here, shard_sizes, levels - 1)
    yield from split_node(cut, shards - left, there, shard_sizes, levels - 1)


def shard_quotas(quotas: DataFrame, shard_blocks: int | None = None) -> DataFrame:
    """shard, source_id and the run [lo, hi) of the source's permuted blocks that the shard takes."""
    spark = quotas.sparkSession
    wanted = quotas.select("source_id", (F.col("full") + (F.col("rest") > 0).cast("long")).alias("n")).where("n > 0")
    blocks = wanted.agg(F.sum("n")).first()[0] or 0
    of = max(1, -(-blocks // (shard_blocks or SHARD_BLOCKS)))
    entries = F.sort_array(F.collect_list(F.struct("source_id", "n")))
    nodes = wanted.agg(F.lit(0).cast("long").alias("first"), F.lit(of).cast("long").alias("shards"), F.map_from_entries(entries).alias("quotas"))
    schema = "first long, shards long, quotas map<long, long>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("first", pa.int64()), ("shards", pa.int64()), ("quotas", pa.map_(pa.int64(), pa.int64()))])
        for batch in batches:
            for row in batch.to_pylist():
                below = split_node(row["first"], row["shards"], dict(row["quotas"]), (blocks, of), LEVELS)
                for first, shards, part in below:
                    yield pa.RecordBatch.from_pylist([{"first": first, "shards": shards, "quotas": list(part.items())}], schema=kinds)

    left = of
    while left > 1:
        nodes = stage(map_batches(nodes, split, schema), "tree")
        left = -(-left >> LEVELS)
        if left > 1:
            nodes = nodes.repartition(spark.sparkContext.defaultParallelism)
    leaves = nodes.select(F.col("first").alias("shard"), F.explode("quotas").alias("source_id", "n"))
    hi = F.sum("n").over(Window.partitionBy("source_id").orderBy("shard"))
    return leaves.select("shard", "source_id", (hi - F.col("n")).alias("lo"), hi.alias("hi"))


def permuted(block: np.ndarray, blocks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0 .. ``blocks`` - 1 for each ``key``, applied to ``block`` (a Feistel network, walked into the range)."""
    bits = np.zeros(len(blocks), dtype=np.uint64)
    while (big := (blocks.astype(np.uint64) - np.uint64(1)) >> (bits * np.uint64(2)) > 0).any():
        bits[big] += np.uint64(1)
    low = (np.uint64(1) << bits) - np.uint64(1)
    out = block.astype(np.uint64)
    open_ = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        while open_.any():
            left, right, b, m, k = out[open_] >> bits[open_], out[open_] & low[open_], bits[open_], low[open_], key[open_]
            for turn in range(4):
                left, right = right, left ^ (mix(right + mix(k + np.uint64(turn))) & m)
            out[open_] = (left << b) | right
            open_[open_] = out[open_] >= blocks.astype(np.uint64)[open_]
    return out.astype(np.int64)


def _placed(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """Documents with their source's plan and ``start``, their first word's place in the sequence of the source."""
    plan = quotas.select(F.struct("source").alias("of"), "source_id", "source_size", "target", "blocks", "full", "rest", "docs")
    docs = sized.join(plan, F.struct("source").eqNullSafe(F.col("of")))
    draw = F.xxhash64(F.lit(SEED), "doc_id")
    chunks = F.ceil(F.col("docs") / CHUNK)
    docs = docs.withColumn("draw", draw).withColumn("chunk", F.floor((F.col("draw") / F.lit(2.0**64) + 0.5) * chunks))
    docs = docs.select("doc_id", "size", "source_id", "source_size", "target", "blocks", "full", "rest", "draw", "chunk")
    sums = docs.groupBy("source_id", "chunk").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source_id").orderBy("chunk")) - F.col("words")
    docs = docs.join(sums.select("source_id", "chunk", before.alias("before")), ["source_id", "chunk"])
    within = F.sum("size").over(Window.partitionBy("source_id", "chunk").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return docs.withColumn("start", F.col("before") + within - F.col("size")).drop("before", "draw", "chunk")


def _pieces(placed: DataFrame) -> DataFrame:
    """The parts of documents in the blocks that are taken (columns of ``PIECES``); ``at``: the block's place in the quota."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset in range(0, batch.num_rows, SLICE):
                part = batch.slice(offset, SLICE)
                c = {n: part.column(n).to_numpy(zero_copy_only=False) for n in part.schema.names}
                narrow, wider = np.divmod(c["source_size"], c["blocks"])
                bound = wider * (narrow + 1)

                def block_of(word: np.ndarray) -> np.ndarray:
                    return np.where(word < bound, word // (narrow + 1), wider + (word - bound) // np.maximum(narrow, 1))

                first = block_of(c["start"])
                count = block_of(c["start"] + c["size"] - 1) - first + 1
                row = np.repeat(np.arange(len(first)), count)
                block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                base = block * narrow[row] + np.minimum(block, wider[row])
                width = narrow[row] + (block < wider[row])
                for epoch in range(EPOCHS + 1):
                    key = mix(c["source_id"].astype(np.uint64)[row] * np.uint64(64) + np.uint64(epoch) + np.uint64(SEED << 32))
                    at = permuted(block, c["blocks"][row], key) + epoch * c["blocks"][row]
                    taken = np.where(at < c["full"][row], width, np.where(at == c["full"][row], np.minimum(c["rest"][row], width), 0))
                    lo = np.maximum(base, c["start"][row])
                    words = np.minimum(base + taken, c["start"][row] + c["size"][row]) - lo
                    k = words > 0
                    if k.any():
                        columns = {
                            "doc_id": c["doc_id"][row][k],
                            "source_id": c["source_id"][row][k],
                            "epoch": np.full(int(k.sum()), epoch, dtype=np.int32),
                            "block": block[k],
                            "at": at[k],
                            "begin": (lo - c["start"][row])[k],
                            "words": words[k],
                        }
                        yield pa.RecordBatch.from_pydict(columns)

    needed = ["doc_id", "source_id", "source_size", "size", "start", "blocks", "full", "rest"]
    return map_batches(placed.where("size > 0").select(*needed), run, PIECES)


def mixture(placed: DataFrame, quotas: DataFrame, shard_blocks: int | None = None) -> DataFrame:
    """The mix: ``PIECES``, each with its shard and its place in it (order by place, then source_id, epoch, block, begin)."""
    runs = shard_quotas(quotas, shard_blocks)
    cells = F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))).alias("cell")
    runs = runs.select("shard", F.col("source_id").alias("of"), "lo", "hi", cells)
    pieces = _pieces(placed)
    held = (F.col("source_id") == F.col("of")) & (F.floor(F.col("at") / CELL) == F.col("cell"))
    held = held & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    place = F.xxhash64(F.lit(SEED), "source_id", "epoch", "block")
    return pieces.join(runs, held).select("shard", place.alias("place"), *pieces.columns)


def planned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What :func:`mixture` takes: documents in their places, and the sources' quotas."""
    sized = stage(sized_documents(docs), "sized")
    quotas = stage(source_quotas(source_targets(sized)), "quotas")
    return stage(_placed(sized, quotas), "placed"), quotas


def mixed_texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """shard, place and text of each piece, sorted within shards: what a trainer reads."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    text = F.array_join(F.slice(words, F.col("begin").cast("int") + 1, F.col("words").cast("int")), " ")
    order = ["shard", "place", "source_id", "epoch", "block", "doc_id", "begin"]
    out = pieces.join(keyed_texts(docs), "doc_id").select(*order, text.alias("text"))
    return out.repartition("shard").sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    placed, quotas = planned(docs)
    taken = mixture(placed, quotas).select("doc_id", F.col("words").alias("taken"))
    plan = placed.select("doc_id", "size", "source_size", "target")
    sums = [F.max(c).alias(c) for c in plan.columns[1:]] + [F.coalesce(F.sum("taken"), F.lit(0).cast("long")).alias("taken")]
    return plan.unionByName(taken, allowMissingColumns=True).groupBy("doc_id").agg(*sums)
