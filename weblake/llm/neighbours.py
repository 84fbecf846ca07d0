"""Approximate nearest neighbours with a hierarchical k-means tree searched best bin first.

* The tree is fitted on a bounded sample of ``SAMPLE`` vectors (smallest hashes of the id): k-means with
  ``BRANCHES`` centres, again within each centre, until a node has few vectors. Every vector of the table
  is then put into the leaf that a descent by the nearest centre leads to.
* A query visits leaves best bin first: a priority queue holds the branches not taken by their distance
  (to the centre, less what the centre's spread may hide), and the nearest is opened next.
* How far a query goes is calibrated on sample queries against brute force within the sample: the share of
  the (distinct) sample vectors that the visited leaves hold, so that many small leaves count like a
  large one, widens until the mean recall of the ``k`` nearest is above ``recall`` by two standard errors. A
  query whose leaves hold fewer than k other vectors of the table visits more until they do.
* Leaves are cut into blocks of ``BLOCK`` vectors, so a value that a third of the rows has fills many
  blocks and not one task, and the queries of a leaf into blocks, too. A block's best ``k`` for a query
  go on to that query's merge, so a query gets at most k rows a block. A block keeps its ``k`` smallest ids of
  each distinct vector beforehand (further copies can't be among the k nearest, as ties go to smaller ids).

Nearness is the Euclidean distance in double precision on the original vectors; ties go to the smaller id.

Defined results: vectors that are null, zero, or hold null or non-finite components, or have another
length than most of the sample, take no part; neither do rows without id; rows that repeat an id count
each as a candidate, and as a query the least vector counts; with fewer than k candidates all are returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblake.llm.common import map_batches, ship, stage

SAMPLE = 20_000
BRANCHES = 16
LEAF = 160  # sample vectors that are not split further
BLOCK = 4096
QUERY_BLOCK = 1024
QUERY_STEP = 100


@dataclass
class Tree:
    """Nodes in one array each: centre, spread (largest distance to it in the sample), children, leaf number."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray  # -1 for inner nodes
    leaves: int
    width: int
    weight: np.ndarray | None = None  # share of the distinct sample vectors in each leaf
    share: float = 0.0  # that the leaves a query visits must hold

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by descending to the nearest centre (ties: the first)."""
        out = np.empty(len(vectors), dtype=np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            near = _distances(vectors[rows], self.centres[kids]).argmin(1)
            todo += [(int(kid), rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def best_bins(self, query: np.ndarray, share: float, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves of a best-bin-first traversal until they hold ``share`` of the sample and, by ``sizes``,
        ``least`` vectors."""
        found: list[int] = []
        queue, held, have = [(0.0, 0)], 0.0, 0
        while queue and (held < share or have < least):
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                kids = self.children[node]
                far = np.sqrt(((self.centres[kids] - query) ** 2).sum(1)) - 0.5 * self.spread[kids]
                best = int(far.argmin())
                for i, kid in enumerate(kids):
                    if i != best:
                        heapq.heappush(queue, (float(far[i]), kid))
                node = kids[best]
            found.append(int(self.leaf[node]))
            held += self.weight[found[-1]]
            have += int(sizes[found[-1]]) if sizes is not None else 0
        return found


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the dot product: fast, and near enough to choose candidates."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _kmeans(vectors: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Cluster of each vector; k-means++ start."""
    rng = np.random.default_rng(seed)
    centres = [vectors[rng.integers(len(vectors))]]
    near = _distances(vectors, np.array(centres))[:, 0]
    while len(centres) < k and near.max() > 1e-12:
        centres.append(vectors[rng.choice(len(vectors), p=near / near.sum())])
        near = np.minimum(near, _distances(vectors, centres[-1][None])[:, 0])
    middle = np.array(centres)
    own = np.zeros(len(vectors), dtype=np.int64)
    for _ in range(rounds):
        own = _distances(vectors, middle).argmin(1)
        for i in range(len(middle)):
            if (own == i).any():
                middle[i] = vectors[own == i].mean(0)
    return own


def fit_tree(sample: np.ndarray) -> Tree:
    centres, spread, children, leaf = [], [], [], []
    leaves = 0

    def grow(vectors: np.ndarray) -> int:
        nonlocal leaves
        node = len(centres)
        middle = vectors.mean(0)
        centres.append(middle)
        spread.append(float(np.sqrt(_distances(vectors, middle[None]).max())))
        children.append([])
        leaf.append(-1)
        own = _kmeans(vectors, BRANCHES, node) if len(vectors) > LEAF else np.zeros(len(vectors))
        parts = [p for i in np.unique(own) if len(p := vectors[own == i])]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
        else:
            children[node] = [grow(p) for p in parts]
        return node

    grow(sample)
    return Tree(np.array(centres), np.array(spread), children, np.array(leaf), leaves, sample.shape[1])


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float, queries: int = 200) -> float:
    """The least share, widening by a fifth each time, whose mean recall on the sample is as wanted, by two
    standard errors."""
    own = tree.assign(sample)
    picked = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
    exact = _distances(sample[picked], sample)
    exact[np.arange(len(picked)), picked] = np.inf
    want = min(k, len(sample) - 1)
    if want < 1 or tree.leaves == 1:
        return 1.0
    # Neighbours farther than the k-th nearest don't count; ties at it do.
    limit = np.partition(exact, want - 1, axis=1)[:, want - 1] * (1 + 1e-9)
    # What a query holds before it visits the leaf of each of its nearest.
    before = []
    for i, q in enumerate(picked):
        order = tree.best_bins(sample[q], 2.0)
        held = np.empty(tree.leaves)
        held[order] = np.cumsum(tree.weight[order]) - tree.weight[order]
        before.append(held[own[np.flatnonzero(exact[i] <= limit[i])]])
    share = 1.0 / tree.leaves
    while share < 1.0:
        got = [min(want, int((b < share).sum())) / want for b in before]
        if np.mean(got) - 2 * np.std(got) / np.sqrt(len(got)) >= recall:
            return share
        share *= 1.2
    return 1.0


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & sound)
    return rows.where(F.exists("vector", lambda x: x != 0.0))


def learn_tree(vectors: DataFrame, k: int, recall: float) -> Tree | None:
    """From the ``SAMPLE`` vectors whose ids hash lowest."""
    rows = vectors.select("vec_id", "vector", F.xxhash64("vec_id").alias("rank"))
    picked = rows.orderBy("rank", "vec_id").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(picked):
        return None
    sizes, n = np.unique([len(v) for v in picked], return_counts=True)
    width = int(sizes[n.argmax()])
    sample = np.array([v for v in picked if len(v) == width], dtype=np.float64)
    tree = fit_tree(sample)
    distinct = np.unique(sample, axis=0)
    tree.weight = np.bincount(tree.assign(distinct), minlength=tree.leaves) / len(distinct)
    tree.share = calibrate(tree, sample, k, recall)
    return tree


_PLACED = pa.schema([("vec_id", pa.int64()), ("leaf", pa.int32()), ("vector", pa.binary())])


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, width)


def place_vectors(vectors: DataFrame, tree: Tree, sizes: np.ndarray | None = None, k: int = 0) -> DataFrame:
    """(vec_id, leaf, packed vector): each vector in its leaf, or, with the leaves' sizes, in all it visits."""
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        tree = sent.value
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            matrix = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, tree.width)
            if sizes is not None:
                # One of the vectors is the query itself.
                bins = [tree.best_bins(v, tree.share, sizes, k + 1) for v in matrix]
                rows = np.repeat(np.arange(len(ids)), [len(b) for b in bins])
                leaf = np.concatenate(bins) if bins else np.empty(0)
            else:
                rows, leaf = np.arange(len(ids)), tree.assign(matrix)
            packed = [v.tobytes() for v in matrix]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), pa.array(leaf.astype(np.int32)), pa.array([packed[r] for r in rows], pa.binary())], schema=_PLACED
            )

    fitting = vectors.where(F.size("vector") == tree.width)
    return map_batches(fitting, run, "vec_id long, leaf int, vector binary")


def _blocks(placed: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt into blocks of their leaf of about ``size``, and (leaf, number of blocks)."""
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", count.alias(f"{name}s"))
    # At most one row for each leaf of the tree, which a bounded sample fitted.
    dealt = placed.join(F.broadcast(sizes), "leaf").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col(f"{name}s")).cast("int"))
    return dealt.drop(f"{name}s"), sizes


def nearest(embeddings: DataFrame, k: int = 10, query_step: int = QUERY_STEP, recall: float = 0.97) -> DataFrame:
    """Per query (ids divisible by ``query_step``): query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    ship(spark)
    vectors = usable_vectors(embeddings)
    tree = learn_tree(vectors, k, recall)
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = stage(place_vectors(vectors, tree), "leaves")
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    for row in placed.groupBy("leaf").count().collect():  # a row for each leaf: bounded by the sample
        sizes[row["leaf"]] = row["count"]
    placed, v_blocks = _blocks(placed, BLOCK, "block")
    asking = vectors.where(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = place_vectors(asking, tree, sizes, k)
    queries, q_blocks = _blocks(stage(queries, "visits"), QUERY_BLOCK, "part")
    # Each block of vectors meets each block of its leaf's queries.
    placed = placed.join(F.broadcast(q_blocks), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = queries.join(F.broadcast(v_blocks), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    width = tree.width
    schema = "query_id long, vec_id long, score double"

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(own) or not len(asked):
            return empty
        own = own.sort_values("vec_id", kind="stable")
        # k + 1: one of the copies may be the query itself.
        own = own[own.groupby("vector", sort=False).cumcount() <= k]
        ids = own["vec_id"].to_numpy()
        base = np.frombuffer(b"".join(own["vector"]), dtype="<f8").reshape(-1, width)
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(asked), 128):
            some = asked.iloc[at : at + 128]
            points = np.frombuffer(b"".join(some["vector"]), dtype="<f8").reshape(-1, width)
            rough = _distances(points, base)
            for i, query in enumerate(some["vec_id"].to_numpy()):
                near = rough[i]
                if len(near) > 4 * k:
                    limit = np.partition(near, k + 1)[k + 1]
                    rows = np.flatnonzero(near <= limit + 1e-9 * (1.0 + limit + (points[i] ** 2).sum()))
                else:
                    rows = np.arange(len(near))
                rows = rows[ids[rows] != query]
                exact = np.sqrt(((base[rows] - points[i]) ** 2).sum(1))
                best = np.lexsort((ids[rows], exact))[:k]
                out_q.append(np.full(len(best), query))
                out_v.append(ids[rows][best])
                out_s.append(exact[best])
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    key = ["leaf", "block", "part"]
    found = placed.select(*key, "vec_id", "vector").groupBy(*key).cogroup(queries.select(*key, "vec_id", "vector").groupBy(*key))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.applyInPandas(search, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
