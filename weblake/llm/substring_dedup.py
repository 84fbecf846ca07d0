"""Substring dedup: prefix-partitioned suffix subtrees find the repeats of ``width`` words or more.

Suffixes that share ``width`` words meet in one group, named by the smallest-hashing ``PREFIX``-word
run among those words, so one suffix in about seven leads a group and equal windows always have the
same leader.

1. Count leaders over all documents. A leader that occurs once begins no repeat, so its suffixes end
   here; this is what keeps the rest small.
2. The suffixes of repeated leaders are shuffled to their groups, packed by document. In a group the
   subtree is built down to the depth of ``width`` words: its nodes are the distinct 20-word paths,
   its leaves the suffixes below, in order of (doc_id, start). A node with two leaves or more is deep
   and internal: a repeat. All leaves but its first are marked; neighbouring marked starts
   make up the longer (maximal) repeats.
3. A group with more than ``GROUP_WORDS`` suffixes doesn't fit: it is dealt out by document to as many
   subtrees as it needs, and what comes first in each goes on to groups by a longer prefix, all
   ``width`` words, where a node has at most one leaf from each part.

Documents with exactly equal texts are settled before: the later ones are repeats as a whole.
What is removed is judged on the input. Paths are compared by 64-bit hashes of word hashes.

Defined results: null or empty text: no words; rows without doc_id take no part; of rows repeating a
doc_id one counts; an empty table gives an empty result; very long texts count whole; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblake.llm.common import HASHES, keyed_texts, map_batches, map_rows, stage, window_hashes, words

WIDTH = 20
PREFIX = 7
# Suffixes of a group that are handled together.
GROUP_WORDS = 20_000
_WORD_AND_GAP = re.compile(rb"([^\x20\x09-\x0d]+)([\x20\x09-\x0d]*)")


def leaders(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` words the smallest hash of its PREFIX-word runs, and the first place
    in the document where the window has it. Places never decrease from window to window."""
    low = window_hashes(h, PREFIX)
    at = np.arange(len(low))
    runs, have = width - PREFIX + 1, 1
    if len(low) < runs:
        return low[:0], at[:0]
    while have < runs:  # the minimum of twice as many runs each time
        step = min(have, runs - have)
        left = low[:-step] <= low[step:]
        low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
        have += step
    return low, at


def _packed(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary cells cut from ``values`` at ``offsets`` (in values)."""
    ends = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _cuts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]]))


def _leader_counts(texts: DataFrame, width: int) -> DataFrame:
    """(leader, n, docs): occurrences, and the documents, of each leader in each batch of documents."""
    schema = pa.schema([("leader", pa.int64()), ("n", pa.int64()), ("docs", pa.binary())])

    def run(batches):
        for batch in batches:
            found, owners, ns = [], [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    low, place = leaders(HASHES.of(words(text)), width)
                    if len(low):
                        # The same run leads neighbouring windows; that is one occurrence. Equal windows
                        # have leaders of their own: at the same offset, so at different places.
                        own, n = np.unique(low[_cuts(place)[:-1]], return_counts=True)
                        found.append(own)
                        ns.append(n)
                        owners.append(np.full(len(own), doc, dtype=np.int64))
            if not found:
                continue
            keys, docs, n = np.concatenate(found), np.concatenate(owners), np.concatenate(ns)
            order = np.argsort(keys, kind="stable")
            cuts = _cuts(keys[order])
            sums = np.add.reduceat(n[order], cuts[:-1])
            arrays = [pa.array(keys[order][cuts[:-1]].view(np.int64)), pa.array(sums), _packed(cuts, docs[order])]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return map_batches(texts, run, "leader long, n long, docs binary")


def _repeated_leaders(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, leaders, parts): each document's repeated leaders and in how many parts their groups come."""
    counts = _leader_counts(texts, width)
    # A leader has one row for each batch of documents at most.
    total = F.sum("n").over(Window.partitionBy("leader"))
    repeated = counts.withColumn("total", total).where("total > 1")
    parts = F.ceil(F.col("total") * (width // 2) / F.lit(GROUP_WORDS)).cast("int")
    schema = pa.schema([("doc_id", pa.int64()), ("leader", pa.int64()), ("parts", pa.int32())])

    def run(batches):
        for batch in batches:
            docs = [np.frombuffer(d, dtype=np.int64) for d in batch.column(2).to_pylist()]
            sizes = [len(d) for d in docs]
            if docs:
                columns = [np.concatenate(docs), *(np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    flat = map_batches(repeated.select("leader", parts.alias("parts"), "docs"), run, "doc_id long, leader long, parts int")
    return flat.groupBy("doc_id").agg(F.collect_list("leader").alias("leaders"), F.collect_list("parts").alias("parts"))


def _compressed(texts: DataFrame) -> DataFrame:
    """Texts as Zstandard frames, for the shuffle by doc_id."""

    def make():
        squeeze = zstandard.ZstdCompressor(level=3).compress

        def step(cols: dict) -> dict:
            packed = [squeeze(t.encode("utf-8", "surrogatepass")) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "packed": packed}

        return step

    return map_rows(texts, make, "doc_id long, packed binary")


def _suffixes(packed: DataFrame, repeated: DataFrame, width: int) -> DataFrame:
    """(leader, part, doc_id, starts, paths): the suffixes of repeated leaders, packed by document."""
    schema = pa.schema(
        [("leader", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("starts", pa.binary()), ("paths", pa.binary())]
    )

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                doc, data, own, parts = (batch.column(i)[row].as_py() for i in range(4))
                h = HASHES.of(expand(data).split())
                (low, _), paths = leaders(h, width), window_hashes(h, width)
                known = np.array(own, dtype=np.int64).view(np.uint64)
                order = np.argsort(known)
                known, parts = known[order], np.array(parts, dtype=np.int32)[order]
                place = np.minimum(np.searchsorted(known, low), len(known) - 1)
                starts = np.flatnonzero(known[place] == low)
                starts = starts[np.argsort(low[starts], kind="stable")]
                cuts = _cuts(low[starts])
                lead = low[starts][cuts[:-1]]
                # part 0: the group fits; else the document's part, from 1.
                deal = parts[place[starts[cuts[:-1]]]]
                mixed = (doc * 2654435761 >> 7) & 0x7FFFFFFF
                deal = np.where(deal > 1, 1 + mixed % np.maximum(deal, 1), 0).astype(np.int32)
                columns = [
                    pa.array(lead.view(np.int64)),
                    pa.array(deal),
                    pa.array(np.full(len(lead), doc, dtype=np.int64)),
                    _packed(cuts, starts.astype("<i4")),
                    _packed(cuts, paths[starts]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    joined = packed.join(repeated, "doc_id").select("doc_id", "packed", "leaders", "parts")
    return map_batches(joined, run, "leader long, part int, doc_id long, starts binary, paths binary")


def _subtrees(suffixes: DataFrame) -> DataFrame:
    """(doc_id, starts, paths, marked): marked leaves of each group; of groups dealt out also the first
    leaves, unmarked."""
    schema = pa.schema([("doc_id", pa.int64()), ("starts", pa.binary()), ("paths", pa.binary()), ("marked", pa.bool_())])

    def leaves(doc, start, path, marked):
        if not len(doc):
            return
        cuts = _cuts(doc)
        columns = [
            pa.array(doc[cuts[:-1]]),
            _packed(cuts, start),
            pa.array([b""] * (len(cuts) - 1), pa.binary()) if marked else _packed(cuts, path),
            pa.array(np.full(len(cuts) - 1, marked)),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        last, seen = None, set()  # the paths so far of the group that the batch before ended in
        for batch in batches:
            lead, part, doc = (batch.column(i).to_numpy() for i in range(3))
            sizes = np.array([len(x) // 4 for x in batch.column(3).to_pylist()])
            start = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<i4")
            path = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<u8")
            group = np.cumsum(np.concatenate([[0], (lead[1:] != lead[:-1]) | (part[1:] != part[:-1])]))
            group, docs, dealt = np.repeat(group, sizes), np.repeat(doc, sizes), np.repeat(part > 0, sizes)
            order = np.lexsort((start, docs, path, group))
            first = np.ones(len(order), dtype=bool)
            first[1:] = (path[order][1:] != path[order][:-1]) | (group[order][1:] != group[order][:-1])
            is_first = np.empty(len(order), dtype=bool)
            is_first[order] = first
            ends = (lead[0], part[0]), (lead[-1], part[-1])
            if ends[0] == last:
                for i in np.flatnonzero((group == 0) & is_first):
                    is_first[i] = int(path[i]) not in seen
            if ends[1] != last:
                seen = set()
            seen.update(path[(group == group[-1]) & is_first].tolist())
            last = ends[1]
            yield from leaves(docs[~is_first], start[~is_first], path[~is_first], True)
            up = is_first & dealt
            yield from leaves(docs[up], start[up], path[up], False)

    ordered = suffixes.repartition("leader", "part").sortWithinPartitions("leader", "part", "doc_id")
    return map_batches(ordered, run, "doc_id long, starts binary, paths binary, marked boolean")


def _longer_prefix(first: DataFrame) -> DataFrame:
    """(doc_id, starts): marked leaves among the first ones of the parts, by groups of the whole path."""
    schema = pa.schema([("path", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32())])

    def run(batches):
        for batch in batches:
            starts = [np.frombuffer(x, dtype="<i4") for x in batch.column(1).to_pylist()]
            paths = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
            if starts:
                docs = np.repeat(batch.column(0).to_numpy(), [len(s) for s in starts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), pa.array(docs), pa.array(np.concatenate(starts))], schema=schema)

    leaf = map_batches(first.select("doc_id", "starts", "paths"), run, "path long, doc_id long, start int")
    lowest = leaf.groupBy("path").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.count("*").alias("n"))
    later = leaf.join(lowest.where("n > 1"), "path").where(F.struct("doc_id", "start") != F.col("least"))

    def pack():
        return lambda cols: {"doc_id": cols["doc_id"], "starts": [np.array(s, dtype="<i4").tobytes() for s in cols["start"]]}

    each = later.groupBy("doc_id").agg(F.collect_list("start").alias("start"))
    return map_rows(each, pack, "doc_id long, starts binary")


def _copies(texts: DataFrame) -> DataFrame:
    """doc_id of documents whose very text a smaller doc_id has."""
    digests = texts.select("doc_id", F.unhex(F.md5("text")).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return digests.join(first, "digest").where("doc_id > first").select("doc_id")


def repeated_starts(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, starts, copy): packed starts of the windows that occur earlier; copy: the whole text does."""
    copies = stage(_copies(texts), "copies")
    repeated = _repeated_leaders(texts, width).join(copies, "doc_id", "left_anti")
    leaves = stage(_subtrees(_suffixes(_compressed(texts), repeated, width)), "leaves")
    marked = leaves.where("marked").select("doc_id", "starts")
    marked = marked.unionByName(_longer_prefix(leaves.where("not marked")))
    marked = marked.groupBy("doc_id").agg(F.collect_list("starts").alias("starts"))
    whole = copies.select("doc_id", F.array().cast("array<binary>").alias("starts"), F.lit(True).alias("copy"))
    return marked.withColumn("copy", F.lit(False)).unionByName(whole)


def kept_words(n: int, starts: list[bytes], copy: bool, width: int) -> np.ndarray:
    """Which of ``n`` words stay."""
    if copy:
        return np.full(n, n < width)
    edges = np.zeros(n + 1, dtype=np.int32)
    begin = np.frombuffer(b"".join(starts), dtype="<i4")
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + width, -1)
    return np.cumsum(edges)[:n] == 0


def without_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and kept_sha256 of the kept words joined by one space.

    ``with_text``: text in its place, with the removed words and the white space after them cut out.
    ``carry``: columns of ``docs`` to keep in a struct ``carried``.
    """
    texts = keyed_texts(docs, carry)
    found = repeated_starts(texts.select("doc_id", "text"), width)

    def make():
        expand = zstandard.ZstdDecompressor().decompress

        def step(cols: dict) -> dict:
            out: dict = {"doc_id": cols["doc_id"], "n_words": [], "n_removed": [], last: []}
            for data, starts, copy in zip(cols["packed"], cols["starts"], cols["copy"]):
                raw = expand(data)
                tokens = raw.split()
                keep = kept_words(len(tokens), starts or [], bool(copy), width)
                removed = len(tokens) - int(keep.sum())
                out["n_words"].append(len(tokens))
                out["n_removed"].append(removed)
                if with_text:
                    if removed:
                        pairs = _WORD_AND_GAP.findall(raw)
                        raw = b"".join(w + gap for (w, gap), k in zip(pairs, keep) if k).strip()
                    out[last].append(raw.decode("utf-8", "replace"))
                else:
                    kept = b" ".join([w for w, k in zip(tokens, keep) if k] if removed else tokens)
                    out[last].append(hashlib.sha256(kept).hexdigest())
            return out

        return step

    last = "text" if with_text else "kept_sha256"
    joined = _compressed(texts).join(found, "doc_id", "left")
    return map_rows(joined, make, f"doc_id long, n_words long, n_removed long, {last} string")
