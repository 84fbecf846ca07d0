"""Best-fit packing of token sequences by linear grouping.

Documents are tokenized and cut into pieces of at most ``CAPACITY`` tokens. How many pieces there are
of each length decides the whole packing, and there are at most ``CAPACITY`` lengths, so the plan is
made from that histogram, of bounded size, on the driver:

1. Large lengths, in descending order, are dealt into ``GROUPS`` groups of equal cardinality; each
   counts as long as its group's longest (linear grouping).
2. Over those few sizes, configurations (what goes into one sequence) are chosen by a knapsack that
   fills the capacity best and holds the largest size left; each is used as often as the groups allow.
3. Actual lengths are substituted: each use takes the next pieces of its groups.
4. Small pieces, longest first, go where they fit best; those that fit nowhere open new sequences.

Sequences that look alike stay one class (first number, how many, lengths in order), so the plan does
not grow with the data. Spark numbers the pieces of each length and looks each up in the plan.

Defined results: null or empty text is a piece with the end id alone; rows with a null doc_id or a
repeated one are packed like others; ties are broken by doc_id and piece; an empty table gives an
empty result; very long documents become many pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblake.llm.common import hold, map_batches, map_rows, stage, texts_of

CAPACITY = 2048
END_ID = 0
GROUPS = 192
# Pieces of up to this length are small.
SMALL = CAPACITY // 8
# Chunks that a worker remembers.
MEMO_CHUNKS = 600_000
_WIDE_GAP = re.compile(r" (?=\s)|[\x1c-\x1f]")
_CUT = re.compile(r" (?=\S)")
# Fixed value: how byte-level BPE of this family parts a text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary with its tokens as bytes: printable Latin-1 characters stand for
    themselves, the other bytes, in order, for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkIds(dict):
    """What follows a space, up to the next one -> the ids of both as little-endian 32-bit numbers,
    remembered up to a bound.

    The byte-level pre-tokenizer always starts a new word at a space that a non-space follows, so a
    text may be parted there and its chunks encoded one by one. New chunks are merged by tiktoken, four times
    as fast, with the ranks of the tokenizer's own file; all that are remembered are compared with the tokenizers
    library, a slice of documents at a time, and a difference raises an error. Texts with special tokens, and what
    comes before a text's first space, go to the library.
    """

    def __init__(self, tokenizer_path: str):
        super().__init__()
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = _byte_ranks({t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special})
        self.merge = Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.marks = {m: pack_ids(self.merge(m)) for m in ".,;:!?"}
        self.fresh: list[str] = []

    def library(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str) -> bytes:
        mark = self.marks.get(chunk[-1:])
        if mark is not None and chunk[:-1].isalpha():
            return self[chunk[:-1]] + mark  # letters and a mark are words of their own
        ids = pack_ids(self.merge(" " + chunk))
        if len(self) < MEMO_CHUNKS:
            self[chunk] = ids
            self.fresh.append(chunk)
        return ids

    def check(self) -> None:
        """Compare what is new in the memo since the last call with the library."""
        new = self.tokenizer.encode_batch_fast([" " + chunk for chunk in self.fresh], add_special_tokens=False)
        for chunk, found in zip(self.fresh, new):
            if pack_ids(found.ids) != self[chunk]:
                raise ValueError(f"tiktoken and the tokenizers library differ on {chunk!r}")
        self.fresh = []

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        wide = _WIDE_GAP.search(text)
        if wide and wide[0] != " " or self.special.search(text):
            return self.library(text)
        first, *rest = _CUT.split(text) if wide else text.split(" ")
        # An empty last chunk is a space at the end.
        return self.library(first) + b"".join([self[chunk] for chunk in rest])


@lru_cache(maxsize=2)
def _chunk_ids(tokenizer_path: str) -> ChunkIds:
    return ChunkIds(tokenizer_path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Of a longer document the first piece may be shorter."""

    def make():
        chunks = hold(_chunk_ids(tokenizer_path))
        encode = chunks.of
        end = END_ID.to_bytes(4, "little")

        def step(cols: dict) -> dict:
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(cols["doc_id"], cols["text"]):
                ids = encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    for k, v in zip(out, (doc, piece, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]))):
                        out[k].append(v)
            chunks.check()
            return out

        return step

    return map_rows(texts_of(docs), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(size, [[length, count], ...] longest first) of groups of equal cardinality."""
    total, out, used = sum(counts.values()), [], 0
    share = max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if used % share == 0 or not out:
                out.append((length, []))
            take = min(left, share - used % share)
            out[-1][1].append([length, take])
            used, left = used + take, left - take
    return out


def _configuration(sizes: np.ndarray, left: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """Group ``first`` and what of the groups fills the rest of the capacity best."""
    room = capacity - int(sizes[first])
    # chosen[c]: the group that made the sum c reachable, taken once more.
    reach, chosen = np.zeros(room + 1, dtype=bool), np.full(room + 1, -1, dtype=np.int64)
    reach[0] = True
    best = 0
    for g in np.flatnonzero((sizes <= room) & (left > 0)):
        size = int(sizes[g])
        for _ in range(min(int(left[g]) - (g == first), room // size)):
            new = np.zeros_like(reach)
            new[size:] = reach[:-size] & ~reach[size:]
            # A sum may only build on sums reached with groups so far, this one's copies included.
            if not new.any():
                break
            chosen[new] = g
            reach |= new
        best = int(np.flatnonzero(reach)[-1])
        if best == room:
            break
    uses = {first: 1}
    while best:
        g = int(chosen[best])
        uses[g] = uses.get(g, 0) + 1
        best -= int(sizes[g])
    return uses


def _take(queue: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The next ``n`` pieces of a group, as (length, count)."""
    out = []
    while n:
        length, have = queue[0]
        use = min(n, have)
        out.append((length, use))
        n -= use
        queue[0][1] -= use
        if not queue[0][1]:
            queue.pop(0)
    return out


def _aligned(slots: list[list[tuple[int, int]]]) -> list[tuple[int, tuple[int, ...]]]:
    """(how many, lengths) of sequences built by taking from every slot in step."""
    queues, out = [[list(x) for x in s] for s in slots], []
    while queues[0]:
        n = min(q[0][1] for q in queues)
        out.append((n, tuple(q[0][0] for q in queues)))
        for q in queues:
            q[0][1] -= n
            if not q[0][1]:
                q.pop(0)
    return out


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list:
    """[(how many sequences, lengths in order)] that hold exactly the pieces of ``counts``."""
    large = {k: n for k, n in counts.items() if k > small and n}
    found: list[tuple[int, tuple[int, ...]]] = []
    grouped = _groups(large, groups)
    sizes, queues = np.array([s for s, _ in grouped], dtype=np.int64), [q for _, q in grouped]
    left = np.array([sum(n for _, n in q) for q in queues], dtype=np.int64)
    for first in range(len(sizes)):
        while left[first]:
            uses = _configuration(sizes, left, first, capacity)
            times = min(int(left[g]) // n for g, n in uses.items())
            slots = []
            for g, n in uses.items():
                left[g] -= n * times
                slots += [_take(queues[g], times) for _ in range(n)]
            found += _aligned(slots)
    # Small pieces: by the room left, a list of classes.
    rooms: dict[int, list] = {}
    order: list[int] = []

    def add(n: int, lengths: tuple[int, ...]) -> None:
        room = capacity - sum(lengths)
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((n, lengths))

    for n, lengths in found:
        add(n, lengths)
    for length in sorted((k for k, n in counts.items() if k <= small and n), reverse=True):
        wanted = counts[length]
        while wanted:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                n = wanted // each
                add(n, (length,) * each) if n else add(1, (length,) * (wanted % each))
                wanted -= n * each or wanted % each
                continue
            room = order[at]
            n, lengths = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            use = min(n, wanted)
            add(use, (*lengths, length))
            if n > use:
                add(n - use, lengths)
            wanted -= use
    return [c for room in sorted(rooms) for c in rooms[room]]


def _lookup(plan: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the first sequence and the offset."""
    rank: dict[int, int] = {}
    keys, sequences, offsets, base = [], [], [], 0
    for n, lengths in plan:
        at = 0
        for length in lengths:
            keys.append((length << 44) + rank.get(length, 0))
            rank[length] = rank.get(length, 0) + n
            sequences.append(base)
            offsets.append(at)
            at += length
        base += n
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return tuple(np.array(x, dtype=np.int64)[order] for x in (keys, sequences, offsets))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece and length) with sequence_id and offset."""
    # Files of the staged table number the pieces: place in the file, after all earlier files.
    staged = stage(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    sizes = staged.groupBy("length", "part").count()
    histogram = sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()  # at most ``capacity`` rows
    keys, sequences, offsets = _lookup(plan_packing({r["length"]: r["n"] for r in histogram}, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = staged.withColumn("rank", F.row_number().over(within)).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("before", "part")
    names = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            place = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence = sequences[place] + rank - (keys[place] & ((1 << 44) - 1))
            columns = [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offsets[place])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return map_batches(ranked.select(*names, "rank"), run, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity)
