import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import SCHEMA, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weblake.llm.packing import CAPACITY, ChunkIds, packed_documents, plan_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
CHUNKS = ChunkIds(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def check(rows, texts):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in enumerate(texts):
        ids, at = [*ids_of(text), 0], 0
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        for i, r in enumerate(own):
            assert r["start"] == at and (r["length"] == CAPACITY or i == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or len(ids) > CAPACITY)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(sequences)


def test_pieces_and_sequences(spark):
    texts = [None, "", "a", "a  b\n c", prose(1, 5000), " ".join(["word"] * 2046), " ".join(["word"] * 2047), "x<|endoftext|>y"]
    texts += [prose(s, 20 + 7 * s) for s in range(2, 60)] + [prose(2, 34)] * 5
    rows = packed_documents(documents(spark, texts, clashing=True), PATH).collect()
    used = check(rows, texts)
    assert used <= -(-sum(len(ids_of(t)) + 1 for t in texts) // CAPACITY) + 1


def test_plan_holds_every_piece_and_is_tight():
    rng = random.Random(3)
    for spread in (lambda: min(2048, int(rng.lognormvariate(6, 1)) + 1), lambda: rng.randint(600, 1500), lambda: rng.choice([1, 1024, 2048])):
        counts = defaultdict(int)
        for _ in range(20_000):
            counts[spread()] += 1
        plan = plan_packing(dict(counts))
        held = defaultdict(int)
        for n, lengths in plan:
            assert n > 0 and sum(lengths) <= CAPACITY
            for length in lengths:
                held[length] += n
        assert held == counts
        used, bound = sum(n for n, _ in plan), -(-sum(k * n for k, n in counts.items()) // CAPACITY)
        assert used <= 1.02 * bound or spread is not None and min(counts) > 500


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sI1,. \n\t  é\x1c<|>"), max_size=40))
def test_chunks_encode_as_the_whole(text):
    assert np.frombuffer(CHUNKS.of(text), dtype="<u4").tolist() == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert np.frombuffer(CHUNKS.of(text), dtype="<u4").tolist() == ids_of(text)
    CHUNKS.check()


def test_empty_table_and_null_ids(spark):
    assert packed_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    rows = spark.createDataFrame([(None, "x", None, None, None), (None, "x", None, None, None)], SCHEMA)
    assert packed_documents(rows, PATH).count() == 2
