import hashlib

import numpy as np
import public_tokenizers
from helpers import SCHEMA, by_id, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from weblake.llm.pieces import PieceCodec, piece_ids

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
CODEC = PieceCodec(PATH)

TEXTS = [
    None, "", " ", "   three", "tail   ", "a\tb\nc  d e", "▁literal ▁", "日本語 und Ümläute 😀", "<s>x</s> <0x41>",
    "\x00\x01", "\n\n\n", prose(1, 300), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é é", "x" * 5000, " ".join(["same"] * 3000),
]


def library(text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    packed = np.array(ids, dtype="<u4").tobytes()
    decoded = hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    return len(ids), hashlib.sha256(packed).hexdigest(), decoded


def test_matches_the_library(spark):
    got = by_id(piece_ids(documents(spark, TEXTS, clashing=True), PATH), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == {i: library(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    ids = np.frombuffer(CODEC.encode(text), dtype="<u4").tolist()
    assert ids == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert CODEC.decoded(text) == CODEC.decode(ids) == LIBRARY.decode(ids)
    CODEC.check()


def test_empty_table(spark):
    assert piece_ids(spark.createDataFrame([], SCHEMA), PATH).count() == 0
