"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece they would make
and then from the left; the best is merged until none is left. Characters outside the vocabulary become
byte pieces. A pair of neighbouring characters that no piece of the vocabulary contains is never
merged, so a text is first parted there (always before a run of spaces), and the parts, which repeat
a great deal, are remembered up to a bound.

In each Arrow batch the parts that went through the agenda are also encoded by the sentencepiece library; a
difference raises an error instead of giving wrong ids.

Defined results: null or empty text gives the begin and end ids and decodes to an empty text; a literal
U+2581 reads as a space, as in the library; very long texts are encoded whole; repeated rows give
equal rows; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

from pyspark.sql import DataFrame

from weblake.llm.common import map_rows, texts_of

SPACE = "▁"
# Parts that a worker remembers.
MEMO_PARTS = 600_000
_PART = re.compile(f"{SPACE}+[^{SPACE}]*")


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceCodec(dict):
    """Part of a text (a run of spaces and what follows it, without the first space) -> its packed ids."""

    def __init__(self, model_path: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=model_path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in ids if sp.is_control(i)}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        # Neighbours that some piece contains; no other two characters ever end up in one piece.
        self.joined = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in self.joined):
            raise ValueError("a piece goes on after a space: texts can't be parted at spaces")
        self.marks = {m: pack_ids(self.merged(m)) for m in ".,;:!?"}
        self.odd: dict[str, str] = {}  # parts that don't decode to themselves
        self.unchecked: dict[str, bytes] = {}
        self.runs: dict[str, list[int]] = {}

    def merged(self, run: str) -> list[int]:
        """Ids of a run of joinable characters, by the agenda."""
        symbols: list[str | None] = list(run)
        n, score = len(symbols), self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            piece = run[i : i + 2]
            if piece in score:
                agenda.append((-score[piece], i, i + 1, piece))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            one, two = symbols[left], symbols[right]
            if one is None or two is None or len(one) + len(two) != len(piece):
                continue  # one of the two was merged meanwhile
            symbols[left], symbols[right] = piece, None
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                wider = piece + symbols[nxt]
                if wider in score:
                    heapq.heappush(agenda, (-score[wider], left, nxt, wider))
            if (prev := before[left]) >= 0:
                wider = symbols[prev] + piece
                if wider in score:
                    heapq.heappush(agenda, (-score[wider], prev, left, wider))
        ids: list[int] = []
        for symbol in symbols:
            if symbol is not None:
                known = self.id_of.get(symbol)
                if known is not None:
                    ids.append(known)
                else:
                    ids += [self.byte_id[b] for b in symbol.encode("utf-8", "replace")]
        return ids

    def part_ids(self, part: str) -> list[int]:
        """Ids of a part: the agenda on each run of joinable characters."""
        ids: list[int] = []
        start = 0
        for i in range(1, len(part) + 1):
            if i == len(part) or part[i - 1 : i + 1] not in self.joined:
                run = part[start:i]
                found = self.runs.get(run)
                if found is None:
                    found = self.merged(run)
                    if len(self.runs) < MEMO_PARTS // 4:
                        self.runs[run] = found
                ids += found
                start = i
        return ids

    def __missing__(self, key: str) -> bytes:
        mark = self.marks.get(key[-1:])
        if mark is not None and len(key) > 1 and key[-2:] not in self.joined:
            return self[key[:-1]] + mark
        part = SPACE + key
        numbers = self.part_ids(part)
        ids = pack_ids(numbers)
        if "".join([self.pieces[i] for i in numbers]) != part:  # else the pieces themselves are the text
            if (decoded := self.decode(numbers, strip=False)) != part.replace(SPACE, " "):
                self.odd[key] = decoded
        self.unchecked[key] = ids
        if len(self) < MEMO_PARTS:
            self[key] = ids
        return ids

    def check(self) -> None:
        """Compare the parts that went through the agenda since the last call with the library."""
        if not self.unchecked:
            return
        # The library puts a space before each text itself.
        theirs = self.library.encode([k.replace(SPACE, " ") for k in self.unchecked], num_threads=1)
        for (key, own), ids in zip(self.unchecked.items(), theirs):
            if pack_ids(ids) != own and key:  # the library has no ids for an empty text
                raise ValueError(f"the agenda and the library differ on {key!r}")
        self.unchecked.clear()

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [p[1:] for p in _PART.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> bytes:
        """Ids as bytes, with begin and end ids."""
        return b"".join([pack_ids([self.begin]), *[self[p] for p in self.parts(text)], pack_ids([self.end])])

    def decode(self, ids: list[int], strip: bool = True) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, the leading space taken off."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if strip and text.startswith(" ") else text

    def decoded(self, text: str) -> str:
        """What the ids of ``text`` decode to: each part's own decoding, joined."""
        if not self.odd:
            return text.replace(SPACE, " ")
        return "".join(self.odd.get(p, " " + p.replace(SPACE, " ")) for p in self.parts(text))[1:]


@lru_cache(maxsize=2)
def _codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def piece_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        codec = _codec(model_path)

        def step(cols: dict) -> dict:
            out: dict = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in cols["text"]:
                ids = codec.encode(text)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decoded(text).encode("utf-8", "replace")).hexdigest())
            codec.check()
            return out

        return step

    return map_rows(texts_of(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
