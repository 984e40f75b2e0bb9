"""Exact encoding by a merge-type SentencePiece model, by backtracking instead of merging, and decoding.

A merge-type model starts from single code points and merges the best-scored adjacent pair (the leftmost of
equals) until no pair is a piece. Its result is the only sequence of pieces in which every piece, and every two
neighbours, stay as they are when they are merged anew on their own. So an encoder may go from left to
right: take the longest piece at the place (all pieces that begin there come from an Aho-Corasick
automaton), accept it if it is compatible with the piece before it, else try the next shorter one, and if none
fits, mark the place as failed in a bitfield, drop the piece before and go on with its shorter ones. A failed place
is never entered again, so the work is linear in the text for a given vocabulary.

A text is cut where no piece can span, before each space mark that follows another character (if the
vocabulary has no piece with such a mark inside), and the ids of short stretches are remembered. Characters
without a piece become byte pieces. Normalisation is that of identity models (a leading space mark, spaces as marks);
other models are refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from labspark.llm.shared import text_slices

SPACE = "▁"
#: Stretches of at most this many code points are remembered, and how many stretches and pairs a worker holds.
SHORT = 48
MOST_REMEMBERED = 400_000
#: Text bytes handled at once in a Python worker.
SLICE_BYTES = 2 << 20

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceModel:
    """Pieces, scores and the automaton of one model file; encodes and decodes single texts."""

    def __init__(self, path: str):
        spec = model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        if (spec.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or normal.precompiled_charsmap
                or normal.remove_extra_whitespaces or not normal.escape_whitespaces
                or spec.trainer_spec.treat_whitespace_as_suffix or kinds & {USER_DEFINED, UNUSED}):
            raise ValueError("only merge-type models with identity normalisation and plain pieces are encoded exactly")
        self.dummy_prefix = normal.add_dummy_prefix
        self.pieces = [p.piece for p in spec.pieces]
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.begin, self.end = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.longest = max(map(len, self.scores))
        self.automaton = ahocorasick.Automaton()
        for piece in self.scores:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        cut = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if cut else lambda text: [text]
        # what a decoder writes for an id: control pieces nothing, byte pieces their byte, the others their text
        byte_of = {i: b for b, i in self.byte_ids.items()}
        control = {i for i, p in enumerate(spec.pieces) if p.type == CONTROL}
        surface = {self.unknown: spec.trainer_spec.unk_surface}
        self.written = [b"" if i in control else bytes([byte_of[i]]) if i in byte_of
                        else surface.get(i, p.replace(SPACE, " ")).encode() for i, p in enumerate(self.pieces)]
        self.is_byte, self.is_control = np.zeros(len(self.pieces), bool), np.zeros(len(self.pieces), bool)
        self.is_byte[list(byte_of)] = True
        self.is_control[list(control)] = True
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._shorter: dict[str, str] = {}  # at most one entry per piece and per character

    def merged(self, text: str) -> list[str]:
        """The merges themselves, on a short text: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                     if a + b in self.scores]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether the two stay apart, and whole, when merged anew together (``before`` is empty at the start)."""
        answer = self._fits.get((before, piece))
        if answer is None:
            answer = self.merged(before + piece) == ([before, piece] if before else [piece])
            if len(self._fits) >= MOST_REMEMBERED:
                self._fits.clear()
            self._fits[before, piece] = answer
        return answer

    def longest_at(self, text: str, place: int) -> str:
        """The longest piece that begins at a place; the bare character where none does."""
        for last, piece in self.automaton.iter_long(text, place, min(len(text), place + self.longest)):
            if last + 1 - len(piece) == place:
                return piece
            break
        return text[place]

    def shorter(self, piece: str) -> str:
        """The next shorter piece with which a piece begins; its bare first character at last, then the empty text."""
        answer = self._shorter.get(piece)
        if answer is None:
            answer = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.scores), piece[:len(piece) > 1])
            self._shorter[piece] = answer
        return answer

    def fitting_start(self, text: str) -> list[str]:
        """The longest matches one after the other from the start, as long as they adjoin and fit; most often all."""
        chosen: list[str] = []
        known, before, place = self._fits, "", 0
        for last, piece in self.automaton.iter_long(text):
            place += len(piece)
            if place != last + 1:
                break
            fits = known.get((before, piece))
            if not (self.fits(before, piece) if fits is None else fits):
                break
            chosen.append(piece)
            before = piece
        return chosen

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a text, from left to right with a bitfield of failed places."""
        chosen = self.fitting_start(text)
        place = sum(map(len, chosen))
        if place == len(text):
            return chosen
        failed = bytearray(len(text) // 8 + 1)
        piece = self.longest_at(text, place)
        while place < len(text):
            before = chosen[-1] if chosen else ""
            while piece:
                end = place + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and self.fits(before, piece):
                    break
                piece = self.shorter(piece)
            if piece:
                chosen.append(piece)
                place = end
                piece = self.longest_at(text, place) if place < len(text) else ""
            else:
                failed[place >> 3] |= 1 << (place & 7)
                dropped = chosen.pop()
                place -= len(dropped)
                piece = self.shorter(dropped)
        return chosen

    def packed(self, stretch: str) -> bytes:
        """The ids of a stretch as little-endian unsigned 32-bit integers."""
        packed = self._old.get(stretch)
        if packed is None:
            pieces = self.backtracked(stretch)
            ids = list(map(self.ids.get, pieces))
            if None in ids:
                ids = self._with_bytes(pieces)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(stretch) <= SHORT:
            if len(self._known) >= MOST_REMEMBERED:  # what is still in use comes back from the old ones
                self._old, self._known = self._known, {}
            self._known[stretch] = packed
        return packed

    def _with_bytes(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for piece in pieces:
            if piece in self.ids:
                ids.append(self.ids[piece])
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in piece.encode())
            elif not ids or ids[-1] != self.unknown:  # a run of unknown characters is one unknown id
                ids.append(self.unknown)
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text with begin and end ids; the empty text has these two alone."""
        if text:
            text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        stretches = self.stretches(text)
        inner = b"".join([known or self.packed(stretch) for known, stretch
                          in zip(map(self._known.get, stretches), stretches, strict=True)])
        return np.concatenate([[self.begin], np.frombuffer(inner, "<u4"), [self.end]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids write nothing, the leading space mark goes, bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        try:
            if self.is_control[ids[1:-1]].any():  # they end a run of bytes
                text = self._decode_mended(ids)
            else:
                text = b"".join(map(self.written.__getitem__, ids.tolist())).decode()
        except UnicodeDecodeError:
            text = self._decode_mended(ids)
        # the space mark of the first piece that writes anything goes; that of a byte or of the unknown piece stays
        first = next((i for i in ids if self.written[i]), None)
        if self.dummy_prefix and first is not None and self.pieces[first].startswith(SPACE):
            return text[1:]
        return text

    def _decode_mended(self, ids: np.ndarray) -> str:
        parts: list[str] = []
        run = b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.written[i]
                continue
            while run:  # one mark for every byte that begins no character
                for size in (1, 2, 3, 4):
                    try:
                        parts.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    parts.append("�")
                run = run[size:]
            if i is not None:
                parts.append(self.written[i].decode())
        return "".join(parts)


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens and ids, the whole text's ids as packed little-endian unsigned 32-bit integers.

    ``docs`` has doc_id and text (others are left out). Null texts count as empty: they have the begin and
    the end id alone. Repeated rows get equal ids, no rows give none. No shuffle; a Python worker holds
    one slice of texts and bounded tables of remembered stretches and pairs.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                ids = [model.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) for i in ids], pa.int64()),
                     pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {key}, n_tokens long, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids and the decoded text; null ids decode to the empty text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for part in text_slices(batch, 2, 2 * SLICE_BYTES):
                texts = [model.decode(np.frombuffer(i.as_py() or b"", "<u4")) for i in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(
        work, f"doc_id {key}, n_tokens long, ids binary, decoded string")
