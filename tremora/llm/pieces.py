"""SentencePiece encoding and decoding, exact for merge-type models with an identity normaliser.

A piece sequence is what merging yields if and only if each two neighbours are: merging their joined text gives
them back. So a word is encoded from left to right with the longest piece an Aho-Corasick automaton finds; where two
neighbours don't fit, the next shorter piece is tried, then the piece before, and a bitfield keeps positions from
which the rest can't be reached. Words repeat, so each worker keeps a bounded memo of them.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import small_batches, text_of

SPACE = "▁"
#: A word with the spaces before it, or a run of line ends. No piece reaches over such a boundary.
CHUNK = re.compile(r" +[^ \n]*|[^ \n]+|\n+")
#: Bounds of the memos of a worker, in entries, and of the words that enter them, in characters.
MEMO, MEMO_CHARS = 300_000, 48


class Memo(dict):
    """A mapping that computes what it lacks and starts anew when full; keys over `longest` aren't kept."""

    def __init__(self, make, bound: int = MEMO, longest: int | None = None):
        self.make, self.bound, self.longest = make, bound, longest

    def __missing__(self, key):
        value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[key] = value
        return value


class PieceCoder:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.bytes = [0] * 256
        self.texts: list[bytes] = [b""] * n
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.texts[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.texts[i] = piece.replace(SPACE, " ").encode()
        self.known = {p for p in self.ids if len(p) == 1}
        if any("\n" in p or SPACE in p.lstrip(SPACE) or not self.known.issuperset(p) for p in self.ids):
            raise ValueError("pieces over word ends, or of unknown characters, aren't supported")
        if model.normalize(" a  b") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b":
            raise ValueError("only an identity normaliser with a space put first is supported")
        self.pieces = ahocorasick.Automaton()
        for p in self.ids:
            self.pieces.add_word(p, (1 - len(p), p))
        self.pieces.make_automaton()
        self.shorter = Memo(self._shorter)
        self.fits = Memo(lambda pair: self.merge(pair[0] + pair[1]) == [p for p in pair if p])
        self.chunks = Memo(self._chunk, longest=MEMO_CHARS)

    def merge(self, text: str) -> list[str]:
        """The merges themselves: the best-scored neighbours first, the leftmost of equals. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _shorter(self, piece: str) -> str | None:
        """The longest piece that piece starts with, itself left out."""
        return next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), None)

    def split(self, text: str) -> list[str]:
        """Pieces of a text of known characters."""
        fits, last = self.fits, ""
        pieces = [p for _, (_, p) in self.pieces.iter_long(text)]
        for piece in pieces:
            if not fits[last, piece]:
                return self._backtrack(text)
            last = piece
        return pieces

    def _backtrack(self, text: str) -> list[str]:
        longest: list[str] = [""] * len(text)
        # Matches come by their ends, so the last one from a start is the longest.
        for end, (back, piece) in self.pieces.iter(text):
            longest[end + back] = piece
        fits, shorter = self.fits, self.shorter
        reachable = bytearray(b"\1") * (len(text) + 1)
        done: list[str] = []
        at, piece = 0, longest[0]
        while True:
            last = done[-1] if done else ""
            while piece is not None and not (reachable[at + len(piece)] and fits[last, piece]):
                piece = shorter[piece]
            if piece is not None:
                done.append(piece)
                at += len(piece)
                if at == len(text):
                    return done
                piece = longest[at]
            else:
                reachable[at] = 0
                piece = done.pop()
                at -= len(piece)

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Packed ids of one word, and the bytes they decode to."""
        chunk = chunk.replace(" ", SPACE)
        ids: list[int] = []
        if self.known.issuperset(chunk):
            ids = [self.ids[p] for p in self.split(chunk)]
        else:
            start = 0
            for k, c in enumerate(chunk):
                if c not in self.known:
                    if start < k:
                        ids += [self.ids[p] for p in self.split(chunk[start:k])]
                    ids += [self.bytes[b] for b in c.encode()]
                    start = k + 1
            if start < len(chunk):
                ids += [self.ids[p] for p in self.split(chunk[start:])]
        return struct.pack(f"<{len(ids)}I", *ids), b"".join([self.texts[i] for i in ids])

    def code(self, text: str) -> tuple[bytes, str]:
        """Packed little-endian ids with begin and end, and the text that they decode to."""
        ends = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        if not text:
            return b"".join(ends), ""
        ids, texts = zip(*map(self.chunks.__getitem__, CHUNK.findall(" " + text.replace(SPACE, " "))), strict=True)
        return b"".join((ends[0], *ids, ends[1])), b"".join(texts)[1:].decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """Text of ids; begin, end and other marks give none, and one leading space goes."""
        marks = {self.begin, self.end}
        return b"".join([self.texts[i] for i in ids if i not in marks]).removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=4)
def coder(path: str) -> PieceCoder:
    """One coder for each model and worker."""
    return PieceCoder(path)


def encode_decode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, ids_packed binary, n_tokens long, decoded string) and the columns to keep, for each row of docs.

    ids_packed holds all ids, begin and end included, as little-endian unsigned 32-bit integers. A null or empty text
    has just the two. Repeated rows are coded each for itself, ids may be null, and other columns aren't read. Texts
    are coded whole; memory follows the longest text of a batch, not the table. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model_path).code
        for batch in batches:
            made = [code(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", *keep)),
                    pa.array([m[0] for m in made], pa.binary()),
                    pa.array([len(m[0]) // 4 for m in made], pa.int64()),
                    pa.array([m[1] for m in made], pa.string()),
                ],
                ["doc_id", *keep, "ids_packed", "n_tokens", "decoded"],
            )

    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *keep)
    kept = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return chosen.mapInArrow(run, f"{kept}, ids_packed binary, n_tokens long, decoded string")


def unpacked(packed: Column) -> Column:
    """The ids as an array of integers."""
    digits = F.hex(packed)

    def one(k: Column) -> Column:
        parts = [F.substr(digits, (8 * k + at).cast("int"), F.lit(2)) for at in (7, 5, 3, 1)]
        return F.conv(F.concat(*parts), 16, 10).cast("int")

    starts = F.sequence(F.lit(0), (F.octet_length(packed) / 4 - 1).cast("int"))
    return F.when(F.octet_length(packed) > 0, F.transform(starts, one)).otherwise(F.array().cast("array<int>"))


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded text."""
    return encode_decode(docs, model_path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
