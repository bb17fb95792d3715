"""Byte-level BPE encoding and decoding in linear time by Aho-Corasick backtracking.

Bytes are mapped to Latin-1 letters so that a pyahocorasick automaton over all
tokens finds, in one pass over a piece, every token that starts at each byte.
Encoding walks forward with the longest token at each byte and steps back to
the next shorter one where the pair of neighbours could not stand side by side
after the merges.  Whether two tokens can is decided by undoing their last
merges from the seam outwards: the pair is incompatible as soon as two parts
that meet at the seam would have merged earlier than either part's own merge.
The answer is memoised per pair, a byte once found to lead nowhere is never
entered again, and a token has a bounded number of shorter ones, so the work
is linear in the piece.

A piece that is itself a token is that token, as the rank files' own library
does it.  Pieces come from a pattern, are encoded separately and are
remembered (the memo is bounded).

Defined results: null and empty texts have no ids; repeated rows get repeated
results; null keys stay null; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.llm.common import bounded_batches, id_and_bytes

MEMO = 600_000                 # pieces a worker remembers
MEMO_CHARS = 48                # longest piece remembered
PAIRS = 1_000_000              # token pairs whose compatibility a worker remembers
WINDOW = 1 << 14               # bytes of a piece whose tokens are looked up at once
# Unicode White_Space, spelled out: what \\s means to the rank files' own library
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def spelled_out(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` as explicit classes."""
    return (pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")
            .replace(r"\s", f"[{SPACE}]"))


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = read_ranks(rank_file)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(spelled_out(pattern))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}        # token -> the parts of its last merge
        self.joins: dict[tuple[int, int], int] = {}         # parts -> token
        for token in sorted(self.ranks, key=self.ranks.get):
            rank = self.ranks[token]
            if len(token) > 1:
                parts = self._merged_below(token, rank)
                if len(parts) == 2:
                    self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
                    self.joins[self.halves[rank]] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)

    def _merged_below(self, token: bytes, limit: int) -> list[bytes]:
        """The parts of a token after all merges of a rank below ``limit``."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [self.ranks.get(a + b, limit) for a, b in zip(parts, parts[1:])]
            low = min(ranked)
            if low >= limit:
                break
            k = ranked.index(low)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens can be neighbours when all merges are done."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the later of the two last merges until no merge is left.  A merge over the
        seam beats the undone ones if its rank is lower: on the left it must be lower than
        the undone token's, on the right equal rank wins too, as the left one goes first."""
        halves, joins = self.halves, self.joins
        bound = None                     # merges over the seam from this rank on come too late
        while True:
            over = joins.get((left, right))
            if over is not None and (bound is None or over < bound):
                return False
            can_left, can_right = left in halves, right in halves
            if can_left and (not can_right or left > right):
                bound, left = left, halves[left][1]
            elif can_right:
                bound, right = right + 1, halves[right][0]
            else:
                return True

    def _tokens_at(self, piece: str):
        """Function from a byte of the piece to the tokens starting there, longest first,
        as (length, rank); looked up a window at a time."""
        held: dict[int, list[list[tuple[int, int]]]] = {}

        def at(pos: int) -> list[tuple[int, int]]:
            block = pos // WINDOW
            rows = held.get(block)
            if rows is None:
                first = block * WINDOW
                text = piece[first:first + WINDOW + self.longest]
                rows = [[] for _ in range(len(text))]
                for end, (size, rank) in self.automaton.iter(text):
                    rows[end - size + 1].append((size, rank))
                for row in rows:
                    row.reverse()
                if len(held) > 3:
                    held.pop(min(held))
                held[block] = rows
            return rows[pos - block * WINDOW]

        return at

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        at, size = self._tokens_at(piece.decode("latin-1")), len(piece)
        ids: list[int] = []
        tried: list[int] = []                       # index of each chosen token among those at its byte
        pos, k = 0, 0
        dead = bytearray(size + 1)                  # bytes no valid encoding can pass through
        while pos < size:
            choices = at(pos)
            while k < len(choices):
                length, rank = choices[k]
                if not dead[pos + length] and (not ids or self.compatible(ids[-1], rank)):
                    ids.append(rank)
                    tried.append(k)
                    pos, k = pos + length, 0
                    break
                k += 1
            else:                                   # nothing fits: this byte is dead, step back
                dead[pos] = 1
                rank, k = ids.pop(), tried.pop() + 1
                pos -= len(self.tokens[rank])
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        memo = self.memo
        if not memo.roomy():
            memo.clear()
        if self._splits_at_spaces(text):
            first, *rest = text.split(" ")
            return memo.whole(first) + b"".join(map(memo.__getitem__, rest))
        return b"".join([memo.one(p) for p in self.pattern.findall(text)])

    @staticmethod
    def _splits_at_spaces(text: str) -> bool:
        """Whether no space has white space beside it: each space then begins a piece, and
        the text can be cut there."""
        if "  " in text:
            return False
        return not any(c in text and (c + " " in text or " " + c in text) for c in OTHER_SPACES)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a sequence of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


OTHER_SPACES = regex.findall(f"[{SPACE}]", "".join(map(chr, [*range(32), *range(33, 0x3001)])))


class _Memo(dict):
    """From a word that is one piece with the space before it to the ids of that piece.
    Other pieces (at a line start, punctuation) are in ``pieces``."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe
        self.pieces: dict[str, bytes] = {}

    def roomy(self) -> bool:
        return len(self) + len(self.pieces) < MEMO

    def clear(self) -> None:
        super().clear()
        self.pieces.clear()

    def one(self, piece: str) -> bytes:
        """Ids of one piece of the pattern."""
        held, key = (self, piece[1:]) if piece[0] == " " else (self.pieces, piece)
        found = held.get(key)
        if found is None:
            ids = self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= MEMO_CHARS and self.roomy():
                held[key] = found
        return found

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.one, self.bpe.pattern.findall(text)))

    def __missing__(self, word: str) -> bytes:
        return self.whole(" " + word)


@functools.lru_cache(maxsize=2)
def byte_bpe(rank_file: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def _shared(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())       # a vocabulary file: a fixed, small size


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(id_col, ids)`` of every row, ids as little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)
    file = _shared(docs.sparkSession, rank_path)
    src = id_and_bytes(docs, id_col, text_col)

    def run(batches):
        bpe = byte_bpe(file.value, pattern)
        for batch in batches:
            ids = [bpe.encode((b or b"").decode("utf-8", "replace")) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {id_type}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """``(id_col, ids, decoded)`` of every row: the bytes the ids stand for."""
    bounded_batches(encoded.sparkSession)
    file = _shared(encoded.sparkSession, rank_path)
    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        bpe = byte_bpe(file.value, pattern)
        for batch in batches:
            out = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                             ["id", "ids", "decoded"])

    id_type = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(run, f"id {id_type}, ids binary, decoded binary")
            .withColumnRenamed("id", id_col))
