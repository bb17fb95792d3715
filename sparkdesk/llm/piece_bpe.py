"""SentencePiece BPE encoding and decoding in linear time by a table of prefixes.

A BPE encoding of a prefix ends in exactly one token, and the encoding before
that token is the encoding of the shorter prefix.  So one pass of an
Aho-Corasick automaton fills a table: for every character, among the tokens
that end there, longest first, the one that may stand after the last token of
the prefix in front of it.  Ids are then read backwards from the end of the
table.  Whether two tokens may stand side by side is told by undoing their
merges from the seam outwards (a merge over the seam that comes earlier than
an undone one rules the pair out) and is remembered per pair; where scores of
different pieces are equal, the pair's own text is merged step by step instead.

Texts are cut where no piece of the vocabulary can reach over (before a space
mark after another character, if no piece holds such a place), and the ids of
short chunks are remembered (the memo is bounded).  A chunk of any length takes
time linear in it.

Models: BPE without a character map, user-defined pieces or removal of white
space (``PieceModel`` refuses others).  Characters outside the vocabulary become
byte pieces, or the unknown id, one for a run, where the model has none.

Defined results: null and empty texts have no ids but the end id, where one is
asked for; very long texts and words are encoded whole; repeated rows get
repeated results; null keys stay null; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.llm.common import bounded_batches, id_and_bytes

MEMO = 500_000                 # chunks, and parts of chunks, a worker remembers
MEMO_CHARS = 48                # longest chunk remembered
PAIRS = 1_000_000              # token pairs whose compatibility a worker remembers
# fixed values: the model file's message fields, piece types and the space mark
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_TYPE, BPE, BYTE_FALLBACK, UNK_ID, EOS_ID, UNK_SURFACE = 3, 2, 35, 40, 42, 44
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
MARK = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(field number, value)`` of a protocol buffer message."""
    pos = 0

    def varint() -> int:
        nonlocal pos
        value = shift = 0
        while True:
            byte = data[pos]
            pos += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while pos < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[pos:pos + size]
        pos += size


class PieceModel:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        parts: dict[int, list[bytes]] = {PIECES: [], TRAINER: [], NORMALIZER: []}
        for field, value in _fields(model):
            if field in parts:
                parts[field].append(value)
        trainer, normalizer = dict(_fields(b"".join(parts[TRAINER]))), dict(_fields(b"".join(parts[NORMALIZER])))
        rows = [dict(_fields(p)) for p in parts[PIECES]]
        self.pieces = [r[PIECE].decode() for r in rows]
        self.types = [r.get(TYPE, NORMAL) for r in rows]
        if (trainer.get(MODEL_TYPE, 1) != BPE or normalizer.get(CHARSMAP) or normalizer.get(REMOVE_SPACES, 1)
                or not normalizer.get(ESCAPE_SPACES, 1) or USER_DEFINED in self.types or UNUSED in self.types):
            raise ValueError("only BPE models without normalisation and user-defined pieces are read")
        self.prefix = MARK if normalizer.get(DUMMY_PREFIX, 1) else ""
        self.unk, self.eos = trainer.get(UNK_ID, 0), trainer.get(EOS_ID, 2)
        self.unk_surface = trainer.get(UNK_SURFACE, " ⁇ ".encode()).decode()
        self.bytes = {}
        if trainer.get(BYTE_FALLBACK):
            self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self._learn({p: (i, struct.unpack("<f", r.get(SCORE, bytes(4)))[0])
                     for i, (p, t, r) in enumerate(zip(self.pieces, self.types, rows)) if t == NORMAL})
        # no token reaches over a mark behind another character: chunks are independent
        apart = not any(re.search(f"[^{MARK}]{MARK}", t) for t in self.ids)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if apart else "(?s).+")
        self.glued = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)
        self.surfaces = [self._surface(i) for i in range(len(self.pieces))]
        self.byte_ids = np.array([t == BYTE for t in self.types] + [False])

    def _learn(self, vocabulary: dict[str, tuple[int, float]]) -> None:
        """Ranks, last merges and automaton of the tokens that merging can reach."""
        order = {s: k for k, s in enumerate(sorted({s for _, s in vocabulary.values()}, reverse=True))}
        self.ranks = {p: order[s] for p, (_, s) in vocabulary.items() if len(p) > 1}
        self.ids = {p: i for p, (i, _) in vocabulary.items()}
        # characters that only occur inside pieces get ids past the vocabulary
        inner = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.extra = {len(self.pieces) + k: c for k, c in enumerate(inner)}
        self.ids.update({c: i for i, c in self.extra.items()})
        self.texts = {i: p for p, i in self.ids.items()}
        shared: dict[int, int] = {}
        for r in self.ranks.values():
            shared[r] = shared.get(r, 0) + 1
        self.rank_of = {self.ids[p]: r for p, r in self.ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}         # token -> the parts of its last merge
        self.joins: dict[tuple[int, int], int] = {}          # parts -> token
        self.tied = set()                                    # tokens with a tie in their merges
        self.automaton = ahocorasick.Automaton()
        for p in sorted(self.ids, key=len):
            i = self.ids[p]
            if len(p) > 1:
                parts = self._merged(p, len(p))
                if len(parts) != 2:                          # no merge order ends in this piece
                    continue
                self.halves[i] = left, right = self.ids[parts[0]], self.ids[parts[1]]
                self.joins[left, right] = i
                if shared[self.ranks[p]] > 1 or left in self.tied or right in self.tied:
                    self.tied.add(i)
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()

    def _merged(self, text: str, whole: int = -1) -> list[str]:
        """The tokens of a short text merged step by step: best score first, then leftmost.
        Stops at the two parts whose merge gives a token of ``whole`` characters."""
        parts, ranks = list(text), self.ranks
        while len(parts) > 1:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            _, k = min(found)
            if len(parts) == 2 and whole == len(text):
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens can be neighbours when all merges are done."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        halves, ranks, tied = self.halves, self.rank_of, self.tied
        a, b, bound = left, right, None      # merges over the seam from rank ``bound`` on come too late
        by_steps = a in tied or b in tied
        while not by_steps:
            over = self.joins.get((a, b))
            if over is not None:
                if over in tied:
                    break
                if bound is None or ranks[over] < bound:
                    return False
            undo_a = a in halves and (b not in halves or ranks[a] > ranks[b])
            if undo_a:
                bound, a = ranks[a], halves[a][1]
            elif b in halves:
                bound, b = ranks[b] + 1, halves[b][0]
            else:
                return True
        return self._merged(self.texts[left] + self.texts[right]) == [self.texts[left], self.texts[right]]

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of one chunk: the last token of every prefix, then the way back."""
        last, compatible = array("i"), self.compatible          # per character; -1 - code for unknown ones
        for end, (size, token) in self.automaton.iter(text):
            done = len(last)
            if end < done:
                continue                                        # a longer token was right
            while done < end - size + 1 or (done < end and size == 1):
                last.append(-1 - ord(text[done]))               # no token ends here
                done += 1
            start = end + 1 - size
            if done == end and (not start or last[start - 1] < 0 or compatible(last[start - 1], token)):
                last.append(token)
        for c in text[len(last):]:
            last.append(-1 - ord(c))
        ids: list[int] = []
        pos = len(text)
        while pos:
            token = last[pos - 1]
            pos -= 1 if token < 0 else len(self.texts[token])
            if token >= 0 and token not in self.extra:
                ids.append(token)
                continue
            char = chr(-1 - token) if token < 0 else self.extra[token]
            if self.bytes:
                ids.extend(self.bytes[x] for x in reversed(char.encode("utf-8", "surrogatepass")))
            elif not ids or ids[-1] != self.unk:                # a run of unknown characters is one
                ids.append(self.unk)
        ids.reverse()
        return ids

    def encode(self, text: str, end: bool = False) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        tail = struct.pack("<i", self.eos) if end else b""
        if not text:
            return tail
        marked = self.prefix + text.replace(" ", MARK)
        return b"".join(map(self.memo.__getitem__, self.cut.findall(marked))) + tail

    def _surface(self, i: int) -> str:
        kind = self.types[i]
        return {CONTROL: "", UNKNOWN: self.unk_surface}.get(kind, self.pieces[i].replace(MARK, " "))

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids; byte pieces that are no UTF-8 become U+FFFD, one each."""
        surfaces = self.surfaces
        if not self.byte_ids[ids].any():
            found = list(map(surfaces.__getitem__, ids.tolist()))
        else:
            found, run = [], bytearray()
            for i in [*ids.tolist(), -1]:
                if self.byte_ids[i]:
                    run.append(int(self.pieces[i][3:5], 16))
                    continue
                if run:
                    found.append(_decoded(bytes(run)))
                    run.clear()
                if i >= 0:
                    found.append(surfaces[i])
        text = "".join(found)
        # the mark put in front goes again; an unknown or byte piece in front keeps it
        first = next((i for i in ids.tolist() if self.types[i] != CONTROL), None)
        if self.prefix and first is not None and self.pieces[first][:1] == MARK:
            return text[1:]
        return text


def _decoded(data: bytes) -> str:
    """UTF-8 text with one U+FFFD for every byte that belongs to no character."""
    return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in data.decode("utf-8", "surrogateescape"))


class _Memo(dict):
    """From a chunk to its ids as bytes; ``parts`` has those of the parts of longer chunks."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            ids = self.model.encode_chunk(text)
            found = struct.pack(f"<{len(ids)}i", *ids)
            if len(text) <= MEMO_CHARS:
                if len(self.parts) >= MEMO:
                    self.parts.clear()
                self.parts[text] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        # neighbours that no piece holds side by side part the chunk, too (not where a run of
        # unknown characters shares one id)
        glued = self.model.glued
        seams = [k for k in range(1, len(chunk)) if chunk[k - 1:k + 1] not in glued] if self.model.bytes else []
        found = b"".join([self.part(chunk[a:b]) for a, b in zip([0, *seams], [*seams, len(chunk)])])
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = found
        return found


@functools.lru_cache(maxsize=2)
def piece_model(model: bytes) -> PieceModel:
    return PieceModel(model)


def _shared(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())       # a vocabulary file: a fixed, small size


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           end: bool = True) -> DataFrame:
    """``(id_col, ids)`` of every row, ``ids`` an array of ints; ``end`` adds the end id."""
    bounded_batches(docs.sparkSession)
    file = _shared(docs.sparkSession, model_path)
    src = id_and_bytes(docs, id_col, text_col)

    def run(batches):
        model = piece_model(file.value)
        for batch in batches:
            rows = [model.encode((b or b"").decode("utf-8", "replace"), end) for b in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)]).astype("i4")
            values = pa.array(np.frombuffer(b"".join(rows), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "ids"])

    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, ids, decoded)`` of every row: the text the ids stand for (null ids: empty)."""
    bounded_batches(encoded.sparkSession)
    file = _shared(encoded.sparkSession, model_path)
    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        model = piece_model(file.value)
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            values = np.asarray(lists.flatten())
            out = [model.decode(values[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.string())],
                                             ["id", "ids", "decoded"])

    id_type = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(run, f"id {id_type}, ids array<int>, decoded string")
            .withColumnRenamed("id", id_col))
