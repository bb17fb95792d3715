"""Sequence packing as vector bin packing.

An example has three sizes: tokens, segments (one for a whole example or any
piece of it) and loss-bearing tokens; a sequence has a limit on each.
Examples at least as long as a sequence give whole sequences first.  The rest
wait in a bounded pool, and the open sequence takes, among those that fit
under all limits, the one whose sizes (as shares of the limits) have the
largest dot product with what the sequence has left: long examples while there
is much room, loss-heavy or light ones as that limit comes near.  When nothing
fits, or one segment slot is left, the longest example is cut to the room left
and its rest goes back to the pool.  What a task has left over at its end, and
any sequence closed under its length by another limit, is divided into
sequences whose lengths are powers of two, which need no padding.

Every task packs the rows of its own input split in one pass, holding the pool
and one Arrow batch; nothing is shuffled or gathered.  A sequence number is
the task's partition number and a counter, so a task that is run again gives
the same sequences from the same split.

Defined results: ids are those of the tokenizer library without its closing
tokens, so an added token written in a text gives its own id; null and empty
texts are the closing id alone; repeated rows
are packed as often as they occur; a null key stays null; an empty table gives
no pieces; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparkdesk.llm.common import BLANK, BLOCK, bounded_batches, id_and_bytes

POOL = 256                      # examples waiting for a sequence, per task
MEMO = 600_000                  # words whose ids a worker remembers
MEMO_BYTES = 64                 # longest word remembered
# ASCII punctuation between a Latin-1 letter and a blank is a pre-token of its own: cut
# off, so that the word before it is shared with its other forms
STOP = re.compile(rb"(?:(?<=[a-z])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))"
                  rb"[!-&(-/:-@\[-`{-~]+(?=[ \n]|\Z)")
NEVER = 1 << 40
LATIN = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")
SCHEMA = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, loss bigint"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1
    characters stand for themselves, the others take the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordTokenizer:
    """Ids of a byte-level BPE tokenizer with word ends, whose pre-tokens never hold an
    ASCII blank: texts are cut at blanks and a word's ids are worked out once while they
    are remembered.  ASCII case is folded first, as the tokenizer itself folds case.

    A word of plain Latin-1 letters is one pre-token and no normalizer changes it, so the
    merges of all such new words of a batch are applied together in numpy; every other
    word goes through the tokenizer library.

    The vocabulary's added tokens are cut out of the text as it is, before case is folded,
    and stand for their own ids; ``encode_special_tokens``, the library's switch of that
    name, takes the special ones as ordinary text instead.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # what the cut leaves is text, also where folded case makes it look like a token
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model = parts["model"]
        added = [t for t in parts.get("added_tokens") or () if not (t["special"] and encode_special_tokens)]
        for t in added:
            if any(t[k] for k in ("normalized", "single_word", "lstrip", "rstrip")) or BLANK.search(t["content"].encode()):
                raise ValueError(f"added token {t['content']!r} is not matched as plain text")
        # under a key with a blank, which no word holds
        self.added = {b" " + t["content"].encode(): np.array([t["id"]], "<u4").tobytes() for t in added}
        self.plain = [key[1:] for key in self.added]
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.plain, key=len, reverse=True))) + b")")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.last = np.array([vocab[c + end] for c in byte_letters()], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)      # by rank
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        # open-addressing table: pair -> rank, so a lookup is a gather or two
        self.slots = np.full(1 << 19, -1, np.int64)
        self.ranks = np.full(1 << 19, NEVER, np.int64)
        open_, at = np.arange(len(keys)), self._slot(keys)
        while len(open_):
            free = self.slots[at] < 0
            self.slots[at[free]] = open_[free]              # the last writer of a slot wins
            won = self.slots[at] == open_
            open_, at = open_[~won], (at[~won] + 1) & (len(self.slots) - 1)
        used = self.slots >= 0
        self.ranks[used] = self.slots[used]
        self.slots[used] = keys[self.slots[used]]
        self.memo: dict[bytes, bytes] = {}

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B97F4A7C1 >> 20) & ((1 << 19) - 1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; NEVER where there is no such merge."""
        key = left << 20 | right
        at = self._slot(key)
        out = np.full(len(key), NEVER, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.slots[at]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & (found >= 0)
            open_, at = open_[more], (at[more] + 1) & (len(self.slots) - 1)
        return out

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one pre-token each: in every round each word merges the
        leftmost of its pairs of lowest rank, until no word has a pair to merge."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        ids = self.inner[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(raw)) - np.repeat(ends - size, size)
        done_word, done_ids = [], []

        def keys(at):                   # rank, then place: the smallest key merges first
            inside = at + 1 < len(ids)
            nxt = np.minimum(at + 1, len(ids) - 1)
            inside &= word[nxt] == word[at]
            out = np.full(len(at), NEVER << 8, np.int64)
            out[inside] = self._rank(ids[at[inside]], ids[nxt[inside]]) << 8
            return out | place[at]

        key = keys(np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(key, first)
            length = np.diff(np.append(first, len(ids)))
            over = np.repeat(low >> 8 >= NEVER, length)
            if over.any():
                done_word.append(word[over])
                done_ids.append(ids[over])
                stay = ~over
                ids, key, word, place = ids[stay], key[stay], word[stay], place[stay]
                low, length = low[low >> 8 < NEVER], length[low >> 8 < NEVER]
                if not len(ids):
                    break
            at = np.flatnonzero(key == np.repeat(low, length))
            ids[at] = self.merged[key[at] >> 8]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, key, word, place = ids[keep], key[keep], word[keep], place[keep]
            at -= np.arange(len(at))            # one symbol went after each earlier merge
            key[at] = keys(at)
            before = at[(at > 0)] - 1
            before = before[word[before] == word[before + 1]]
            key[before] = keys(before)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        data = ids[order].astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words))) * 4]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words) -> dict[bytes, bytes]:
        plain, other = {}, []
        for w in words:
            if w in self.added:
                continue
            if len(w) > MEMO_BYTES:
                other.append(w)
            elif w.isalpha():                                   # ASCII letters only
                plain[w] = w
            elif LATIN.fullmatch(text := w.decode("utf-8", "replace")):
                plain[w] = text.lower().encode()
            else:
                other.append(w)
        out = dict(zip(plain, self._merge(list(plain.values())))) if plain else {}
        out.update((w, self.added[w]) for w in words if w in self.added)
        if other:
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other],
                                                     add_special_tokens=False)
            out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, found))
        return out

    def encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        """Ids of each text.  Texts over a block long are worked through block by block."""
        if sum(map(len, bodies)) <= 2 * BLOCK or len(bodies) == 1 and len(bodies[0]) <= 2 * BLOCK:
            return self._encode(bodies)
        out, group, size = [], [], 0
        for body in bodies:
            if group and size + len(body) > 2 * BLOCK:
                out += self._encode(group)
                group, size = [], 0
            if len(body) > 2 * BLOCK:
                out.append(np.concatenate([self._encode([b])[0] for b in blocks(body)]))
            else:
                group.append(body)
                size += len(body)
        return out + self._encode(group)

    def _words(self, body: bytes) -> list[bytes]:
        if not any(t in body for t in self.plain):
            return STOP.sub(rb" \g<0>", body.lower()).split()
        out = []
        for i, part in enumerate(self.cut.split(body)):         # text and tokens in turn
            out += [b" " + part] if i % 2 else STOP.sub(rb" \g<0>", part.lower()).split()
        return out

    def _encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        memo = self.memo
        split = [self._words(b) for b in bodies]
        words = set().union(*split) if split else set()
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(words)
        fresh = self._learn(new)
        memo.update((w, v) for w, v in fresh.items() if len(w) <= MEMO_BYTES)
        if any(len(w) > MEMO_BYTES for w in fresh):
            memo = {w: memo[w] if w in memo else fresh[w] for w in words}
        return [np.frombuffer(b"".join(map(memo.__getitem__, s)), "<u4") for s in split]


def blocks(data: bytes):
    """A text in pieces of about a block, cut at blanks."""
    pos = 0
    while pos < len(data):
        hit = BLANK.search(data, pos + BLOCK)
        yield data[pos:hit.end() if hit else len(data)]
        pos = hit.end() if hit else len(data)


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer as the library has it by default: added tokens count as such."""
    return WordTokenizer(path, encode_special_tokens=False)


class Packer:
    """Packs examples into sequences; ``emit(example, start, ids, sequence, offset)`` is
    called once per piece.  An example is any tag with its ids and, if not all of a
    piece's tokens but the first bear loss, a 0/1 mask of the same length."""

    def __init__(self, emit, tokens: int = 2048, segments: int = 64, loss_tokens: int = 2048,
                 pool: int = POOL):
        self.emit, self.limit = emit, np.array([tokens, segments, loss_tokens], float)
        self.tokens, self.pool = tokens, pool
        self.waiting: list[tuple] = []          # (tag, start, ids, mask)
        self.size = np.zeros((0, 3))
        self.sequence = 0

    def _loss(self, ids, mask) -> int:
        return max(len(ids) - 1, 0) if mask is None else int(mask.sum())

    def add(self, tag, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        start = 0
        while len(ids) - start >= self.tokens:
            cut = self._cut(ids[start:], None if mask is None else mask[start:], self.limit)
            part = ids[start:start + cut]
            self._close([(tag, start, part, None if mask is None else mask[start:start + cut])])
            start += cut
        if start < len(ids):
            self._wait([(tag, start, ids[start:], None if mask is None else mask[start:])])
        while len(self.waiting) >= self.pool:
            self._fill()

    def finish(self) -> None:
        while self.waiting:
            self._fill()

    def _wait(self, items: list[tuple]) -> None:
        self.waiting += items
        self.size = np.vstack([self.size] + [[[len(i), 1, self._loss(i, m)]] for _, _, i, m in items])

    def _take(self, k: int) -> tuple:
        item = self.waiting[k]
        last = self.waiting.pop()
        if k < len(self.waiting):
            self.waiting[k] = last
            self.size[k] = self.size[-1]
        self.size = self.size[:-1]
        return item

    def _cut(self, ids, mask, room: np.ndarray) -> int:
        """Longest prefix of an example within the room (at least one token)."""
        n = min(len(ids), int(room[0]))
        if mask is None:
            return max(1, min(n, int(room[2]) + 1))
        over = np.flatnonzero(np.cumsum(mask[:n]) > room[2])
        return max(1, int(over[0]) if len(over) else n)

    def _fill(self) -> None:
        """Build one sequence from the pool."""
        room, pieces = self.limit.copy(), []
        while self.waiting and room[0] >= 1 and room[1] >= 1:
            fits = (self.size <= room).all(axis=1)
            if room[1] == 1 and not (fits & (self.size[:, 0] == room[0])).any():
                fits &= False                    # the last slot: cut a long one to the room
            if fits.any():
                gain = (self.size / self.limit) @ (room / self.limit)
                item = self._take(int(np.argmax(np.where(fits, gain, -1.0))))
            else:
                tag, start, ids, mask = item = self._take(int(np.argmax(self.size[:, 0])))
                cut = self._cut(ids, mask, room)
                if pieces and self._loss(ids[:cut], None if mask is None else mask[:cut]) > room[2]:
                    self._wait([item])           # not even one token fits under the loss limit
                    break
                if cut < len(ids):
                    self._wait([(tag, start + cut, ids[cut:], None if mask is None else mask[cut:])])
                    item = (tag, start, ids[:cut], None if mask is None else mask[:cut])
            pieces.append(item)
            room -= [len(item[2]), 1, self._loss(item[2], item[3])]
        self._close(pieces)

    def _close(self, pieces: list[tuple]) -> None:
        """Write a sequence; one that is not full is divided at powers of two."""
        left = sum(len(p[2]) for p in pieces)
        queue = list(reversed(pieces))
        while left:
            goal = self.tokens if left >= self.tokens else 1 << (left.bit_length() - 1)
            at = 0
            while at < goal:
                tag, start, ids, mask = queue.pop()
                cut = min(len(ids), goal - at)
                if cut < len(ids):
                    queue.append((tag, start + cut, ids[cut:], None))
                self.emit(tag, start, ids[:cut], self.sequence, at)
                at += cut
            left -= goal
            self.sequence += 1


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", tokens: int = 2048, segments: int = 64,
                   loss_tokens: int = 2048, closing_id: int = 1, prompt_col: str | None = None) -> DataFrame:
    """Tokenize every text, close it with ``closing_id`` and pack.  One row per piece:
    ``id_col, start, length, ids`` (little-endian unsigned 32-bit)``, doc_tokens,
    sequence_id, offset, loss`` (its loss-bearing tokens).

    All tokens of a piece but the first bear loss, unless ``prompt_col`` names the text
    that comes before ``text_col`` (tokenized on its own; null is empty): then those of the
    prompt bear none, and all others do, the closing id too."""
    bounded_batches(docs.sparkSession)
    src = id_and_bytes(docs, id_col, text_col)
    if prompt_col is not None:
        src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"),
                          F.col(prompt_col).cast("binary").alias("prompt"))
    id_type = src.schema["id"].dataType

    def run(batches):
        tokenizer = word_tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(tag, start, ids, sequence, at):
            key, size, silent = tag
            loss = len(ids) - 1 if silent is None else start + len(ids) - max(start, min(silent, start + len(ids)))
            rows.append((key, start, len(ids), ids.tobytes(), size, base + sequence, at, loss))

        packer = Packer(emit, tokens, segments, loss_tokens)

        def flush():
            out = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)
            rows.clear()
            return out

        schema = None
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss"]
        for batch in batches:
            if schema is None:
                schema = pa.schema([("id", batch.schema.field(0).type), *(
                    (n, pa.binary() if n == "ids" else pa.int64()) for n in names[1:])])
            keys = batch.column(0).to_pylist()
            texts = tokenizer.encode([b or b"" for b in batch.column(1).to_pylist()])
            prompts = [None] * len(keys)
            if prompt_col is not None:
                prompts = tokenizer.encode([b or b"" for b in batch.column(2).to_pylist()])
            for key, before, ids in zip(keys, prompts, texts):
                ids = np.append(ids, np.uint32(closing_id)).astype("<u4")
                if before is None:
                    packer.add((key, len(ids), None), ids)
                else:
                    mask = np.repeat([0, 1], [len(before), len(ids)])
                    packer.add((key, len(mask), len(before)), np.concatenate([before, ids]), mask)
                if len(rows) >= 5000:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    return (src.mapInArrow(run, f"id {id_type.simpleString()}, {SCHEMA}")
            .withColumnRenamed("id", id_col))
