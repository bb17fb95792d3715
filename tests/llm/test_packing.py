import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from sparkdesk.llm import packing, queries
from tests.conftest import SF
from tests.llm.data import documents, edge_documents, none

LIBRARY = Tokenizer.from_file(queries.WORD_BPE)
LIBRARY.encode_special_tokens = True


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, texts, tokens=2048, segments=64):
    """pieces: rows; texts: list of (id, text).  Every id lies in one piece; sequences are
    gapless, within the limits, full or a power of two long."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for key in {i for i, _ in texts}:
        want = [library_ids(t) for i, t in texts if i == key]
        got = sorted(by_doc.pop(key), key=lambda p: p.start)
        assert sum(p.length for p in got) == sum(map(len, want))
        if len(want) == 1:
            ids, at = want[0], 0
            for p in got:
                assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
                part = np.array(ids[at:at + p.length], "<u4").tobytes()
                assert p.ids == part if hasattr(p, "ids") else p.ids_crc32 == zlib.crc32(part)
                at += p.length
            assert at == len(ids)
    assert not by_doc
    padding = 0
    for rows in by_seq.values():
        rows.sort(key=lambda p: p.offset)
        at = 0
        for p in rows:
            assert p.offset == at
            at += p.length
        assert at <= tokens and len(rows) <= segments
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_tokenizer_matches_the_library():
    r = random.Random(6)
    parts = ["hello", "World", "it's", "don't.", "É", "cÀfé,", "naïve...", "ß", "ẞ", "İ", "Σίσυφος", "é", "́",
             "12", "3.4", "***", "a***", "é###", "×", "a×.", " ", "  ", "\n", "\t", "\x1c", " ", " ", "中文", "\U0001f642",
             "<|endoftext|>", "x" * 70, "'s", "ing,", ".", "d'été.", "\x00", "​"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 15))) for _ in range(3000)] + parts
    words = packing.WordTokenizer(queries.WORD_BPE)
    got = words.encode([t.encode() for t in texts])
    for t, ids in zip(texts, got):
        assert ids.tolist() == library_ids(t)[:-1], repr(t)


def test_tokenizer_blocks_and_full_memo(monkeypatch):
    text = " ".join(f"word{i % 37}x é{i}." for i in range(4000))
    want = library_ids(text)[:-1]
    monkeypatch.setattr(packing, "BLOCK", 500)
    monkeypatch.setattr(packing, "MEMO", 50)
    words = packing.WordTokenizer(queries.WORD_BPE)
    got = words.encode([b"", text.encode(), b"one two"])
    assert got[1].tolist() == want and got[0].tolist() == [] and got[2].tolist() == library_ids("one two")[:-1]


def test_all_limits_hold():
    r, out = random.Random(3), []
    packer = packing.Packer(lambda *a: out.append(a), tokens=64, segments=5, loss_tokens=20, pool=16)
    examples = {}
    for k in range(400):
        n = r.choice([1, 2, 5, 30, 64, 200])
        ids, mask = np.arange(n, dtype="<u4") + 1000 * k, np.array([r.random() < 0.4 for _ in range(n)], np.int64)
        examples[k] = (ids, mask)
        packer.add(k, ids, mask)
    packer.finish()
    seen, seqs = {}, {}
    for k, start, ids, seq, at in out:
        assert (ids == examples[k][0][start:start + len(ids)]).all()
        seen.setdefault(k, []).append((start, len(ids)))
        seqs.setdefault(seq, []).append((at, len(ids), int(examples[k][1][start:start + len(ids)].sum())))
    for k, (ids, _) in examples.items():
        at = 0
        for start, n in sorted(seen[k]):
            assert start == at
            at += n
        assert at == len(ids)
    for rows in seqs.values():
        total = sum(n for _, n, _ in rows)
        assert total <= 64 and len(rows) <= 5 and sum(x for _, _, x in rows) <= 20
        assert total & (total - 1) == 0


def test_dot_product_prefers_what_fills_the_room():
    out = []
    packer = packing.Packer(lambda *a: out.append(a), tokens=8, segments=8, loss_tokens=8, pool=100)
    for k, n in enumerate([3, 5, 2, 6]):
        packer.add(k, np.zeros(n, "<u4"))
    packer.finish()
    assert [(t, len(i), s, a) for t, _, i, s, a in out] == [(3, 6, 0, 0), (2, 2, 0, 6), (1, 5, 1, 0), (0, 3, 1, 5)]


def test_edges(spark):
    df = edge_documents(spark)
    pieces = packing.pack_documents(df, queries.WORD_BPE).collect()
    assert check(pieces, [(r.doc_id, r.text) for r in df.collect()]) == 0
    assert packing.pack_documents(none(spark), queries.WORD_BPE).count() == 0
    many = documents(spark, ["tiny"] * 700 + [None] * 300)
    assert check(packing.pack_documents(many, queries.WORD_BPE).collect(),
                 [(r.doc_id, r.text) for r in many.collect()]) == 0


def test_whole_table(spark):
    pieces = queries.op5_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert check(pieces, [tuple(d) for d in docs]) == 0


UNCHANGED = Tokenizer.from_file(queries.WORD_BPE)
ADDED = ["a <|endoftext|> b", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "don't<|endoftext|>'s",
         "e<|endoftext|>́ É.<|startoftext|>,", "<|endoftext|", "<<|endoftext|>>", "x" * 70 + "<|endoftext|>" + "y" * 70,
         "<|endoftext|>" * 6, "<|startoftext|>\n\n<|endoftext|>"]


def unchanged_ids(text):
    return UNCHANGED.encode(text, add_special_tokens=False).ids


def test_added_tokens_match_the_unchanged_library(monkeypatch):
    r = random.Random(9)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "<", "endoftext", "a", "Été", "́",
             " ", "\n", "'s", ".", "12", "中文", "x" * 70]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 15))) for _ in range(2000)] + ADDED
    words = packing.word_tokenizer(queries.WORD_BPE)
    for t, ids in zip(texts, words.encode([t.encode() for t in texts])):
        assert ids.tolist() == unchanged_ids(t), repr(t)
    monkeypatch.setattr(packing, "BLOCK", 100)
    monkeypatch.setattr(packing, "MEMO", 3)
    long = " ".join(texts)
    words = packing.WordTokenizer(queries.WORD_BPE, encode_special_tokens=False)
    assert words.encode([long.encode()])[0].tolist() == unchanged_ids(long)


def test_added_tokens_are_packed_as_such(spark):
    pieces = packing.pack_documents(documents(spark, ADDED), queries.WORD_BPE).collect()
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        by_doc.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
        assert p.doc_tokens == len(unchanged_ids(ADDED[p.doc_id])) + 1
    assert by_doc == {i: [*unchanged_ids(t), 1] for i, t in enumerate(ADDED)}


def test_prompts_bear_no_loss_and_the_loss_limit_closes_sequences(spark):
    """Instruction data: prompt tokens count for length only, and a binding loss limit closes
    sequences that still have room for tokens."""
    r = random.Random(8)
    rows = [(i, None if i % 9 == 0 else " ".join(r.choice("abcdef") for _ in range(r.randrange(60))),
             None if i % 11 == 0 else " ".join(r.choice("uvwxyz") for _ in range(r.randrange(40)))) for i in range(150)]
    rows.append((150, "a " * 900, "u " * 300))
    df = spark.createDataFrame(rows, "doc_id long, ask string, text string").coalesce(1)
    limit = 60
    pieces = packing.pack_documents(df, queries.WORD_BPE, tokens=256, segments=8, loss_tokens=limit,
                                    prompt_col="ask").collect()
    of, loss, held, count = {}, {}, {}, {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
        loss[p.sequence_id] = loss.get(p.sequence_id, 0) + p.loss
        held[p.sequence_id] = held.get(p.sequence_id, 0) + p.length
        count[p.sequence_id] = count.get(p.sequence_id, 0) + 1
    for i, ask, text in rows:
        mine = sorted(of[i], key=lambda p: p.start)
        want = [*list(library_ids(ask or ""))[:-1], *library_ids(text or "")]
        assert b"".join(p.ids for p in mine) == np.array(want, "<u4").tobytes()
        assert sum(p.loss for p in mine) == len(library_ids(text or ""))
    assert max(loss.values()) <= limit and max(count.values()) <= 8 and max(held.values()) <= 256
    # the limit binds: without it sequences hold more (one closed short of 256 tokens is divided)
    free = packing.pack_documents(df, queries.WORD_BPE, tokens=256, segments=8, prompt_col="ask").collect()
    most = {}
    for p in free:
        most[p.sequence_id] = most.get(p.sequence_id, 0) + p.loss
    assert sum(x > limit for x in most.values()) > 5 and len(most) < len(loss)
