import random

import pytest
import xxhash

from pyspark.sql import functions as F

from sparkdesk.llm import simhash
from sparkdesk.session import materialize
from tests.llm.data import documents, edge_documents, none, prose


def slow_fingerprint(text, n=3):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits=2):
    """rows: (id, fingerprint) -> smallest id reachable of each row."""
    fps = sorted({fp for _, fp in rows})
    seen, out = set(), {}
    for fp in fps:
        if fp in seen:
            continue
        todo, group = [fp], set()
        while todo:
            a = todo.pop()
            if a in group:
                continue
            group.add(a)
            todo += [b for b in fps if b not in group and bin(a ^ b).count("1") <= bits]
        seen |= group
        ids = [i for i, f in rows if f in group and i is not None]
        out.update(dict.fromkeys(group, min(ids) if ids else None))
    return out


def expected(df):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    comp = slow_components(rows)
    return sorted(((i, f"{fp:016x}", comp[fp]) for i, fp in rows), key=str)


def found(df):
    return sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)


def test_edges(spark):
    df = edge_documents(spark)
    assert found(df) == expected(df)
    assert found(none(spark)) == []


def test_near_copies(spark):
    r, texts = random.Random(5), []
    for k in range(12):
        words = prose(k, 400).split()
        texts.append(" ".join(words))
        for _ in range(6):
            edited = list(words)
            edited[r.randrange(400)] = "EDITED"
            texts.append(" ".join(edited))
            texts.append(" ".join(words).upper())
    df = documents(spark, texts)
    assert found(df) == expected(df)


def chains_and_hubs(steps):
    r, fps = random.Random(9), set()
    for _ in range(5):
        x = r.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            for b in r.sample(range(64), r.choice(steps)):
                x ^= 1 << b
    hub = r.getrandbits(64)
    return fps | {hub ^ (1 << b) for b in range(64)} | {hub}


def frame(spark, fps):
    return spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")


@pytest.mark.parametrize("bits,hot", [(2, 64), (2, 0), (2, 3), (0, 64), (1, 64), (3, 64), (3, 2), (4, 4)])
def test_chains_and_hubs_of_fingerprints(spark, bits, hot):
    """Links and components on chosen fingerprints, whole and split buckets: chains of steps
    about as long as the limit, and a full ball."""
    fps = chains_and_hubs([max(1, bits - 1), max(1, bits), bits + 1])
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1)
             for a, b in simhash.links(frame(spark, fps), bits, hot).collect()]
    assert all(0 < bin(a ^ b).count("1") <= bits for a, b in links)
    parent = {x: x for x in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[top(a)] = top(b)
    groups = {}
    for x in fps:
        groups.setdefault(top(x), set()).add(x)
    want = slow_components([(x, x) for x in fps], bits)
    assert {frozenset(g) for g in groups.values()} == {
        frozenset(x for x in fps if want[x] == m) for m in set(want.values())}


def test_matches_are_verified_and_split_buckets_stay_small(spark):
    """Fingerprints that share a segment only are met and rejected; a hot segment value
    becomes parts that no group of copies fills, with as many links as rows."""
    r = random.Random(3)
    fps = {0x1234567800000000 | r.getrandbits(32) for _ in range(40)}
    met, proved = simhash.candidates(frame(spark, fps))
    assert met.count() == 40 * 39 // 2 and proved.count() == 0
    assert simhash.links(frame(spark, fps)).count() < 5
    many = {0x1234567800000000 | 1 << a | 1 << b for a in range(32) for b in range(32)}
    met, proved = simhash.candidates(frame(spark, many), hot=64)
    assert proved.count() <= 33 * len(many)
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in proved.collect())


def broadcast_sides(df):
    """The plan below each broadcast exchange of ``df``, as text."""
    lines, sides = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            sides.append("\n".join(lines[i + 1:end]))
    return sides


@pytest.mark.parametrize("hot", [64, 0])
def test_exploded_rows_are_never_broadcast(spark, hot):
    """A fingerprint is some 34 rows of either bucket table, which Spark takes for one: by its
    estimate a few MB, on the driver hundreds."""
    r = random.Random(11)
    nodes = materialize(frame(spark, {r.getrandbits(64) for _ in range(3000)}))
    for found in simhash.candidates(nodes, hot=hot):
        assert not any("Generate" in side for side in broadcast_sides(found))
        found.collect()                           # then the plan as adaptive execution ends it
        assert not any("Generate" in side for side in broadcast_sides(found))


def test_rows_of_documents_are_never_broadcast(spark):
    """Fingerprints go to the rows of all documents, whose file is small where texts repeat."""
    df = documents(spark, [prose(k % 5, 30) for k in range(400)])
    rows = simhash.near_duplicates(df)
    assert not any("[id#" in side for side in broadcast_sides(rows))
    assert found(df) == expected(df)
    rows.collect()
    assert not any("[id#" in side for side in broadcast_sides(rows))


def test_components(spark):
    from sparkdesk.llm.common import connected_components
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)]
    edges += [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (9, 8), (8, 9)]
    got = dict(tuple(x) for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    label = {v: v for e in edges for v in e}
    for _ in range(len(edges)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {v: m for v, m in label.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_keep_one(spark):
    df = documents(spark, ["a b c d", "A B C D", "x y z w v", None, "", "q r s t"], first_id=10)
    kept = simhash.keep_one(df.union(df))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10, 12, 13, 15]


def test_long_text_in_blocks(monkeypatch):
    text = prose(4, 3000)
    want = slow_fingerprint(text)
    from sparkdesk.llm import common
    monkeypatch.setattr(common, "BLOCK", 100)
    assert simhash.fingerprint(text.encode()) == want


def test_keep_one_keeps_different_texts_of_a_key(spark):
    one, two, three = "a b c d e", "p q r s t u", "v w x y z"
    rows = [(1, one, "r"), (1, two, "r"), (1, two, "s"), (2, two, "r"), (3, three, "r"), (0, three, "r"), (4, one, "t"),
            (None, one, "n"), (5, None, "e"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _th string")
    kept = sorted((str(r.doc_id), r.text or "") for r in simhash.keep_one(df.repartition(3)).collect())
    # texts without words are one group, of which one row of key 5 stays
    assert kept == sorted([("1", one), ("1", two), ("0", three), ("None", one), ("5", "")])
    # the row that stays does not depend on the order of rows
    picks = {tuple(sorted(map(str, simhash.keep_one(df.orderBy(F.rand(s)).repartition(4)).collect()))) for s in range(3)}
    assert len(picks) == 1
