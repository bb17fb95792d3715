import corpus_pipeline
import __spark_entry__
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkdesk.session import materialize
from tests.conftest import SF
from tests.llm.data import documents, edge_documents, none, prose
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_packing import check
from tests.llm.test_simhash import slow_components, slow_fingerprint


def staged(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], "unused")))
    return out


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_against_brute_force(spark):
    shared = "\n".join(prose(50 + i, 25) for i in range(4))
    rows = [f"{prose(i, 60)}\n{prose(100 + i, 20)}" for i in range(25)]
    rows += [f"{prose(200 + i, 40)}\n{shared}\n{prose(300 + i, 30)}" for i in range(6)]
    rows += [rows[3], rows[4] + " red1", f"mail bob@corp.com {prose(9, 30)}", None, "", "12345 ???", "short one"]
    docs = documents(spark, rows)
    first, known, lines, single, masked, packed = staged(spark, docs)
    for df in (known, lines, single, masked):
        assert df.columns == docs.columns
    gone = {i for i, t in texts(first)} - {i for i, t in texts(known)}
    assert gone == {i for i, t in enumerate(rows) if not any(c.isalpha() for c in t or "")}
    assert texts(lines) == slow_lines(texts(known))
    prints = [(i, slow_fingerprint(t)) for i, t in texts(lines)]
    comp = slow_components(prints)
    assert texts(single) == [(i, t) for i, t in texts(lines) if comp[slow_fingerprint(t)] == i]
    assert texts(masked) == [(i, t.replace("bob@corp.com", "[EMAIL]")) for i, t in texts(single)]
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    assert check(packed.collect(), texts(masked)) == 0


def test_edges(spark):
    *_, packed = staged(spark, edge_documents(spark).withColumn("lang", F.lit("en")))
    assert {r.doc_id for r in packed.collect()} >= {None, 3, 6}
    assert staged(spark, none(spark))[-1].count() == 0


def test_run_and_registration(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    packed = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert 900 < len(ids) <= docs.count()
    vocab = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert vocab.get_vocab_size() == 49408
