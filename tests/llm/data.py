"""Small inputs shared by the tests of the operators."""

import random

from pyspark.sql import types as T

# documents columns and names that operators use for themselves
CLASHING = ["id", "body", "fp", "th", "_th", "_id", "_gone", "_lines", "_spans", "found", "score", "lang_pred",
            "spans", "start", "ids", "offset", "gram", "n", "pos", "h1", "first", "root", "node", "_m_email"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHING]])
WORDS = "red green blue grey black white amber teal olive coral ivory lilac peach plum rust sand".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(spark, texts, first_id=0):
    """Documents with ids in order; extra columns clash with the operators' own names."""
    rows = [(first_id + i, t, "en", "src", None if t is None else len(t), *["x"] * len(CLASHING))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def edge_documents(spark):
    """Null and empty texts, blanks, repeated rows, a null key, null columns, a long text."""
    base = documents(spark, [None, "", " \n\t ", "one", prose(1, 30), prose(1, 30), prose(2, 20_000), "ß ñ \U0001f642"])
    blank = [None] * len(CLASHING)
    odd = spark.createDataFrame([(None, prose(3, 12), None, None, None, *blank), (None, None, None, None, None, *blank),
                                 (4, prose(1, 30), "en", "src", 1, *["x"] * len(CLASHING)),
                                 (4, prose(1, 30), "en", "src", 1, *["x"] * len(CLASHING))], SCHEMA)
    return base.unionByName(odd)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
