"""Small tables with the awkward rows that every text operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("fp", T.StringType()), T.StructField("size", T.StringType()), T.StructField("spans", T.StringType()),
])

PROSE = " ".join(f"word{i % 97} stands here{i % 31}" for i in range(300))


def awkward(spark):
    texts = [
        None, "", " \t\n", "one", PROSE, PROSE, PROSE.replace("word5 ", "word6 "), "a" * 50_000, "Write to ann.b@mail.example.com or +1 (961) 555-6946 now.",
        "naïve — 日本語 text with 😀 and é", "line\n" * 80, "x@y.z " * 2000, "Released under the MIT License.",
    ]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", i, "q", "r", "t") for i, t in enumerate(texts)]
    rows += [rows[4], (None, PROSE, None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
