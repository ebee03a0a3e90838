"""Small tables with everything that operators must bear."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use for results or inside, as further columns of the input.
CLASHES = ["score", "n_words", "spans", "fp", "rate", "copy", "place", "fail_bits", "n_hits", "rejected", "contaminated", "entities",
           "m", "cdf", "_w", "_e", "_n", "root", "h", "e", "_key", "_salt", "_u", "_id", "_from", "_text", "_aside", "clean_text", "n_lines"]

STORY = "The quick brown fox jumps over the lazy dog while seven slow turtles watch from the river bank and think about lunch in silence"


def odd_rows():
    long_text = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
    return [
        (1, STORY, "en", "a", 10), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "de", "b", 4),
        (5, STORY, "en", "a", 10), (5, STORY, "en", "a", 10), (6, STORY + " again and again", "en", "a", 10),
        (7, long_text, "en", "a", 1), (8, "12345 67890 !!!", "de", "b", 3), (None, STORY, "en", "a", 1),
        (9, "Ünïcödé wörds — 中文 слова x \U0001f600", "de", None, 5), (10, "one", "de", "b", 3),
    ]


def table(spark, rows, clashes=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]) if clashes else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
