"""The corpus pipeline: toxicity, SimHash near-dedup, benchmark
decontamination, source mixing and token files, each stage over all that its
predecessor kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read back as the next
stage's documents.  All but the last return the columns of ``documents``.
Null or empty texts, repeated rows and further columns are treated as the
operators say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ecotally.llm import decontaminate, mixing, simhash, tokens, toxicity
from ecotally.llm.common import id_remainder, scratch, stored, table

SEED = 7


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity score rejects; the lexicon is learned
    from the labels of three quarters of the ids."""
    labels = table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 4) != 2)
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group, the one of smallest id."""
    return simhash.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover one word in twenty or
    more, and cuts the covered spans of 13 words or more out of the others."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by Poisson counts so that sources reach smoothed
    weights, in global random order."""
    return mixing.mixed(docs, seed=SEED).select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the mix to ORC files in a random order of documents (copies of
    one document far apart) and returns what reading them back gives."""
    path = scratch(spark, "token-files")
    copy = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    key = F.md5(F.concat_ws("|", F.lit(f"{SEED}:files"), F.col("doc_id").cast("string"), F.col("_copy").cast("string")))
    tokens.write_tokens(docs.withColumn("_copy", copy), path, order_by=[key])
    return tokens.digest(tokens.read_tokens(spark, path, "doc_id", docs.schema["doc_id"].dataType.simpleString()))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: No stage but mixing can be said in SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
