"""Registered queries of the training-data operators, with production
parameters over whole tables, and the SQL that must give the same rows where
SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, hmm, langid, mixing, page_text, phrases, prefix_trie, quality, simhash, structure_repair, surrogates, tokens, toxicity
from .common import id_remainder, table

#: Key of the registered query; a real run passes its own secret.
SURROGATE_KEY = "registered-query"


def op1_decontamination(spark, sf_dir):
    """Words of documents covered by benchmark windows, and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.judged(docs, table(spark, sf_dir, "benchmark")))


def op2_poisson_mix(spark, sf_dir):
    """Copies of each document under smoothed source weights, shuffled with
    their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "source", "n_copies", "copy", "place", F.sha2("text", 256).alias("text_sha256"))


def op3_quality_ledger(spark, sf_dir):
    """Measurements, failure bits and verdicts of the quality rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(quality.ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "kept")


def op4_language_id(spark, sf_dir):
    """Language of every document, learned from three quarters of the ids."""
    held = id_remainder("doc_id", 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held)
    model = langid.fit(docs.filter(~F.col("held_out")))
    found = langid.identified(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_toxicity(spark, sf_dir):
    """Toxicity score of every document, learned from three quarters of the ids."""
    held = id_remainder("doc_id", 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held)
    found = toxicity.scored(docs.withColumn("held_out", held), toxicity.fit(docs, labels))
    predicted = (F.col("score") >= toxicity.PREDICTED_FROM).cast("int").alias("predicted")
    return found.select("doc_id", "held_out", "score", predicted, "n_hits", "n_quoted")


def op6_token_output(spark, sf_dir):
    """Documents encoded to ORC files in id order and read back."""
    return tokens.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_repeated_phrases(spark, sf_dir):
    """Words of each document that no earlier 20-word window covers."""
    kept = phrases.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_pii_surrogates(spark, sf_dir):
    """Documents with personal data replaced by keyed surrogates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, SURROGATE_KEY).select("doc_id", "text", "n_entities", "entities")


def op9_simhash_anchors(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    return simhash.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_hmm_score(spark, sf_dir):
    """Language-model score of every document, learned from four fifths of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm.scored(docs.withColumn("held_out", hmm.held_out()))


def op11_prefix_trie(spark, sf_dir):
    """Nodes of the prefix trie of all rebuilt conversations."""
    turns = prefix_trie.rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie.digest(*prefix_trie.trie(turns))


def op12_structure_repair(spark, sf_dir):
    """Faults and cheapest repair of every damaged conversation."""
    rows = structure_repair.damaged(table(spark, sf_dir, "conversations"))
    return structure_repair.digest(structure_repair.repaired(rows))


def op13_page_text(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.extracted(pages, page_text.fit(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_poisson_mix, op3_quality_ledger, op4_language_id, op5_toxicity, op6_token_output,
    op7_repeated_phrases, op8_pii_surrogates, op9_simhash_anchors, op10_hmm_score, op11_prefix_trie, op12_structure_repair,
    op13_page_text,
)}

ORACLE = {"op2_poisson_mix": mixing.SQL, "op3_quality_ledger": quality.SQL, "op11_prefix_trie": prefix_trie.SQL,
          "op12_structure_repair": structure_repair.SQL}
