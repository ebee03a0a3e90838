"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the measurements
and one bit per failed rule; a policy is a version name with the mask of the
rules that reject, so a new policy needs no new look at the texts, and the
effect of leaving a rule out (ablation) is read off counts per bit pattern.
All expressions are built-in SQL functions.

Results of odd input: a null or empty text measures 0 everywhere and fails
``too_short``; repeated rows get a row each; an empty table gives an empty
ledger and ablations of 0; measures of a text don't depend on other columns;
columns that clash with a measure are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, Aside

GRAM = 8
SYMBOLS = "[#*$%&|<>]"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters"]

#: name -> failing condition over the measurements; the position is the bit.
RULES = {
    "too_short": "n_words < 20",
    "repeated_phrases": "100 * n_repeat_words > 30 * n_words",
    "long_or_short_words": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_lines",
    "few_letters": "100 * n_letters < 50 * word_chars",
}

#: The base rules' bits, and policy versions: name -> rules that reject.
BASE = ["too_short", "repeated_phrases"]
POLICIES = {
    "base-1": BASE,
    "prose-1": list(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask_of(rules) -> int:
    return sum(bit(r) for r in rules)


def measured(docs: DataFrame, text: str = "text", gram: int = GRAM) -> DataFrame:
    """``docs`` with the measurement columns.

    Windows of ``gram`` words are compared by 64-bit hash.  Only a text with a
    repeated hash is looked at further: hashes are sorted with their
    positions, the positions of repeated ones sorted again, and each covers
    the words up to the next, at most ``gram``."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE_CHARS))
    aside = Aside(docs.drop(*MEASURES), [text])
    df = aside.rows.withColumn("_t", t)
    df = df.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("_g", F.expr(
        f"CASE WHEN size(_w) > {gram} THEN transform(sequence(1, size(_w) - {gram - 1}), i -> xxhash64(slice(_w, i, {gram}))) END"))
    # only texts with a repeated window are sorted: (hash, position) pairs, of which neighbours with one hash are kept
    df = df.withColumn("_s", F.expr(
        "CASE WHEN size(array_distinct(_g)) < size(_g) THEN array_sort(transform(_g, (g, i) -> struct(g, i))) END"))
    df = df.withColumn("_d", F.expr(
        """CASE WHEN size(_s) > 1 THEN array_sort(transform(filter(sequence(0, size(_s) - 1), k ->
             (k > 0 AND _s[greatest(k - 1, 0)].g = _s[k].g)
             OR (k < size(_s) - 1 AND _s[least(k + 1, size(_s) - 1)].g = _s[k].g)), k -> _s[k].i)) END"""))
    covered = F.expr(f"""CASE WHEN size(_d) > 0 THEN aggregate(sequence(0, size(_d) - 1), 0L, (n, k) -> n +
        CASE WHEN k = size(_d) - 1 THEN {gram} ELSE least({gram}, _d[k + 1] - _d[k]) END) ELSE 0L END""")
    return aside.restored(
        df.withColumn("word_chars", F.char_length(F.concat_ws("", "_w")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_lines", F.size("_l").cast("long"))
        .withColumn("n_letters", F.regexp_count("_t", F.lit(r"\p{L}")).cast("long"))
        .withColumn("n_repeat_words", covered),
        MEASURES,
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``."""
    df = measured(docs.drop("fail_bits"), text)
    bits = F.lit(0).cast("long")
    for rule, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("fail_bits", bits)


def failed(bits: str, mask: int) -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) != 0


def judged(rows: DataFrame, policy: str = "prose-1") -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``."""
    base = failed("fail_bits", mask_of(BASE))
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & ~failed("fail_bits", mask_of(POLICIES[policy])))


def ablations(rows: DataFrame, policy: str = "prose-1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those rejected by it
    alone (kept if the rule were left out).  The ledger is counted once per
    bit pattern (at most 2 to the number of rules)."""
    rules, mask = POLICIES[policy], mask_of(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in rules]))
    return (
        patterns.withColumn("r", each).groupBy("r.rule", "r.bit")
        .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
             F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_rejected_alone"))
        .withColumn("policy", F.lit(policy)).select("policy", "rule", "n_failed", "n_rejected_alone")
    )


#: ``op3`` in DuckDB SQL over ``documents``.
SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS gram FROM w, range(1, len(w) - 6) r(i) WHERE len(w) >= 8),
 h AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
 s AS (SELECT doc_id, i, LEAD(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM h WHERE c > 1),
 r AS (SELECT doc_id, SUM(LEAST(8, COALESCE(nx - i, 8)))::BIGINT AS n_repeat_words FROM s GROUP BY doc_id),
 m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        COALESCE(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '\p{L}')) AS n_letters
       FROM w LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 16 ELSE 0 END
        + CASE WHEN 100 * n_letters < 50 * word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
 (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
