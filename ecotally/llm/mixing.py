"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate, target size over present size; every
document gets a uniform number from a hash of seed and id, and the
inverse of the Poisson distribution at that number is its count of copies.
Copies are exploded and put in a global random order (range-partitioned on a
second hash).

Results of odd input: a null source is a source of its own; a null or empty
text has size 0 and the rate of its source; rows equal in id get the same
count; an empty table mixes to an empty one; a source with target weight
0 or without a weight goes, one of total size 0 keeps rate 0; further columns
are carried along, clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Aside, stored

#: Sources whose rates are sent to every executor; beyond, they are joined by a shuffle with salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 32


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Characters per source (partial sums before the shuffle)."""
    size = F.sum(F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long"))
    return docs.groupBy(F.col(source).alias("_source")).agg(size.alias("size"), F.count(F.lit(1)).alias("n_docs"))


def smoothed_weights(sizes: DataFrame, power: float = 0.5) -> DataFrame:
    """Target weights ``size ** power``: large sources shrink, small ones grow."""
    return sizes.select("_source", F.pow(F.col("size").cast("double"), F.lit(power)).alias("weight"))


def rates(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean repetition per source that gives each its share of the present
    total."""
    w = weights.select(F.col("_source").alias("_w"), "weight")
    both = sizes.join(w, F.col("_source").eqNullSafe(F.col("_w"))).drop("_w")
    all_size, all_weight = both.agg(F.sum("size"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(all_weight or 0))
    rate = F.when((F.col("size") > 0) & F.lit(bool(all_weight)), share * F.lit(float(all_size or 0)) / F.col("size"))
    return both.select("_source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_inverse(rate: str, u: str):
    """The least k with P(count <= k) > ``u``.

    The distribution is summed upward by its recursion, with nothing kept but
    the term, the sum and the count, from 0 or, for large rates, from 12
    standard deviations below the mean on, where the term is had from
    Stirling's series: about 24 times the root of the rate in steps."""
    low = f"CAST(greatest(0, floor({rate} - 12 * sqrt({rate}) - 30)) AS int)"
    start = f"if({low} < 20, 0, {low})"
    most = f"CAST(ceil({rate} + 12 * sqrt({rate}) + 30) AS int)"
    term = f"""CASE WHEN {low} < 20 THEN exp(-{rate}) ELSE exp({low} * ln({rate} / {low}) - {rate} + {low} - 0.5 * ln(2 * pi() * {low})
        - 1 / (12D * {low}) + 1 / (360D * {low} * {low} * {low})) END"""
    step = f"""named_struct('p', s.p * {rate} / (k + 1), 'sum', s.sum + s.p, 'n', s.n + if(s.sum + s.p <= {u}, 1, 0))"""
    return F.expr(f"""CASE WHEN {rate} > 0 THEN CAST(aggregate(sequence({start}, {most}),
        named_struct('p', {term}, 'sum', 0D, 'n', {start}), (s, k) -> {step}, s -> s.n) AS long) ELSE 0L END""")


def uniform(seed: int, *columns: str):
    """A number in [0, 1) of 32 bits from the MD5 of seed and columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_counts(docs: DataFrame, weights=None, seed: int = 7, doc_id: str = "doc_id", text: str = "text",
                source: str = "source", power: float = 0.5) -> DataFrame:
    """``docs`` with ``rate`` and ``n_copies``.  ``weights`` is a DataFrame
    (source, weight); without one, weights are smoothed sizes."""
    sizes = stored(source_sizes(docs, source, text), "source-sizes")
    if weights is None:
        weights = smoothed_weights(sizes, power)
    else:
        weights = weights.select(F.col(weights.columns[0]).alias("_source"), F.col(weights.columns[1]).cast("double").alias("weight"))
    by_source = stored(rates(sizes, weights), "source-rates")
    few = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    aside = Aside(docs, list(dict.fromkeys([doc_id, text, source])))
    rows = aside.rows.withColumnsRenamed({doc_id: "_id", text: "_text", source: "_from"})
    if few:
        joined = rows.join(F.broadcast(by_source), F.col("_from").eqNullSafe(F.col("_source")))
    else:
        salted = by_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        place = F.pmod(F.xxhash64("_id", "_text"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("_place", place).join(
            salted, F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_place") == F.col("_salt")))
    counted = joined.withColumn("_u", uniform(seed, "_id")).withColumn("n_copies", poisson_inverse("rate", "_u"))
    counted = counted.withColumnsRenamed({"_id": doc_id, "_text": text, "_from": source})
    return aside.restored(counted, ["rate", "n_copies"])


def mixed(docs: DataFrame, weights=None, seed: int = 7, doc_id: str = "doc_id", **kw) -> DataFrame:
    """Every document as often as its count says, with ``copy`` (from 0) and
    ``place`` (the random sort key), in global random order."""
    counted = with_counts(docs, weights, seed, doc_id, **kw).drop("copy", "place").filter("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    placed = copies.withColumn("place", F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.col(doc_id).cast("string"), F.col("copy").cast("string"))))
    return placed.repartitionByRange("place").sortWithinPartitions("place", doc_id, "copy")


#: ``op2`` in DuckDB SQL over ``documents`` (seed 7, power 0.5).
SQL = """
WITH s AS (SELECT source, SUM(COALESCE(length(text), 0))::BIGINT AS size FROM documents GROUP BY source),
 w AS (SELECT source, size, pow(size::DOUBLE, 0.5) AS weight FROM s),
 r AS (SELECT source, CASE WHEN size > 0 THEN weight / (SELECT SUM(weight) FROM w) * (SELECT SUM(size) FROM w)::DOUBLE / size ELSE 0 END AS rate FROM w),
 p AS (SELECT source, rate, k, exp(-rate + k * ln(CASE WHEN rate > 0 THEN rate ELSE 1 END) - lgamma(k + 1)) AS mass
       FROM r, range(0, 400) t(k) WHERE rate > 0 AND k <= rate + 12 * sqrt(rate) + 30),
 c AS (SELECT source, k, SUM(mass) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
 u AS (SELECT doc_id, source, sha256(text) AS text_sha256, CAST('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM documents),
 n AS (SELECT u.doc_id, u.source, u.text_sha256, (SELECT COUNT(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS n_copies FROM u)
SELECT doc_id, source, text_sha256, n_copies::BIGINT AS n_copies, t.copy::BIGINT AS copy,
 md5('7:order|' || CAST(doc_id AS VARCHAR) || '|' || CAST(t.copy AS VARCHAR)) AS place
FROM n, range(0, 400) t(copy) WHERE t.copy < n_copies
"""
