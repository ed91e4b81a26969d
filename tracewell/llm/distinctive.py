"""How distinctive a term is of a record, against the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Terms whose statistics are broadcast: as document frequencies add up to the postings, at most so many terms hold
#: more than one in COMMON_TERMS of them.
COMMON_TERMS = 20_000


def term_scores(records: DataFrame, key: str, terms: str, min_df: int = 2, mu: float = 500.0) -> DataFrame:
    """(key, term, tf, length, df, cf, n_records, n_terms, score) of every record's terms held by ``min_df`` records.

    ``score`` is the term's contribution to the relative entropy between the record's Dirichlet-smoothed term
    distribution and the collection's: ``p * ln(p / q)`` with ``q = cf / n_terms`` and ``p = (tf + mu * q) / (length + mu)``.
    Counts are over the records with at least one term: ``n_records`` of them with ``n_terms`` terms in all. Null keys and null
    terms are left out, records without terms give no rows; ``key`` should be unique (rows that share one count as one record).

    Term frequencies need no shuffle besides the one that the records came by, if they are partitioned by key. The
    statistics of common terms (at most COMMON_TERMS, whatever the collection) are broadcast, so only the postings of
    rarer terms, none of them hot, are shuffled by term.
    """
    own = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.array_compact(terms).alias("terms"))
    flat = own.select("key", F.size("terms").cast("bigint").alias("length"), F.explode("terms").alias("term"))
    tf = materialize(flat.groupBy("key", "length", "term").agg(F.count("*").alias("tf")), "tf")
    sums = tf.groupBy("key").agg(F.sum("tf").alias("terms"), F.count("*").alias("distinct"))
    n_records, n_terms, postings = sums.agg(F.count("*"), F.sum("terms"), F.sum("distinct")).first()
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats = materialize(df.where(F.col("df") >= min_df), "terms")
    floor = (postings or 0) / COMMON_TERMS
    common = F.broadcast(stats.where(F.col("df") > floor))
    frequent = tf.join(common, "term")
    rare = tf.join(common.select("term"), "term", "left_anti").join(stats.where(F.col("df") <= floor), "term")
    held = frequent.unionByName(rare)
    q = F.col("cf") / F.lit(float(n_terms or 1))
    p = (F.col("tf") + mu * q) / (F.col("length") + mu)
    n = {"n_records": F.lit(n_records).cast("bigint"), "n_terms": F.lit(n_terms or 0).cast("bigint")}
    return held.select("key", "term", "tf", "length", "df", "cf", *[v.alias(k) for k, v in n.items()], (p * F.log(p / q)).alias("score"))
