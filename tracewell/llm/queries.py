"""Queries of the operators in this subpackage over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import split_kind, terms
from ..operators.current import canonical_map, current_rows, id_aliases, report_methods
from ..session import materialize, table
from .cooccurrence import cooccurrence
from .crosssplit import cross_pairs, cross_rows
from .distinctive import term_scores
from .ideal_point import closeness, ranking
from .packing import pack
from .splitting import split_texts
from .sql import SQL
from .tokens import encode
from .topn import top_n

__all__ = ["QUERIES", "SQL"]


# 1. items that appear together


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of methods in at least 8 common reports and 15 times as many as by chance, with their greatest call score."""
    mapped = canonical_map(table(spark, d, "method_map"))
    reports = current_rows(table(spark, d, "bug_reports"), ["bug_id"], ["loaded_at", "row_id"], ["loaded_at", "row_id", "method"])
    pairs = cooccurrence(report_methods(reports, mapped, ["bug_id"]), "bug_id", "method_id")
    ids = materialize(id_aliases(mapped), "ids")
    calls = table(spark, d, "method_call_method").where("call_score is not null and not isnan(call_score)").select("id1", "id2", "call_score")
    for side in ("1", "2"):
        calls = calls.join(ids.select(F.col("id").alias(f"id{side}"), F.col("method_id").alias(f"m{side}")), f"id{side}")
    scores = calls.groupBy(F.least("m1", "m2").alias("item_a"), F.greatest("m1", "m2").alias("item_b")).agg(F.max("call_score").alias("call_score"))
    found = pairs.join(scores, ["item_a", "item_b"], "left")
    return found.select(F.col("item_a").alias("method_id_a"), F.col("item_b").alias("method_id_b"), "n_ab", F.round("ratio", 6).alias("ratio"), "call_score")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).where("call_score >= 0.5").select("method_id_a", "method_id_b")


# 3. how distinctive a term is


def report_terms(spark: SparkSession, d: str) -> DataFrame:
    current = current_rows(table(spark, d, "bug_reports"), ["bug_id"], ["loaded_at", "row_id"], ["loaded_at", "row_id", "report"])
    return term_scores(current.select("bug_id", terms(F.col("report")).alias("terms")), "bug_id", "terms")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the operator's terms of a report the one with the greatest tf * ln(N / df), equals by code point."""
    weight = F.round(F.col("tf") * F.log(F.col("n_records") / F.col("df")), 6)
    best = report_terms(spark, d).groupBy("key").agg(F.min(F.struct((-weight).alias("w"), "term")).alias("best"))
    return best.select(F.col("key").alias("bug_id"), "best.term")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every shared term of every report with its contribution to the divergence from the collection."""
    return report_terms(spark, d).select(F.col("key").alias("bug_id"), "term", "tf", "df", (F.round("score", 6) + 0.0).alias("score"))


# 4. one ranking from several scores


def current_scores(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    known = table(spark, d, "features").select("bug_id", "method_name", "scored_at", *columns)
    return current_rows(known, ["bug_id", "method_name"], ["scored_at"], ["scored_at", *columns]).drop("scored_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The three methods of each bug closest to the ideal point, each score scaled to its places."""
    scores = materialize(current_scores(spark, d, ["bfr", "brr", "cfs"]), "scores")
    close = materialize(closeness(scores, "bug_id", "method_name", ["bfr", "brr", "cfs"], scale="place"), "close")
    best = top_n(close, ["bug_id"], [F.col("closeness").desc(), F.col("method_name").desc()], 3)
    return best.select("bug_id", "rnk", "method_name")


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranking of each bug by winsorised, vector-normalised scores; closeness to nine decimals, equals by name."""
    scores = materialize(current_scores(spark, d, ["bfr", "brr", "cfs"]), "scores")
    close = closeness(scores, "bug_id", "method_name", ["bfr", "brr", "cfs"])
    stored = materialize(close.withColumn("closeness", F.round("closeness", 9)), "close")
    return ranking(stored, "bug_id", [F.col("closeness").desc(), F.col("method_name").desc()])


# 6. top N items within every group


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    """The five methods of each bug with the highest rate, with their label."""
    current = current_scores(spark, d, ["label", "buggy_rate"])
    usable = materialize(current.where("label in (0, 1) and buggy_rate is not null and not isnan(buggy_rate)"), "rates")
    return top_n(usable, ["bug_id"], [F.col("buggy_rate").desc(), F.col("method_name").desc()], 5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_top(spark, d).select("bug_id", "rnk", "method_name")


# 7. same or near-same records across splits


def sided_reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bug_reports").select("row_id", "bug_id", "source", split_kind(F.col("split")).alias("side"), terms(F.col("report")).alias("terms"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as defined: the same bug_id, or alike with at least eight terms each."""
    return cross_pairs(sided_reports(spark, d), short_copies=False).select("row_id_a", "row_id_b")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows that also stand in training, as p7_found defines it, per split and source: all, and those with the same bug_id."""
    reports = sided_reports(spark, d)
    overlap = cross_rows(reports).where("side <> 'train' and (same_bug or n_long_links > 0)").select("row_id", "same_bug")
    named = reports.select("row_id", "side", "source").join(overlap, "row_id")
    return named.groupBy(F.col("side").alias("split"), "source").agg(F.count("*").alias("n_rows"), F.count_if("same_bug").alias("n_same_bug"))


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Every row of a split with the class of its equal rows and the number of classes of the other side that it is linked with."""
    return cross_rows(sided_reports(spark, d)).select("row_id", F.col("side").alias("split"), "class_id", "n_terms", "n_links", "n_long_links", "same_bug")


# 8. encoding of the whole corpus


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


# 9. filling containers


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    tokens = materialize(encode(table(spark, d, "documents"), "doc_id", "text"), "tokens")
    return pack(tokens).withColumnRenamed("key", "doc_id")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row about the containers: documents without a place, with several first pieces, split though they would fit, and containers with
    more tokens than they hold or with gaps; and whether at most one container in a hundred could be spared."""
    placed = materialize(p9_containers(spark, d), "placed")
    texts = placed.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("firsts"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    every = table(spark, d, "documents").select("doc_id").distinct().join(texts, "doc_id", "left")
    own = every.agg(F.count("*").alias("n_documents"), F.count_if(F.col("pieces").isNull()).alias("n_missing"), F.count_if(F.col("firsts") > 1).alias("n_repeated"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= 2048)).alias("n_split"))
    boxes = placed.groupBy("container").agg(F.sum("n_tokens").alias("held"), F.max(F.col("offset") + F.col("n_tokens")).alias("reach"))
    full = boxes.agg(F.count_if(F.col("held") > 2048).alias("n_overfull"), F.count_if(F.col("held") != F.col("reach")).alias("n_gaps"), (F.sum("held") >= F.count("*") * 2048 * 0.97).alias("filled"))
    return own.join(full)


# 10. splitting long texts


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row about the pieces: texts whose pieces don't begin and end with it, and pieces that are too long, don't share 64 tokens with the
    one before, or don't hold the text that stands at their offsets."""
    pieces = materialize(p10_pieces(spark, d), "pieces")
    w = Window.partitionBy("doc_id").orderBy("piece")
    each = pieces.select("*", (F.lag("token_end").over(w) - F.col("token_start")).alias("shared"))
    bad = each.groupBy("doc_id").agg(
        F.min("byte_start").alias("low"),
        F.max("byte_end").alias("high"),
        F.count_if((F.col("token_end") - F.col("token_start") > 512) | (F.size("ids") != F.col("token_end") - F.col("token_start"))).alias("long"),
        F.count_if(F.col("shared") != 64).alias("apart"),
        (F.max("piece") + 1 != F.count("*")).cast("int").alias("misnumbered"),
    )
    texts = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes")).join(bad, "doc_id")
    whole = texts.agg(F.count_if((F.col("low") != 0) | (F.col("high") != F.octet_length("bytes"))).alias("n_not_whole"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in ("long", "apart", "misnumbered")])
    at = pieces.join(table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes")), "doc_id")
    own = F.col("bytes").substr((F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int"))
    whole_characters = ~F.contains("text", F.lit("\ufffd"))
    return whole.join(at.agg(F.count_if(whole_characters & (F.encode("text", "UTF-8") != own)).alias("n_other_text")))


QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p4_found": p4_found,
    "p4_ranking": p4_ranking,
    "p6_found": p6_found,
    "p6_top": p6_top,
    "p7_found": p7_found,
    "p7_counts": p7_counts,
    "p7_overlaps": p7_overlaps,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_checks": p9_checks,
    "p10_pieces": p10_pieces,
    "p10_checks": p10_checks,
}
