"""Same or almost same records across two sides, by joining hashes."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Least number of distinct terms of a record that is compared for likeness, and least share of common terms.
MIN_TERMS = 8
SIMILARITY = 0.8
#: Candidate pairs up to which their ids are broadcast (8 bytes each); beyond that all sets are shuffled by id.
BROADCAST_IDS = 2_000_000


def _share(similarity: float) -> tuple[int, int]:
    """A similarity as a fraction (p, q), so that all comparisons are of whole numbers."""
    s = Fraction(similarity).limit_denominator(1000)
    if not 0 < s <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    return s.numerator, s.denominator


def _bands(min_terms: int = MIN_TERMS, similarity: float = SIMILARITY, largest: int = 1_000_000_000) -> list[tuple[int, int]]:
    """Ranges of set sizes such that two like sets lie in the same or in adjacent ranges."""
    p, q = _share(similarity)
    ratio = max(Fraction(7, 5), Fraction(q, p))
    out, low = [], max(1, min_terms)
    while low <= largest:
        high = int(low * ratio)
        out.append((low, high))
        low = high + 1
    return out


def _signatures(sets: DataFrame, min_terms: int, similarity: float) -> DataFrame:
    """(id, bits, key, meta) of hash sets (id, n, bits, h), meta being ``n * 4 + own * 2 + cut``.

    In the size range of the larger set, two like sets differ in at most ``2 * high * (1 - s) / (1 + s)`` terms. Terms fall into
    ``k`` parts by their hash, k so large that one part at least differs in at most one term: there the
    parts are equal, or one is the other without one term. A key stands for a whole part, or (``cut``) for a part without
    one of its terms. Sets are keyed in their own range and, as possibly the smaller one, in the next.
    """
    p, q = _share(similarity)
    ranges = _bands(min_terms, similarity)
    lows = F.array(*[F.lit(low) for low, _ in ranges])
    parts = F.array(*[F.lit(2 * high * (q - p) // (q + p) // 2 + 1) for _, high in ranges])
    own = F.size(F.filter(lows, lambda low: low <= F.col("n"))) - 1
    banded = sets.withColumn("_own", own).select("*", F.explode(F.array(F.col("_own"), F.col("_own") + 1)).alias("_band"))
    # the next range only for sets that can have a like set there
    reaches = (F.col("_band") == F.col("_own")) | (F.col("n").cast("bigint") * q >= F.element_at(lows, F.col("_band") + 1).cast("bigint") * p)
    banded = banded.where((F.col("_band") < len(ranges)) & reaches).withColumn("_k", F.element_at(parts, F.col("_band") + 1))
    part_of = lambda h: F.pmod(F.shiftright(h, 20), F.col("_k")).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda p: F.aggregate(F.filter("h", lambda h: part_of(h) == p), F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(h)))
    with_parts = banded.withColumn("_whole", whole)
    # 48 bits of hash: shorter keys make for smaller shuffles, and pairs that meet by chance are discarded
    key_of = lambda p, v: F.shiftrightunsigned(F.xxhash64(F.col("_band"), p, v), 16)
    full = F.transform("_whole", lambda v, p: F.struct(key_of(p, v).alias("key"), F.lit(0).alias("cut")))
    less = F.transform("h", lambda h: F.struct(key_of(part_of(h), F.col("_whole")[part_of(h)].bitwiseXOR(h)).alias("key"), F.lit(1).alias("cut")))
    own_flag = (F.col("_band") == F.col("_own")).cast("int") * 2
    each = with_parts.select("id", "bits", (F.col("n") * 4 + own_flag).alias("_m"), F.explode(F.concat(full, less)).alias("_s"))
    return each.select("id", "bits", "_s.key", (F.col("_m") + F.col("_s.cut")).alias("meta"))


def like_sets(left: DataFrame, right: DataFrame, min_terms: int = MIN_TERMS, similarity: float = SIMILARITY) -> DataFrame:
    """(left_id, right_id) of all pairs of hash sets (id, h) whose common terms are ``similarity`` or more of all their terms.

    ``h`` holds 64-bit hashes of the distinct terms, at least ``min_terms`` of them; ids are unique in each input. Exact on
    the hashes: candidates come from the signatures above, which lose no pair, and are verified.
    A pair meets only where a part of both agrees but for one term, so candidates stay few for common terms too;
    the bit sketch (a bit for each of 64 classes of terms that occur) and the sizes discard most of the rest inside the join. Only sets
    that are in a candidate pair are shuffled for verification, as long as their ids (at most BROADCAST_IDS) can be broadcast.
    """
    p, q = _share(similarity)

    def prepared(sets: DataFrame, name: str) -> DataFrame:
        bit = F.aggregate("h", F.lit(0).cast("bigint"), lambda a, h: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(63).cast("int"))))
        sized = sets.select("id", F.size("h").alias("n"), bit.alias("bits"), "h")
        return _signatures(sized, min_terms, similarity).select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "bits", "meta")], "key")

    a, b = prepared(left, "l"), prepared(right, "r")
    ln, rn = (F.shiftright(c, 2).cast("bigint") for c in ("l_meta", "r_meta"))
    flags = F.col("l_meta").bitwiseOR(F.col("r_meta")).bitwiseAND(2) == 2  # one in its own range at least
    cuts = F.col("l_meta").bitwiseAND(F.col("r_meta")).bitwiseAND(1) == 0  # one whole at least
    apart = F.bit_count(F.col("l_bits").bitwiseXOR(F.col("r_bits"))) * (q + p) <= (ln + rn) * (q - p)
    near = flags & cuts & apart & (F.least(ln, rn) * q >= F.greatest(ln, rn) * p)
    candidates = materialize(a.join(b, (a["key"] == b["key"]) & near).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id")).distinct(), "candidates")
    few = candidates.count() <= BROADCAST_IDS

    def asked(sets: DataFrame, name: str, to: str) -> DataFrame:
        named = sets.select(F.col("id").alias(name), F.col("h").alias(to))
        return named.join(F.broadcast(candidates.select(name).distinct()), name, "left_semi") if few else named

    sized = candidates.join(asked(left, "left_id", "_a"), "left_id").join(asked(right, "right_id", "_b"), "right_id")
    common = F.size(F.array_intersect("_a", "_b")).cast("bigint")
    return sized.where(common * q >= (F.size("_a") + F.size("_b") - common) * p).select("left_id", "right_id")


def cross_links(rows: DataFrame, min_terms: int = MIN_TERMS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records (row_id, side, terms), side being ``train`` or anything else (evaluation).

    Records with the same set of distinct terms form a class, however few terms those are, named by its least row_id: ``members`` has
    (row_id, side, class_id, n_terms). ``links`` has (train_class, eval_class, n_terms) for all pairs of classes with training members in the
    first and evaluation members in the second that are equal, or have ``min_terms`` each and are alike (``like_sets``); copies are not
    expanded, and ``n_terms`` is the fewer terms of the two. Records with a null side or without terms (null or empty) belong to no class.
    """
    sets = rows.where("side is not null").select("row_id", "side", F.array_sort(F.array_distinct(F.transform("terms", lambda t: F.xxhash64(t)))).alias("h")).where(F.size("h") > 0)
    hashed = sets.withColumns({"h1": F.xxhash64("h"), "h2": F.xxhash64("h", F.lit(7))})
    train = F.max(F.col("side") == "train")
    other = F.max(F.col("side") != "train")
    classes = materialize(hashed.groupBy("h1", "h2").agg(F.min("row_id").alias("id"), F.first("h").alias("h"), train.alias("train"), other.alias("other")), "classes")
    named = classes.select("h1", "h2", F.col("id").alias("class_id"))
    members = hashed.select("row_id", "side", "h1", "h2", F.size("h").alias("n_terms")).join(named, ["h1", "h2"]).select("row_id", "side", "class_id", "n_terms")
    large = classes.where(F.size("h") >= min_terms)
    alike = like_sets(large.where("train").select("id", "h"), large.where("other").select("id", "h"), min_terms, similarity)  # a class meets itself there too
    sizes = classes.select("id", F.size("h").alias("n"))
    sized = alike.join(sizes.select(F.col("id").alias("left_id"), F.col("n").alias("_l")), "left_id").join(sizes.select(F.col("id").alias("right_id"), F.col("n").alias("_r")), "right_id")
    links = sized.select(F.col("left_id").alias("train_class"), F.col("right_id").alias("eval_class"), F.least("_l", "_r").alias("n_terms"))
    short = classes.where((F.size("h") < min_terms) & F.col("train") & F.col("other"))
    return members, links.unionByName(short.select(F.col("id").alias("train_class"), F.col("id").alias("eval_class"), F.size("h").alias("n_terms")))


def cross_rows(rows: DataFrame, min_terms: int = MIN_TERMS, similarity: float = SIMILARITY) -> DataFrame:
    """(row_id, side, class_id, n_terms, n_links, n_long_links, same_bug): one row per record (row_id, bug_id, side, terms) with a side.

    ``n_links`` counts the classes of the other side that its class is equal to or alike, ``n_long_links`` those where both have ``min_terms``
    terms, and ``same_bug`` says whether its bug_id stands on the other side too. A record without terms has no class, size 0 and no links.
    Nothing is expanded to pairs of records.
    """
    members, links = cross_links(rows, min_terms, similarity)
    linked = materialize(links, "links")
    long = F.count_if(F.col("n_terms") >= min_terms).alias("n_long_links")
    of = lambda c: linked.groupBy(F.col(c).alias("class_id")).agg(F.count("*").alias("n_links"), long)
    counted = of("train_class").withColumn("_train", F.lit(True)).unionByName(of("eval_class").withColumn("_train", F.lit(False)))
    sided = rows.where("side is not null").select("row_id", "bug_id", "side", (F.col("side") == "train").alias("_train"))
    there = sided.where("bug_id is not null").groupBy("bug_id").agg(F.max("_train").alias("_t"), F.max(~F.col("_train")).alias("_e"))
    known = sided.join(members.select("row_id", "class_id", "n_terms"), "row_id", "left").join(counted, ["class_id", "_train"], "left").join(there, "bug_id", "left")
    same = F.coalesce(F.when(F.col("_train"), F.col("_e")).otherwise(F.col("_t")), F.lit(False))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_terms", "n_links", "n_long_links")]
    return known.select("row_id", "side", "class_id", *zero, same.alias("same_bug"))


def cross_pairs(rows: DataFrame, min_terms: int = MIN_TERMS, similarity: float = SIMILARITY, short_copies: bool = True) -> DataFrame:
    """(row_id_a, row_id_b, same_bug): pairs of one training and one evaluation record (row_id_a smaller) with the same bug_id, or alike.

    ``rows``: (row_id, bug_id, side, terms). The links between classes are expanded to their members here, as asked. Equal records of fewer
    than ``min_terms`` terms are pairs too unless ``short_copies`` is off.
    """
    members, links = cross_links(rows, min_terms, similarity)
    own = materialize(members, "members")
    t = own.where("side = 'train'").select(F.col("row_id").alias("t"), F.col("class_id").alias("train_class"))
    e = own.where("side <> 'train'").select(F.col("row_id").alias("e"), F.col("class_id").alias("eval_class"))
    wanted = links if short_copies else links.where(F.col("n_terms") >= min_terms)
    alike = wanted.join(t, "train_class").join(e, "eval_class").select("t", "e", F.lit(False).alias("same_bug"))
    sided = rows.where("side is not null and bug_id is not null").select("row_id", "bug_id", "side")
    bt = sided.where("side = 'train'").select(F.col("row_id").alias("t"), "bug_id")
    be = sided.where("side <> 'train'").select(F.col("row_id").alias("e"), "bug_id")
    same = bt.join(be, "bug_id").select("t", "e", F.lit(True).alias("same_bug"))
    both = alike.unionByName(same).groupBy(F.least("t", "e").alias("row_id_a"), F.greatest("t", "e").alias("row_id_b")).agg(F.max("same_bug").alias("same_bug"))
    return both
