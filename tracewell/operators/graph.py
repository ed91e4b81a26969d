"""Operators over versioned graph tables.

``nodes`` has (uri, relative_uri, version, label, commit_id, not_declared, deleted_ver, chain_root, ...), a node and its later
versions sharing ``chain_root``; ``edges`` has (src, rel, dst); ``versions`` has (version, commit_id). A node lives from its
version on; a chain whose last node has ``deleted_ver = v`` is gone from version v on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def relative_uri(uri: Column) -> Column:
    return F.substring_index(uri, "#", 1)


def uri_version(uri: Column) -> Column:
    """The integer after the last ``#``; null if there is none."""
    return F.element_at(F.split(uri, "#"), -1).try_cast("int")


def declared() -> Column:
    return ~F.coalesce(F.col("not_declared").cast("boolean"), F.lit(False))


def version_of(versions: DataFrame, commit: str) -> int:
    """Version of a commit id: exact if longer than seven characters, by prefix else; -1 if unknown."""
    hit = F.col("commit_id") == commit if len(commit) > 7 else F.col("commit_id").startswith(commit)
    found = versions.where(hit).agg(F.min("version")).first()[0]
    return -1 if found is None else found


def versions_of(versions: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit_id, version) of each wanted (commit_id), as ``version_of``; one equi-join, every version standing under its prefixes."""
    names = F.array_distinct(F.concat(F.array("commit_id"), F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.left("commit_id", i))))
    first = versions.select(F.explode(names).alias("commit_id"), "version").groupBy("commit_id").agg(F.min("version").alias("version"))
    return commits.select("commit_id").distinct().join(first, "commit_id", "left").select("commit_id", F.coalesce("version", F.lit(-1)).alias("version"))


def chain_roots(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(uri, root, pos): each node of ``update`` edges with the first node of its chain and its place from 1.

    Pointer doubling: each round doubles the steps taken, so depth d takes log2(d) rounds of one join each. Every round is stored, so
    the plan doesn't grow. A node with several predecessors (a merge) follows the smallest; cycles raise an error.
    """
    e = edges.where("rel = 'update'").groupBy(F.col("dst").alias("uri")).agg(F.min("src").alias("up"))
    heads = edges.where("rel = 'update'").select(F.col("src").alias("uri")).distinct().join(e, "uri", "left_anti")
    at = materialize(e.select("uri", "up", F.lit(1).cast("bigint").alias("steps")).unionByName(heads.select("uri", F.col("uri").alias("up"), F.lit(0).cast("bigint").alias("steps"))), "chain")
    for _ in range(rounds):
        up = at.select(F.col("uri").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_more"))
        at = materialize(at.join(up, "up").select("uri", F.col("_up").alias("up"), (F.col("steps") + F.col("_more")).alias("steps"), (F.col("_more") > 0).alias("moved")), "chain")
        moved = at.where("moved").limit(1).count()
        at = at.drop("moved")
        if not moved:
            return at.select("uri", F.col("up").alias("root"), (F.col("steps") + 1).alias("pos"))
    raise ValueError("update edges form a cycle")


def newest_at(nodes: DataFrame, v: int) -> DataFrame:
    """The newest node ``<= v`` of every chain that isn't deleted at ``v``; ties by uri. One aggregation by chain."""
    known = [c for c in nodes.columns if c not in ("version", "uri", "chain_root")]
    best = F.max(F.when(F.col("version") <= v, F.struct("version", "uri", *known)))
    g = nodes.groupBy("chain_root").agg(best.alias("_n"), F.min("deleted_ver").alias("_gone"))
    return g.where(F.col("_n").isNotNull() & (F.col("_gone").isNull() | (F.col("_gone") > v))).select("chain_root", "_n.*")


def replaced_at(nodes: DataFrame, refs: DataFrame, column: str, v: int) -> DataFrame:
    """``refs`` with the node named in ``column`` replaced by the newest of its chain at ``v``; rows of deleted chains go."""
    root = nodes.select(F.col("uri").alias(column), F.col("chain_root").alias("_root"))
    now = newest_at(nodes, v).select(F.col("chain_root").alias("_root"), F.col("uri").alias("_now"))
    return refs.join(root, column).join(now, "_root").drop(column, "_root").withColumnRenamed("_now", column)


def diff_versions(nodes: DataFrame, v: int) -> DataFrame:
    """(change, old_uri, new_uri) between version ``v`` and the one before: ADD, UPDATE or DELETE, per chain."""
    before = newest_at(nodes, v - 1).select("chain_root", F.col("uri").alias("old_uri"))
    after = newest_at(nodes, v).select("chain_root", F.col("uri").alias("new_uri"))
    both = before.join(after, "chain_root", "full").where("not old_uri <=> new_uri")
    change = F.when(F.col("old_uri").isNull(), "ADD").when(F.col("new_uri").isNull(), "DELETE").otherwise("UPDATE")
    return both.select(change.alias("change"), "old_uri", "new_uri")


def apply_diff(snapshot: DataFrame, diff: DataFrame) -> DataFrame:
    """(uri) of the snapshot (uri) after a diff: deleted and updated nodes go, added and updated ones come."""
    kept = snapshot.select("uri").join(diff.where("old_uri is not null").select(F.col("old_uri").alias("uri")), "uri", "left_anti")
    return kept.unionByName(diff.where("new_uri is not null").select(F.col("new_uri").alias("uri")))


def latest(nodes: DataFrame, v: int | None = None) -> DataFrame:
    """(relative_uri, uri): the newest node by exact relative URI; with ``v`` the newest ``<= v``, if none the newest."""
    top = F.max(F.struct("version", "uri"))
    if v is None:
        return nodes.groupBy("relative_uri").agg(top.alias("_t")).select("relative_uri", "_t.uri")
    seen = F.max(F.when(F.col("version") <= v, F.struct("version", "uri")))
    return nodes.groupBy("relative_uri").agg(F.coalesce(seen, top).alias("_t")).select("relative_uri", "_t.uri")


def similar_edges(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, rel, dst): ``similar`` edges between the version nodes of paired relative URIs (rel_a, rel_b).

    Each node is linked with the other side's newest node not later than itself, in both directions; unordered pairs once. As the nearest
    earlier version is wanted, both sides are unioned per pair and carried forward by a window, not joined by range.
    """
    from pyspark.sql import Window

    p = pairs.select("rel_a", "rel_b").dropna().distinct()
    n = nodes.select("relative_uri", "version", "uri")
    a = p.join(n, F.col("rel_a") == F.col("relative_uri")).select("rel_a", "rel_b", "version", F.col("uri").alias("a"), F.lit(None).cast("string").alias("b"))
    b = p.join(n, F.col("rel_b") == F.col("relative_uri")).select("rel_a", "rel_b", "version", F.lit(None).cast("string").alias("a"), F.col("uri").alias("b"))
    w = Window.partitionBy("rel_a", "rel_b").orderBy("version").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).select("a", "b", F.last("a", True).over(w).alias("_a"), F.last("b", True).over(w).alias("_b"))
    x, y = F.coalesce("a", "_a"), F.coalesce("b", "_b")
    linked = both.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null and x <> y")
    return linked.select(F.least("x", "y").alias("src"), F.lit("similar").alias("rel"), F.greatest("x", "y").alias("dst")).distinct()


def upsert_nodes(stored: DataFrame, triples: DataFrame, properties: list[str], labels: str | None = None) -> DataFrame:
    """(uri, properties...) after writing triples (uri, property, value, seq): the last writer of a property wins, others stay.

    ``labels`` names a property that adds up instead: an array column of all labels written so far, sorted.
    """
    last = [F.max(F.when((F.col("property") == p) & F.col("value").isNotNull(), F.struct("seq", "value")))["value"].alias(f"_{p}") for p in properties]
    more = [F.collect_set(F.when(F.col("property") == labels, F.col("value"))).alias("_labels")] if labels else []
    wide = triples.groupBy("uri").agg(*last, *more)
    none = F.array().cast("array<string>")
    both = [F.array_sort(F.array_union(F.coalesce(labels, none), F.coalesce("_labels", none))).alias(labels)] if labels else []
    return stored.select("uri", *properties, *([labels] if labels else [])).join(wide, "uri", "full").select("uri", *[F.coalesce(f"_{p}", p).alias(p) for p in properties], *both)


def upsert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.select("src", "rel", "dst").unionByName(new.select("src", "rel", "dst")).distinct()


def register_versions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``versions`` with the new (version, commit_id) rows whose commit isn't there yet."""
    fresh = new.join(stored.select("commit_id"), "commit_id", "left_anti").groupBy("commit_id").agg(F.min("version").alias("version"))
    return stored.select("version", "commit_id").unionByName(fresh.select("version", "commit_id"))


def undirected(edges: DataFrame, a: str, b: str, *extra: str) -> DataFrame:
    """(node, neighbour, extra...): every edge both ways."""
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), *extra)
    return one.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("neighbour"), *extra))


def of_degree(edges: DataFrame, end: str, k: int) -> DataFrame:
    """(end, n): the nodes at this end (``src`` or ``dst``) of exactly ``k`` edges; for none at all use an anti join."""
    return edges.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") == k)


def two_hops(edges: DataFrame, block: int = 256) -> DataFrame:
    """(x, y): nodes two undirected hops apart over distinct (src, dst), x < y, each pair once.

    A middle node with many neighbours is cut into blocks of about ``block``; two blocks meet as a join key of their own, so no
    middle is hot and the pairs of one come from many tasks. They are made distinct before the shuffle as far as a task holds them twice.
    """
    e = materialize(undirected(edges, "src", "dst").distinct(), "undirected")
    blocks = e.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    cut = e.join(blocks, "node").select("node", "neighbour", "_blocks", F.pmod(F.xxhash64("neighbour"), F.col("_blocks")).cast("int").alias("_own"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = cut.select("node", F.col("neighbour").alias("x"), F.col("_own").alias("_i"), every.alias("_j"))
    right = cut.select("node", F.col("neighbour").alias("y"), every.alias("_i"), F.col("_own").alias("_j"))
    return left.join(right, ["node", "_i", "_j"]).where("x < y").select("x", "y").distinct()


def metadata(nodes: DataFrame, edges: DataFrame, versions: DataFrame) -> DataFrame:
    """One row of counts: methods, call edges, similar edges, versions. Four single-row aggregates side by side."""
    n = nodes.agg(F.count_if(F.col("label") == "Method").alias("n_methods"))
    e = edges.agg(F.count_if(F.col("rel") == "call").alias("n_calls"), F.count_if(F.col("rel") == "similar").alias("n_similar"))
    one = [x.withColumn("_k", F.lit(0)) for x in (n, e, versions.agg(F.count("*").alias("n_versions")))]
    return one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")


def latest_by_signature(nodes: DataFrame, v: int, chain: str = "chain_root") -> DataFrame:
    """(class, name, n_params, uri): the newest live node of each short signature ``Class-name`` with its number of parameters."""
    short = newest_at(nodes, v)
    params = F.regexp_extract("relative_uri", r"\((.*)\)", 1)
    n = F.when(params == "", 0).otherwise(F.size(F.split(params, ","))).cast("bigint")
    keyed = short.select(F.regexp_extract("relative_uri", r"([^./-]+)-", 1).alias("class"), F.regexp_extract("relative_uri", r"-([^(]+)\(", 1).alias("name"), n.alias("n_params"), "version", "uri")
    return keyed.groupBy("class", "name", "n_params").agg(F.max(F.struct("version", "uri"))["uri"].alias("uri"))


def sum_metadata(rows: DataFrame) -> DataFrame:
    """Sums of metadata that repositories report as strings; null and unreadable ones are skipped."""
    return rows.agg(*[F.coalesce(F.sum(F.col(c).try_cast("bigint")), F.lit(0)).alias(c) for c in rows.columns])


def extracted_commit(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(commit_id, extracted): the newest extracted commit not later than each wanted one, else the first extracted.

    ``commits``: (ord, commit_id, extracted); ``wanted``: (commit_id). One pass by ranges of the order, not a join by range.
    """
    from pyspark.sql import Window

    width = 10_000
    at = commits.select("ord", "commit_id", "extracted", F.floor(F.col("ord") / width).alias("_b"))
    last = at.where("extracted").groupBy("_b").agg(F.max_by("commit_id", "ord").alias("_last"), F.max("ord").alias("_at"))
    every = at.select("_b").distinct().join(last, "_b", "left")
    before = every.select("_b", F.last("_last", True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.last(F.when(F.col("extracted"), F.col("commit_id")), True).over(Window.partitionBy("_b").orderBy("ord"))
    first = commits.where("extracted").agg(F.min_by("commit_id", "ord").alias("_first"))
    seen = at.withColumn("_own", own).join(before, "_b").join(F.broadcast(first))
    return seen.join(wanted.select("commit_id").distinct(), "commit_id", "left_semi").select("commit_id", F.coalesce("_own", "_before", "_first").alias("extracted"))


def merge_properties(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of both tables; where both have a key the new value counts, even a null one."""
    both = old.select(key, F.col(value).alias("_o")).join(new.select(key, F.col(value).alias("_n"), F.lit(True).alias("_in")), key, "full")
    return both.select(key, F.when(F.col("_in"), F.col("_n")).otherwise(F.col("_o")).alias(value))
