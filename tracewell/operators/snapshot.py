"""Snapshots of a versioned code graph, their differences, and changes written into it.

Tables as in ``graph``. A class node has its members by ``has`` edges to the first node of each member; a member's later nodes are reached by
its chain. A class gets a new node only when it is renamed, and the new node the old one's ``has`` and ``inheritance`` edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import declared, newest_at, replaced_at, upsert_edges

#: Labels of nodes, relations of edges: fixed values.
CLASS, API, METHOD, PARAMETER, VARIABLE = "Class", "API", "Method", "Parameter", "Variable"
CALL, INSTANCE_OF, RETURN_TYPE, INHERITANCE, HAS, UPDATE, SIMILAR = "call", "instanceof", "returnType", "inheritance", "has", "update", "similar"


def classes_at(nodes: DataFrame, v: int) -> DataFrame:
    """The newest node of every class alive and declared at ``v``."""
    return newest_at(nodes, v).where((F.col("label") == CLASS) & declared())


def members_at(nodes: DataFrame, edges: DataFrame, v: int) -> DataFrame:
    """(class_root, class_uri, kind, root, uri): each live class itself and its live members, by the newest nodes at ``v``, once each.

    Members of classes that are deleted or not there yet don't come out, nor do deleted members; parameters are no members.
    """
    live = classes_at(nodes, v).select(F.col("chain_root").alias("class_root"), F.col("uri").alias("class_uri"))
    has = edges.where(F.col("rel") == HAS).select(F.col("src").alias("class_uri"), F.col("dst").alias("first"))
    root = nodes.where(F.col("label").isin(METHOD, VARIABLE, CLASS)).select(F.col("uri").alias("first"), F.col("chain_root").alias("root"))
    now = newest_at(nodes, v).select(F.col("chain_root").alias("root"), F.col("label").alias("kind"), "uri")
    own = has.join(live, "class_uri").join(root, "first").join(now, "root").select("class_root", "class_uri", "kind", "root", "uri")
    return own.unionByName(live.select("*", F.lit(CLASS).alias("kind"), F.col("class_root").alias("root"), F.col("class_uri").alias("uri"))).distinct()


def sub_graph(nodes: DataFrame, edges: DataFrame, methods: DataFrame, v: int, detail: bool = False) -> DataFrame:
    """(uri, rel, via, target): the live targets of the calls of ``methods`` (uri), by their newest nodes at ``v``, each once.

    With ``detail`` also the methods' parameters (``via``) with the classes they are instances of, and their return types.
    """
    keep = methods.select("uri").distinct()

    def targets(rel: str) -> DataFrame:
        own = edges.where(F.col("rel") == rel).select(F.col("src").alias("uri"), F.col("dst").alias("target")).join(keep, "uri", "left_semi")
        return replaced_at(nodes, own, "target", v).select("uri", F.lit(rel).alias("rel"), F.lit(None).cast("string").alias("via"), "target")

    if not detail:
        return targets(CALL).distinct()
    parameter = nodes.where(F.col("label") == PARAMETER).select(F.col("uri").alias("via"))
    own = edges.where(F.col("rel") == HAS).select(F.col("src").alias("uri"), F.col("dst").alias("via")).join(keep, "uri", "left_semi").join(parameter, "via")
    typed = own.join(edges.where(F.col("rel") == INSTANCE_OF).select(F.col("src").alias("via"), F.col("dst").alias("target")), "via")
    params = replaced_at(nodes, typed, "target", v).select("uri", F.lit(PARAMETER).alias("rel"), "via", "target")
    return targets(CALL).unionByName(targets(RETURN_TYPE)).unionByName(params).distinct()


def grouped(graph: DataFrame) -> DataFrame:
    """(uri, targets): the sub-graph as one sorted list of (rel, via, target) per method."""
    return graph.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("rel", "via", "target"))).alias("targets"))


def diff_members(nodes: DataFrame, edges: DataFrame, v: int) -> DataFrame:
    """(change, kind, old_class, new_class, old_uri, new_uri, within) between the snapshots at ``v - 1`` and ``v``.

    ``change`` is ADD, UPDATE or DELETE. ``within`` marks members that come, change or go with their class (it is new, renamed or
    deleted): a report of the difference leaves those out, as the class stands for them, and variables too; ``apply_members`` needs all rows.
    """
    key = ["class_root", "root"]
    old = members_at(nodes, edges, v - 1).select(*key, F.col("kind").alias("_ko"), F.col("class_uri").alias("old_class"), F.col("uri").alias("old_uri"))
    new = members_at(nodes, edges, v).select(*key, F.col("kind").alias("_kn"), F.col("class_uri").alias("new_class"), F.col("uri").alias("new_uri"))
    both = old.join(new, key, "full").where("not (old_uri <=> new_uri and old_class <=> new_class)")
    change = F.when(F.col("old_uri").isNull(), "ADD").when(F.col("new_uri").isNull(), "DELETE").otherwise("UPDATE")
    rows = both.select("class_root", change.alias("change"), F.coalesce("_kn", "_ko").alias("kind"), "old_class", "new_class", "old_uri", "new_uri")
    changed = rows.where(F.col("kind") == CLASS).select("class_root", F.lit(True).alias("_changed")).distinct()
    within = F.coalesce("_changed", F.lit(False)) & (F.col("kind") != CLASS)
    return rows.join(changed, "class_root", "left").select("change", "kind", "old_class", "new_class", "old_uri", "new_uri", within.alias("within"))


def apply_members(snapshot: DataFrame, diff: DataFrame) -> DataFrame:
    """(class_uri, kind, uri) of a snapshot after a difference: what was deleted or updated goes, what was added or updated comes."""
    gone = diff.where("old_uri is not null").select(F.col("old_class").alias("class_uri"), F.col("old_uri").alias("uri"))
    come = diff.where("new_uri is not null").select(F.col("new_class").alias("class_uri"), "kind", F.col("new_uri").alias("uri"))
    return snapshot.select("class_uri", "kind", "uri").join(gone, ["class_uri", "uri"], "left_anti").select("class_uri", "kind", "uri").unionByName(come)


def snapshot_triples(nodes: DataFrame, edges: DataFrame, v: int) -> DataFrame:
    """(line): tab-separated triples of a snapshot, each once: labels of its nodes, ``has`` of its classes, and its calls."""
    members = materialize(members_at(nodes, edges, v), "members")
    calls = sub_graph(nodes, edges, members.where(F.col("kind") == METHOD), v)
    called = calls.select(F.col("target").alias("uri")).distinct().join(nodes.select("uri", F.col("label").alias("kind")), "uri")
    labels = members.select("uri", "kind").unionByName(called.select("uri", "kind")).select(F.concat_ws("\t", "uri", F.lit("label"), "kind").alias("line"))
    has = members.where(F.col("kind") != CLASS).select(F.concat_ws("\t", "class_uri", F.lit(HAS), "uri").alias("line"))
    return labels.unionByName(has).unionByName(calls.select(F.concat_ws("\t", "uri", "rel", "target").alias("line"))).distinct()


NODE_COLUMNS = ["uri", "relative_uri", "version", "label", "commit_id", "not_declared", "deleted_ver", "chain_root", "chain_pos"]


def update_graph(nodes: DataFrame, edges: DataFrame, changes: DataFrame, version: int, commit: str, links: DataFrame | None = None, properties: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a change set under a new version.

    ``changes``: (relative_uri, op, new_relative_uri, label[, class_uri]) with ADD, MODIFY (a rename where ``new_relative_uri`` is given) or DELETE of
    classes, methods and variables; ``class_uri`` is the relative URI of an added member's class. A modified node gets a new node in its
    chain, joined by an ``update`` edge; the new node of a renamed class gets the old one's ``has`` and ``inheritance`` edges; a deleted
    chain's last node gets ``deleted_ver``; an added one starts a chain and gets a ``has`` edge from its class's latest node, renamed or added in
    the same change set included. Changes to unknown or deleted nodes, and additions of nodes that are there, are left out.

    ``links``: (relative_uri, rel, target) of nodes of this change set; both ends are the newest nodes of their relative URIs, and an unknown
    target of a call becomes a node ``API`` that isn't declared. Other columns of ``nodes`` than the known ones come for new nodes from
    ``properties`` (relative_uri, columns...), null where it has none.
    """
    extra = [c for c in nodes.columns if c not in NODE_COLUMNS]
    tail = materialize(newest_at(nodes, version).select("chain_root", "uri", "relative_uri", "label", "chain_pos"), "tail")
    hit = changes.where("op in ('MODIFY', 'DELETE')").select("relative_uri", "op", "new_relative_uri").distinct().join(tail, "relative_uri")
    gone = hit.where("op = 'DELETE'").select("uri", F.lit(version).alias("_gone")).distinct()
    kept = nodes.select(*NODE_COLUMNS, *extra).join(gone, "uri", "left").withColumn("deleted_ver", F.coalesce("deleted_ver", "_gone")).drop("_gone")
    rel = F.coalesce("new_relative_uri", "relative_uri")
    uri = F.concat_ws("#", rel, F.lit(version).cast("string"))
    none = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in extra]
    new = [F.lit(version).alias("version"), F.col("label"), F.lit(commit).alias("commit_id"), F.lit(False).alias("not_declared"), F.lit(None).cast("int").alias("deleted_ver")]
    modified = hit.where("op = 'MODIFY'").select(uri.alias("uri"), rel.alias("relative_uri"), *new, "chain_root", (F.col("chain_pos") + 1).alias("chain_pos"), *none, F.col("uri").alias("_old")).dropDuplicates(["uri"])
    modified = materialize(modified, "modified")
    added = changes.where("op = 'ADD'").withColumn("label", F.coalesce("label", F.lit(METHOD))).join(tail.select("relative_uri"), "relative_uri", "left_anti").dropDuplicates(["relative_uri"])
    first = materialize(added.select(uri.alias("uri"), rel.alias("relative_uri"), *new, uri.alias("chain_root"), F.lit(1).alias("chain_pos"), *none), "added")
    steps = modified.select(F.col("_old").alias("src"), F.lit(UPDATE).alias("rel"), F.col("uri").alias("dst"))
    renamed = modified.where(F.col("label") == CLASS).select(F.col("_old").alias("src"), F.col("uri").alias("_new"))
    copied = edges.where(F.col("rel").isin(HAS, INHERITANCE)).join(renamed, "src").select(F.col("_new").alias("src"), "rel", "dst")
    out = kept.unionByName(modified.drop("_old")).unionByName(first)
    every = upsert_edges(edges, steps.unionByName(copied))
    if "class_uri" in changes.columns:
        owner = tail.join(modified.select(F.col("_old").alias("uri")), "uri", "left_anti").select("relative_uri", "uri")
        owner = owner.unionByName(modified.select("relative_uri", "uri")).unionByName(first.select("relative_uri", "uri"))
        # a class renamed in this change set is found by its old name as well
        old_names = tail.join(modified.select(F.col("_old").alias("uri"), F.col("uri").alias("_now")), "uri").select("relative_uri", F.col("_now").alias("uri"))
        of = owner.unionByName(old_names).select(F.col("relative_uri").alias("class_uri"), F.col("uri").alias("src"))
        has = added.where("class_uri is not null").select("class_uri", uri.alias("dst")).join(of, "class_uri").select("src", F.lit(HAS).alias("rel"), "dst")
        every = upsert_edges(every, has)
    if links is not None:
        at = newest_at(out, version).groupBy("relative_uri").agg(F.max(F.struct("version", "uri"))["uri"].alias("uri"))
        named = links.select("relative_uri", "rel", "target").distinct().join(at.withColumnRenamed("uri", "src"), "relative_uri")
        both = materialize(named.join(at.select(F.col("relative_uri").alias("target"), F.col("uri").alias("dst")), "target", "left"), "links")
        unknown = both.where(F.col("dst").isNull() & (F.col("rel") == CALL)).select("target").distinct()
        api_uri = F.concat_ws("#", "target", F.lit(str(version)))
        apis = unknown.select(api_uri.alias("uri"), F.col("target").alias("relative_uri"), F.lit(version).alias("version"), F.lit(API).alias("label"), F.lit(commit).alias("commit_id"), F.lit(True).alias("not_declared"), F.lit(None).cast("int").alias("deleted_ver"), api_uri.alias("chain_root"), F.lit(1).alias("chain_pos"), *none)
        out = out.unionByName(apis)
        every = upsert_edges(every, both.where(F.col("dst").isNotNull() | (F.col("rel") == CALL)).select("src", "rel", F.coalesce("dst", api_uri).alias("dst")))
    if properties is not None and extra:
        given = [c for c in extra if c in properties.columns]
        of = properties.select("relative_uri", F.lit(version).alias("version"), *[F.col(c).alias(f"_{c}") for c in given])
        out = out.join(of, ["relative_uri", "version"], "left").select(*NODE_COLUMNS, *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in extra])
    return out, every
