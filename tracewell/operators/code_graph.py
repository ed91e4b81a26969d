"""From Java files to changes of the code graph: entities, their relations, and the calls as far as names resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .graph import newest_at
from .java import outlines
from .snapshot import CALL, CLASS, HAS, INHERITANCE, INSTANCE_OF, METHOD, PARAMETER, RETURN_TYPE, VARIABLE

#: Kinds of declarations that the graph doesn't hold, with all that stands in them.
IGNORED = ["interface", "enum", "annotation"]


def _simple(name: Column) -> Column:
    return F.element_at(F.split(name, r"[.$]"), -1)


def entities(files: DataFrame) -> DataFrame:
    """(relative_uri, label, class_uri, name, n_args, type, super_name, parameters, calls, is_constructor, source_code, position), stored, of
    Java files (path, code): classes, fields, methods and constructors, each relative URI once (the first by path and place).

    Interfaces, enums and annotations are left out with their members. A class is named by package and name, a member ``Class-name`` or
    ``Class-name(types)`` with simple type names.
    """
    rows = outlines(files.select(F.xxhash64("path").alias("id"), "code")).join(files.select(F.xxhash64("path").alias("id"), "path").distinct(), "id")
    kinds = rows.where(~F.col("kind").isin("field", "method", "constructor")).select("id", "class_name", F.col("kind").alias("_kind")).dropDuplicates(["id", "class_name"])
    own = rows.join(kinds, ["id", "class_name"]).where(~F.col("_kind").isin(IGNORED))
    sort = F.col("kind")
    signature = F.concat("name", F.lit("("), F.array_join(F.transform("parameters", lambda p: p["type"]), ","), F.lit(")"))
    member = F.when(sort == "field", F.col("name")).otherwise(signature)
    of_class = ~sort.isin("field", "method", "constructor")
    uri = F.when(of_class, F.col("class_name")).otherwise(F.concat_ws("-", "class_name", member))
    label = F.when(of_class, CLASS).when(sort == "field", VARIABLE).otherwise(METHOD)
    each = own.select(
        uri.alias("relative_uri"),
        label.alias("label"),
        F.when(~of_class, F.col("class_name")).alias("class_uri"),
        "name",
        F.size("parameters").alias("n_args"),
        "type",
        "super_name",
        "parameters",
        "calls",
        F.when(~of_class & (sort != "field"), sort == "constructor").alias("is_constructor"),
        F.col("source").alias("source_code"),
        F.concat("path", F.lit(":"), F.col("first")).alias("position"),
        F.row_number().over(Window.partitionBy(uri).orderBy("path", "place")).alias("_n"),
    )
    return materialize(each.where("_n = 1").drop("_n"), "entities")


def relations(found: DataFrame) -> DataFrame:
    """(relative_uri, rel, target) of ``entities``: inheritance, field, parameter and return types, parameters, and calls.

    A type or superclass is taken for the class of that simple name, the least by name of several; unknown ones have no relation. A call is looked
    up by name and number of arguments: in the class of its receiver (a parameter, a field, a class, or the own class or its superclass
    where there is none), else where one method alone has that name and number; what isn't found is named
    ``Receiver-name(n)``, to become a node that isn't declared. Constructors aren't called.
    """
    classes = found.where(F.col("label") == CLASS).groupBy(_simple(F.col("relative_uri")).alias("simple")).agg(F.min("relative_uri").alias("class_name"))
    bare = lambda c: F.regexp_replace(c, r"(\[\])+$", "")
    typed = lambda df, rel: df.join(classes, bare(F.col("type")) == F.col("simple")).select("relative_uri", F.lit(rel).alias("rel"), F.col("class_name").alias("target"))
    methods = found.where(F.col("label") == METHOD)
    params = methods.select("relative_uri", F.posexplode("parameters").alias("i", "p")).select(F.concat("relative_uri", F.lit("-parameter-"), "i").alias("uri"), "relative_uri", F.col("p.type").alias("type"))
    out = typed(found.where("super_name is not null").withColumn("type", F.col("super_name")), INHERITANCE)
    out = out.unionByName(typed(found.where(F.col("label") == VARIABLE), INSTANCE_OF)).unionByName(typed(methods, RETURN_TYPE))
    out = out.unionByName(params.select("relative_uri", F.lit(HAS).alias("rel"), F.col("uri").alias("target")))
    out = out.unionByName(typed(params.select(F.col("uri").alias("relative_uri"), "type"), INSTANCE_OF))

    supers = found.where("super_name is not null").select(F.col("relative_uri").alias("class_uri"), "super_name")
    calls = methods.select("relative_uri", "class_uri", "parameters", F.explode("calls").alias("c")).select("relative_uri", "class_uri", "parameters", F.regexp_replace("c.receiver", r"^this\.", "").alias("receiver"), "c.name", "c.n_args")
    calls = calls.join(supers, "class_uri", "left")
    fields = found.where(F.col("label") == VARIABLE).select("class_uri", F.col("name").alias("receiver"), bare(F.col("type")).alias("_field"))
    calls = calls.join(fields, ["class_uri", "receiver"], "left")
    param = F.try_element_at(F.filter("parameters", lambda p: p["name"] == F.col("receiver")), F.lit(1))["type"]
    own = _simple(F.col("class_uri"))
    of = F.when(F.col("receiver").isin("", "this"), own).when(F.col("receiver") == "super", F.col("super_name"))
    named = F.when(F.col("receiver").rlike(r"(^|\.)[A-Z]\w*$"), _simple(F.col("receiver")))
    calls = calls.select("relative_uri", "name", "n_args", "super_name", F.coalesce(of, bare(param), "_field", named).alias("of"), "receiver").distinct()
    known = methods.where("not is_constructor").select(_simple(F.col("class_uri")).alias("of"), "name", "n_args", F.col("relative_uri").alias("target"))
    at = known.groupBy("of", "name", "n_args").agg(F.min("target").alias("_own"))
    above = at.withColumnsRenamed({"of": "super_name", "_own": "_above"})
    alone = known.groupBy("name", "n_args").agg(F.min("target").alias("_alone"), F.count("*").alias("_many")).where("_many = 1").drop("_many")
    met = calls.join(at, ["of", "name", "n_args"], "left").join(above, ["super_name", "name", "n_args"], "left").join(alone, ["name", "n_args"], "left")
    from_above = F.when(F.col("receiver").isin("", "this"), F.col("_above"))
    other = F.concat(F.coalesce("of", F.lit("")), F.lit("-"), "name", F.lit("("), "n_args", F.lit(")"))
    target = F.coalesce("_own", from_above, F.when(F.col("of").isNull() | F.col("receiver").isin("", "this", "super"), F.col("_alone")), other)
    return out.unionByName(met.select("relative_uri", F.lit(CALL).alias("rel"), target.alias("target"))).distinct()


def changes(nodes: DataFrame, found: DataFrame, v: int) -> DataFrame:
    """(relative_uri, op, new_relative_uri, label, class_uri): what leads from the graph at ``v`` to ``entities``.

    What isn't there yet is added (parameters with their methods), a method whose source differs is modified, and a declared class, method
    or variable that no file holds any more is deleted.
    """
    params = found.where(F.col("label") == METHOD).select(F.col("relative_uri").alias("m"), F.posexplode("parameters").alias("i", "p")).select(F.concat("m", F.lit("-parameter-"), "i").alias("relative_uri"), F.lit(PARAMETER).alias("label"), F.lit(None).cast("string").alias("class_uri"), F.lit(None).cast("string").alias("source_code"))
    new = found.select("relative_uri", "label", "class_uri", "source_code").unionByName(params)
    old = newest_at(nodes, v).where(F.col("label").isin(CLASS, METHOD, VARIABLE, PARAMETER)).select("relative_uri", F.col("label").alias("_label"), F.col("source_code").alias("_source"), F.lit(True).alias("_there"))
    both = new.withColumn("_here", F.lit(True)).join(old, "relative_uri", "full")
    op = F.when(F.col("_there").isNull(), "ADD").when(F.col("_here").isNull(), F.when(F.col("_label") != PARAMETER, "DELETE")).when((F.col("label") == METHOD) & ~F.col("source_code").eqNullSafe(F.col("_source")), "MODIFY")
    return both.select("relative_uri", op.alias("op"), F.lit(None).cast("string").alias("new_relative_uri"), F.coalesce("label", "_label").alias("label"), "class_uri").where("op is not null")
