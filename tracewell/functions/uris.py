"""Column functions for method URIs and lists of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters that count as blanks in a URI.
BLANKS = " \t\n\x0b\f\r"


def _bare(uri: Column) -> Column:
    """A URI without blanks and without a trailing ``#number``; the pattern runs only where there is a ``#``."""
    s = F.translate(uri, BLANKS, "")
    return F.when(F.contains(s, F.lit("#")), F.regexp_replace(s, r"#\d+$", "")).otherwise(s)


def _canonical(bare: Column) -> Column:
    head = F.substring_index(bare, "(", 1)
    tail = F.substring(bare, F.length(head) + 1, F.length(bare))
    return F.concat(F.translate(head, "/", "."), F.when(F.contains(tail, F.lit(".")), F.regexp_replace(tail, r"[^(),]*\.", "")).otherwise(tail))


def canonical_uri(uri: Column) -> Column:
    """The form in which two spellings of a method URI are compared.

    Blanks and a trailing ``#number`` go, ``/`` before the parameter list reads as ``.``, and each parameter
    type keeps only what follows its last ``.``.
    """
    return F.transform(F.array(_bare(uri)), _canonical)[0]  # the array binds the bare form, so that it is made once


def method_list(literal: Column) -> Column:
    """Canonical URIs of a list literal (either quote, odd blanks, repeats), each once; none for other text."""
    quoted = F.regexp_extract_all(literal, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
    bare = F.transform(F.coalesce(quoted, F.array().cast("array<string>")), lambda q: _bare(F.substring(q, F.lit(2), F.length(q) - 2)))
    return F.array_distinct(F.transform(F.filter(bare, lambda u: u != ""), _canonical))


def strip_generics(signature: Column) -> Column:
    """A signature without type arguments in angle brackets, however deep; brackets without a partner stay."""
    n = F.length(signature) - F.length(F.translate(signature, "<", ""))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), signature, lambda s, _: F.regexp_replace(s, r"<[^<>]*>", ""))).otherwise(signature)


def rooted(path: Column, prefix: str = "", drop: str = "") -> Column:
    """A project's path as a dotted name: the segment matching the pattern ``drop`` goes, ``prefix`` comes before."""
    kept = F.regexp_replace(path, rf"(^|/){drop}(?=/)", "") if drop else path
    return F.concat(F.lit(prefix), F.translate(F.regexp_replace(kept, "^/", ""), "/", "."))


def without_prefix(name: Column, prefix: str) -> Column:
    """A full name without the namespace ``prefix``; another name as it is."""
    return F.when(F.startswith(name, F.lit(prefix)), F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(name)


def with_prefix(name: Column, prefix: str) -> Column:
    """The full name of a short one."""
    return F.concat(F.lit(prefix), name)


def project_name(project_id: Column) -> Column:
    """The part of a project's id before the first ``/``."""
    return F.split_part(project_id, F.lit("/"), F.lit(1))


def position(raw: Column, of_class: Column, project_path: str = "", project_id: str = "") -> Column:
    """A source position without its parentheses, of a class without the line, the project's path replaced by its id."""
    bare = F.regexp_replace(raw, r"^\(|\)$", "")
    cut = F.when(of_class, F.split_part(bare, F.lit(":"), F.lit(1))).otherwise(bare)
    return F.replace(cut, F.lit(project_path), F.lit(project_id)) if project_path else cut
