"""Shredding of nested JSON into an adjacency table, and entity tables from it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADJACENCY = "key bigint, root_pos int, node int, parent int, owner int, path string, label string, ordinal int, kind string, scalar string"
_ARROW = pa.schema(
    [("key", pa.int64()), ("root_pos", pa.int32()), ("node", pa.int32()), ("parent", pa.int32()), ("owner", pa.int32()), ("path", pa.string()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())]
)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))((?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)")
_WORDS = {"true": True, "false": False, "null": None}


class _Digits:
    """An integer of more digits than Python reads, as its text."""

    def __init__(self, text: str):
        self.text = text


def _simple(text: str, i: int) -> tuple:
    """The string, number or word at ``i``, and the place after it."""
    if text.startswith('"', i):
        return scanstring(text, i + 1, True)
    for word, value in _WORDS.items():
        if text.startswith(word, i):
            return value, i + len(word)
    m = _NUMBER.match(text, i)
    if m is None:
        raise ValueError("no JSON value")
    if m[2]:
        return float(m[0]), m.end()
    try:
        return int(m[1]), m.end()
    except ValueError:
        return _Digits(m[1]), m.end()


def _parsed_deep(text: str):
    """What ``json.loads`` gives, without recursion and for integers of any length."""
    after = lambda i: _SPACE.match(text, i).end()

    def label(i: int) -> tuple[str, int]:
        if not text.startswith('"', i):
            raise ValueError("no field name")
        name, i = scanstring(text, i + 1, True)
        i = after(i)
        if not text.startswith(":", i):
            raise ValueError("no colon")
        return name, after(i + 1)

    open_, labels, i = [], [], after(0)
    while True:
        if text.startswith(("{", "["), i):
            value, end = ({}, "}") if text[i] == "{" else ([], "]")
            i = after(i + 1)
            if not text.startswith(end, i):
                open_.append(value)
                labels.append(None)
                if end == "}":
                    labels[-1], i = label(i)
                continue
            i += 1
        else:
            value, i = _simple(text, i)
        while True:
            i = after(i)
            if not open_:
                if i < len(text):
                    raise ValueError("more after the value")
                return value
            inside = open_[-1]
            keyed = isinstance(inside, dict)
            if keyed:
                inside[labels[-1]] = value
            else:
                inside.append(value)
            if text.startswith(",", i):
                i = after(i + 1)
                if keyed:
                    labels[-1], i = label(i)
                break
            if not text.startswith("}" if keyed else "]", i):
                raise ValueError("not closed")
            value, i = open_.pop(), i + 1
            labels.pop()


def _parsed(text: str | None):
    """The value of a complete JSON text; None where it isn't one."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_no_constant)
    except json.JSONDecodeError:
        return None
    except (ValueError, RecursionError):  # long integers, deep nesting
        try:
            return _parsed_deep(text)
        except ValueError:
            return None


def _unwrapped(value, wrapper: str | None):
    """The value inside objects whose only field is ``wrapper``, which holds a value or its JSON text."""
    while wrapper is not None and isinstance(value, dict) and len(value) == 1 and wrapper in value:
        value = value[wrapper]
        if isinstance(value, str):
            value = _parsed(value)
    return value


def _roots(text: str | None, wrapper: str | None) -> Iterator[tuple[int, dict]]:
    """The root objects of a text with their places in the array, 0 for a single one."""
    value = _unwrapped(_parsed(text), wrapper)
    for pos, root in enumerate(value if isinstance(value, list) else [value]):
        root = _unwrapped(root, wrapper)
        if isinstance(root, dict):
            yield pos, root


def _scalar(value) -> str | None:
    if value is None:
        return None
    text = value if isinstance(value, str) else value.text if isinstance(value, _Digits) else json.dumps(value)
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _nodes(key: int, root_pos: int, root: dict, keep: set[str] | None, out: list[list]) -> None:
    """Append the nodes of one root object in document order. Iterative, so depth has no limit."""
    node, stack = 0, [(root, -1, -1, "", "", 0)]
    while stack:
        value, parent, owner, path, label, ordinal = stack.pop()
        kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "string" if isinstance(value, str) else "scalar"
        row = (key, root_pos, node, parent, owner, path, label, ordinal, kind, None if kind in ("object", "array", "null") else _scalar(value))
        for column, cell in zip(out, row, strict=True):
            column.append(cell)
        below: list = []
        if kind == "object":
            for k, v in value.items():
                inner = f"{path}.{k}" if path else k
                if keep is None or inner in keep:
                    below.append((v, node, node, inner, k, 0))
        elif kind == "array":
            inner = path + "[]"
            if keep is None or inner in keep:
                below = [(v, node, owner, inner, label, i) for i, v in enumerate(value)]
        stack.extend(reversed(below))
        node += 1


def shred(df: DataFrame, key: str, column: str, wrapper: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """The adjacency table of a column of JSON texts: one row per object, array, scalar or null.

    A text holds one root object or an array of them (``root_pos`` counts array places from 0, nulls included). The
    result has (key, root_pos, node, parent, owner, path, label, ordinal, kind, scalar): ``node`` numbers a root's nodes in
    document order from 0, ``parent`` is -1 for the root, ``owner`` is the object that a value belongs to (for the elements of an array
    the one that holds the array), ``path`` joins labels by ``.`` and ends in ``[]`` for an
    element, ``ordinal`` is the place in the array, ``kind`` is object, array, string, scalar or null.

    Null, cut off and non-JSON texts, ``NaN`` constants and roots that are no objects give no rows. ``paths`` names the
    paths to keep (their parents come along); all by default. Lone surrogates in strings become ``?``.
    A key may repeat: roots of several rows with the same key can't be told apart, so keys should be unique.
    """
    keep = None if paths is None else {p[:i] for p in paths for i in range(1, len(p) + 1) if i == len(p) or p[i] == "." or p[i:].startswith("[]")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _ARROW]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for pos, root in _roots(text.as_py(), wrapper):
                    _nodes(k, pos, root, keep, out)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _ARROW, strict=True)], schema=_ARROW)
                    out = [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _ARROW, strict=True)], schema=_ARROW)

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(column).alias("text")).mapInArrow(run, ADJACENCY)


def objects(nodes: DataFrame, path: str) -> DataFrame:
    """The non-null nodes at ``path``, or where an array stands there its non-null elements.

    (key, root_pos, node, up, pos, scalar): ``up`` is the object that holds the value or the array, ``pos`` the place in the
    array, 0 for a single value.
    """
    at = nodes.where(F.col("path").isin(path, path + "[]") & ~F.col("kind").isin("null", "array"))
    return at.select("key", "root_pos", "node", F.col("owner").alias("up"), F.col("ordinal").alias("pos"), "scalar")


def entity(nodes: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """An entity table: the values at ``path`` with their scalar children, one column per field.

    Object nodes are joined with their scalar children and pivoted; a missing or null child is null. (key,
    root_pos, node, up, pos, scalar, fields...), where ``up`` links to the parent's ``node`` and ``scalar`` holds a
    value that is no object itself. An empty path stands for the roots.
    """
    if path:
        own = objects(nodes, path)
        below = [f"{p}.{f}" for p in (path, path + "[]") for f in fields]
    else:
        own = nodes.where("parent = -1").select("key", "root_pos", "node", F.col("parent").alias("up"), F.lit(0).alias("pos"), "scalar")
        below = fields
    child = nodes.where(F.col("path").isin(below) & F.col("kind").isin("string", "scalar")).select("key", "root_pos", F.col("parent").alias("node"), "label", F.col("scalar").alias("_value"))
    wide = child.groupBy("key", "root_pos", "node").agg(*[F.max(F.when(F.col("label") == f, F.col("_value"))).alias(f"_{i}") for i, f in enumerate(fields)])
    return own.join(wide, ["key", "root_pos", "node"], "left").select("key", "root_pos", "node", "up", "pos", "scalar", *[F.col(f"_{i}").alias(f) for i, f in enumerate(fields)])


EVENTS = "key bigint, event_pos int, action string, repo string, number bigint, title string, body string, labels array<struct<name: string>>"
_EVENTS_ARROW = pa.schema(
    [("key", pa.int64()), ("event_pos", pa.int32()), ("action", pa.string()), ("repo", pa.string()), ("number", pa.int64()), ("title", pa.string()), ("body", pa.string()), ("labels", pa.list_(pa.struct([("name", pa.string())])))]
)


def _event(root: dict) -> tuple:
    inner = lambda v: v if isinstance(v, dict) else {}
    text = lambda v: None if isinstance(v, (dict, list)) else _scalar(v)
    issue = inner(root.get("issue"))
    number, labels = issue.get("number"), issue.get("labels")
    whole = isinstance(number, int) and not isinstance(number, bool) and -(2**63) <= number < 2**63
    each = [x for x in (labels if isinstance(labels, list) else [labels]) if x is not None and not isinstance(x, list)]
    names = [{"name": text(x.get("name") if isinstance(x, dict) else x)} for x in each]
    return text(root.get("action")), text(inner(root.get("repository")).get("name")), number if whole else None, text(issue.get("title")), text(issue.get("body")), names


def issue_events(df: DataFrame, key: str, column: str, wrapper: str = "payload") -> DataFrame:
    """One row per event of a column of issue payloads, its roots and labels as ``shred`` finds them; no shuffle, so it serves streams.

    (key, event_pos, action, repo, number, title, body, labels): a label is an object with a name or the name itself, one or an array of
    them; a missing value, and a number that is no 64-bit integer, is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, pos, *_event(root)) for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for pos, root in _roots(text.as_py(), wrapper)]
            columns = zip(*rows, strict=True) if rows else [()] * len(_EVENTS_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EVENTS_ARROW, strict=True)], schema=_EVENTS_ARROW)

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(column).alias("text")).mapInArrow(run, EVENTS)
