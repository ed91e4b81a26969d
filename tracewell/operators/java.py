"""A light reading of Java code: what it declares, and what its methods call.

No compiler and no class path: names are resolved as far as the text tells. Python runs once per file, on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r'''//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*(?:\$\w*)*|\$\w*|\d[\w.]*|->|::|\.\.\.|[^\s\w]''', re.S)
# Words of the language.
_CONTROL = {"if", "for", "while", "do", "switch", "try"}
_TYPES = {"class", "interface", "enum", "record"}
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
_NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "throw", "synchronized", "super", "this", "new", "try", "assert", "else", "do"}

Token = tuple[str, int]


class _Word(str):
    """A token that knows where in the text it stands."""

    at: int


def java_tokens(code: str) -> list[Token]:
    """(token, line) without comments; strings are one token."""
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(code):
        line += code.count("\n", at, m.start())
        at = m.start()
        if not m[0].startswith(("//", "/*")):
            word = _Word(m[0])
            word.at = m.start()
            out.append((word, line))
    return out


def _closing(tokens: list[Token], i: int, pairs: str) -> int:
    """The place of the bracket that closes the one at ``i``; the end if none does."""
    depth = 0
    for j in range(i, len(tokens)):
        if tokens[j][0] == pairs[0]:
            depth += 1
        elif tokens[j][0] == pairs[1]:
            depth -= 1
            if not depth:
                return j
    return len(tokens) - 1


def _plain(tokens: list[Token]) -> list[Token]:
    """Tokens without annotations and their arguments (``@interface`` stays)."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i][0] == "@" and i + 1 < len(tokens) and tokens[i + 1][0] != "interface":
            i += 2
            while i + 1 < len(tokens) and tokens[i][0] == ".":
                i += 2
            if i < len(tokens) and tokens[i][0] == "(":
                i = _closing(tokens, i, "()") + 1
        else:
            out.append(tokens[i])
            i += 1
    return out


def _split(tokens: list[str]) -> list[list[str]]:
    """Parts between commas that stand in no brackets."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += t in "(<[{" and len(t) == 1
        depth -= t in ")>]}" and len(t) == 1
        if t == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _type_name(tokens: list[str]) -> str:
    """A type as its last simple name with its brackets, type arguments left out."""
    depth, name, tail = 0, "", ""
    for t in tokens:
        depth += t == "<"
        if not depth:
            if t in ("[", "]"):
                tail += t
            elif t == "...":
                tail += "[]"
            elif t[0].isalpha() or t[0] in "_$":
                name = t
        depth -= t == ">"
    return name + tail


def _parameters(tokens: list[str]) -> list[tuple[str, str]]:
    """(type, name) of the parameters between a method's parentheses; ``String a[]`` is an array too."""
    out = []
    for part in _split([t for t in tokens if t not in _MODIFIERS]):
        arrays = 0
        while part[-2:] == ["[", "]"]:
            part, arrays = part[:-2], arrays + 1
        if len(part) > 1 and part[-1] != "this":
            out.append((_type_name(part[:-1]) + "[]" * arrays, part[-1]))
    return out


def _calls(tokens: list[Token]) -> list[tuple[str, str, int]]:
    """(receiver, name, number of arguments) of the calls in a body; constructors (``new``) aren't calls."""
    out = []
    for i in range(len(tokens) - 1):
        name = tokens[i][0]
        if tokens[i + 1][0] == "(" and (name[0].isalpha() or name[0] in "_$") and name not in _NO_CALLS and not (i and tokens[i - 1][0] == "new"):
            k = i
            while k >= 2 and tokens[k - 1][0] == "." and (tokens[k - 2][0][0].isalnum() or tokens[k - 2][0][0] in "_$"):
                k -= 2
            if k and tokens[k - 1][0] == "new":
                continue
            inside = [t for t, _ in tokens[i + 2 : _closing(tokens, i + 1, "()")]]
            receiver = "".join(t for t, _ in tokens[k : i - 1]) if k < i else "?" if i and tokens[i - 1][0] == "." else ""
            out.append((receiver, name, len(_split(inside))))
    return out


def _sequence(tokens: list[Token]) -> list[str]:
    """A method's tokens in order, with ``End`` after each block of a control statement."""
    out, stack, head = [], [], None
    for i, (t, _) in enumerate(tokens):
        out.append(t)
        if t in _CONTROL or t in ("else", "catch", "finally"):
            head = t
        elif t == "{":
            stack.append(head)
            head = None
        elif t == "}":
            if stack and stack.pop():
                out.append("End")
        elif t in (";", "->") or (t == ")" and i + 1 < len(tokens) and tokens[i + 1][0] not in ("{", ")", ".", "->") and head not in ("for", "if", "while")):
            head = None if t == ";" and "(" not in out[-3:] else head
    return out


def statement_blocks(tokens: list[str]) -> list[list[str]]:
    """The statements of a method body: a control statement's head is a block, its braces end one, ``End`` stands alone, and every other statement is one."""
    out, now, depth = [], [], 0
    for t in tokens:
        if t == "End":
            out.append([t])
            continue
        depth += t == "("
        depth -= t == ")"
        if t == "}" and not depth:
            if now:
                out.append(now)
            now = []
            continue
        now.append(t)
        if not depth and t in (";", "{"):
            out.append(now)
            now = []
    return out + [now] if now else out


def java_outline(code: str) -> list[dict]:
    """What a file declares, in order: classes, fields, methods and constructors, with their class, lines and details.

    Each has ``kind`` (class, interface, enum, annotation, record, field, method, constructor), ``name``, ``class_name`` (dotted, with the package, of the
    class it stands in or is), ``super_name``, ``type`` (of a field; what a method returns), ``parameters``, ``calls``, ``first``,
    ``signature_end``, ``last``, ``span`` (offsets in the text) and ``tokens`` (of methods). Methods without a body end at their semicolon. Annotations are skipped. Local and
    anonymous classes count as part of the method. Unbalanced code gives what could be read.
    """
    tokens = _plain(java_tokens(code))
    found: list[dict] = []
    package = ""
    if tokens and tokens[0][0] == "package":
        end = next((i for i, (t, _) in enumerate(tokens) if t == ";"), 0)
        package = "".join(t for t, _ in tokens[1:end])
    # (class name, kind, place of its row) of the open classes
    stack: list[tuple[str, str, int]] = []
    start = i = 0

    def row(kind: str, name: str, owner: str, low: int, opened: int, high: int, **more) -> dict:
        line = lambda k: tokens[min(k, len(tokens) - 1)][1]
        return {"kind": kind, "name": name, "class_name": owner, "super_name": None, "type": None, "parameters": [], "calls": [], "tokens": [], "first": line(low), "signature_end": line(opened), "last": line(high), "span": (tokens[low][0].at, tokens[high][0].at + len(tokens[high][0])), **more}

    def fields(low: int, high: int) -> None:
        words = [t for t, _ in tokens[low:high] if t not in _MODIFIERS]
        if len(words) < 2 or not stack or words[0] in ("package", "import", "return"):
            return
        parts = _split(words)
        if not parts:
            return
        cut = lambda p: p[: p.index("=")] if "=" in p else p
        head = cut(parts[0])
        base = head[:-1]
        while base and base[-1] in ("[", "]"):
            base = base[:-1]
        names = [[head[-1]] if head[-1] != "]" else [head[-3], "[", "]"]] + [cut(p) for p in parts[1:]]
        kind = _type_name(head[:-1] if head[-1] != "]" else head[:-3])
        if not kind:
            return
        for n in names:
            if n and (n[0][0].isalpha() or n[0][0] in "_$"):
                found.append(row("field", n[0], stack[-1][0], low, high, high, type=kind + "".join(n[1:])))

    while i < len(tokens):
        t = tokens[i][0]
        if t == "}" and stack:
            found[stack.pop()[2]]["last"] = tokens[i][1]
            start = i = i + 1
            continue
        if t == ";":
            words = [x for x, _ in tokens[start:i]]
            at = words.index("(") if "(" in words else -1
            if stack and at > 0 and "=" not in words[:at]:
                _method(found, row, stack, tokens, start, start + at, i, i)
            else:
                fields(start, i)
            start = i = i + 1
            continue
        if t == "=" and stack:  # an initialiser: on to its end, over braces and parentheses
            depth, j = 0, i
            while j < len(tokens):
                x = tokens[j][0]
                depth += x in ("(", "{", "[")
                depth -= x in (")", "}", "]")
                if depth < 0 or (x == ";" and not depth):
                    break
                j += 1
            fields(start, j)
            start = i = j + 1 if j < len(tokens) and tokens[j][0] == ";" else j
            continue
        if t == "{":
            words = [x for x, _ in tokens[start:i]]
            at = next((k for k, x in enumerate(words[:-1]) if x in _TYPES and (x != "record" or (k + 2 < len(words) and words[k + 2] in ("(", "<")))), None)
            paren = words.index("(") if "(" in words else -1
            if at is not None and (paren < 0 or at < paren):
                kind = "annotation" if at and words[at - 1] == "@" else words[at]
                name = words[at + 1]
                owner = f"{stack[-1][0]}${name}" if stack else f"{package}.{name}" if package else name
                base = _super_name(words[at + 2 :]) if kind == "class" else None
                found.append(row(kind, name, owner, start, i, i, super_name=base))
                stack.append((owner, kind, len(found) - 1))
                start = i = i + 1
                if kind == "enum":  # constants stand before the first semicolon of the body
                    depth, j = 0, i
                    while j < len(tokens) and not (depth == 0 and tokens[j][0] in (";", "}")):
                        depth += tokens[j][0] in ("(", "{")
                        depth -= tokens[j][0] in (")", "}")
                        j += 1
                    start = i = j + 1 if j < len(tokens) and tokens[j][0] == ";" else j
                continue
            end = _closing(tokens, i, "{}")
            if stack and paren > 0:
                _method(found, row, stack, tokens, start, start + paren, i, end)
            start = i = end + 1
            continue
        i += 1
    for _, _, at in stack:  # never closed
        found[at]["last"] = tokens[-1][1]
    return found


def _super_name(words: list[str]) -> str | None:
    """The class after ``extends`` in the rest of a class's head; ``extends`` of a type parameter doesn't count."""
    depth, base = 0, None
    for w in words:
        depth += (w == "<") - (w == ">")
        if not depth and w in ("implements", "permits"):
            break
        if base is not None:
            base.append(w)
        elif w == "extends" and not depth:
            base = []
    return _type_name(base) or None if base else None


def _method(found: list[dict], row, stack, tokens: list[Token], low: int, paren: int, opened: int, end: int) -> None:
    name = tokens[paren - 1][0]
    if not (name[0].isalpha() or name[0] in "_$") or name in _NO_CALLS:
        return
    words = [t for t, _ in tokens[low : paren - 1] if t not in _MODIFIERS]
    if words[:1] == ["<"]:  # type parameters
        depth = 0
        for k, w in enumerate(words):
            depth += (w == "<") - (w == ">")
            if not depth:
                words = words[k + 1 :]
                break
    simple = stack[-1][0].rsplit("$", 1)[-1].rsplit(".", 1)[-1]
    constructor = not words and name == simple
    if not words and not constructor:
        return
    close = _closing(tokens, paren, "()")
    body = tokens[opened : end + 1] if end > opened else []
    found.append(
        row(
            "constructor" if constructor else "method",
            name,
            stack[-1][0],
            low,
            opened,
            end,
            type=None if constructor else _type_name(words),
            parameters=[{"type": t, "name": n} for t, n in _parameters([t for t, _ in tokens[paren + 1 : close]])],
            calls=[{"receiver": r, "name": n, "n_args": a} for r, n, a in _calls(body)],
            tokens=_sequence(tokens[low : end + 1]),
        )
    )


_PARAMETER = pa.struct([("type", pa.string()), ("name", pa.string())])
_CALL = pa.struct([("receiver", pa.string()), ("name", pa.string()), ("n_args", pa.int32())])
_OUTLINE = pa.schema(
    [("id", pa.int64()), ("place", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("class_name", pa.string()), ("super_name", pa.string()), ("type", pa.string())]
    + [("parameters", pa.list_(_PARAMETER)), ("calls", pa.list_(_CALL)), ("first", pa.int32()), ("signature_end", pa.int32()), ("last", pa.int32()), ("tokens", pa.list_(pa.string())), ("source", pa.string())]
)
OUTLINE = (
    "id bigint, place int, kind string, name string, class_name string, super_name string, type string, parameters array<struct<type: string, name: string>>, "
    "calls array<struct<receiver: string, name: string, n_args: int>>, first int, signature_end int, last int, tokens array<string>, source string"
)


def outlines(files: DataFrame) -> DataFrame:
    """(OUTLINE) of Java texts (id, code), which no column function can parse: a row per class, field, method and constructor, ``place`` counting
    from 0 in each text. ``source`` is a method's text, from after its annotations. Null and empty texts have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for k, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code = cell.as_py() or ""
                for place, f in enumerate(java_outline(code)):
                    a, b = f.pop("span")
                    source = code[a:b] if f["kind"] in ("method", "constructor") else None
                    rows.append({"id": k, "place": place, "source": source, **f})
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_OUTLINE)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_OUTLINE)

    return files.select("id", "code").mapInArrow(run, OUTLINE)
