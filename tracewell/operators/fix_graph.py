"""The graph of fixes as lists in files of the shared folder, which tasks map into memory: scores of all methods are then made per query, and no
row per link or per summand is shuffled or stored."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import micros
from ..session import shared_dir
from .features import _expand, _linked, _places, _summed, _together

#: The files: sorted ids, the sizes of their lists, where these begin, and the lists; times of reports (``NEVER`` where unknown), and for each
#: method all methods with a common report and how many are common.
FILES = {
    "bug_ids": "i8", "bug_size": "i4", "bug_start": "i8", "bug_values": "i4", "at": "i8",
    "method_ids": "i8", "method_size": "i4", "method_start": "i8", "method_values": "i4",
    "link_size": "i4", "link_start": "i8", "link_values": "i4", "link_common": "",
}
NEVER = np.iinfo("i8").max
#: Summands that are held at once.
HELD = 2_000_000


def _mapped(folder: str, name: str, kind: str, mode: str = "r") -> np.ndarray:
    path = f"{folder}/{name}"
    return np.asarray(np.memmap(path, kind, mode)) if os.path.getsize(path) else np.zeros(0, kind)


def _opened(graph: tuple[str, str]) -> SimpleNamespace:
    folder, common = graph
    return SimpleNamespace(**{name: _mapped(folder, name, kind or common) for name, kind in FILES.items() if os.path.exists(f"{folder}/{name}")})


def _append(folder: str, name: str, parts: list[str]) -> None:
    """Parts one after another as one file; each is deleted when it is in."""
    with open(f"{folder}/{name}", "wb") as out:
        for part in parts:
            with open(f"{folder}/{part}.{name}", "rb") as part_file:
                shutil.copyfileobj(part_file, out, 1 << 24)
            os.remove(f"{folder}/{part}.{name}")


def _starts(folder: str, name: str) -> np.ndarray:
    """Where lists begin, written from their sizes."""
    sizes, at = _mapped(folder, f"{name}_size", "i4"), 0
    with open(f"{folder}/{name}_start", "wb") as out:
        np.zeros(1, "i8").tofile(out)
        for i in range(0, len(sizes), HELD):
            ends = at + np.cumsum(sizes[i : i + HELD], dtype="i8")
            ends.tofile(out)
            at = ends[-1]
    return _mapped(folder, f"{name}_start", "i8")


def _span(start: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``keys``, by its place, where all its values stand."""
    size = start[keys + 1] - start[keys]
    return np.repeat(np.arange(len(keys)), size), np.repeat(start[keys] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _cuts(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of items whose weights add up to at most ``most``, or of one item."""
    total, i = np.cumsum(weights), 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def _lists(pairs: DataFrame, folder: str, names: tuple[str, str, str], kind: str, parts: int) -> bool:
    """Files of the lists of ``pairs`` (key, value), each pair once, in order of keys; false if there is a null, and none is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        rows, part = pa.Table.from_batches(held), uuid.uuid4().hex
        if any(c.null_count for c in rows.columns):
            yield pa.RecordBatch.from_pydict({"part": pa.array([None], pa.string()), "first": pa.array([None], pa.int64())})
            return
        key, value = (c.to_numpy() for c in rows.columns)
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
        ids, n = np.unique(key[new], return_counts=True)
        for name, array in zip(names, (ids, n.astype("i4"), value[new].astype(kind))):
            array.tofile(f"{folder}/{part}.{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "first": pa.array([ids[0]], pa.int64())})

    done = pairs.repartitionByRange(parts, pairs.columns[0]).mapInArrow(run, "part string, first bigint").collect()
    if any(r.part is None for r in done):
        return False
    for name in names:
        _append(folder, name, [r.part for r in sorted(done, key=lambda r: r.first)])
    return True


def _by_range(spark: SparkSession, bounds: np.ndarray, run, schema: str) -> DataFrame:
    """``run(i, lo, hi)`` gives the batches of each range between two bounds, a task each."""
    ends = [int(x) for x in bounds]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from run(i, ends[i], ends[i + 1])

    return spark.range(0, len(ends) - 1, 1, max(len(ends) - 1, 1)).mapInArrow(of, schema)


def _written(spark: SparkSession, folder: str, names: list[str], bounds: np.ndarray, run) -> None:
    """Files of the arrays that ``run(lo, hi)`` gives for the ranges, in their order, piece by piece."""

    def write(i: int, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        part = uuid.uuid4().hex
        files = [open(f"{folder}/{part}.{name}", "wb") for name in names]
        for arrays in run(lo, hi):
            for file, array in zip(files, arrays):
                array.tofile(file)
        for file in files:
            file.close()
        yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "part": [part]})

    done = sorted(_by_range(spark, bounds, write, "i bigint, part string").collect())
    for name in names:
        _append(folder, name, [r.part for r in done])


def fix_graph(fixed: DataFrame, times: DataFrame) -> tuple[str, str] | None:
    """The files of the graph of ``fixed`` (bug_id, method_id), which may repeat, and of ``times`` (node, at) of reports: their folder and the type
    of the numbers of common reports.

    None, so that joins are to be used, where the shared folder is no file system, an id is null, a report has several times, or there are
    over 2**31 reports or methods. A retried task writes a new part, and only the parts of tasks that ended well are put together.
    """
    spark = fixed.sparkSession
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    if base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return None
    folder = f"{base.toUri().getPath()}/tracewell/{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex}"
    os.makedirs(folder)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = fixed.select(F.col("bug_id").cast("bigint"), F.col("method_id").cast("bigint"))
    if not _lists(pairs, folder, ("bug_ids", "bug_size", "raw"), "i8", parts):
        return None
    start = _starts(folder, "bug")
    if len(start) > NEVER >> 32:
        return None
    even = lambda start: np.unique(np.searchsorted(start, np.linspace(0, start[-1], parts + 1)))
    by_bug = even(start)

    def turned(i: int, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        start, raw = _mapped(folder, "bug_start", "i8")[lo : hi + 1], _mapped(folder, "raw", "i8")
        for x in _cuts(np.diff(start), HELD):
            n = np.diff(start[x.start : x.stop + 1])
            yield pa.RecordBatch.from_arrays([pa.array(raw[start[x.start] : start[x.stop]]), pa.array(np.repeat(np.arange(lo + x.start, lo + x.stop), n))], names=["method", "bug"])

    _lists(_by_range(spark, by_bug, turned, "method bigint, bug bigint"), folder, ("method_ids", "method_size", "method_values"), "i4", parts)
    of_method = _starts(folder, "method")
    if len(of_method) > NEVER >> 32:
        return None

    def numbers(lo: int, hi: int) -> Iterator[tuple]:
        start, raw, ids = _mapped(folder, "bug_start", "i8"), _mapped(folder, "raw", "i8"), _mapped(folder, "method_ids", "i8")
        for i in range(int(start[lo]), int(start[hi]), HELD):
            yield (np.searchsorted(ids, raw[i : min(i + HELD, int(start[hi]))]).astype("i4"),)

    _written(spark, folder, ["bug_values"], by_bug, numbers)
    os.remove(f"{folder}/raw")
    common = np.min_scalar_type(int(_mapped(folder, "method_size", "i4").max(initial=0))).name
    graph = folder, common
    if not _timed(times, graph):
        return None

    def links(lo: int, hi: int) -> Iterator[tuple]:
        g = _opened(graph)
        for x in _cuts(g.method_size[lo:hi], HELD):
            keys = np.arange(lo + x.start, lo + x.stop)
            row, bug = _expand((g.method_start, g.method_values), keys)
            for cut in _cuts(np.bincount(row, g.bug_size[bug], len(keys)), HELD):
                place, other, c = _common(keys[cut], g)
                yield np.bincount(place, minlength=cut.stop - cut.start).astype("i4"), other.astype("i4"), c.astype(common)

    _written(spark, folder, ["link_size", "link_values", "link_common"], even(of_method), links)
    _starts(folder, "link")
    return graph


def _common(keys: np.ndarray, g: SimpleNamespace) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, other method, common reports) of the methods ``keys``."""
    n = len(g.method_ids)
    place, bug = _expand((g.method_start, g.method_values), keys)
    i, other = _expand((g.bug_start, g.bug_values), bug)
    code, c = np.unique(place[i] * n + other, return_counts=True)
    place, other = code // n, code % n
    apart = keys[place] != other
    return place[apart], other[apart], c[apart]


def _timed(times: DataFrame, graph: tuple[str, str]) -> bool:
    """The times of reports, put into their file by the tasks that have them; false if a report has several."""
    folder, n = graph[0], os.path.getsize(f"{graph[0]}/bug_ids") // 8
    with open(f"{folder}/at", "wb") as out:
        for i in range(0, n, HELD):
            np.full(min(HELD, n - i), NEVER).tofile(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, n = _mapped(folder, "bug_ids", "i8"), _mapped(folder, "at", "i8", "r+"), 0
        for batch in batches:
            if batch.num_rows:
                node, time = (c.to_numpy() for c in batch.columns)
                place, known = _places(node, ids)
                at[place[known]] = time[known]
                n += int(known.sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows = times.select(F.col("node").cast("bigint").alias("node"), micros(F.col("at")).cast("bigint").alias("at")).where("node is not null and at is not null")
    put, at = sum(r.n for r in rows.mapInArrow(run, "n bigint").collect()), _mapped(folder, "at", "i8")
    return put == sum(int((at[i : i + HELD] != NEVER).sum()) for i in range(0, n, HELD))


def _best(q: np.ndarray, n: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query by score and id; numbers of reports stand in the order of their ids."""
    order = np.lexsort((-n, -score, q))
    q = q[order]
    top = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[top], n[order][top], score[order][top]


def _reports(g: SimpleNamespace, q: np.ndarray, asked: np.ndarray, n: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, report, score) of the seeds ``n`` of the queries ``q`` (numbers from 0, asked at ``asked``) and of the ``k`` best reports linked with
    them."""
    of_bug, of_method, bugs = (g.bug_start, g.bug_values), (g.method_start, g.method_values), len(g.bug_ids)
    nodes, at_node = np.unique(n, return_inverse=True)
    row, method = _expand(of_bug, nodes)
    order = np.argsort(at_node, kind="stable")
    by_node = np.searchsorted(at_node[order], np.arange(len(nodes) + 1)), order
    late, held = [], 0
    for cut in _cuts(np.bincount(row, g.method_size[method], len(nodes)), HELD):
        place, other, part = _linked(nodes[cut], of_bug, of_method)
        which, seed = _expand(by_node, np.arange(cut.start, cut.stop))
        at_link, link = _expand((np.searchsorted(place, np.arange(cut.stop - cut.start + 1)), np.arange(len(place))), which)
        mq, mn = q[seed[at_link]], other[link]
        early = g.at[mn] < asked[mq]
        late.append((mq[early], mn[early], part[link][early]))
        held += len(late[-1][0])
        if held > 4 * HELD:
            late = [_summed(*map(np.concatenate, zip(*late)), bugs)]
            held = len(late[0][0])
    mq, mn, ms = _summed(*map(np.concatenate, zip(*late)), bugs)
    mq, mn, ms = _best(mq, mn, np.round(ms, 12), k)
    return _summed(np.concatenate([q, mq]), np.concatenate([n, mn]), np.concatenate([score, ms]), bugs)


def _scores(g: SimpleNamespace, method: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Methods and scores of one query: its own (method, score), and ``sim / degree`` of each that they are linked with."""
    degree = g.link_size[method]
    cuts = list(_cuts(degree, HELD))

    def dealt(cut: slice) -> tuple[np.ndarray, np.ndarray]:
        row, at = _span(g.link_start, method[cut])
        other, c = g.link_values[at], g.link_common[at].astype(float)
        return other, c / (g.method_size[method[cut]][row] + g.method_size[other] - c) / degree[cut][row]

    if len(cuts) > 1:
        total, seen = np.bincount(method, score, len(g.method_ids)), np.zeros(len(g.method_ids), bool)
        seen[method] = True
        for cut in cuts:
            other, part = dealt(cut)
            seen[other] = True
            total += np.bincount(other, part, len(total))
        found = np.flatnonzero(seen)
        return found, total[found]
    other, part = (np.concatenate(x) for x in zip((method, score), dealt(cuts[0])))
    low = other.min()
    if other.max() - low > 32 * len(other):
        found, at = np.unique(other, return_inverse=True)
        return found, np.bincount(at, part)
    other = other - low
    total = np.bincount(other, part)
    seen = np.zeros(len(total), bool)
    seen[other] = True
    found = np.flatnonzero(seen)
    return found + low, total[found]


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves away from zero, and exact ones alike whatever the order of summing."""
    x = x + 1e-9
    return np.copysign(np.floor(np.abs(x) * 10.0**places + 0.5) / 10.0**places, x)


def graph_scores(graph: tuple[str, str], best: DataFrame, k: int = 50, chunk: int = 64, places: int = 6) -> DataFrame:
    """(query, method_id, cfs): the collaborative scores from strictly earlier reports, as ``collaborative`` defines them, by following links in
    ``graph``; ``best``: stored (query, at, node, score), the ``k`` best earlier seeds of each query, itself asked at ``at``. ``cfs`` is rounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _together(batches)
        if columns is None:
            return
        g = _opened(graph)
        n, known = _places(columns[2], g.bug_ids)
        query, asked, n, score = (x[known] for x in (columns[0], columns[1], n, columns[3]))
        order = np.argsort(query, kind="stable")
        query, asked, n, score = query[order], asked[order], n[order], score[order]
        ids, first = np.unique(query, return_index=True)
        first = np.append(first, len(query))
        for i in range(0, len(ids), chunk):
            j = min(i + chunk, len(ids))
            rows = slice(first[i], first[j])
            q = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
            rq, rn, rs = _reports(g, q, asked[first[i:j]], n[rows], score[rows], k)
            row, own = _expand((g.bug_start, g.bug_values), rn)
            fq, fm, fs = _summed(rq[row], own, rs[row] / g.bug_size[rn][row], len(g.method_ids))
            ends, out, held = np.searchsorted(fq, np.arange(j - i + 1)), [], 0
            for x in range(j - i):
                mine = slice(ends[x], ends[x + 1])
                found, total = _scores(g, fm[mine], fs[mine])
                out.append((np.full(len(found), ids[i + x]), g.method_ids[found], _rounded(total, places)))
                held += len(found)
                if held > 200_000 or x + 1 == j - i:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query", "method_id", "cfs"])
                    out, held = [], 0

    rows = best.select(F.col("query").cast("bigint"), F.col("at").cast("bigint"), F.col("node").cast("bigint"), F.col("score").cast("double"))
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query").mapInArrow(run, "query bigint, method_id bigint, cfs double")
