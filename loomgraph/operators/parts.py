"""Connected parts of link tables (type, src, dst, ...): found without a round for each step, and settled whole in one task.

Links of different types are different graphs.  Links are first joined where
they lie, chunk by chunk; only nodes that two chunks share are compared after
that, so a table that holds neighbours together takes one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import saved

#: Links that a worker joins at once; rows of whole parts that it settles at once.
CHUNK, GROUP = 1 << 19, 1 << 16
#: Links of the largest part that one task settles: by steps in proportion to its links, or to their square.
LINEAR, SQUARE = 1 << 18, 1 << 14


def compact(kind: pa.Array, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of links as numbers from 0, and the ids of these; inside a type numbers follow ids."""
    codes = kind.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    keys, node = np.unique(np.concatenate([codes, codes]) * max(len(ids), 1) + at, return_inverse=True)
    return node[: len(src)], node[len(src) :], ids[keys % max(len(ids), 1)]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least connected number of each of n."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not ((up := label[label]) == label).all():
            label = up


def on_cycles(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which links lie on a cycle: both ends are in one strongly connected component."""
    alive = np.arange(len(a))
    for _ in range(64):  # most links lead in from or out to nowhere
        left = (np.bincount(b[alive], minlength=n)[a[alive]] > 0) & (np.bincount(a[alive], minlength=n)[b[alive]] > 0)
        if left.all():
            break
        alive = alive[left]
    out = np.zeros(len(a), dtype=bool)
    if len(alive):
        scc = components(a[alive], b[alive])
        out[alive] = [scc[x] == scc[y] for x, y in zip(a[alive].tolist(), b[alive].tolist(), strict=True)]
    return out


def components(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """The strongly connected component of each node, by Tarjan's algorithm without recursion."""
    after: dict[int, list[int]] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        after.setdefault(x, []).append(y)
    index, low, scc, waiting = {}, {}, {}, []
    for first in after:
        if first in index:
            continue
        index[first] = low[first] = len(index)
        waiting.append(first)
        path = [(first, iter(after[first]))]
        while path:
            x, rest = path[-1]
            for y in rest:
                if y not in index:
                    index[y] = low[y] = len(index)
                    waiting.append(y)
                    path.append((y, iter(after.get(y, ()))))
                    break
                if y not in scc:
                    low[x] = min(low[x], index[y])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[x])
                if low[x] == index[x]:
                    while True:
                        y = waiting.pop()
                        scc[y] = x
                        if y == x:
                            break
    return scc


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        a, b, ids = compact(table["type"].combine_chunks(), table["src"].to_numpy(), table["dst"].to_numpy())
        return table.append_column("part", pa.array(ids[roots(a, b, len(ids))[a]], pa.int64())).to_batches()

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield from joined()
            held, n = [], 0
    if n:
        yield from joined()


def with_part(links: DataFrame) -> DataFrame:
    """``links`` with ``part``, a node whose links they are connected to, in whatever direction; links without an end are left out."""
    rows = links.where("type IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part bigint"
    placed = saved(rows.mapInArrow(_join_chunks, schema), "placed")
    ends = placed.select("type", "part", F.explode(F.array("src", "dst")).alias("node"))
    seam = saved(ends.groupBy("type", "node").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").drop("hi"), "seam")
    if seam.isEmpty():
        return placed
    bridges = saved(ends.join(seam, ["type", "node"]).where("part <> lo").select("type", F.col("part").alias("src"), F.col("lo").alias("dst")).distinct(), "bridges")
    return placed.join(_labels(bridges), ["type", "part"], "left").withColumn("part", F.coalesce("label", "part")).select(*placed.columns)


def _labels(bridges: DataFrame) -> DataFrame:
    """(type, part, label) of all ends of bridges: in one task if that holds them, else by labels that travel and jump, in about log n rounds."""
    if bridges.count() <= CHUNK:
        joined = bridges.coalesce(1).mapInArrow(_join_chunks, "type string, src bigint, dst bigint, part bigint")
        return saved(joined.select("type", F.col("part").alias("label"), F.explode(F.array("src", "dst")).alias("part")).distinct(), "labels")
    both = saved(bridges.union(bridges.select("type", "dst", "src")).distinct(), "bridges")
    labels = saved(both.groupBy("type", F.col("src").alias("part")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("part", "src"), ["type", "src"]).groupBy("type", F.col("dst").alias("part")).agg(F.min("label").alias("seen"))
        near = labels.join(seen, ["type", "part"]).select("type", "part", F.col("label").alias("old"), F.least("label", "seen").alias("near"))
        new = saved(near.join(labels.select("type", F.col("part").alias("near"), F.col("label").alias("jumped")), ["type", "near"]).select("type", "part", "old", F.least("near", "jumped").alias("label")), "labels")
        labels = new.select("type", "part", "label")
        if new.where("label <> old").isEmpty():
            return labels


def split(links: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``links`` with ``part``: those of parts of up to ``most`` links, and those of larger ones or None."""
    placed = with_part(links)
    large = saved(placed.groupBy("type", "part").count().where(F.col("count") > most).select("type", "part"), "large")
    if large.isEmpty():
        return placed, None
    placed = saved(placed, "placed")
    return placed.join(large, ["type", "part"], "left_anti"), placed.join(large, ["type", "part"], "left_semi")


def settled(links: DataFrame, settle: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``settle`` makes of tables of some whole parts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < GROUP:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            part, kind = table["part"].to_numpy(), table["type"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            whole = n - int(((part == part[-1]) & (kind == kind[-1])).sum())
            if whole:
                yield from settle(table.slice(0, whole))
            held, n = table.slice(whole).to_batches(), n - whole
        if n:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    return links.repartition("type", "part").sortWithinPartitions("type", "part").mapInArrow(run, schema)


def _after(a: np.ndarray, b: np.ndarray) -> dict[int, dict[int, None]]:
    """Different successors of each node, in order."""
    out: dict[int, dict[int, None]] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        out.setdefault(x, {})[y] = None
    return out


def _ends(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return compact(table["type"].combine_chunks(), table["src"].to_numpy(), table["dst"].to_numpy())


def cycle_links(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The links that lie on a cycle, all columns, as often as they come."""
    a, b, ids = _ends(table)
    yield from table.filter(pa.array(on_cycles(a, b, len(ids)))).to_batches()


def reached(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(src, dst, depth): what links reach from the sources marked in ``asked``, with the least number of steps."""
    a, b, ids = _ends(table)
    after, src, dst, depth = _after(a, b), [], [], []

    def batch():
        return pa.RecordBatch.from_pydict({"src": pa.array(ids[np.array(src, dtype=np.int64)], pa.int64()), "dst": pa.array(ids[np.array(dst, dtype=np.int64)], pa.int64()), "depth": pa.array(depth, pa.int32())})

    for start in np.unique(a[table["asked"].to_numpy()]).tolist():
        seen, here, step = set(after[start]), list(after[start]), 1
        while here:
            src += [start] * len(here)
            dst += here
            depth += [step] * len(here)
            following = []
            for x in here:
                for y in after.get(x, ()):
                    if y not in seen:
                        seen.add(y)
                        following.append(y)
            here, step = following, step + 1
        if len(src) >= GROUP:
            yield batch()
            src, dst, depth = [], [], []
    if src:
        yield batch()


def needless(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(src, dst): links besides which a path leads on by another link and other nodes; no loops."""
    a, b, ids = _ends(table)
    apart = a != b
    after = _after(a[apart], b[apart])
    ways: dict[int, int] = {}
    for following in after.values():
        for y in following:
            ways[y] = ways.get(y, 0) + 1
    src, dst = [], []
    for start, following in after.items():
        if len(following) < 2:
            continue
        for end in following:
            if ways[end] > 1 and _leads([x for x in following if x != end], start, end, after):
                src.append(start)
                dst.append(end)
    yield pa.RecordBatch.from_pydict({"src": pa.array(ids[np.array(src, dtype=np.int64)], pa.int64()), "dst": pa.array(ids[np.array(dst, dtype=np.int64)], pa.int64())})


def _leads(starts: list[int], closed: int, end: int, after: dict) -> bool:
    """Whether a path from one of ``starts`` leads to ``end`` without a closed node."""
    seen, here = {closed, *starts}, list(starts)
    while here:
        for y in after.get(here.pop(), ()):
            if y == end:
                return True
            if y not in seen:
                seen.add(y)
                here.append(y)
    return False


def held(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(id): links with an id that, taken in id order, would close a cycle with those without and the earlier ones not held."""
    a, b, _ = _ends(table)
    ids = table["id"].to_pylist()
    after = _after(*(x[[i is None for i in ids]] for x in (a, b)))
    out = []
    for i, x, y in sorted((i, x, y) for i, x, y in zip(ids, a.tolist(), b.tolist(), strict=True) if i is not None):
        if x == y or _leads([y], -1, x, after):
            out.append(i)
        else:
            after.setdefault(x, {})[y] = None
    yield pa.RecordBatch.from_pydict({"id": pa.array(out, pa.int64())})
