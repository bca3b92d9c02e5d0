"""SimHash near-duplicates through BK-trees of fingerprints (op4).

Fingerprints that differ in at most ``radius`` bits agree on at least ``k`` of ``radius + k`` blocks of
bits. So each shard holds the fingerprints with equal values of ``k`` blocks, and builds a BK-tree of them:
children hang below their parent by integer Hamming distance, and a search follows only edges within
the radius. Shard trees grow with the data, so they are dealt out with their shard, never broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S
from .components import connected_components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted in one step.
_STEP = 1 << 16
#: Most (query, node) pairs that one step of a search works on.
_PAIRS = 1 << 21
#: Fingerprints that a shard has on average at most.
_SHARD = 64


def fingerprint(text: str | bytes | None, words: int = 3, seed: int = 42) -> int:
    """Bit ``i`` is 1 if set in over half of the XXH64s of the word shingles, repeats included; no word: 0."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    got = raw.translate(_LOWER).split()  # bytes.split() splits at exactly the six ASCII whitespace bytes
    if not got:
        return 0
    joined = b" ".join(got)
    n = len(got) - words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, ends)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        part = h[at : at + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """``keep`` columns with ``fp``, the fingerprint as a signed long. A null text has no word."""
    S.arrow_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = rows.drop("__text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


class BkForest:
    """BK-trees of many shards in arrays. ``shard`` and ``value`` list the points, sorted by shard, without repeats.

    All trees grow level by level: the first point of each open group becomes a node, and the others are
    grouped anew by their distance from it. Nodes lie so that a subtree is a run of consecutive places.
    """

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value.copy()
        self.order = np.arange(n)  # the input point at each place
        self.edge = np.zeros(n, np.int64)  # distance from the parent
        self.end = np.zeros(n, np.int64)  # where the subtree ends
        heads = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if n else np.zeros(0, np.int64)
        self.root = heads[np.cumsum(np.concatenate(([True], shard[1:] != shard[:-1]))) - 1] if n else heads
        begin, end = heads, np.concatenate((heads[1:], [n])) if n else heads
        while len(begin):
            self.end[begin] = end
            inner = end - begin > 1
            b, e = begin[inner] + 1, end[inner]
            if not len(b):
                break
            size = e - b
            group = np.repeat(np.arange(len(b)), size)
            places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + b[group]
            d = np.bitwise_count(self.value[places] ^ self.value[b[group] - 1]).astype(np.int64)
            rank = np.argsort(group * 128 + d, kind="stable")
            self.value[places], self.order[places] = self.value[places][rank], self.order[places][rank]
            key = (group * 128 + d)[rank]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            begin = places[new]
            self.edge[begin] = key[new] % 128
            last = np.concatenate((np.flatnonzero(new)[1:], [len(key)])) - 1
            end = places[last] + 1

    def search(self, queries: np.ndarray, radius: int, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """``(query place, found place)`` pairs within the radius, each query in its own tree.

        ``skip(query, node)`` may tell whole subtrees that need not be searched.
        """
        found_q, found_n = [], []
        q, node = queries, self.root[queries]
        while len(q):
            if skip is not None:
                keep = ~skip(q, node)
                q, node = q[keep], node[keep]
            d = np.bitwise_count(self.value[q] ^ self.value[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            found_q.append(q[hit])
            found_n.append(node[hit])
            next_q, next_n = [], []
            child, live = node + 1, np.arange(len(q))
            while True:  # along the children of each node; most nodes have few
                live = live[child[live] < self.end[node[live]]]
                if not len(live):
                    break
                at = child[live]
                near = np.abs(self.edge[at] - d[live]) <= radius
                next_q.append(q[live[near]])
                next_n.append(at[near])
                child[live] = self.end[at]
            q = np.concatenate(next_q) if next_q else np.zeros(0, np.int64)
            node = np.concatenate(next_n) if next_n else np.zeros(0, np.int64)
        return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (queries[:0], queries[:0])

    def spanning_links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places that connect what links within the radius connect, at most one per point.

        Queries go in growing blocks; after each, subtrees that lie wholly in the query's own class are
        skipped. So a dense group costs little more than its size, and no class is missed.
        """
        n = len(self.value)
        label, out_a, out_b = np.arange(n), [], []
        size = self.end - np.arange(n)
        by_rank = np.argsort(np.arange(n) - self.root, kind="stable")  # the first points of all trees, then the second ...
        at, block = 0, max(64, int((self.root == np.arange(n)).sum()))
        while at < n:
            ids = by_rank[at : at + block]
            ids = ids[size[self.root[ids]] > 1]
            low, high = _subtree_range(label, self.end)
            todo = [ids]
            while todo:
                part = todo.pop()
                if len(part) > 64 and int(np.minimum(size[self.root[part]], 4096).sum()) > _PAIRS:
                    todo += [part[: len(part) // 2], part[len(part) // 2 :]]
                    continue
                a, b = self.search(part, radius, lambda q, node: (low[node] == label[q]) & (high[node] == label[q]))
                fresh = label[a] != label[b]
                a, b = a[fresh], b[fresh]
                if len(a):
                    keep, label = _union(label, a, b)
                    out_a.append(a[keep])
                    out_b.append(b[keep])
                    low, high = _subtree_range(label, self.end)
            at, block = at + block, block * 2
        if not out_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_a), np.concatenate(out_b)


def _subtree_range(label: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest label in each subtree, by doubling over runs of places (a sparse table)."""
    n = len(label)
    low, high = label.copy(), label.copy()
    size = end - np.arange(n)
    lo, hi, step = label.copy(), label.copy(), 1
    while step <= int(size.max(initial=0)):
        mine = np.flatnonzero((size >= step) & (size < 2 * step))
        other = end[mine] - step
        low[mine], high[mine] = np.minimum(lo[mine], lo[other]), np.maximum(hi[mine], hi[other])
        lo[: n - step], hi[: n - step] = np.minimum(lo[: n - step], lo[step:]), np.maximum(hi[: n - step], hi[step:])
        step *= 2
    return low, high


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the classes of ``a[i]`` and ``b[i]``; which pairs were needed, and the new labels."""
    names, ends = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
    parent, keep = list(range(len(names))), []
    x, y = ends[: len(a)], ends[len(a) :]
    once = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_index=True)[1]

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in once.tolist():
        p, q = top(int(x[i])), top(int(y[i]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            keep.append(i)
    new = names[[top(i) for i in range(len(names))]]
    where = np.searchsorted(names, label)
    hit = names[np.minimum(where, len(names) - 1)] == label
    return np.array(keep, np.int64), np.where(hit, new[np.minimum(where, len(names) - 1)], label)


def _forest_links(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(frames)  # one partition of shards: (shard, fp) alone, 16 bytes a row
        pdf = pd.concat(got) if got else pd.DataFrame({"shard": [], "fp": []})
        if not len(pdf):
            return
        shard, fp = pdf["shard"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
        order = np.lexsort((fp, shard))
        forest = BkForest(shard[order], fp[order])
        a, b = forest.spanning_links(radius)
        yield pd.DataFrame({"a": forest.value[a].view(np.int64), "b": forest.value[b].view(np.int64)})

    return run


def _blocks(n: int, radius: int, bits: int) -> tuple[int, int]:
    """``(blocks, agreeing)``: cut into ``radius + agreeing`` blocks, so many of them agree within the radius.

    The fewest for which a shard has about ``_SHARD`` of ``n`` spread fingerprints at most: shards don't grow with the data.
    """
    agreeing = 1
    while n > _SHARD << bits * agreeing // (radius + agreeing) and bits // (radius + agreeing) > 1:
        agreeing += 1
    return radius + agreeing, agreeing


def link_fingerprints(prints: DataFrame, radius: int = 3, bits: int = 64) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that connect all that links within the radius connect.

    A shard holds the fingerprints with equal bits in a choice of blocks, one for each choice of as many as must agree.
    """
    distinct = S.materialize(prints.select("fp").distinct())
    many, agreeing = _blocks(distinct.count(), radius, bits)
    cuts = [bits * i // many for i in range(many + 1)]
    shards = []
    for at, some in enumerate(itertools.combinations(range(many), agreeing)):
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in some)
        shards.append(F.xxhash64(F.lit(at), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    rows = distinct.select("fp", F.explode(F.array(*shards)).alias("shard")).select("shard", "fp")
    return rows.repartition("shard").mapInPandas(_forest_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep`` columns, ``fp`` and ``component_id``, the smallest id reachable through links.

    Equal fingerprints are linked too. Null and empty texts have fingerprint 0. A component in which every
    id is null has a null ``component_id``; repeated rows stay, in one component. Columns of ``keep`` that are called like
    the result's own are left out.
    """
    keep = tuple(c for c in keep if c not in ("doc_id", "fp", "component_id", "class"))
    source = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("__words"))
    prints = S.materialize(fingerprints(source, "__words", ("doc_id", *keep), words))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = S.materialize(connected_components(S.materialize(link_fingerprints(prints, radius))))
    whole = parts.join(least, parts.node == least.fp).groupBy("root").agg(F.min("least").alias("component"))
    linked = parts.join(whole, "root").select(F.col("node").alias("fp"), "component", "root")
    # Written, so that the rows of a fingerprint that very many copies share can be dealt out to several tasks.
    ids = S.materialize(least.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "fp").alias("class")))
    return prints.join(ids, "fp").select("doc_id", *keep, "fp", "component_id", "class")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when one document of each near-duplicate group does.

    The smallest id stays (a null id only if there is no other; of one id with several texts, one text); of equal
    rows one stays. Texts are not shuffled unless the rows to remove are too many for Spark to broadcast.
    """
    keyed = docs.withColumns({"__id": F.col(doc_id), "__hash": F.xxhash64(text)})
    rows = near_duplicates(keyed, text, doc_id, words, radius, ("__id", "__hash"))
    keys = S.materialize(rows.groupBy("class", "__id", "__hash").agg(F.count("*").alias("n")))
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__hash").alias("hash"))
    best = keys.groupBy("class").agg(F.min(order).alias("best"))
    marked = keys.join(S.materialize(best), "class").withColumn("stays", F.col("__id").eqNullSafe(F.col("best.id")) & (F.col("__hash") == F.col("best.hash")))
    gone = S.materialize(marked.where("not stays or n > 1").select(F.col("__id").alias("id"), F.col("__hash").alias("hash"), "stays"))
    same = keyed["__id"].eqNullSafe(gone["id"]) & (keyed["__hash"] == gone["hash"])
    left = keyed.join(gone, same, "left_anti")
    repeated = gone.where("stays")
    if not repeated.isEmpty():  # equal rows: one of each
        left = left.unionByName(keyed.join(repeated, keyed["__id"].eqNullSafe(repeated["id"]) & (keyed["__hash"] == repeated["hash"]), "left_semi").dropDuplicates(["__id", "__hash"]))
    return left.drop("__id", "__hash")
