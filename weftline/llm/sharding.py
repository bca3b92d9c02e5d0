"""Sharding by a K-d tree over metadata (op1), with DataFrame operations alone.

A node that must yield ``k`` shards is split at the distributed weighted quantile ``floor(k / 2) / k`` (the
median for even ``k``) of its widest dimension, until each leaf is one shard of about the target bytes. The
quantiles of a level are found together, by histograms of the key that narrow in on them, so no node is ever sorted or
gathered. Nodes, goals and splits are tables; the driver knows nothing but the depth.

Equal texts are one group: all of its rows lie where its smallest place in each dimension is. A split goes between
groups, unless the group there has more than the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Bits of a split key: the dimension's place, then hashes of the group, of the row's id and of its place in the input.
_DIM_BITS, _GROUP_BITS, _ID_BITS, _ROW_BITS = 22, 12, 18, 10
_TIE = _GROUP_BITS + _ID_BITS + _ROW_BITS
#: Keys of one group: splits between groups lie at its multiples.
_WITHIN = 1 << (_ID_BITS + _ROW_BITS)
#: Buckets of one histogram in the root; nodes below need fewer for the same share of a shard.
_BUCKETS, _LEAST_BUCKETS = 1 << 14, 1 << 8
#: A split may miss its quantile by this share of one shard.
_TOLERANCE = 0.004
#: Rows of a shard that are sorted in one run, and the most nodes that are broadcast.
_RUN_ROWS, _MAX_BROADCAST = 1 << 17, 1_000_000


def hashed_place(value: Column) -> Column:
    """A place for each distinct value: equal values lie together, others apart. A null lies at the lower end."""
    return F.when(value.isNull(), 0).otherwise(F.shiftrightunsigned(F.xxhash64(value), 64 - _DIM_BITS)).cast("long")


def number_place(rows: DataFrame, value: Column) -> Column:
    """A number's place between the table's smallest and largest one. A null lies at the lower end."""
    value = value.cast("double")
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None or not high > low:
        return F.lit(0).cast("long")
    return F.coalesce(F.floor((value - low) / (high - low) * ((1 << _DIM_BITS) - 1)), F.lit(0)).cast("long")


def _low(hashed: Column, bits: int) -> Column:
    return hashed.bitwiseAND(F.lit((1 << bits) - 1))


def _small(rows: DataFrame, most: int) -> DataFrame:
    """A table of at most so many rows, broadcast if these are few; else Spark deals rows out by node."""
    return F.broadcast(rows) if most <= _MAX_BROADCAST else rows


def _keyed(rows: DataFrame, dims: list[Column], size: Column, group: Column, row_id: Column) -> DataFrame:
    """``__row, size, p0, p1, ..., tie``: the places of each row's group, and the bits that part rows alike in a dimension."""
    places = [f"p{i}" for i in range(len(dims))]
    facts = rows.select("__row", F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"), F.xxhash64(group).alias("g"),
                        (F.shiftleft(_low(F.xxhash64(row_id), _ID_BITS), _ROW_BITS) + _low(F.xxhash64("__row"), _ROW_BITS)).alias("own"),
                        *[d.alias(p) for d, p in zip(dims, places)])
    groups = facts.groupBy("g").agg(F.count("*").alias("many"), *[F.min(p).alias(f"least_{p}") for p in places]).where("many > 1")
    joined = facts.join(groups, "g", "left").withColumns({p: F.coalesce(f"least_{p}", p) for p in places})
    return joined.select("__row", "size", *places, (F.shiftleft(_low(F.col("g"), _GROUP_BITS), _ID_BITS + _ROW_BITS) + F.col("own")).alias("tie"))


def _key(dims: int) -> Column:
    """The row's key in its node's dimension."""
    return F.shiftleft(F.expr("case dim " + " ".join(f"when {i} then p{i}" for i in range(dims)) + " end"), _TIE) + F.col("tie")


def _goals(at: DataFrame, dims: int) -> DataFrame:
    """A row for each node that must be split: its dimension, the range of keys to search, and the bytes to reach."""
    ends = [x for i in range(dims) for x in (F.min(f"p{i}").alias(f"lo{i}"), F.max(f"p{i}").alias(f"hi{i}"))]
    stats = at.where("k > 1").groupBy("node", "k").agg(F.sum("size").alias("bytes"), *ends)
    widest = F.expr(f"-array_max(array({', '.join(f'struct(hi{i} - lo{i} as w, {-i} as i)' for i in range(dims))})).i")
    stats = stats.withColumn("dim", widest.cast("int"))
    end = lambda which: F.expr("case dim " + " ".join(f"when {i} then {which}{i}" for i in range(dims)) + " end")
    return stats.select("node", "k", "dim", F.expr("cast(k div 2 as int)").alias("left"), F.shiftleft(end("lo"), _TIE).alias("lo"), F.shiftleft(end("hi") + 1, _TIE).alias("hi"),
                        F.lit(0.0).alias("before"), F.expr("bytes * (k div 2) / k").alias("goal"), F.expr(f"{_TOLERANCE}D * bytes / k").alias("slack"),
                        F.lit(None).cast("long").alias("split"))


def _narrowed(at: DataFrame, goals: DataFrame, dims: int, nodes: int) -> DataFrame:
    """The goals after one more histogram: ``split`` where it is found, else a range of one bucket."""
    buckets = max(_LEAST_BUCKETS, _BUCKETS // nodes)
    step = f"if(hi - lo > {_WITHIN}, ceil((hi - lo) / {buckets}.0D / {_WITHIN}) * {_WITHIN}, greatest(1, (hi - lo + {buckets - 1}) div {buckets}))"
    open_ = goals.where("split is null").withColumn("step", F.expr(f"cast({step} as long)"))
    rows = at.join(_small(open_.select("node", "dim", "lo", "hi", "step"), nodes), "node").withColumn("key", _key(dims)).where("key >= lo and key < hi")
    counts = rows.groupBy("node", F.expr("(key - lo) div step").alias("bucket")).agg(F.sum("size").alias("bytes"))
    upto = Window.partitionBy("node").orderBy("bucket")  # as many rows of a node as it has buckets
    after = counts.withColumn("after", F.sum("bytes").over(upto)).join(open_, "node").withColumn("after", F.col("after") + F.col("before"))
    hit = after.where("after >= goal").groupBy("node").agg(F.min(F.struct("bucket", "bytes", "after")).alias("hit"))
    found = open_.join(hit, "node", "left").withColumns({"from": F.expr("lo + hit.bucket * step"), "to": F.expr("least(lo + (hit.bucket + 1) * step, hi)")})
    near = "if(goal - (hit.after - hit.bytes) < hit.after - goal, from, to)"
    split = F.expr(f"case when hit is null then hi when to - from = 1 or hit.bytes <= slack then {near} end")
    found = found.select("node", "k", "dim", "left", F.coalesce("from", "lo").alias("lo"), F.coalesce("to", "hi").alias("hi"),
                         F.expr("coalesce(hit.after - hit.bytes, before)").alias("before"), "goal", "slack", split.alias("split"))
    return goals.where("split is not null").unionByName(found)


def kd_shards(docs: DataFrame, dims: list[Column], size: Column, group: Column, row_id: Column,
              shards: int | None = None, target_bytes: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Give the number of ``shards``, or ``target_bytes`` for as many as the sum of ``size`` needs. ``dims`` are places
    (``hashed_place``, ``number_place``). Rows alike in all dimensions are parted by hashes of ``group``, ``row_id`` and
    place in the input. Rows of one group stay together, unless the split that meets them would miss its quantile by
    more than the tolerance. A null size counts as 0. A row larger than a shard's target makes its shard that much
    larger. An empty table stays empty. ``docs`` must not have a column ``__row``. With ``order`` a shard's slots follow the
    first dimension and then these columns of ``docs``; else they are in no order that holds for the whole shard.
    """
    rows = S.materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    at = S.materialize(_keyed(rows, dims, size, group, row_id))
    many, total = at.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, -(-total // target_bytes)) if shards is None else shards
    at, largest, nodes = at.withColumns({"node": F.lit(0), "k": F.lit(shards)}), shards, 1
    while largest > 1:
        goals = S.materialize(_goals(at, len(dims)))
        while not goals.where("split is null").isEmpty():  # a search has 62 bits, of which each histogram settles 8 at least
            goals, last = S.materialize(_narrowed(at, goals, len(dims), nodes)), goals
            S.discard(last)
        moved = at.join(_small(goals.select("node", "dim", "split", "left"), nodes), "node", "left")
        right = _key(len(dims)) >= F.col("split")
        now = S.materialize(moved.select(
            "__row", "size", *[f"p{i}" for i in range(len(dims))], "tie", F.when(right, F.col("node") + F.col("left")).otherwise(F.col("node")).alias("node"),
            F.when(F.col("split").isNull(), F.col("k")).when(right, F.col("k") - F.col("left")).otherwise(F.col("left")).alias("k")))
        S.discard(goals, at)
        at, largest, nodes = now, largest - largest // 2, nodes * 2
    if order:
        at = at.join(rows.select("__row", F.struct(*order).alias("order")), "__row")
    return rows.join(_numbered(at, shards, max(1, many // shards // _RUN_ROWS), bool(order)), "__row").select(*docs.columns, "shard", "slot")


def _numbered(at: DataFrame, shards: int, runs: int, ordered: bool = False) -> DataFrame:
    """``__row, shard, slot``: each shard is numbered in runs by hash, or ``ordered`` by ranges of its first dimension, whose lengths then give each run's first slot."""
    if ordered:
        ends = at.groupBy("node").agg(F.min("p0").alias("low"), F.max("p0").alias("high"))
        at, run, by = at.join(_small(ends, shards), "node"), F.expr(f"cast((p0 - low) * {runs} div (high - low + 1) as int)"), ["p0", "order", "__row"]
    else:
        run, by = F.pmod(F.xxhash64("__row"), F.lit(runs)).cast("int"), ["p0", "p1", "__row"]
    order = Window.partitionBy("shard", "run").orderBy(*by)
    places = [c for c in at.columns if c in ("p0", "p1", "order")]
    placed = S.materialize(at.select("__row", F.col("node").alias("shard"), run.alias("run"), *places).withColumn("rank", F.row_number().over(order)).drop(*places))
    sizes = placed.groupBy("shard", "run").agg(F.max("rank").cast("long").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return placed.join(_small(first, shards * runs), ["shard", "run"]).select("__row", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, extra_bytes: int = 16, sized: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot``, by language, source and id; equal texts are one group.

    Size is no dimension, as it would gather the largest texts in a few shards, whose sizes would then differ by a
    large text. A row's size is the UTF-8 bytes of ``text`` and ``extra_bytes``; a null text has no bytes and is like an
    empty one. With ``sized``, ``docs`` comes from ``size_table`` instead. Columns that are called ``shard`` or ``slot``
    already are replaced; all others stay as they are.
    """
    docs = docs.drop("shard", "slot")
    size, group = (F.col("size"), F.col("text_hash")) if sized else (_size(extra_bytes), F.xxhash64(F.coalesce("text", F.lit(""))))
    dims = [hashed_place(F.col("lang")), hashed_place(F.col("source")), number_place(docs, F.col("doc_id"))]
    return kd_shards(docs, dims, size, group, F.col("doc_id"), shards, target_bytes)


def shard_mixture(docs: DataFrame, order: list[Column], target_bytes: int, extra_bytes: int = 16) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot``, by their ``slot`` in a mixture, which is replaced.

    The mixture is the tree's only dimension, as language or source would part what it has mixed: each shard is a range of it, and
    a shard's slots follow the mixture in ``order``. Equal texts are one group, at its first place.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(*kept, number_place(docs, F.col("slot")).alias("__place"), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]).alias("__order"))
    group = F.xxhash64(F.coalesce("text", F.lit("")))
    return kd_shards(rows, [F.col("__place")], _size(extra_bytes), group, F.col("doc_id"), None, target_bytes, [F.col("__order")]).select(*kept, "shard", "slot")


def _size(extra_bytes: int) -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + extra_bytes


def size_table(docs: DataFrame, extra_bytes: int = 16) -> DataFrame:
    """The columns that sharding needs, written once, so that texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return S.materialize(docs.select("doc_id", "lang", "source", _size(extra_bytes).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")))
