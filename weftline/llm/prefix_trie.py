"""Prefix tries of conversations by partition refinement.

All conversations begin in one class. Turn by turn a class is split by what its members say next; a class with one
sequence left is retired, and the rest of that sequence is a chain of nodes that needs no more splitting. Equal
conversations are one sequence with a weight from the start, so copies don't keep a class alive. Several turns are
split at once, twice as many in each round, so rounds grow with the logarithm of the longest shared beginning.

The fold back needs no rounds: what a node's subtree adds up to is a sum over the sequences through it, as each of
them knows its words from a depth on, and from which depth on it stands for its class (as its smallest member).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranges import scan

from . import shared as S

#: Ids in a piece of a class's id list.
LIST_IDS = 4096
#: Turns split in the first round and in each round at most; a window holds that many rows.
FIRST_TURNS, MOST_TURNS = 4, 1024


def turn_table(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``id, place, said, words``: turns numbered from 1, the SHA-256 of role and text, and the text's words.

    Nulls are empty; null turns come first; of equal turns the smaller digest; rows without an id are no conversation.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256))
    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(turn).alias("turn"), said.alias("said"),
                                                      F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return scan(plain, ["id"], ["turn", "said"], {"place": F.lit(1).cast("long")}).select("id", "place", "said", "words")


def with_shared_heads(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """``(ids, turns)`` of conversations whose first ``heads`` turns (``most`` at most) are those of another one, ``base``.

    Both are Columns of ``id``. A base that isn't there has no turns; what a conversation says after its own first turns
    follows what the base has of them.
    """
    turns = S.materialize(turns)
    ids = turns.select("id").distinct().withColumns({"__base": base, "__heads": heads})
    first = turns.where(F.col("place") <= most).withColumnRenamed("id", "__base")
    counts = first.groupBy("__base").agg(F.count("*").alias("__has"))
    begun = ids.join(first, "__base").where(F.col("place") <= F.col("__heads")).select("id", "place", "said", "words")
    own = turns.withColumns({"__base": base, "__heads": heads}).where(F.col("place") > F.col("__heads")).join(counts, "__base", "left")
    own = own.withColumn("place", F.col("place") - F.col("__heads") + F.least("__heads", F.coalesce("__has", F.lit(0))))
    return ids.select("id"), begun.unionByName(own.select("id", "place", "said", "words"))


def _hashes(parts: tuple[str, ...]) -> list[Column]:
    """128 bits of a row's values; sets of rows are compared by XOR."""
    return [F.xxhash64(F.lit(seed), *parts) for seed in ("one", "two")]


def sequences(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``seq, n_turns, n, ends``: distinct sequences of turns, named by their smallest id, with the number of their
    conversations and the SHA-256 of their ids, in order and joined by commas.

    A digest of a list is made in one pass by nature. It streams through pieces of 4,096 ids that other tasks have joined, so
    a task holds a piece at a time, however many ids there are.
    """
    a, b = _hashes(("place", "said"))
    sums = turns.groupBy("id").agg(F.count("*").alias("n_turns"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"))
    whole = ids.join(sums, "id", "left").na.fill(0, ["n_turns", "a", "b"])
    which = ["n_turns", "a", "b"]
    placed = scan(whole, which, ["id"], {"at": F.lit(1).cast("long")})
    pieces = placed.groupBy(*which, F.expr(f"(at - 1) div {LIST_IDS}").alias("piece")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    texts = pieces.select(*which, "piece", F.col("ids")[0].alias("least"), F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("text"))
    S.arrow_batches(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, None
        for batch in batches:
            done = []
            for *now, _, least, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if key is not None:
                        done.append((*out[:3], out[3].hexdigest()))
                    key, out = now, [least, now[0], 0, hashlib.sha256()]
                else:
                    out[3].update(b",")
                out[2] += n
                out[3].update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else ((),) * 4, kinds)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*out[:3], out[3].hexdigest()), kinds)], names)

    names, kinds = ["seq", "n_turns", "n", "ends"], (pa.int64(), pa.int64(), pa.int64(), pa.string())
    ordered = texts.repartition(*which).sortWithinPartitions(*which, "piece")
    return ordered.mapInArrow(run, "seq long, n_turns long, n long, ends string")


def _refined(turns: DataFrame, active: DataFrame) -> DataFrame:
    """Members of classes, ``seq, depth, top, size, parent, ...``, from the turn after the root to the one at which a class is one sequence.

    ``top`` is the class's smallest member, ``size`` its sequences, ``parent`` the class before.
    """
    done, depth, step = [], 0, FIRST_TURNS
    while True:
        block = turns.where((F.col("place") > depth) & (F.col("place") <= depth + step)).join(active, "seq")
        along = Window.partitionBy("seq").orderBy("place")
        upto = along.rowsBetween(Window.unboundedPreceding, 0)
        a, b = _hashes(("place", "said"))
        keyed = S.materialize(block.withColumns({"__a": F.bit_xor(a).over(upto), "__b": F.bit_xor(b).over(upto)}))
        key = ["__top", "place", "__a", "__b"]
        # Written, so that the join deals out both sides anew and a class with very many members is split among tasks.
        classes = S.materialize(keyed.groupBy(*key).agg(F.min("seq").alias("top"), F.count("*").alias("size")))
        members = keyed.join(classes, key)
        members = members.withColumns({"parent": F.coalesce(F.lag("top").over(along), "__top"), "__before": F.lag("size").over(along)})
        members = members.where(F.coalesce(F.col("__before") > 1, F.lit(True)))  # a class of one is retired: what follows is its tail
        done.append(S.materialize(members.select("seq", F.col("place").alias("depth"), "top", "size", "parent", "words", "rest", "n_turns", "n", "ends")))
        S.discard(keyed, classes)
        depth, step = depth + step, min(2 * step, MOST_TURNS)
        active = done[-1].where((F.col("depth") == depth) & (F.col("size") > 1) & (F.col("n_turns") > depth)).select("seq", F.col("top").alias("__top"))
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node of the trie: ``conv_id`` (its smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    ``ids`` has each ``id`` once, ``turns`` has ``id, place (from 1, without gaps), said (binary), words``. No ids give no
    nodes; ids without turns end at the root, the node of depth 0.
    """
    found = S.materialize(sequences(ids, turns))
    own = found.withColumnRenamed("seq", "id")
    rows = turns.join(own, "id").withColumnRenamed("id", "seq").withColumn("back", -F.col("place"))
    rows = S.materialize(scan(rows, ["seq"], ["back"], {"rest": F.col("words")}).drop("back"))
    totals = rows.where("place = 1").select("seq", F.col("rest").alias("rest"))
    top, size = found.agg(F.min("seq"), F.count("*")).first()
    roots = found.join(totals, "seq", "left").withColumns({"__top": F.lit(top).cast("long"), "size": F.lit(size)})
    roots = S.materialize(roots.select("seq", F.lit(0).cast("long").alias("depth"), F.col("__top").alias("top"), "size", F.lit(None).cast("long").alias("parent"),
                                       F.lit(0).cast("long").alias("words"), F.coalesce("rest", F.lit(0)).alias("rest"), "n_turns", "n", "ends"))
    active = roots.where("size > 1 and n_turns > 0").select("seq", F.col("top").alias("__top"))
    members = roots if active.isEmpty() else roots.unionByName(_refined(rows, active))

    # A sequence stands for its class from ``best`` words before its end on; it ends in a leaf if it was retired.
    each = members.groupBy("seq").agg(F.max(F.when(F.col("top") == F.col("seq"), F.col("rest"))).alias("best"), F.max(F.col("size") == 1).alias("leaf"),
                                      F.max(F.when(F.col("size") == 1, F.col("depth"))).alias("retired"))
    each = S.materialize(each)
    nodes = members.join(each, "seq").groupBy("depth", "top").agg(
        F.max(F.when(F.col("seq") == F.col("top"), F.col("parent"))).alias("parent_conv_id"), F.sum("n").alias("n_convs"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(F.col("n") * F.col("rest") - F.least("rest", F.coalesce("best", F.lit(0)))).alias("saved_tokens"),
        F.max(F.when(F.col("n_turns") == F.col("depth"), F.col("ends"))).alias("ends"), F.max(((F.col("size") == 1) & (F.col("n_turns") > F.col("depth"))).cast("long")).alias("__tail"))
    nodes = S.materialize(nodes)
    children = nodes.where("parent_conv_id is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("top")).agg(F.count("*").alias("__children"))
    nodes = nodes.join(children, ["depth", "top"], "left").withColumn("n_children", F.coalesce("__children", F.lit(0)) + F.col("__tail"))
    tails = rows.join(each.where("retired is not null").select("seq", "retired"), "seq").where("place > retired")
    tails = tails.select(F.col("place").alias("depth"), F.col("seq").alias("top"), F.col("seq").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.lit(1).cast("long").alias("n_leaves"),
                         ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"), F.when(F.col("n_turns") == F.col("place"), F.col("ends")).alias("ends"), (F.col("n_turns") > F.col("place")).cast("long").alias("n_children"))
    both = nodes.select(*tails.columns).unionByName(tails)
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    return both.select(F.col("top").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", nobody).alias("ends_sha256"))
