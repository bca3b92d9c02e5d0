"""Mixing sources to target weights by Pfair scheduling (op5), with DataFrame operations alone.

A source with weight ``k / parts`` may start its block ``j`` in slot ``floor(j * parts / k)`` (its release) and
must have had it by slot ``ceil((j + 1) * parts / k)`` (its deadline). Earliest-deadline-first over these
windows meets every deadline, so at each point of the mixture every source is less than one block away from
its share. The windows repeat after ``parts`` slots; one period is scheduled, and rows find their slot in it.

``mix`` ends where the first source has run out. ``mix_shares`` takes the shares from the rows themselves, so that
all sources run out at its end.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S


#: Columns of the mixture; those of the input that are called so are replaced.
_OWN = ("block", "place", "release", "deadline", "slot", "taken")


def source_key(source: Column) -> Column:
    """A source's name in joins; rows without one are a source of their own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def order(source: str = "source", doc_id: str = "doc_id") -> list[Column]:
    """What rows of a mixture are sorted by: slot, then source, then place (see ``_ranked``)."""
    return [F.col("slot"), source_key(F.col(source)), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.col(doc_id)]


def capped_weights(counts: DataFrame, ceiling: float = 0.25, parts: int = 4096) -> DataFrame:
    """``key, n, k``: integer weights with sum ``parts`` in proportion to ``n``, but none above ``ceiling``.

    What is above the ceiling (at least one equal share) is dealt out among the others in proportion. Each
    source has one part at least; the parts left by rounding down go to the largest remainders. ``counts`` has
    a row for each source, so windows over all of it are as small as the list of sources.
    """
    down = Window.orderBy(F.desc("n"), "key")
    s = counts.select("key", F.col("n").cast("double").alias("n"), (F.row_number().over(down) - 1).alias("m"))
    every = Window.partitionBy(F.lit(1))
    s = s.withColumns({"many": F.count("*").over(every), "rest": F.sum("n").over(Window.orderBy("m").rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("c", F.greatest(F.lit(float(ceiling)), 1.0 / F.col("many")))
    left = 1.0 - F.col("c") * F.col("m")
    s = s.withColumn("cap", F.when(left > 1e-9, F.col("c") * F.col("rest") / left))  # if the m largest sources are capped
    fits = F.when((F.col("n") <= F.col("cap")) | (F.col("m") == F.col("many") - 1), F.struct("m", F.coalesce("cap", "n").alias("cap"), "rest"))
    s = s.withColumn("at", F.min(fits).over(every))
    s = s.withColumn("v", F.least(F.col("n"), F.col("at.cap")))
    total = F.col("at.rest") + F.col("at.m") * F.col("at.cap")
    s = s.withColumn("exact", F.greatest(F.lit(parts) - F.col("many"), F.lit(0)) * F.col("v") / total)
    s = s.withColumn("k", (F.floor("exact") + 1).cast("long"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.floor("exact")), "key"))
    spare = F.lit(parts) - F.sum("k").over(every)
    return s.select("key", F.col("n").cast("long").alias("n"), (F.col("k") + F.when(rank <= spare, 1).otherwise(0)).alias("k"))


def schedule(weights: DataFrame) -> DataFrame:
    """``key, turn, at``: the slot within a period of each source's ``turn``-th block, by earliest deadline first.

    Ties go to the first source by key. One array fold over the slots of a period: its size depends on the
    number of parts and sources, not on the rows.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("key", "k"))).alias("s"), F.sum("k").alias("p"))
    pick = """array_min(filter(transform(s, (x, i) -> if((st.next[i] * p) div x.k <= t,
                 struct(((st.next[i] + 1) * p + x.k - 1) div x.k as due, i as i), null)),
                 x -> x is not null)).i"""
    fold = f"""aggregate(sequence(0L, p - 1),
        struct(transform(s, x -> 0L) as next, cast(array() as array<struct<i: int, turn: bigint, at: bigint>>) as got),
        (st, t) -> transform(array({pick}), w -> struct(
            transform(st.next, (n, i) -> if(i = w, n + 1, n)) as next,
            concat(st.got, array(struct(w as i, st.next[w] as turn, t as at))) as got))[0],
        st -> st.got)"""
    runs = one.where("p > 0").select("s", F.explode(F.expr(fold)).alias("g"))
    return runs.select(F.expr("s[g.i].key").alias("key"), "g.turn", "g.at")


def _ranges(docs: DataFrame, source: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their source's key and hash; the counts of each source's 4096 ranges of the hash; where ranges start.

    A source is ranked in ranges, so that the largest one is spread as widely as the others.
    """
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumns({"__key": source_key(F.col(source)), "__h": digest}).withColumn("__range", F.substring("__h", 1, 3))
    ranges = S.materialize(rows.groupBy(F.col("__key").alias("key"), F.col("__range").alias("range")).agg(F.count("*").alias("n")))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.select(F.col("key").alias("__key"), F.col("range").alias("__range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"),
                          F.sum("n").over(Window.partitionBy("key")).alias("__n"))
    return rows, ranges, first


def _ranked(rows: DataFrame, first: DataFrame, doc_id: str) -> DataFrame:
    """Rows with their rank in their source, from 0, by hash and id."""
    order = Window.partitionBy("__key", "__range").orderBy("__h", doc_id)
    return (rows.withColumn("__rn", F.row_number().over(order)).join(first, ["__key", "__range"])
            .withColumn("__rank", F.col("__first") + F.col("__rn") - 1).drop("__first", "__rn"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", doc_id: str = "doc_id",
        block_rows: int = 16, ceiling: float = 0.25, parts: int = 4096) -> DataFrame:
    """All rows and columns of ``docs`` with their place in the mixture.

    ``block`` counts the source's blocks of ``block_rows`` rows, in an order shuffled by a hash of the id;
    ``release``, ``deadline`` and ``slot`` are counted in blocks of the mixture, ``place`` in rows of the block.
    ``taken`` tells whether the slot lies before the mixture's end: the first point at which a source that has
    run out is a whole block short of its share. Rows beyond it are kept, marked, for a later mixture.

    ``weights`` (``key`` by ``source_key``, ``k`` parts) may be given for all sources; else ``capped_weights``
    of the row counts. A null source is a source of its own, a null id sorts first, repeated rows count as
    rows, an empty table stays empty.
    """
    rows, ranges, first = _ranges(docs.drop(*_OWN), source, doc_id)
    counts = ranges.groupBy("key").agg(F.sum("n").alias("n"))
    if weights is None:
        weights = capped_weights(counts, ceiling, parts)
    weights = S.materialize(weights.select("key", "k").join(counts, "key"))
    period = weights.agg(F.sum("k").alias("p")).first()["p"] or 1
    blocks = f"((n + {block_rows - 1}) div {block_rows} + 1)"
    end = weights.agg(F.min(F.expr(f"({blocks} * {period} + k - 1) div k")).alias("end")).first()["end"]
    parts_of = weights.select(F.col("key").alias("__key"), F.col("k").alias("__k"))
    turns = schedule(weights).select(F.col("key").alias("__key"), F.col("turn").alias("__turn"), F.col("at").alias("__at"))
    ranked = (_ranked(rows, first.drop("__n"), doc_id)
              .join(F.broadcast(parts_of), "__key")  # a row for each source
              .withColumn("block", F.expr(f"__rank div {block_rows}")).withColumn("place", (F.col("__rank") % block_rows).cast("int"))
              .withColumn("__turn", F.col("block") % F.col("__k"))
              .join(F.broadcast(turns), ["__key", "__turn"]))  # a row for each part
    out = ranked.withColumns({
        "release": F.expr(f"(block * {period}) div __k"), "deadline": F.expr(f"((block + 1) * {period} + __k - 1) div __k"),
        "slot": F.expr(f"(block div __k) * {period} + __at")})
    return out.withColumn("taken", F.col("slot") < F.lit(end)).drop("__key", "__h", "__range", "__rank", "__k", "__turn", "__at")


def share_limit(counts: DataFrame, ceiling: float = 0.25, real: float = 1 / 16) -> tuple[int, int]:
    """``(limit, total)``: the rows of a source that a mixture of all sources can hold, and that mixture's rows.

    The mixture is the largest one in which no source is above ``ceiling``, or above an equal share of the largest
    sources where the others are too few for it: where all others together have less than ``real`` of the rows of the
    least of those. So no rare source holds the others down. As few sources as fit under the ceiling can be
    above it, and the driver sees only those.
    """
    total, share = counts.agg(F.sum("n")).first()[0] or 0, Fraction(str(ceiling))
    largest = [r["n"] for r in counts.orderBy(F.desc("n")).limit(math.ceil(1 / share)).collect()]
    rest = total
    for m, n in enumerate(largest, 1):
        rest -= n
        if rest < real * n:
            share = max(share, Fraction(1, m))
            break
    rest, limit = total, Fraction(0)
    for m, n in enumerate(largest):
        limit = share * rest / (1 - share * m)  # if the m largest sources are above it
        if n <= limit:
            break
        rest -= n
    limit = math.floor(limit)
    return limit, int(counts.agg(F.sum(F.least("n", F.lit(limit)))).first()[0] or 0)


def mix_shares(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", block_rows: int = 16,
               ceiling: float = 0.25, real: float = 1 / 16) -> DataFrame:
    """All rows and columns of ``docs`` with their place in a mixture that holds each source whole or up to its limit.

    A row is ``taken`` unless its source is above ``share_limit`` and has given that many rows before, by a hash of the
    id; so only what is above the ceiling is left out, however rare or many the other sources are. ``block`` and
    ``place`` are as in ``mix``; ``release``, ``deadline`` and ``slot`` are counted in rows of the mixture. A source with
    ``q`` of its ``total`` rows has its block between ``floor(first row * total / q)`` and ``ceil(end row * total / q)``,
    in a slot drawn by hash, so at each point every source is at most one block away from its share. Blocks of
    several sources may have one slot: sort by slot, source and place. Rows not taken have no release, deadline and slot.
    """
    docs = docs.drop(*_OWN)
    rows, ranges, first = _ranges(docs, source, doc_id)
    limit, total = share_limit(ranges.groupBy("key").agg(F.sum("n").alias("n")), ceiling, real)
    ranked = _ranked(rows, first, doc_id).withColumns({
        "block": F.expr(f"__rank div {block_rows}"), "place": (F.col("__rank") % block_rows).cast("int"),
        "__q": F.least("__n", F.lit(limit).cast("long")), "taken": F.col("__rank") < limit})
    out = ranked.withColumns({
        "release": F.expr(f"if(taken, (cast(block * {block_rows} as decimal(19, 0)) * {total}) div __q, null)"),
        "deadline": F.expr(f"if(taken, (cast(least((block + 1) * {block_rows}, __q) as decimal(19, 0)) * {total} + __q - 1) div __q, null)")})
    out = out.withColumn("slot", F.expr("release + pmod(xxhash64(__key, block), deadline - release)"))
    return out.select(*docs.columns, "block", "place", "release", "deadline", "slot", "taken")
