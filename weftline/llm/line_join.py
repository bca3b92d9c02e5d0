"""Near-duplicate lines by a segment-partition edit join (op7), with DataFrame operations alone.

Lengths fall into buckets, and within a bucket every line is cut at the same places into one segment more than edits
are allowed: the first ones counted from the line's start, the others from its end. Let ``k`` be the first segment up to
whose end two linked lines have ``k`` edits at most. Then there are exactly ``k`` edits before it and none in it, so
it stands in both lines at places that differ by ``k`` at most from the nearer end. Each line is indexed by its
segments and probes the index by them, shifted by so much. A line near its bucket's lower end does so for the bucket
below, too.

What meets under a key is filtered by letter counts within the join and verified by a banded bit-parallel edit distance.
The lines of a key with many are told apart by one of them, the pivot. Two lines that leave the pivot at different
places, from the start and from the end, differ first where the earlier one leaves it, and last where the later one
comes back to it: so both edits are known, and each line is made into a few variants that must be equal (see
``_variants``). Lines that leave it at one place in one way are a group of their own, with a pivot of their own. So near
copies of one line cost about their number and their links, not the square of their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S
from .components import connected_components

_SPACE_CHARS = " \t\x0b\x0c\r"
#: Letters whose counts (5 bits each) rule pairs out: frequent ones of European languages.
_LETTERS = "etaoinsrhdlu"
#: Lines under one key that are compared as they are; those of a key with more are told apart by a pivot. The limit grows by
#: ``_GROWTH`` each turn (1: it stays), ``_TURNS`` times at most; rows of one block of a comparison.
_GROUP, _GROWTH, _TURNS, _BLOCK = 64, 1, 24, 256
#: Characters of pivots that are broadcast.
_PIVOT_CHARS = 1 << 24


def _bucket(n: str) -> str:
    """The least length of the bucket of length ``n``: its four leading bits."""
    return f"({n} - {n} % shiftleft(1, greatest(0, length(bin({n})) - 4)))"


def _segments(edits: int) -> list[tuple[int, int, list[int]]]:
    """``(segment, of how many, its shifts)``: 0 for the index, the others to probe it."""
    out = []
    for k in range(edits + 1):
        w = min(k, edits - k)
        out.append((k, edits + 1, [0, *range(1, w + 1), *(range(-1, -w - 1, -1) if w > 1 else ())]))
    return out


def _place(k: int, edits: int, shift: int) -> tuple[str, str]:
    """SQL for ``(place from 1, length)`` of segment ``k`` of a line with ``n`` characters in the bucket from ``b``."""
    many = edits + 1
    size = f"(b div {many})" if k < edits else f"(b - {edits} * (b div {many}))"
    if 2 * k <= edits:
        return f"(1 + {k} * (b div {many}) + {shift})", size
    behind = f"(b - {edits} * (b div {many}) + {edits - 1 - k} * (b div {many}))" if k < edits else "0"
    return f"(n - {size} - {behind} + 1 + {shift})", size


def _keys(edits: int) -> list[tuple[bool, int, str, str, str]]:
    """``(indexed, edits, key, first, size)`` of all keys of a line whose bucket allows up to ``edits`` edits, by column.

    Index keys come in the first ``edits + 1`` columns; a bucket with fewer edits leaves some columns NULL.
    """
    out = []
    for e in range(1, edits + 1):
        index, probe = [], []
        for k, _, shifts in _segments(e):
            for s in shifts:
                first, size = _place(k, e, s)
                key = f"xxhash64(salt, {k}, b, substring(line, cast({first} as int), cast({size} as int)))"
                # A shifted segment must lie within the line.
                key = key if s == 0 else f"if({first} >= 1 and {first} + {size} - 1 <= n, {key}, null)"
                (index if s == 0 else probe).append((s == 0, e, key, first, size))
        out.append((index, probe))
    many = max(len(probe) for _, probe in out)
    columns = []
    for at in range(edits + 1 + many):
        cases = [(i if at <= edits else p)[at if at <= edits else at - edits - 1] for i, p in out if len(i if at <= edits else p) > (at if at <= edits else at - edits - 1)]
        pick = lambda which: "case e " + " ".join(f"when {c[1]} then {c[which]}" for c in cases) + " end"
        columns.append((at <= edits, 0, pick(2), pick(3), pick(4)))
    return columns


def _allowed(length: str, edits: int, similarity: float) -> str:
    """Edits that a line of that length may differ by."""
    return f"least({edits}, cast(floor({length} * {round(1 - similarity, 9)}D + 1e-9D) as int))"


def _in_buckets(lines: DataFrame, edits: int, allowed) -> DataFrame:
    """Rows ``salt, line_id, line, n`` with ``b`` and ``e``: a row for each bucket that a line is compared in."""
    below = [f"if({_bucket(f'(n - {j})')} < {_bucket(f'(n - {j - 1})')} and {allowed(_bucket(f'(n - {j})'))} >= {j}, {_bucket(f'(n - {j})')}, null)" for j in range(1, edits + 1)]
    below = [f"if(n > {j}, {x}, null)" for j, x in enumerate(below, 1)]
    rows = lines.withColumn("b", F.explode(F.expr(f"array({', '.join([_bucket('n'), *below])})"))).where("b is not null")
    return rows.withColumn("e", F.expr(allowed("b"))).where("e > 0 and b > e")


def _letter_counts(text: str = "line") -> str:
    return " | ".join(f"shiftleft(cast((octet_length({text}) - octet_length(replace({text}, '{c}', ''))) & 31 as bigint), {5 * i})" for i, c in enumerate(_LETTERS))


def _may_link(a: str, b: str, edits: int) -> str:
    """Each edit changes two letter counts by one at most."""
    parts = []
    for i in range(len(_LETTERS)):
        d = f"((shiftright({a}, {5 * i}) - shiftright({b}, {5 * i})) & 31)"
        parts.append(f"least({d}, 32 - {d})")
    return f"({' + '.join(parts)}) <= {2 * edits}"


def banded_distance(a: str, b: str, edits: int) -> Column:
    """Edit distance of two string columns, ``edits + 1`` if larger: bit vectors of the band around the diagonal.

    Common words at both ends are left out first, each with the blank behind it. Bit ``i`` of the vectors is row ``j - edits + i`` of column ``j``.
    """
    w = 2 * edits + 1
    mask, top = (1 << w) - 1, 1 << (w - 1)
    match = " | ".join(f"if(coalesce(get(p, j + {edits - (w - 1) + i}) = t[j], false), {1 << i}, 0)" for i in range(w))
    d0 = f"(((((m & st.vp) + st.vp) ^ st.vp) | m | st.vn) & {mask})"
    step = f"""transform(array({match}), m -> transform(array({d0}), d -> transform(array(struct(
        d as d, (st.vn | ~(d | st.vp)) & {mask} as hp, d & st.vp as hn)), x -> struct(
            (x.hn | ~(shiftright(x.d, 1) | x.hp)) & {mask} as vp, shiftright(x.d, 1) & x.hp as vn,
            st.dist + case when j < size(p) - {edits} then if((x.d & {top}) = 0, 1, 0)
                else if((x.hp & st.h) <> 0, 1, 0) - if((x.hn & st.h) <> 0, 1, 0) end as dist,
            if(j < size(p) - {edits}, st.h, shiftright(st.h, 1)) as h))[0])[0])[0]"""
    # Trimmed words are set apart again by a tail that both share, so that neither side is shorter than the band.
    tail = "array(" + ", ".join(["'\x01'"] * (edits + 1)) + ")"
    fold = f"""aggregate(sequence(0, size(t) - 1), struct({mask & (mask << edits)} as vp, 0 as vn, {edits} as dist, {top >> 1} as h),
        (st, j) -> if(st.dist > {3 * edits}, st, {step}), st -> least(st.dist, {edits + 1}))"""
    shared = """transform(array(struct(split({a}, ' ') as u, split({b}, ' ') as v)), x -> struct(x.u as u, x.v as v,
        coalesce(nullif(array_position(zip_with(x.u, x.v, (q, r) -> coalesce(q = r, false)), false), 0) - 1, size(x.u)) as head,
        coalesce(nullif(array_position(zip_with(reverse(x.u), reverse(x.v), (q, r) -> coalesce(q = r, false)), false), 0) - 1, size(x.u)) as foot))[0]""".format(a=a, b=b)
    middle = f"""transform(array({shared}), s -> transform(array(least(s.foot, least(size(s.u), size(s.v)) - s.head)), f -> struct(
        concat(filter(split(array_join(transform(slice(s.u, cast(s.head + 1 as int), cast(size(s.u) - s.head - f as int)), q -> concat(q, ' ')), ''), ''), c -> c <> ''), {tail}) as p,
        concat(filter(split(array_join(transform(slice(s.v, cast(s.head + 1 as int), cast(size(s.v) - s.head - f as int)), q -> concat(q, ' ')), ''), ''), c -> c <> ''), {tail}) as t))[0])[0]"""
    return F.expr(f"""if(abs(char_length({a}) - char_length({b})) > {edits}, {edits + 1},
        transform(array({middle}), y -> transform(array(y.p), p -> transform(array(y.t), t -> {fold})[0])[0])[0])""")


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """``doc_id, __row, line_no, line, n, line_id`` of each line with a visible character, outer whitespace gone."""
    rows = docs.select("doc_id", "__row", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "__row", "line_no", F.btrim("raw", F.lit(_SPACE_CHARS)).alias("line")).where(F.col("line") != "")
    return rows.withColumn("n", F.char_length("line")).withColumn("line_id", F.xxhash64("line"))


def _if_small(rows: DataFrame, max_broadcast: int) -> DataFrame:
    """A written table, broadcast if its rows are counted and few."""
    return F.broadcast(rows) if rows.count() <= max_broadcast else rows


def _texts(ids: DataFrame, lines: DataFrame, max_broadcast: int) -> DataFrame:
    """``line_id, line, n`` of the given ids, and how many ``copies`` there are."""
    wanted = _if_small(S.materialize(ids.distinct()), max_broadcast)  # else the lines are dealt out by id
    return lines.select("line_id", "line", "n").join(wanted, "line_id").groupBy("line_id").agg(F.min("line").alias("line"), F.min("n").alias("n"), F.count("*").alias("copies"))


def _keyed(rows: DataFrame, edits: int, keep: list[str]) -> DataFrame:
    """``keep`` columns and the keys of each row in a bucket, as columns ``k0, k1, ...``."""
    return rows.select(*keep, "line_id", "n", "b", "e", *[F.expr(c[2]).alias(f"k{i}") for i, c in enumerate(_keys(edits))])


def _opened(keyed: DataFrame, edits: int) -> DataFrame:
    """A row for each key: ``key``, ``at`` (its column) and the row's facts."""
    keys = [f"k{i}" for i in range(len(_keys(edits)))]
    return keyed.select(*[c for c in keyed.columns if c not in keys], F.posexplode(F.array(*keys)).alias("at", "key")).where("key is not null")


def _met(keyed: DataFrame, edits: int, max_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """``(pairs, rows of larger groups)`` of the rows that share a key.

    Groups are counted with a combining aggregate first: most keys have one line, and of two lines the smallest and the
    largest id are the pair. So only rows of larger groups are looked up again, with their key and its ``m`` rows.
    """
    rows = _opened(keyed, edits)
    groups = rows.groupBy("key").agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi"), F.count("*").alias("m"), F.min("at").alias("least"))
    groups = S.materialize(groups.where(f"lo < hi and least <= {edits}"))
    more = _if_small(groups.where("m > 2").select("key", "m"), max_broadcast)
    return groups.where("m = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")), S.materialize(rows.join(more, "key"))


def _pairs(rows: DataFrame, edits: int) -> DataFrame:
    """Pairs ``a, b`` of rows with one key whose lengths and letter counts allow a link; shifted segments don't meet each other.

    A key's rows are dealt out to blocks by hash, and each pair of blocks is compared by itself.
    """
    rows = rows.select("key", "line_id", "n", "counts", (F.col("at") <= edits).alias("indexed"), F.expr(f"cast((m + {_BLOCK - 1}) div {_BLOCK} as int)").alias("blocks"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(line_id), blocks) as int)"))
    side = lambda i, mine, other, several: rows.select(
        "key", F.col("own").alias(mine), F.explode(F.expr(several)).alias(other), F.col("line_id").alias(i), F.col("n").alias(f"{i}n"), F.col("counts").alias(f"{i}c"), F.col("indexed").alias(f"{i}i"))
    left, right = side("a", "x", "y", "sequence(own, blocks - 1)"), side("b", "y", "x", "sequence(0, own)")
    near = F.expr(f"((x < y and a <> b) or a < b) and abs(an - bn) <= {edits} and (ai or bi) and {_may_link('ac', 'bc', edits)}")
    return left.join(right.withColumnsRenamed({"key": "key2", "x": "x2", "y": "y2"}), (F.col("key") == F.col("key2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & near).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _shared_length(a: str, b: str) -> str:
    """SQL for the number of characters that two strings begin with alike: by halves, largest first."""
    powers = ", ".join(str(1 << i) for i in range(30, -1, -1))
    return f"""aggregate(array({powers}), 0, (p, k) -> if(k <= least(char_length({a}), char_length({b})) - p
        and substring({a}, p + 1, k) = substring({b}, p + 1, k), p + k, p))"""


def _variants() -> Column:
    """``star, ops, text`` of a line ``line`` with ``n`` characters that leaves the pivot after ``p`` and comes back ``s`` before its end.

    For two lines that leave the pivot at different places, the first place where they differ is the smaller ``p``, where the
    other one goes on like the pivot. So the first edit puts the pivot's character there, in place of the line's or before it, or
    takes the line's away; and the last edit likewise, from the end. Either line may take either edit, or one takes both;
    ``ops`` has a bit for each (1 first, 2 last). Lines that leave the pivot at one place with different characters may have
    these stand for each other: a star, which both must have. Two lines with at most two edits thus have equal
    variants with equal stars and different bits. Where their common beginning and end overlap, the longer one has one or
    two characters more in one place: ``ops`` 3.
    """
    head, tail = "substring(line, 1, p)", "substring(line, n - s + 1)"
    bp, be = "substring(pivot, p + 1, 1)", "substring(pivot, pn - s, 1)"
    begin = [("0", "0", "true", "0", "''"), ("0", "1", "p < n and p < pn", "1", bp), ("0", "1", "p < n", "1", "''"), ("0", "1", "p < pn", "0", bp), ("1", "0", "p < n", "1", "'\x01'")]
    end = [("0", "0", "true", "0", "''"), ("0", "2", "s < n and s < pn", "1", be), ("0", "2", "s < n", "1", "''"), ("0", "2", "s < pn", "0", be), ("2", "0", "s < n", "1", "'\x01'")]
    out = []
    for i, (star, ops, test, cut, put) in enumerate(begin):
        for j, (star2, ops2, test2, cut2, put2) in enumerate(end):
            if i and j:
                text = f"concat({head}, {put}, substring(line, p + 1 + {cut}, n - s - p - {cut} - {cut2}), {put2}, {tail})"
                test = f"{begin[i][2]} and {test2} and p + s + {cut} + {cut2} <= n"
            elif j:
                text, test = f"concat(substring(line, 1, n - s - {cut2}), {put2}, {tail})", test2
            else:
                text, test = f"concat({head}, {put}, substring(line, p + 1 + {cut}))", begin[i][2]
            out.append((f"{star} + {star2}", f"{ops} + {ops2}", test, text))
    out += [("0", "3", "p + 2 <= n", f"concat({head}, substring(line, p + 3))"), ("0", "3", "p >= 1 and p < n", "concat(substring(line, 1, p - 1), substring(line, p + 2))"),
            ("0", "3", "p + 2 <= pn", f"concat({head}, substring(pivot, p + 1, 2), substring(line, p + 1))")]
    made = ", ".join(f"if({test}, struct({ops} as ops, xxhash64(salt, {star}, {text}) as key, {star} as star), null)" for star, ops, test, text in out)
    return F.expr(f"array_distinct(filter(array({made}), v -> v is not null))")


def _apart(rows: DataFrame, max_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """``(pairs, rows)``: links between lines of a group that leave its pivot in different ways, and rows of the groups of those that leave it in one way.

    ``rows`` has ``salt`` (the group), ``line_id``, ``line``, ``n``, ``counts``, ``copies``. The pivot is the line with the most copies, as
    near copies leave the line they come from at many places; of several any one, by hash. What lines of a group have in
    common by then is cut off.
    """
    pivots = S.materialize(rows.groupBy("salt").agg(F.max_by("line", F.struct("copies", F.xxhash64("salt", "line_id"))).alias("pivot")).withColumn("pn", F.char_length("pivot")))
    few = pivots.agg(F.sum("pn")).first()[0] <= _PIVOT_CHARS
    placed = rows.join(F.broadcast(pivots) if few else pivots, "salt")
    placed = S.materialize(placed.withColumns({"p": F.expr(_shared_length("line", "pivot")), "s": F.expr(_shared_length("reverse(line)", "reverse(pivot)"))}))
    once = placed.select("line_id", "line", "n", "pivot", "pn", "p", "s", F.xxhash64("pivot").alias("salt")).dropDuplicates(["line_id", "line", "pivot"])  # groups by several keys may have one pivot
    made = S.materialize(once.select("line_id", F.explode(_variants()).alias("v")).select("line_id", "v.key", "v.ops", "v.star"))
    shared = S.materialize(made.groupBy("key").agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi")).where("lo < hi").select("key"))
    met = made.join(_if_small(shared, max_broadcast), "key")  # most variants are one line's alone
    # Which bits a variant meets: one that has taken no edit all others (and its like where there is a star), the first edit the last.
    low = met.select("line_id", "key", F.col("ops").alias("lo"), F.explode(F.expr("case when ops = 0 then if(star > 0, array(0, 1, 2), array(1, 2, 3)) when ops = 1 then array(2) end")).alias("hi"))
    high = met.select(F.col("line_id").alias("other"), F.col("key").alias("key2"), F.col("ops").alias("hi2"), F.explode(F.expr("if(ops = 2, array(0, 1), array(0))")).alias("lo2"))
    meet = (F.col("key") == F.col("key2")) & (F.col("lo") == F.col("lo2")) & (F.col("hi") == F.col("hi2")) & ((F.col("line_id") < F.col("other")) | ((F.col("hi") > 0) & (F.col("line_id") > F.col("other"))))
    pairs = S.materialize(low.join(high, meet).select(F.least("line_id", "other").alias("a"), F.greatest("line_id", "other").alias("b")).distinct())
    ways = """array(struct(xxhash64(salt, 1, p, substring(line, p + 1, 1)) as salt, substring(line, p + 2) as line),
        struct(xxhash64(salt, 2, s, if(s < n, substring(line, n - s, 1), '')) as salt, substring(line, 1, n - s - 1) as line))"""
    left = placed.where("line <> pivot").select(F.explode(F.expr(ways)).alias("w"), "line_id", "counts", "copies").select("w.salt", "line_id", "w.line", F.char_length("w.line").alias("n"), "counts", "copies")
    sizes = S.materialize(left.groupBy("salt").agg(F.count("*").alias("m")).where("m > 1"))
    left = S.materialize(left.join(_if_small(sizes, max_broadcast), "salt"))
    S.discard(placed, made, shared, pivots, sizes)
    return pairs, left


def _candidates(lines: DataFrame, edits: int, similarity: float, max_broadcast: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of pairs ``a, b`` of line ids that hold all links, and the texts of these lines with their letter counts."""
    many = len(_keys(edits))
    long = lines.select(F.lit(0).cast("long").alias("salt"), "line_id", "line", "n").where(f"{_allowed('n', edits, similarity)} > 0")
    keyed = _keyed(_in_buckets(long, edits, lambda x: _allowed(x, edits, similarity)), edits, [])
    # Copies of a line are counted as one from here on; numbers alone are shuffled.
    keyed = S.materialize(keyed.groupBy("line_id", "b").agg(F.max("n").alias("n"), F.max("e").alias("e"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(many)]))
    found, rows = _met(keyed, edits, max_broadcast)
    ids = found.select(F.explode(F.array("a", "b")).alias("line_id")).unionByName(rows.select("line_id"))
    texts = S.materialize(_texts(ids, lines, max_broadcast).withColumn("counts", F.expr(_letter_counts())))
    out, limit = [found], _GROUP
    rows = rows.join(texts.select("line_id", "counts"), "line_id")
    if edits > 2:  # two edits are the first and the last one; of more, those between may be anywhere
        return [*out, _pairs(rows, edits)], texts
    out.append(_pairs(rows.where(f"m <= {limit}"), edits))
    large = rows.where(f"m > {limit}").select(F.col("key").alias("salt"), "line_id", "counts").distinct()
    large = S.materialize(large.join(texts.select("line_id", "line", "n", "copies"), "line_id"))
    for turn in range(_TURNS):
        if large.isEmpty():
            break
        limit *= _GROWTH
        last = turn == _TURNS - 1  # what still meets is compared
        links, rows = _apart(large, max_broadcast)
        small = (rows if last else rows.where(f"m <= {limit}")).select(F.col("salt").alias("key"), "line_id", "n", "counts", "m", F.lit(0).alias("at"))
        out += [links, S.materialize(_pairs(small, edits).distinct())]
        large = S.materialize(rows.where(f"m > {limit}"))
        S.discard(rows)
    return out, texts


def line_links(lines: DataFrame, edits: int = 2, similarity: float = 0.8, max_broadcast: int = 2_000_000) -> DataFrame:
    """All links ``a, b`` (line ids, ``a < b``) between different lines of a table ``line_id, line, n``.

    Two lines link if they differ by ``edits`` edits at most and by ``1 - similarity`` of the shorter one's characters.
    """
    found, texts = _candidates(lines, edits, similarity, max_broadcast)
    pairs = S.materialize(reduce(DataFrame.unionByName, found).distinct())
    side = lambda id_, name: texts.select(F.col("line_id").alias(id_), F.col("line").alias(name), F.col("counts").alias(f"{name}c"), F.col("n").alias(f"{name}n"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(F.expr(_may_link("xc", "yc", edits)))
    return S.materialize(both.where(banded_distance("x", "y", edits) <= F.expr(_allowed("least(xn, yn)", edits, similarity))).select("a", "b"))


def line_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edits: int = 2, similarity: float = 0.8, max_broadcast: int = 2_000_000,
                 row_id: str | None = None) -> DataFrame:
    """A row for each line with a visible character: ``doc_id``, ``line_no``, ``line_id``, ``class_id``, ``n_links``, ``first_doc``, ``first_line``, ``kept``.

    ``line_id`` is a 64-bit hash of the line without outer whitespace, ``class_id`` the smallest ``line_id`` that is
    reachable by links (see ``line_links``; equal lines are one), ``n_links`` the number of different lines that link to it.
    ``first_doc`` and ``first_line`` tell the class's first line, by smallest id and place; ``kept`` is true for that
    one. Null and empty texts have no lines; a null id comes first; repeated rows are documents of their own, of which
    one is kept. A line of any length takes part, with as many edits as its length allows. ``row_id`` names a column of
    unique row numbers to keep as ``__row``.
    """
    number = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), number.alias("__row"))
    lines = S.materialize(_lines(source, "text"))
    links = line_links(lines, edits, similarity, max_broadcast)
    found = S.materialize(connected_components(links)).withColumnRenamed("node", "line_id")
    degree = links.select(F.explode(F.array("a", "b")).alias("line_id")).groupBy("line_id").agg(F.count("*").alias("n_links"))

    places = lines.select("doc_id", "__row", "line_no", "line_id")
    first = places.groupBy("line_id").agg(F.min(F.struct(F.col("doc_id"), F.col("__row"), F.col("line_no"))).alias("at"))
    first = first.join(found.join(degree, "line_id"), "line_id", "left").withColumns({"class_id": F.coalesce("root", "line_id"), "n_links": F.coalesce("n_links", F.lit(0).cast("long"))})
    heads = first.groupBy("class_id").agg(F.min("at").alias("head"))
    table = S.materialize(first.select("line_id", "class_id", "n_links").join(heads, "class_id"))
    out = places.join(table, "line_id")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("__row") == F.col("head.__row")) & (F.col("line_no") == F.col("head.line_no"))
    return out.select("doc_id", *(["__row"] if row_id else []), "line_no", "line_id", "class_id", "n_links", F.col("head.doc_id").alias("first_doc"), F.col("head.line_no").alias("first_line"), kept.alias("kept"))


def remove_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edits: int = 2, similarity: float = 0.8) -> DataFrame:
    """All rows and columns of ``docs``; of each class of near-duplicate lines only the first one stays in the texts.

    Lines are told apart as in ``line_classes``; blank ones stay, a null text stays null. Each text is put together
    within its row.
    """
    rows = S.materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    gone = line_classes(rows, text, doc_id, edits, similarity, row_id="__row").where("not kept")
    gone = gone.groupBy("__row").agg(F.collect_list("line_no").alias("__gone"))  # lines of one document
    parts = F.split(F.col(text), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    out = rows.join(gone, "__row", "left").withColumn(text, F.when(F.col("__gone").isNull() | F.col(text).isNull(), F.col(text)).otherwise(rest))
    return out.select(*docs.columns)
