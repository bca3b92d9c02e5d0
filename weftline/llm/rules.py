"""Quality rules with cross-document line frequency (op6), with DataFrame operations alone.

Each text is measured within its row. Lines are normalised and hashed, distinct documents per host are
counted for each line, lines above the limits are removed, and documents that lose too much are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

_SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bare(text: Column) -> Column:
    return F.translate(text, _SPACE_CHARS, "")


def measures(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``; a null text has none.

    All of it happens within the row: window hashes are compared as a set first, and only texts with an equal
    pair have them sorted to find how many words the repeated windows cover.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("__w", F.filter(F.split(t, _SPACES), lambda x: x != ""))
    rows = rows.withColumn("__n", F.size("__w"))
    rows = rows.withColumn("__h", F.expr(f"if(__n >= {window}, transform(sequence(1, __n - {window - 1}), i -> xxhash64(slice(__w, i, {window}))), cast(array() as array<bigint>))"))
    rows = rows.withColumn("__s", F.expr("if(size(array_distinct(__h)) = size(__h), cast(array() as array<struct<h: bigint, i: int>>), array_sort(transform(__h, (h, i) -> struct(h, i))))"))
    rows = rows.withColumn("__at", F.expr("""array_sort(transform(filter(transform(__s, (x, k) -> k),
        k -> (k > 0 and __s[k].h = __s[greatest(k - 1, 0)].h) or (k + 1 < size(__s) and __s[k].h = __s[least(k + 1, size(__s) - 1)].h)), k -> __s[k].i))"""))
    rows = rows.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: _bare(x) != ""))
    return rows.withColumns({
        "n_words": F.col("__n").cast("long"), "word_chars": F.char_length(_bare(t)).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.expr(f"""aggregate(__at, struct(-{window} as last, 0L as n),
            (a, x) -> struct(x as last, a.n + least({window}, x - a.last) as n), a -> a.n)"""),
    }).drop("__w", "__n", "__h", "__s", "__at", "__lines")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Too short, or too much of it is repetition."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _normal(text: Column) -> Column:
    return F.translate(text, _UPPER + "123456789", _LOWER + "000000000")


def line_list(text: Column, host: Column) -> Column:
    """``(h, c)`` of each line with a word: a hash of its host and normalised form, and its code points.

    Normalised: A-Z lower-cased, digits alike, outer whitespace gone.
    """
    t = _normal(F.coalesce(text, F.lit("")))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_SPACE_CHARS))), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(host, x).alias("h"), F.char_length(x).alias("c")))


def frequent_lines(rows: DataFrame, min_docs: int, min_share: float, enough: int | None = None) -> DataFrame:
    """``h`` of the lines in more than ``min_docs`` documents and more than ``min_share`` of the documents of their host.

    More than ``enough`` documents suffice, however large the host is.
    """
    seen = rows.select("host", F.explode(F.expr("array_distinct(transform(lines, x -> x.h))")).alias("h"))
    counts = seen.groupBy("h").agg(F.count("*").alias("n"), F.min("host").alias("host")).where(F.col("n") > min_docs)
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    often = F.col("n") > F.col("docs") * min_share
    often = often if enough is None else often | (F.col("n") > enough)
    return counts.join(hosts, counts.host.eqNullSafe(hosts.host)).where(often).select("h")


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",),
                min_docs: int = 10, min_share: float = 0.02, max_removed: float = 0.5, enough: int | None = None) -> DataFrame:
    """``keep`` columns, the measures, ``base_failed``, ``removed_chars``, ``line_chars`` and ``kept``; a row for each row.

    A line counts once for each document (row) that has it. ``kept`` is false for a document that fails the base
    rules or loses more than ``max_removed`` of its lines' characters to frequent lines. A null or empty text has
    no words and fails; a null host is a host of its own; an empty table stays empty.
    """
    rows = measures(docs.select(*keep, F.col(host).cast("string").alias("host"), F.col(text).alias("__text")), "__text")
    rows = S.materialize(rows.withColumn("lines", line_list(F.col("__text"), F.col("host"))).drop("__text").withColumn("__row", F.monotonically_increasing_id()))
    common = S.materialize(frequent_lines(rows, min_docs, min_share, enough))
    each = rows.select("__row", F.explode("lines").alias("l")).select("__row", F.col("l.h").alias("h"), F.col("l.c").alias("c"))
    lost = each.join(common, "h").groupBy("__row").agg(F.sum("c").alias("removed_chars"))
    out = rows.join(lost, "__row", "left").withColumns({
        "removed_chars": F.coalesce("removed_chars", F.lit(0)),
        "line_chars": F.expr("aggregate(lines, 0L, (a, x) -> a + x.c)"),
        "base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words"))})
    depleted = F.col("removed_chars") > F.col("line_chars") * max_removed
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("__row", "host", "lines")


def remove_frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = 10, min_share: float = 0.02,
                          enough: int | None = 1000) -> DataFrame:
    """All rows and columns of ``docs``, their texts without the frequent lines; null texts stay null.

    Lines are told apart as in ``apply_rules``, blank ones stay. Only line hashes are shuffled for the search; each
    text is put together within its row.
    """
    rows = S.materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    name = F.col(host).cast("string")
    lines = rows.select("__row", name.alias("host"), line_list(F.col(text), name).alias("lines"))
    common = S.materialize(frequent_lines(lines, min_docs, min_share, enough))
    each = lines.select("__row", F.explode(F.expr("array_distinct(transform(lines, x -> x.h))")).alias("h"))
    gone = each.join(common, "h").groupBy("__row").agg(F.collect_set("h").alias("__gone"))
    known = lambda x: F.array_contains(F.col("__gone"), F.xxhash64(name, F.btrim(_normal(x), F.lit(_SPACE_CHARS))))
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~known(x)), "\n")
    out = rows.join(gone, "__row", "left").withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left))
    return out.select(*docs.columns)
