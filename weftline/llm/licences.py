"""Licence scans by canonical digest lookup (op8).

A text is brought into a canonical form - case, copyright lines, equivalent spellings, punctuation - and its
SHA-256 is hash-joined to the digests of known licences, treated alike. All lines are looked up the same way, as entire
texts of their own, so that a notice below an article is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S
from .licence_texts import NOTICES, TEXTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only names the holder, the year or that rights are reserved.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(?:(?:copyright|\(c\)|©)[^\p{L}\p{N}\n]*(?:\(c\)|©|[0-9]{4}|<year>|\[year\]|by )[^\n]*|(?:\(c\)|©)[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
# Spellings that licence matching treats as equivalent.
EQUIVALENT = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("merchantibility", "merchantability"), ("modelled", "modeled"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("owner", "holder"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("https://", "http://"), ("&", " and "),
]


#: Lengths of known texts up to which lines are filtered by them.
_SIZES = 1000


def canonical_lines(text: Column) -> Column:
    """The text's lines, each in canonical form: lower case A-Z, one spelling, words parted by one blank and nothing else.

    Copyright lines are empty. Nothing of the canonical form reaches beyond a line.
    """
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    # Only texts that have such a line need the search for it.
    marked = t.contains("copyright") | t.contains("(c)") | t.contains("©") | t.contains("all rights reserved")
    t = F.when(marked, F.regexp_replace(t, "(?dm)" + COPYRIGHT_LINE, "")).otherwise(t)
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.split(F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " "), "\n")


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" "))), lambda x: x != ""), " ")


def canonical(text: Column) -> Column:
    """The canonical form of the whole text: that of its lines, joined by blanks."""
    return _joined(canonical_lines(text))


def known_licences(spark: SparkSession) -> DataFrame:
    """``licence, text`` of the texts and notices that the library knows."""
    rows = [*TEXTS.items(), *((k, x) for k, many in NOTICES.items() for x in many)]
    return spark.createDataFrame(rows, "licence string, text string")


def scan(docs: DataFrame, known: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_broadcast: int = 100_000) -> DataFrame:
    """``keep`` columns with ``digest``, ``licence`` of the entire text (null: not known) and ``notices``, a row for each row.

    ``notices`` lists the licences named by lines of the text, sorted, without repeats. Two licences with one
    canonical form count as the first by name. A text without a letter or digit (empty or null, too) has the
    digest of nothing and no licence. Known digests are broadcast if at most ``max_broadcast``; else
    Spark deals them out.
    """
    table = known.select("licence", canonical(F.col("text")).alias("c")).where(F.col("c") != "")
    table = S.materialize(table.groupBy(F.sha2("c", 256).alias("digest"), F.char_length("c").alias("n")).agg(F.min("licence").alias("licence")))
    many, sizes = table.count(), [r["n"] for r in table.select("n").distinct().limit(_SIZES + 1).collect()]
    table = F.broadcast(table.drop("n")) if many <= max_broadcast else table.drop("n")
    rows = docs.select(*[c for c in keep if c not in ("digest", "licence", "notices")], F.col(text).cast("string").alias("__text")).withColumn("__canonical", canonical_lines(F.col("__text")))
    lines = F.transform("__canonical", lambda x: F.btrim(x, F.lit(" ")))
    # A line can be a known text only if it is as long as one.
    lines = F.filter(lines, lambda x: F.char_length(x).isin(sizes) if len(sizes) <= _SIZES else x != "")
    rows = rows.withColumns({"digest": F.sha2(_joined(F.col("__canonical")), 256), "__lines": F.array_distinct(F.transform(lines, lambda x: F.sha2(x, 256)))})
    rows = S.materialize(rows.drop("__text", "__canonical").withColumn("__row", F.monotonically_increasing_id()))
    named = (rows.select("__row", F.explode("__lines").alias("digest")).join(table, "digest").groupBy("__row").agg(F.sort_array(F.collect_set("licence")).alias("notices")))
    out = rows.join(table, "digest", "left").join(named, "__row", "left")
    kept = [c for c in rows.columns if c not in ("digest", "__lines", "__row")]
    return out.select(*kept, "digest", "licence", F.coalesce("notices", F.expr("cast(array() as array<string>)")).alias("notices"))


def oracle() -> str:
    """The same scan in DuckDB's SQL."""
    def canon(x: str) -> str:
        x = f"regexp_replace(translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}'), '(?m){COPYRIGHT_LINE}', '', 'g')"
        for a, b in EQUIVALENT:
            x = f"replace({x}, '{a}', '{b}')"
        return f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(x)})" for k, x in [*TEXTS.items(), *((k, x) for k, many in NOTICES.items() for x in many)])
    return f"""
WITH known AS (SELECT sha256(c) AS digest, min(licence) AS licence FROM (SELECT licence, {canon('text')} AS c FROM (VALUES {values}) AS v(licence, text)) WHERE c <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({canon('text')}) AS digest FROM documents),
l AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
n AS (SELECT r, list_sort(list(DISTINCT k.licence)) AS notices FROM l JOIN known k ON k.digest = sha256({canon('line')})
      GROUP BY r)
SELECT doc_id, d.digest, k.licence, array_to_string(coalesce(n.notices, []), ',') AS notices
FROM d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN n ON n.r = d.r
"""
