"""The registered queries ``opN_*`` and their oracle SQL: thin views of the operators beside this module."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, html_text, language, licences, line_join, mixing, prefix_trie, quality, rules, sharding, simhash, warc_zip
from . import shared as S


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    placed = sharding.shard_documents(sharding.size_table(_table(spark, sf_dir, "documents")), shards=40, sized=True)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", S.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document."""
    return decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mixture of all sources, none of which is above a quarter of it."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "block", "place", "release", "deadline", "slot", "taken")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; its source is its host."""
    return rules.apply_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every line of every document."""
    return line_join.line_classes(_table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document, the licence it is, and the licences its lines name."""
    found = licences.scan(_table(spark, sf_dir, "documents"), licences.known_licences(spark))
    return found.select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the languages that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs, S.learnable(F.col("doc_id")))
    return language.identify(docs, model).select("doc_id", S.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of ZIP-packaged archives, written and read back by ranges."""
    made = warc_zip.write_packages(_table(spark, sf_dir, "pages"), f"{S.shared_dir(spark)}/{uuid.uuid4().hex}")
    return warc_zip.page_records(spark, made)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in the middle, and rebuilt from what came out."""
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each begun by turns of the first of its twenty."""
    turns = prefix_trie.turn_table(_table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("id").cast("string").cast("binary")) % 4
    return prefix_trie.trie(*prefix_trie.with_shared_heads(turns, F.col("id") - F.col("id") % 20, heads, 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kdtree": op1_kdtree,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_rules": op6_rules,
    "op7_lines": op7_lines,
    "op8_licences": op8_licences,
    "op9_html": op9_html,
    "op10_language": op10_language,
    "op11_warc": op11_warc,
    "op12_fill_middle": op12_fill_middle,
    "op13_trie": op13_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op8_licences": licences.oracle(),
    "op5_mixing": r"""
WITH RECURSIVE c AS (SELECT coalesce('s' || source, 'n') AS key, count(*)::DOUBLE AS n FROM documents GROUP BY source),
w0 AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) - 1 AS m, count(*) OVER () AS many FROM c),
w1 AS (SELECT *, sum(n) OVER (ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, greatest(0.25::DOUBLE, 1.0::DOUBLE / many) AS c FROM w0),
w2 AS (SELECT *, CASE WHEN 1.0::DOUBLE - c * m > 1e-9 THEN c * rest / (1.0::DOUBLE - c * m) END AS cap FROM w1),
a AS (SELECT m, coalesce(cap, n) AS cap, rest FROM w2 WHERE n <= cap OR m = many - 1 ORDER BY m LIMIT 1),
e AS (SELECT key, w2.n, many, greatest(4096 - many, 0) * least(w2.n, a.cap) / (a.rest + a.m * a.cap) AS exact FROM w2, a),
k0 AS (SELECT *, floor(exact) + 1 AS k, row_number() OVER (ORDER BY exact - floor(exact) DESC, key) AS r FROM e),
k AS (SELECT key, n::BIGINT AS n, (k + CASE WHEN r <= 4096 - sum(k) OVER () THEN 1 ELSE 0 END)::BIGINT AS k FROM k0),
s AS (SELECT list(key ORDER BY key) AS keys, list(k ORDER BY key) AS ks FROM k),
edf AS (
  SELECT -1::BIGINT AS t, list_transform(keys, lambda x: 0::BIGINT) AS nxt, 0::BIGINT AS pick FROM s
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, nxt, list_min(list_filter(list_transform(nxt, lambda x, i: CASE WHEN (x * 4096) // ks[i] <= t + 1
      THEN {'due': ((x + 1) * 4096 + ks[i] - 1) // ks[i], 'i': i::BIGINT} END), lambda y: y IS NOT NULL)).i AS p FROM edf, s WHERE t < 4095)),
turns AS (SELECT keys[pick] AS key, nxt[pick] - 1 AS turn, t AS place_of FROM edf, s WHERE t >= 0),
fin AS (SELECT min((((n + 15) // 16 + 1) * 4096 + k - 1) // k) AS fin FROM k),
d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
        row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM documents)
SELECT doc_id, source, rank // 16 AS block, CAST(rank % 16 AS INTEGER) AS place, ((rank // 16) * 4096) // k AS release,
  ((rank // 16 + 1) * 4096 + k - 1) // k AS deadline, ((rank // 16) // k) * 4096 + place_of AS slot, ((rank // 16) // k) * 4096 + place_of < fin AS taken
FROM d JOIN k USING (key) JOIN turns ON turns.key = d.key AND turns.turn = (rank // 16) % k CROSS JOIN fin
""",
    "op6_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM w, unnest(range(1, len(w) - 6)) AS u(i)),
dup AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, sum(least(8, i - before)) AS n FROM (SELECT r, i, lag(i, 1, -8) OVER (PARTITION BY r ORDER BY i) AS before FROM dup) GROUP BY r),
l AS (SELECT r, source, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT * FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lw GROUP BY r),
ln AS (SELECT r, source, trim(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
       ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM lw),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
freq AS (SELECT c.source, c.x FROM (SELECT source, x, count(DISTINCT r) AS n FROM ln GROUP BY source, x) c
         JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE c.n > 10 AND c.n > h.docs * 0.02),
lost AS (SELECT r, sum(length(ln.x)) AS n FROM ln JOIN freq ON ln.x = freq.x AND ln.source IS NOT DISTINCT FROM freq.source GROUP BY r),
total AS (SELECT r, sum(length(x)) AS n FROM ln GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(lost.n, 0) > coalesce(total.n, 0) * 0.5 AS depleted
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dl USING (r) LEFT JOIN lost USING (r) LEFT JOIN total USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT depleted AS kept FROM m
""",
    "op11_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS least FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN least IS DISTINCT FROM page_id AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least IS DISTINCT FROM page_id THEN least END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
""",
    "op12_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS k, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, k, len(k) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT doc_id, t, n, form, array_to_string(k[1:a], '') AS p, array_to_string(k[a + 1:b], '') AS m, array_to_string(k[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s
""",
    "op13_trie": r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
        {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS v FROM conversations WHERE conv_id IS NOT NULL),
poly AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n] || range(0, 8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS q),
ids AS (SELECT DISTINCT c FROM t),
h AS (SELECT c, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT)),
        lambda a, b: xor(q[xor(a % 256, b) + 1], a // 256)), 4294967295) % 4 AS h FROM ids, poly),
r AS (SELECT h.c, p, v FROM h JOIN t ON t.c = h.c - h.c % 20 AND p <= h UNION ALL SELECT h.c, p, v FROM h JOIN t ON t.c = h.c AND p > h),
s AS (SELECT ids.c, coalesce(list(v ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS s FROM ids LEFT JOIN r ON r.c = ids.c GROUP BY ids.c),
w AS (SELECT c, len(s) AS l, d, s[1:d] AS f, CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM s, unnest(range(0, len(s) + 1)) AS u(d)),
n AS (SELECT f, d, min(c) AS m, count(*) AS n, (count(*) - 1) * max(w) AS saved, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE l = d), '') AS e FROM w GROUP BY f, d),
k AS (SELECT f[1:d - 1] AS f, count(*) AS k FROM n WHERE d > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(k, 0) AS k, b.m AS parent FROM n LEFT JOIN k ON k.f = n.f LEFT JOIN n b ON b.f = n.f[1:n.d - 1] AND n.d > 0),
up AS (SELECT f[1:i] AS f, sum(saved) AS saved, count(*) FILTER (WHERE k = 0) AS leaves FROM a, unnest(range(0, d + 1)) AS u(i) GROUP BY 1)
SELECT m AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n AS BIGINT) AS n_convs, CAST(k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(up.saved AS BIGINT) AS saved_tokens, sha256(e) AS ends_sha256 FROM a JOIN up ON up.f = a.f
""",
}
