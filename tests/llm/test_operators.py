"""Each operator against brute force on small fixtures, and on awkward tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import components, decontaminate, language, licences, line_join, mixing, queries, quality, rules, sharding, simhash
from weftline.llm.html_text import page_text

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, shard string, size string, `key` string, h string, a string"
LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="module")
def awkward(spark):
    """Null columns, empty, blank and very long texts, repeated rows, one id with two texts, columns with clashing names."""
    rows = [(1, "Some plain text here, of nine or so words.", "en", "s1"), (1, "Some plain text here, of nine or so words.", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"),
            (4, " \n\t", "en", None), (5, LONG, "en", "s2"), (5, "another text of the same id", "en", "s2"), (None, "no id", None, "s2"), (7, LONG, "de", "s2"), (8, "1234 !!", "de", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.select(", ".join(columns)).fetchall()))


def _median_shards(rows, shards, dims):
    """Brute force: the nodes of ``(node, k, rows)`` split one by one at the weighted quantile of the widest dimension."""
    done, todo = {}, [(0, shards, rows)]
    while todo:
        node, k, part = todo.pop()
        if k == 1:
            done |= {r["__row"]: node for r in part}
            continue
        at = max(range(dims), key=lambda i: (max(r[f"p{i}"] for r in part) - min(r[f"p{i}"] for r in part), -i))
        part = sorted(part, key=lambda r: (r[f"p{at}"], r["tie"]))
        goal, sums = sum(r["size"] for r in part) * (k // 2) / k, np.cumsum([0] + [r["size"] for r in part])
        cut = int(np.argmin(np.abs(sums - goal)))
        todo += [(node, k // 2, part[:cut]), (node + k // 2, k - k // 2, part[cut:])]
    return done


def test_sharding_against_sorted_medians(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_TOLERANCE", 0.0)
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, f"text {i}", rng.choice(["en", "de", None]), f"https://host{rng.randrange(9)}", rng.randrange(10, 90)) for i in range(400)], "doc_id long, text string, lang string, source string, size long")
    rows = sharding.S.materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    dims = [sharding.hashed_place(F.col("lang")), sharding.hashed_place(F.col("source")), sharding.number_place(docs, F.col("doc_id"))]
    keyed = [r.asDict() for r in sharding._keyed(rows, dims, F.col("size"), F.col("text"), F.col("doc_id")).collect()]
    assert len({r["p1"] for r in keyed}) == 9
    want = _median_shards(keyed, 7, 3)
    ids = {r["__row"]: r["doc_id"] for r in rows.collect()}
    got = {r.doc_id: r.shard for r in sharding.kd_shards(docs, dims, F.col("size"), F.col("text"), F.col("doc_id"), 7).collect()}
    assert got == {ids[k]: v for k, v in want.items()}


def test_sharding(spark, duck, awkward, empty):
    docs = duck.sql("select * from documents").df()
    sized = sharding.size_table(spark.createDataFrame(docs))
    got = sharding.shard_documents(sized, shards=5, sized=True).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and (got["size"] == got.text.map(lambda t: len(t.encode()) + 16)).all() and (got.text_crc32 == got.text.map(lambda t: zlib.crc32(t.encode()))).all()
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 5 and per.max() - per.min() <= 2 * got["size"].max()
    assert (got.groupby("text").shard.nunique() == 1).all()  # each group is small here
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    out = sharding.shard_documents(awkward, target_bytes=100_000).collect()
    assert len(out) == 10 and {r.shard for r in out} <= {0, 1, 2, 3} and out[0].size == "x"  # two texts fill more than a shard each
    assert sharding.shard_documents(empty, shards=3).count() == 0


def test_quality(spark, duck, awkward, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).toPandas().merge(duck.sql("select * from labels").df(), on="doc_id")
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.9 and got.score.between(0, 1).all()
    assert quality.score(awkward, model).count() == 10 and quality.score(empty, model).count() == 0
    constant = quality.fit(empty, labels)
    assert {r.score for r in quality.score(awkward, constant).collect()} == {0.5}


def test_quality_forward_and_gradient():
    rng = np.random.default_rng(2)
    sizes, d = [3, 1, 5], 7
    bag, y, weight = np.repeat(np.arange(3), sizes), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.5])
    x = rng.normal(size=(9, d))
    par = {"w": rng.normal(size=(d, 4)), "b": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array(0.3)}
    model = lambda p: quality.QualityModel(np.zeros(d), np.ones(d), **p)

    def plain(p):
        out = []
        for k in range(3):
            h = [np.tanh(row @ p["w"] + p["b"]) for row in x[bag == k]]
            e = np.exp([p["a"] @ (np.tanh(v @ p["v"]) / (1 + np.exp(-(v @ p["u"])))) for v in h])
            out.append(1 / (1 + np.exp(-(sum(v * q for v, q in zip(h, e / e.sum())) @ p["c"] + p["d"]))))
        return np.array(out)

    loss = lambda p: float((weight * -np.log(np.where(y > 0, plain(p), 1 - plain(p)))).sum() / weight.sum())
    assert np.allclose(model(par).scores([(bag[:4], x[:4]), (bag[4:], x[4:])], 3), plain(par))
    got = quality.gradient(model(par), x, bag, y, weight, decay=0)
    for name, value in par.items():
        for at in np.ndindex(value.shape):
            step = np.zeros_like(value)
            step[at] = 1e-6
            assert abs((loss(par | {name: value + step}) - loss(par | {name: value - step})) / 2e-6 - got[name][at]) < 1e-6


def test_quality_encodes_whole_texts_in_pieces(monkeypatch):
    texts = pa.array(["word " * 500 + "end", None, "short text", "x" * 3000])
    whole = list(quality.encode(texts))
    monkeypatch.setattr(quality.S.text_pieces, "__defaults__", (200,))
    parts = list(quality.encode(texts))
    count = lambda blocks: sum(np.expm1(x[:, -2] * 4).sum() for _, x in blocks)
    assert {int(r) for b in parts for r in b[0]} == {0, 1, 2, 3} and abs(count(whole) - 504) < 0.01 and count(parts) >= 503.9


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    from weftline.llm import shared as S

    got = quality.score(docs, model).where(S.held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.7) == (got.quality == 1)).mean() > 0.95


def _within(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.34:
            words[at] = rng.choice(vocabulary)
        elif kind < 0.67:
            words.insert(at, rng.choice(vocabulary))
        else:
            del words[at]
    return words


def test_decontamination_recall_and_exactness(duck):
    rng = random.Random(5)
    items = [t for (t,) in duck.sql("select text from benchmark order by item_id").fetchall()]
    model = decontaminate.prepare(items)
    vocabulary = [w for t in items for w in t.split()]
    texts, want = [], []
    for k in range(300):
        i = k % len(items)
        words = items[i].split()
        passage = _within(rng, words, rng.randrange(0, int(0.2 * len(words)) + 1), vocabulary)
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(80)) + passage + rng.choices(vocabulary, k=30)))
        want.append(i)
    found = decontaminate.matches(model, pa.array(texts))
    pairs = {(r, i) for r, i, *_ in found}
    assert np.mean([(k, i) in pairs for k, i in enumerate(want)]) >= 0.9
    words = {a + r: w[first[r]:first[r + 1] - 1] for a, b, w, first in decontaminate._words(pa.array(texts)) for r in range(b - a)}
    for row, item, d, first, n in found:  # exact: each told stretch has the told distance, and none is closer
        best = decontaminate.best_match(model.words[item], words[row])[0]
        assert best <= d <= 0.2 * len(model.words[item]) and decontaminate.best_match(model.words[item], words[row][first:first + n])[0] == d


def _edit_distance_within(item, words):
    """Smallest edit distance of the item to any stretch of ``words``, by the plain recurrence."""
    last = [0] * (len(words) + 1)
    for i, w in enumerate(item):
        now = [i + 1]
        for j, x in enumerate(words):
            now.append(min(last[j] + (w != x), last[j + 1] + 1, now[-1] + 1))
        last = now
    return min(last)


def test_decontamination_against_all_windows():
    rng = random.Random(15)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [rng.choices(vocabulary, k=rng.choice((1, 3, 6, 12, 25, 40, 70))) for _ in range(25)]
    texts = []
    for k in range(60):
        item = items[k % len(items)]
        texts.append(rng.choices(vocabulary, k=rng.randrange(20)) + _within(rng, item, rng.randrange(0, len(item) // 8 + 1), vocabulary) + rng.choices(vocabulary, k=rng.randrange(20)))
    found = {(r, i): d for r, i, d, *_ in decontaminate.matches(decontaminate.prepare([" ".join(x) for x in items]), pa.array([" ".join(x) for x in texts]))}
    want = {(r, i): d for r, t in enumerate(texts) for i, x in enumerate(items) if (d := _edit_distance_within(x, t)) <= int(0.2 * len(x) + 1e-9)}
    assert set(found) <= set(want) and all(want[k] <= d for k, d in found.items()) and len(found) >= 0.97 * len(want)
    assert [hit[:3] for hit in decontaminate.matches(decontaminate.prepare(["größe über alles hier"]), pa.array(["“Größe—über…alles” ×hier"]))] == [(0, 0, 0)]


def test_decontamination_edges(spark, awkward, empty, duck):
    bench = spark.createDataFrame([(1, "plain text here"), (2, None), (3, ""), (4, "!!"), (None, "plain TEXT here"), (5, "end")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.find_passages(awkward, bench).collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 1, 0), (1, None, 0), (1, None, 0), (5, 5, 0), (7, 5, 0)], key=str)
    assert decontaminate.remove_contaminated(awkward, bench).count() == 6
    assert decontaminate.find_passages(empty, bench).count() == 0 and decontaminate.find_passages(awkward, bench.limit(0)).count() == 0
    exact = {(d, i) for d, t in duck.sql("select doc_id, text from documents").fetchall() for i, b in duck.sql("select item_id, text from benchmark").fetchall() if b in t}
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_passages(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"), block_bytes=4000).collect()}
    assert exact <= found


def test_decontamination_without_the_first_words():
    rng = random.Random(9)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(400)]
    texts = [f"other words {k} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(20)) if k % 2 == 0 else " ".join(items[k].split()[8:]) for k in range(400)]
    found = {(r, i): (d, first, n) for r, i, d, first, n in decontaminate.matches(decontaminate.prepare(items), pa.array(texts))}
    assert found == {(k, k): (8, 0, 32) for k in range(1, 400, 2)}


def _fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, duck, awkward, empty):
    docs = duck.sql("select doc_id, text from documents").df()
    got = queries.op4_simhash(spark, SF).toPandas().set_index("doc_id")
    prints = np.array([_fingerprint(t) for t in docs.text], dtype=np.uint64)
    assert [f"{p:016x}" for p in prints] == list(got.fingerprint[docs.doc_id])
    near, label = np.bitwise_count(prints[:, None] ^ prints) <= 3, docs.doc_id.to_numpy()
    while not np.array_equal(label, new := np.array([label[n].min() for n in near])):
        label = new
    assert list(label) == list(got.component_id[docs.doc_id])
    out = simhash.near_duplicates(awkward).collect()
    assert len(out) == 10 and len({r.component_id for r in out if r.doc_id in (2, 3, 4)}) == 1
    kept = simhash.keep_one(awkward).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in kept) == [(False, 1, 42), (False, 2, 0), (False, 5, 27), (False, 5, len(LONG)), (False, 8, 7), (True, 0, 5)]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_bk_forest_links_random_points():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    points = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)]]))
    forest = simhash.BkForest(np.zeros(len(points), np.int64), points)
    a, b = forest.spanning_links(3)
    label = np.arange(len(points))
    near = np.bitwise_count(forest.value[:, None] ^ forest.value) <= 3
    assert near[a, b].all()
    links = np.eye(len(points), dtype=bool)
    links[a, b] = links[b, a] = True
    def classes(matrix):
        out = label
        while not np.array_equal(out, new := np.array([out[m].min() for m in matrix])):
            out = new
        return out
    assert np.array_equal(classes(near), classes(links))


@pytest.mark.parametrize("shard, blocks", [(64, (4, 1)), (1, (5, 2))])
def test_block_keys_of_any_number_link_the_same(spark, monkeypatch, shard, blocks):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30_000 // shard if shard == 1 else 300).astype(np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64) for _ in range(4)]
    points = np.unique(np.concatenate([base, base ^ flips[0] ^ flips[1] ^ flips[2], base ^ flips[3]])).view(np.int64)
    monkeypatch.setattr(simhash, "_SHARD", shard)
    assert simhash._blocks(len(points), 3, 64) == blocks and simhash._blocks(1 << 60, 3, 64)[1] > 3
    prints = spark.createDataFrame(pd.DataFrame({"fp": points}))
    got = components.connected_components(simhash.link_fingerprints(prints)).groupBy("root").count().toPandas()["count"]
    want = pd.Series(np.unique(base)).size
    assert len(got) == want and got.sum() == len(points)  # random points link to their own variants alone


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (9, 9), (None, 4)], "a long, b long")
    assert sorted(map(tuple, components.connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (9, 9)]


def test_mixing(spark, awkward, empty):
    sizes = {"big": 70, "mid": 20, "low": 6, "one": 1}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    got = mixing.mix(docs, block_rows=2, ceiling=0.5, parts=64).toPandas()
    weights = {r.key[1:]: r.k for r in mixing.capped_weights(docs.groupBy(mixing.source_key(F.col("source")).alias("key")).agg(F.count("*").alias("n")), 0.5, 64).collect()}
    assert sum(weights.values()) == 64 and weights["big"] <= 32
    turn, slots = dict.fromkeys(weights, 0), {}
    for t in range(400):  # earliest deadline first over released blocks, slot by slot
        s = min((s for s in weights if turn[s] * 64 // weights[s] <= t), key=lambda s: (-(-(turn[s] + 1) * 64 // weights[s]), "s" + s))
        slots[s, turn[s]] = t
        turn[s] += 1
        assert all(abs(weights[s] * (t + 1) / 64 - turn[s]) < 1 for s in weights)
    for s, group in got.groupby("source"):
        order = sorted(group.doc_id, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        place = {i: divmod(r, 2) for r, i in enumerate(order)}
        assert all((r.block, r.place) == place[r.doc_id] and r.slot == slots[s, r.block] and r.release <= r.slot < r.deadline for r in group.itertuples())
    end = min(-(-(-(-n // 2) + 1) * 64 // weights[s]) for s, n in sizes.items())
    assert (got.taken == (got.slot < end)).all()
    assert mixing.mix(awkward).count() == 10 and mixing.mix(empty).count() == 0


def _documents(spark, many, source):
    return spark.range(many).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", f"{source} AS source", "1L AS n_chars")


@pytest.mark.parametrize("many, source, kept", [
    (200_001, "if(id = 200000, null, concat('s', id % 5))", 200_001),  # a single row without a source
    (200_000, "concat('s', id % 5000)", 200_000),  # more sources than parts
    (302, "if(id >= 300, 'rare', concat('s', id % 3))", 302),  # too few sources for the ceiling
    (50_006, "if(id < 40000, 'hot', if(id < 50000, concat('s', id % 10), 'rare'))", 10_006 + 3_335),
])
def test_mixture_is_not_ended_by_rare_sources(spark, many, source, kept):
    import corpus_pipeline

    docs = _documents(spark, many, source)
    got = corpus_pipeline.mixed(spark, docs, SF).groupBy("source").count().toPandas()
    assert got["count"].sum() == kept
    full = docs.groupBy("source").count().toPandas()  # all but the largest source are whole
    assert sorted(got["count"])[:-1] == sorted(full["count"])[:-1] and (kept == many or got["count"].max() * 4 <= kept)


def test_shares_of_a_mixture(spark, awkward, empty):
    docs = _documents(spark, 2003, "if(id < 1500, 'hot', if(id < 2000, concat('s', id % 7), 'rare'))")
    got = mixing.mix_shares(docs).toPandas()
    assert len(got) == 2003 and got.doc_id.is_unique and (got[got.source != "hot"].taken).all() and got.taken.sum() == 503 + 503 // 3
    taken = got[got.taken]
    assert ((taken.release <= taken.slot) & (taken.slot < taken.deadline)).all() and taken.deadline.max() == len(taken)
    for _, rows in taken.groupby("source"):
        assert sorted(16 * rows.block + rows.place) == list(range(len(rows)))
        assert all(abs((rows.slot < t).sum() - t * len(rows) / len(taken)) <= 16 for t in range(len(taken) + 1))
    assert mixing.mix_shares(awkward).count() == 10 and mixing.mix_shares(empty).count() == 0


def test_rules(spark, awkward, empty):
    out = {(r.doc_id, r.n_words): r for r in rules.apply_rules(awkward).collect()}
    long = out[5, 30001]
    assert long.n_repeat_words == 30000 and long.base_failed and not long.kept and out[2, 0].base_failed
    assert rules.apply_rules(empty).count() == 0
    shared = "the same fifteen or more words stand in each and every one of these documents here\n"
    docs = [(i, (shared if i < 15 else "") + " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + k % 26) * (1 + k // 26) for k in range(60 if i % 2 else 10)), "host") for i in range(40)]
    got = {r.doc_id: r.kept for r in rules.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {i: (i < 15 and i % 2 == 1) or (i >= 15 and i % 2 == 1) for i in range(40)}


def test_frequent_lines_are_removed(spark, awkward, empty):
    def text(i, common):
        return "\n".join([f"own line {chr(97 + i % 26) * (1 + i // 26)}", *common, "", "the end " + chr(97 + i % 26) * (2 + i // 26)])

    docs = [(i, text(i, ["  Posted in 20%02d " % (i % 90)] if i < 30 else []), "hot") for i in range(2000)] + [(2000, "posted in 2001", None), (2001, None, "hot")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in rules.remove_frequent_lines(docs, enough=20).collect()}  # 1.5 % of its host
    assert got == {i: text(i, []) for i in range(2000)} | {2000: "posted in 2001", 2001: None}
    assert {r.removed_chars for r in rules.apply_rules(docs, enough=20).where("doc_id < 30").collect()} == {14}
    assert sorted(map(str, rules.remove_frequent_lines(awkward).collect())) == sorted(map(str, awkward.collect())) and rules.remove_frequent_lines(empty).count() == 0


def _distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(last[j] + (x != y), last[j + 1] + 1, now[-1] + 1))
        last = now
    return last[-1]


def _typo(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(text) + 1), rng.random()
        if kind < 0.34 and at < len(text):
            text[at] = rng.choice("abé ")
        elif kind < 0.67 or at == len(text):
            text.insert(at, rng.choice("abé "))
        else:
            del text[at]
    return "".join(text)


def test_banded_distance(spark):
    rng = random.Random(3)
    rows = [(a := "".join(rng.choice("aabbcdé  ") for _ in range(rng.randrange(40))), _typo(rng, a, rng.randrange(5))) for _ in range(400)]
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", line_join.banded_distance("x", "y", 2).alias("d")).collect()
    assert all(r.d == min(_distance(r.x, r.y), 3) for r in got)


def test_lines(spark, awkward, empty):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(8, 60))) for _ in range(20)]
    docs = [(i, "\n".join(_typo(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randrange(7)))) for i in range(50)] + [(50, base[0]), (50, base[0])]
    out = line_join.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    places = {}
    for i, t in docs:
        for k, x in enumerate(t.split("\n")):
            if x := x.strip(" \t\x0b\x0c\r"):
                places.setdefault(x, []).append((i, k))
    lines = sorted(places)
    top = {x: x for x in lines}
    def root(x):
        while top[x] != x:
            x = top[x]
        return x
    links = dict.fromkeys(lines, 0)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            edits = min(2, min(len(a), len(b)) // 5)
            if edits and abs(len(a) - len(b)) <= edits and _distance(a, b) <= edits:
                top[root(a)] = root(b)
                links[a], links[b] = links[a] + 1, links[b] + 1
    want, got = {}, {}
    for x in lines:
        want.setdefault(root(x), []).extend(places[x])
    for r in out:
        got.setdefault(r.class_id, []).append((r.doc_id, r.line_no))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and sum(r.kept for r in out) == len(want)
    assert {(r.doc_id, r.line_no): r.n_links for r in out if r.doc_id < 50} == {at: links[x] for x in lines for at in places[x] if at[0] < 50}
    assert line_join.line_classes(awkward).count() == 7 and line_join.line_classes(empty).count() == 0
    kept = {r.doc_id: r.text for r in line_join.remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    stay = {(r.doc_id, r.line_no) for r in out if r.kept}
    assert {i: [x for x in t.split("\n") if x.strip()] for i, t in kept.items() if i < 50} == {i: [x for k, x in enumerate(t.split("\n")) if (i, k) in stay] for i, t in docs if i < 50}
    assert sorted(map(str, line_join.remove_repeated_lines(empty).collect())) == []


def test_many_lines_under_one_key(spark, monkeypatch):
    """Groups above the limit are taken apart, with the same links: a shared opening, and numbers in one frame."""
    for name, value in (("_GROUP", 8), ("_GROWTH", 2), ("_BLOCK", 5)):
        monkeypatch.setattr(line_join, name, value)
    rng = random.Random(6)
    lines = {"an opening that all of these lines share: " + "".join(rng.choice("abcdefgh ") for _ in range(20)) + "." for _ in range(60)}
    lines |= {_typo(rng, x, 2).strip() for x in list(lines)[:20]} | {f"line number {k:03d} of the table" for k in range(0, 900, 23)} | {str(k) for k in range(12345, 12400)}
    lines = sorted(lines)
    rows = line_join._lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").withColumn("__row", F.col("doc_id")), "text").cache()
    names = {r.line_id: r.line for r in rows.collect()}
    got = sorted(tuple(sorted((names[r.a], names[r.b]))) for r in line_join.line_links(rows).collect())
    want = [(a, b) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= 2 and _distance(a, b) <= min(2, min(len(a), len(b)) // 5)]
    assert got == sorted(want)


def test_licences(spark, awkward, empty):
    from weftline.llm.licence_texts import TEXTS

    known = licences.known_licences(spark)
    mit = "Copyright (c) 1999 Somebody\n" + TEXTS["MIT"].upper().replace("\n", "\r\n  ").replace("LICENSE", "Licence")
    docs = spark.createDataFrame([(1, mit), (2, "text\nReleased under the MIT licence!\nmore"), (3, None), (4, TEXTS["MIT"] + " more")], "doc_id long, text string")
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan(docs, known).collect()}
    assert got == {1: ("MIT", []), 2: (None, ["MIT"]), 3: (None, []), 4: (None, [])}
    assert licences.scan(awkward, known).count() == 10 and licences.scan(empty, known).count() == 0
    assert licences.scan(docs, known, max_broadcast=0).count() == 4
    other = spark.createDataFrame([("PD", "Public domain."), ("X", "GPL v3")], "licence string, text string")
    named = spark.createDataFrame([(1, "a\n * PUBLIC  DOMAIN *\nb"), (2, "gpl-v3"), (3, "public\ndomain")], "doc_id long, text string")
    assert {r.doc_id: (r.licence, r.notices) for r in licences.scan(named, other).collect()} == {1: (None, ["PD"]), 2: ("X", ["X"]), 3: ("PD", [])}


def test_pages(spark, empty):
    page = """<html><head><title>T</title></head><body><h1>Hi  there</h1><p>One <b>two<br>three<p>four&nbsp;&amp; five<ul><li>a<li>b<ol start=3><li>x</li><li>y</ol><li>c</ul>
<div style='display:none'>no</div>tail<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td rowspan=2>Pear<td>10<tr><td>11</table>end<pre>a\n  b</pre><script>if (a<b) x</script>last</div><p hidden>no</p>"""
    assert page_text(page).split("\n") == ["Hi there", "", "One two", "three", "", "four & five", "", "* a", "* b", "  3. x", "  4. y", "* c", "", "tail", "",
                                           "Name   Qty", "Apple  3", "Pear   10", "       11", "", "end", "", "a", "  b", "", "last"]
    cases = {None: "", "": "", "x<!-- never ends <b>": "x", "<td>cell": "cell", "a < b": "a < b", "<table>before<tr><td>1": "before\n1", "</p>x": "x", "<b><i>x</b>y</i>": "xy", "<textarea>a<b</textarea>": "a<b"}
    assert {k: page_text(k) for k in cases} == cases
    assert page_text("<div>" * 30_000 + "deep") == "deep"


def test_pages_show_all_visible_text():
    cases = {
        "<p>a<!-->b--><p>c": "ab-->\n\nc", "a<!--x--!>b<p>c": "ab\n\nc", "a<!--->b": "ab", "x</ bogus>y</>z": "xyz",
        "<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span>no</div>z": "yes\nz",
        "<details><summary>S</summary><p>in</p></details>out": "S\nout", "<details open><summary>S</summary><p>in</p></details>out": "S\n\nin\n\nout",
        "<svg><title>t</title><defs/><text>one</text><text>two</text></svg>m <math><mi>x</mi><annotation>no</annotation></math>": "one\ntwo\nm x",
        "<table><tr><td rowspan=0>r<td>1<tr><td>2<tbody><tr><td>n<td>3</table>": "r  1\n   2\nn  3",
        f"<table><tr><td>{'w' * 70}<td>x<tr><td>a<td>y</table>": f"{'w' * 70}  x\na{' ' * 71}y",
    }
    assert {k: page_text(k) for k in cases} == cases
    deep = page_text("<ul><li>x" * 8000)
    assert deep.count("x") == 8000 and len(deep) < 800_000
    wide = page_text("<table>" + "<tr>" + "<td>" + "word " * 200 + "<td>b" + "</table>")
    assert wide.split().count("word") == 200 and max(map(len, wide.split("\n"))) < 90


def test_random_pages_against_a_recursive_reader():
    rng = random.Random(12)

    def page(depth, visible=True):
        """A tree and, by plain recursion, the words of it that a browser shows."""
        html, words = "", []
        for _ in range(rng.randrange(1, 4)):
            word = f"w{rng.randrange(10**6)}"
            own = [word] if visible else []
            kind = rng.choice(["text", "p", "div", "span", "b", "ul", "table", "none", "hidden", "script", "comment"]) if depth else "text"
            inner, seen = page(depth - 1, visible and kind != "hidden") if depth and kind not in ("text", "script", "comment") else (word, own)
            if kind == "p" and any(x in inner for x in ("<p", "<div", "<ul", "<table")):
                kind = "div"
            if kind == "ul":
                html += f"<ul><li>{inner}<li>{word}</ul>"
                words += [*seen, *own]
            elif kind == "table":
                html += f"<table><tr><td>{inner}</table>"
                words += seen
            elif kind == "none":
                html += f"<div style='display:none'>{inner}</div>"
            elif kind == "hidden":
                html += f"<div style='visibility:hidden'>{inner}<i style='visibility:visible'> {word} </i></div>"
                words += [*seen, word]
            elif kind in ("script", "comment"):
                html += f"<script>{word}</script>" if kind == "script" else f"<!-- {word} -->"
            else:
                html += f" {inner} " if kind == "text" else f" <{kind}>{inner}</{kind}> "
                words += seen
        return html, words

    for _ in range(300):
        html, words = page(4)
        assert [w for w in page_text(html).split() if w != "*"] == words, html


def test_language(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op10_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98
    model = language.fit(docs, F.lit(True))
    out = {(r.doc_id, r.lang_pred) for r in language.identify(awkward, model).collect() if r.doc_id in (2, 3, 4, 8)}
    assert out == {(2, "und"), (3, "und"), (4, "und"), (8, "und")}
    assert language.identify(awkward, language.fit(empty, F.lit(True))).count() == 10 and language.identify(empty, model).count() == 0


def test_queries_are_complete():
    assert {int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in queries.QUERIES)} == set(range(1, 11))
    assert pd.Series(list(queries.QUERIES)).is_unique
