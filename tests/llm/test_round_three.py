"""Archives in packages, cuts for filling in the middle, and prefix tries: against brute force, and on awkward tables."""

import gzip
import hashlib
import json
import random
import re
import struct
import zipfile
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import fill_middle, line_join, prefix_trie, shared, warc_zip

PAGES = "page_id long, url string, html string, digest string, __digest string, path string"


# ---- fill in the middle ----

def _cut(i, t):
    t, h = t or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    parts = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(parts)
    if not t or any(m in t for m in fill_middle.MARKS) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, t, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    spm = h[3] % 100 < 20
    return i, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", t


def test_cuts_against_brute_force(spark):
    texts = ["", None, "a", "ab<P>c", "\U0001f600 é<x", "x<P y", "<S<S", "\x00\n a", "M>", "word " * 30_000 + "end"] + ["<P <S <M P>S>M><<" * (i % 3 + 1) for i in range(60)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "no key", "x", "y"), (3, "the same id", "x", "y"), (3, "the same id", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, form string")
    out = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([_cut(i, t) for i, t, *_ in rows], key=str)
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40) | st.text(max_size=40).map(str.encode))
def test_code_points_round_trip(data):
    points = fill_middle.code_points(data)
    assert fill_middle.encoded(points) == data
    at = fill_middle.borders(points)
    assert at[0] == 0 and at[-1] == len(points) and (len(points) == 0 or (at[1:] > at[:-1]).all())
    assert b"".join(fill_middle.encoded(points[a:b]) for a, b in zip(at, at[1:])) == data


# ---- prefix tries ----

def _nodes(rows):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            talks[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    talks = {c: [y[3:] for y in sorted(v)] for c, v in talks.items()}
    whole = {}
    for c, v in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = talks.get(c - c % 20, [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for f in members:
        if f:
            children[f[:-1]].append(f)
    leaves, saved = {}, {}
    for f in sorted(members, key=len, reverse=True):
        leaves[f] = sum(leaves[k] for k in children[f]) or 1
        saved[f] = (len(members[f]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", f[-1][1])) if f else 0) + sum(saved[k] for k in children[f])
    ends = lambda f, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(f)).encode()).hexdigest()
    return sorted([(min(m), len(f), min(members[f[:-1]]) if f else None, len(m), len(children[f]), leaves[f], saved[f], ends(f, m)) for f, m in members.items()], key=str)


def _trie(df):
    turns = prefix_trie.turn_table(df)
    return prefix_trie.trie(*prefix_trie.with_shared_heads(turns, F.col("id") - F.col("id") % 20, F.crc32(F.col("id").cast("string").cast("binary")) % 4, 3))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, monkeypatch, seed):
    """Long shared beginnings, many copies (in several pieces of ids), prefixes of others, nulls, ties, turnless conversations."""
    monkeypatch.setattr(prefix_trie, "LIST_IDS", 3)
    rng, rows = random.Random(seed), []
    for c in range(0, 150, 3):
        for i in range(rng.choice([0, 1, 2, 5, 12, 40])):
            rows.append((c, rng.choice([i, i, None]), rng.choice(["u", None]), "a b" if i < 8 * seed or rng.random() < 0.8 else rng.choice(["c", "d e f", None])))
    rows += [(c, i, "u", f"same {i}") for c in range(1000, 1100) for i in range(30 if c % 7 else 29)] + [(None, 1, "u", "x"), (7, 1, "u", "only turn"), (9, 1, "u", "twice"), (9, 1, "u", "twice")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, id string, place string")
    assert sorted(map(tuple, _trie(df).collect()), key=str) == _nodes(rows)


def test_trie_of_nothing_and_of_one(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert _trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(20, 0, "u", "a b"), (20, 1, "v", "c")]
    assert sorted(map(tuple, _trie(spark.createDataFrame(rows, schema)).collect()), key=str) == _nodes(rows)


# ---- archives in packages ----

def _records(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        at = first.get(b)
        again = len(b) >= 100 and at is not None and at != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=str)


def test_packages_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", 20_000)
    monkeypatch.setattr(warc_zip, "MEMBER_BYTES", 5_000)
    monkeypatch.setattr(warc_zip, "RUN_BYTES", 4_000)
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}\r\ny", "".join(rng.choice("abc <>é\r\n") for _ in range(rng.randrange(400)))) for i in range(300)]
    rows += [(1000 + i, "u", ("é same" * 30 if i % 2 else "small")) for i in range(80)] + [(2000, None, None), (2001, "u", ""), (None, "u", "é same" * 30), (5, "again", rows[5][2]), (6, "other", "é same" * 30), (2002, "long", "<b>\r\n\r\n" * 200_000)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)
    made = warc_zip.write_packages(df, str(tmp_path / "out"))
    assert made.count() > 1
    for found in (made, warc_zip.packages(spark, str(tmp_path / "out"))):
        assert sorted(map(tuple, warc_zip.page_records(spark, found).collect()), key=str) == _records(rows)
    urls = {r.url for r in warc_zip.read_records(warc_zip.positions(warc_zip.members(made))).collect()}
    assert "http://x/7%0D%0Ay" in urls
    empty = warc_zip.write_packages(df.limit(0), str(tmp_path / "empty"))
    assert empty.count() == 0 and warc_zip.page_records(spark, empty).collect() == []


def _package(path, rows, index="stored", wide=False):
    """A package by hand, with or without an index, with a comment that looks like an end record."""
    records = [gzip.compress(warc_zip._record(i, u, h.encode(), hashlib.sha256(h.encode()).hexdigest(), None)) for i, u, h in rows]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("pages/extra.jsonl", "{}\n" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("archive/data.warc.gz", b"".join(records))
        lines, at = "", 0
        for (i, u, _), r in zip(rows, records):
            lines += f"x 1 {json.dumps({'url': u, 'filename': 'data.warc.gz', 'offset': str(at), 'length': str(len(r))})}\n"
            at += len(r)
        if index == "stored":
            z.writestr("indexes/index.cdxj", lines)
        elif index == "deflated":
            z.writestr("indexes/index.cdx", lines, zipfile.ZIP_DEFLATED)
        elif index == "gzip":
            z.writestr("indexes/index.cdxj.gz", gzip.compress(lines[:40].encode()) + gzip.compress(lines[40:].encode()))
        z.comment = b"see PK\x05\x06" + bytes(18)


@pytest.mark.parametrize("index", ["stored", "deflated", "gzip", "none"])
@pytest.mark.parametrize("wide", [False, True])
def test_packages_of_others(spark, tmp_path, monkeypatch, index, wide):
    """Indexes of all kinds or none, and directories in ZIP64 form."""
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    rows = [(i, f"u{i}", f"text {i} " * (i * 7 % 40)) for i in range(30)]
    _package(tmp_path / "a.wacz", rows, index)
    if wide:
        assert warc_zip._END64 in (tmp_path / "a.wacz").read_bytes()
    found = warc_zip.packages(spark, str(tmp_path))
    got = warc_zip.read_records(warc_zip.positions(warc_zip.members(found)))
    assert sorted((r.record_id, bytes(r.payload).decode()) for r in got.collect()) == sorted((f"<urn:page:{i}>", h) for i, _, h in rows)


def test_directories_in_small_pieces(tmp_path):
    rows = [(i, f"u{i}", "x") for i in range(3)]
    _package(tmp_path / "a.wacz", rows)
    data = (tmp_path / "a.wacz").read_bytes()
    read = lambda start, n: data[start : start + n]
    names = [e[0] for e in warc_zip._entries(read, *warc_zip._directory(read, len(data)), step=7)]
    assert names == ["pages/extra.jsonl", "archive/data.warc.gz", "indexes/index.cdxj"]  # Python's own reader takes the comment for an end record


@pytest.mark.parametrize("data", [b"", b"PK", b"no zip at all" * 9, b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0, 0xFFFFFFFF, 0)])
def test_what_is_no_package(data):
    read = lambda start, n: data[start : start + n]
    with pytest.raises(ValueError, match="not a ZIP package"):
        warc_zip._directory(read, len(data))


def test_compressed_archives_and_false_digests_are_errors(spark, tmp_path):
    record = gzip.compress(warc_zip._record(1, "u", b"x" * 200, "0" * 64, None))
    for name, method in (("deflated", zipfile.ZIP_DEFLATED), ("false", zipfile.ZIP_STORED)):
        (tmp_path / name).mkdir()
        with zipfile.ZipFile(tmp_path / name / "a.wacz", "w") as z:
            z.writestr("archive/data.warc.gz", record, method)
        found = warc_zip.packages(spark, str(tmp_path / name))
        with pytest.raises(Exception, match="is compressed" if name == "deflated" else "payload digest"):
            warc_zip.read_records(warc_zip.positions(warc_zip.members(found))).collect()


def test_uris():
    assert warc_zip._files("file:/a/b")[1] == warc_zip._files("file:///a/b")[1] == warc_zip._files("/a/b")[1] == "/a/b"
    assert shared.BATCH_BYTES


# ---- markup ----

@pytest.mark.parametrize("page,text", [
    ("<div style='display:none;display:block'>a</div>", "a"), ("<p style=\"content:'display:none'\">a</p>", "a"), ("<p style='display:none!important;display:block'>a</p>b", "b"), ("<p style='display:none;display:12'>a</p>b", "b"),
    ("<p style='background:url(data:x;display:none)'>a</p>", "a"), ("<p style='visibility:hidden;visibility:visible'>a</p>", "a"), ("<p hidden style='display:block'>a</p>", "a"),
    ("<span><div>x</span>y</div>", "xy"), ("<span style='display:none'><div>a</span>b</div>", ""), ("<b><p>x</b>y</p>z", "xy\n\nz"), ("<b>x</b>y", "xy"), ("<i><b>x</i>y</b>z", "xyz"),
    ("<form><input type=submit value='Send it'><input value=no><input type=hidden value=no></form>", "Send it"),
    ("<ol type=a start=26><li>x<li>y</ol>", "z. x\naa. y"), ("<ol type=I><li>x<li value=1994>y</ol>", "I. x\nMCMXCIV. y"), ("<ol type=i start=0><li>x</ol>", "0. x")])
def test_markup_as_browsers_take_it(page, text):
    from weftline.llm.html_text import page_text

    assert page_text(page) == text


def _edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_near_copies_of_one_line_cost_their_number(spark, monkeypatch):
    """Variants of one line, each with a word changed, are told apart by pivots: few candidates, no link lost, doubled letters included."""
    rng = random.Random(11)
    monkeypatch.setattr(line_join, "_GROUP", 16)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))
    lines = set()
    while len(lines) < 150:
        at = rng.choice([i for i, c in enumerate(base) if c == " "])
        lines.add(base[:at] + "".join(rng.choice("aehinorst") for _ in range(4)) + base[at:])
    lines |= {base, base[1:], base + "x", base[:7] + base[9:], base[:7] + base[6] + base[6:]}
    rows = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(sorted(lines))], "line_id long, line string, n int")
    names = dict(enumerate(sorted(lines)))
    found, _ = line_join._candidates(rows, 2, 0.8, 1000)
    many = sum(d.count() for d in found)
    got = {(r.a, r.b) for r in line_join.line_links(rows).collect()}
    near = lambda a, b: abs(len(a) - len(b)) <= 2 and _edits(a, b) <= 2
    assert got == {(i, j) for i in names for j in names if i < j and near(names[i], names[j])}
    assert many < len(lines) * 20  # all pairs are 11,935; three keys each, filtered by letters, gave more than that
