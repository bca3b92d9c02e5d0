"""Benchmark decontamination by CGK embedding and coordinate-sampling LSH (op3).

The CGK random walk turns a word sequence into a longer one: at step ``j`` it emits the word under its pointer
and moves on if a random bit of that word, drawn anew for each step, is 1. Sequences at a small edit distance
come back into step soon and then emit the same, so edit distance becomes Hamming distance, and samples of a
few steps are equal with a good chance. Each repetition samples other steps. A walk starts at every word of
every document, so all windows of an item's size are looked up; what is found is verified by exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

#: Steps that one repetition samples, and the longest window by which an item is looked up.
SAMPLES, MAX_WINDOW = 4, 32
_STARTS = 1 << 16
_TABLE_BITS = 18


@dataclass(frozen=True)
class Passages:
    """Items as word hashes, and for each window size the sampled keys of their anchors."""

    words: list[np.ndarray]
    similarity: float
    plans: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # window -> repetitions: sampled steps, multipliers
    keys: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # window -> repetitions: sorted keys, anchors, table
    anchors: dict[int, list[tuple[int, int]]]  # window -> (item, offset in the item)


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, word hashes, place of each row's first word)``; each row ends with a 0."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    for a, b, data, offsets in S.text_chunks(low):
        begin, end, row = S.word_spans(data, offsets, S.letters(data))
        first = np.searchsorted(row, np.arange(b - a + 1)) + np.arange(b - a + 1)
        out = np.zeros(len(begin) + b - a, dtype=np.uint64)
        if len(begin):
            out[np.arange(len(begin)) + row] = S.span_hashes(data, begin, end)
        yield a, b, out, first


def _sampled_keys(words: np.ndarray, starts: np.ndarray, plans: dict[int, list]) -> dict[int, list[np.ndarray]]:
    """The walk from each start, and the key of each window size and repetition; the pointer rests on a 0."""
    halves = words, S.mix64(words)
    at, keys = starts.astype(np.int64), {w: [np.zeros(len(starts), np.uint64) for _ in reps] for w, reps in plans.items()}
    uses: dict[int, list] = {}
    for w, reps in plans.items():
        for r, (steps, factors) in enumerate(reps):
            for j, f in zip(steps.tolist(), factors):
                uses.setdefault(j, []).append((w, r, f))
    seen, bit, part = (np.empty(len(starts), np.uint64) for _ in range(3))
    for j in range(max(uses, default=-1) + 1):
        np.take(words, at, out=seen, mode="clip")
        for w, r, f in uses.get(j, ()):
            np.multiply(seen, f, out=part)
            keys[w][r] += part
        if j >= 64:
            np.take(halves[1], at, out=seen, mode="clip")
        np.right_shift(seen, np.uint64(j % 64), out=bit)
        np.bitwise_and(bit, np.uint64(1), out=bit)
        at += bit.view(np.int64)
    return keys


def _steps(window: int) -> int:
    """Steps after which the pointer is hardly ever beyond the window."""
    return max(1, window * 3 // 2)


def prepare(texts: list[str | None], similarity: float = 0.8, recall: float = 0.999, agree: float = 0.8, seed: int = 11) -> Passages:
    """Look-up tables of the items. ``recall`` is reached where sampled steps agree with the chance ``agree``.

    An item is looked up by windows of the largest power of two of words that half of it has (32 at most), laid end to
    end from its first word and once to its last, so a passage is found if any of them is. Windows of a long item's own size would hold all of its edits at once, and few would be found.
    """
    words = [w[:-1] for _, b, all_, first in _words(pa.array(texts, pa.string())) for w in np.split(all_, first[1:-1])] if texts else []
    anchors: dict[int, list[tuple[int, int]]] = {}
    for i, w in enumerate(words):
        if len(w):
            most = len(w) if len(w) < 5 else len(w) // 2  # shorter items may have no edit
            window = min(MAX_WINDOW, 1 << (most.bit_length() - 1))
            offsets = {*range(0, len(w) - window + 1, window), len(w) - window}
            anchors.setdefault(window, []).extend((i, o) for o in sorted(offsets))
    rng, plans, keys = np.random.default_rng(seed), {}, {}
    for window, found in sorted(anchors.items()):
        samples = min(SAMPLES, _steps(window))
        reps = math.ceil(math.log(1 - recall) / math.log(1 - agree**samples))
        plans[window] = [(np.sort(rng.choice(_steps(window), samples, replace=False)), rng.integers(1, 1 << 63, samples).astype(np.uint64) * np.uint64(2) + np.uint64(1)) for _ in range(reps)]
        rows = [[] for _ in range(reps)]
        for i, o in found:
            item = np.append(words[i], np.uint64(0))
            for r, key in enumerate(_sampled_keys(item, np.array([o]), {window: plans[window]})[window]):
                rows[r].append(key[0])
        keys[window] = []
        for r in range(reps):
            key = np.array(rows[r], np.uint64)
            order = np.argsort(key, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[(key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            keys[window].append((key[order], order, table))
    return Passages(words, similarity, plans, keys, anchors)


def _candidates(model: Passages, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sorted unique ``(item, row, place where the item would begin)`` of all windows whose keys meet an item's.

    ``rows`` has the place of each row's first word. The row is that of the window itself: the item's first words may be
    missing at a row's start, so the item is taken to begin at the row's first word at the earliest.
    """
    found = []
    for low in range(0, len(words), _STARTS):
        starts = np.arange(low, min(low + _STARTS, len(words)))
        for window, reps in _sampled_keys(words, starts, model.plans).items():
            item, offset = np.array(model.anchors[window]).T
            for key, (known, anchor, table) in zip(reps, model.keys[window]):
                at = np.flatnonzero(table[(key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
                first, last = np.searchsorted(known, key[at], "left"), np.searchsorted(known, key[at], "right")
                n = last - first
                at, first, n = at[n > 0], first[n > 0], n[n > 0]
                which = anchor[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                begin = np.repeat(starts[at], n)
                row = np.searchsorted(rows, begin, side="right") - 1
                found.append(np.stack([item[which], row, np.maximum(begin - offset[which], rows[row])], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def best_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """``(distance, begin, end)`` of the stretch of ``words`` with the smallest edit distance to the item; the first one."""
    m = len(words)
    place = np.arange(m + 1)
    cost, begin = np.zeros(m + 1, np.int64), place.copy()
    for i, w in enumerate(item):
        # A cost and the place where its stretch begins travel as one number, smaller costs and earlier places first.
        packed = cost * (m + 2) + begin
        step = np.empty(m + 1, np.int64)
        step[0] = packed[0] + (m + 2)
        step[1:] = np.minimum(packed[:-1] + (words != w) * (m + 2), packed[1:] + (m + 2))
        packed = np.minimum.accumulate(step - place * (m + 2)) + place * (m + 2)
        cost, begin = packed // (m + 2), packed % (m + 2)
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def matches(model: Passages, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """``(row, item, distance, first word, words)``: each row's best passage for each item within the similarity."""
    out = []
    for a, _, words, first in _words(texts):
        best: dict[tuple[int, int], tuple] = {}
        known: dict[tuple, tuple] = {}
        seen: dict[tuple[int, int], int] = {}
        for i, row, at in _candidates(model, words, first).tolist():
            item = model.words[i]
            n, slack = len(item), int((1 - model.similarity) * len(item) + 1e-9)
            low, high = int(first[row]), int(first[row + 1]) - 1
            key = (row, i)
            if (key in best and best[key][0] == 0) or seen.get(key, -(1 << 60)) >= at:
                continue
            if at >= low and at + n <= high and np.array_equal(words[at : at + n], item):
                best[key] = (0, at - low, n)
                continue
            seen[key] = at + slack  # the stretch below covers passages that begin up to there
            begin, end = max(low, at - slack), min(high, at + n + 3 * slack)
            part = words[begin:end]
            if n - int((item[:, None] == part).any(axis=1).sum()) > slack:  # each word that is nowhere costs an edit
                continue
            told = (i, part.tobytes())
            if told not in known:
                known[told] = best_match(item, part)
            d, b, e = known[told]
            if d <= slack and (key not in best or (d, begin + b - low) < best[key][:2]):
                best[key] = (d, begin + b - low, e - b)
        out += [(a + row, i, *hit) for (row, i), hit in sorted(best.items())]
    return out


def _blocks(benchmark: DataFrame, text: str, item_id: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of about ``block_bytes`` of text, each small enough for the driver and a broadcast."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-total // block_bytes))
    for k in range(many):
        got = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(many)) == k).orderBy("id", "text").collect()
        yield [r["id"] for r in got], [r["text"] for r in got]


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_text: str = "text", item_id: str = "item_id",
                  similarity: float = 0.8, recall: float = 0.999, block_bytes: int = 1 << 24) -> DataFrame:
    """A row for each row of ``docs`` and item that it holds: ``keep`` columns, ``item_id``, ``distance``, ``first_word``, ``n_words``.

    Words are runs of letters and digits of any script (see ``shared.letters``), lower-cased. A document holds an item if a stretch of it is within
    ``(1 - similarity) * words of the item`` word edits of it; the best stretch is told. Items without a word are
    held by none, items of under 5 words only as they are; null and empty texts hold nothing; equal items each
    have their row. The benchmark is a query set: it goes against all documents in blocks of ``block_bytes``.
    """
    spark: SparkSession = docs.sparkSession
    S.arrow_batches(spark)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    id_type = benchmark.select(F.col(item_id).alias("item_id")).schema["item_id"].dataType
    schema = rows.drop("__text").schema.add("item_id", id_type).add("distance", "integer").add("first_word", "long").add("n_words", "integer")
    out = None
    for ids, texts in _blocks(benchmark, item_text, item_id, block_bytes):
        shared = spark.sparkContext.broadcast((ids, prepare(texts, similarity, recall)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, model = shared.value
            for batch in batches:
                hits = matches(model, batch.column(batch.num_columns - 1))
                if hits:
                    row, item, distance, first, n = zip(*hits)
                    held = batch.select(list(range(batch.num_columns - 1))).take(pa.array(row))
                    more = [pa.array([ids[i] for i in item]), pa.array(distance, pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*held.columns, *more], names=schema.fieldNames())

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
                        similarity: float = 0.8, recall: float = 0.999, block_bytes: int = 1 << 24) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item (see ``find_passages``)."""
    spark = docs.sparkSession
    S.arrow_batches(spark)
    place, schema = docs.columns.index(text), docs.schema
    for _, texts in _blocks(benchmark, item_text, item_id, block_bytes):
        shared = spark.sparkContext.broadcast(prepare(texts, similarity, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[hit[0] for hit in matches(shared.value, batch.column(place))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
