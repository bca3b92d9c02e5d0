"""Quality classifier by attention-based multiple-instance learning (op2).

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded from its own
bytes; a gated attention network, learned from document labels alone, weighs the passages, and a
logistic unit scores the weighted sum of their representations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

PASSAGE_WORDS = 64
#: Byte classes: characters that stand for themselves come first, then kinds of characters.
_SINGLE = b"\n.,!?|#$%&*<>"
_KINDS = (b" \t\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"'\"-():;")
_N = len(_SINGLE) + len(_KINDS) + 3
#: Buckets that words are hashed to, so that prose can be told by its words.
_WORDS = 256
FEATURES = _N * _N + _WORDS + 4
#: Passages that are encoded and scored in one step.
_BLOCK = 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _classes() -> np.ndarray:
    table = np.full(256, _N - 3, dtype=np.int64)
    for i, c in enumerate(_SINGLE):
        table[c] = i
    for i, kind in enumerate(_KINDS):
        table[list(kind)] = len(_SINGLE) + i
    table[0x80:0xC0], table[0xC0:] = _N - 2, _N - 1
    return table


_CLASS = _classes()


def encode(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row of each passage, its features)`` in blocks, rows in order; every row has a passage.

    Features: square roots of the shares of byte-class pairs and of hashed words, the shares of words equal to the word
    before and of words seen earlier in the passage, the number of words and their mean length. Very long texts are
    cut into pieces first, where a passage may end early.
    """
    for a, b, data, offsets in S.text_pieces(texts):
        begin, end, row = S.word_spans(data, offsets, S.NOT_SPACE)
        first = np.searchsorted(row, np.arange(b - a))  # first word of each row
        rank = np.arange(len(begin)) - first[row]
        # A passage ends where its row or its words do; blanks before a row's first word count to its first passage.
        head = np.flatnonzero((rank % PASSAGE_WORDS == 0) & (rank > 0))
        empty = np.diff(offsets) == 0
        start = np.unique(np.concatenate([offsets[:-1][~empty], begin[head]])).astype(np.int64)
        owner = np.searchsorted(offsets, start, side="right") - 1
        stop = np.concatenate([start[1:], [len(data)]]).astype(np.int64)
        hashes = S.span_hashes(_LOWER[data], begin, end) if len(begin) else np.zeros(0, np.uint64)
        for low in range(0, len(start), _BLOCK):
            high = min(low + _BLOCK, len(start))
            w0, w1 = np.searchsorted(begin, [start[low], stop[high - 1]])
            x = _features(data, start[low:high], stop[low:high], owner[low:high], begin[w0:w1], end[w0:w1], hashes[w0:w1])
            yield a + owner[low:high], x
        if empty.any():
            yield a + np.flatnonzero(empty), np.zeros((int(empty.sum()), FEATURES), np.float32)


def _features(data, start, stop, owner, begin, end, h) -> np.ndarray:
    """Features of passages that follow each other in ``data``, with their words."""
    n = len(start)
    part = data[start[0] : stop[-1]]
    of_byte = np.repeat(np.arange(n), stop - start)
    kind = _CLASS[part]
    inside = owner[of_byte[1:]] == owner[of_byte[:-1]]
    pairs = np.bincount((of_byte[:-1] * (_N * _N) + kind[:-1] * _N + kind[1:])[inside], minlength=n * _N * _N).reshape(n, _N * _N).astype(np.float32)
    x = np.zeros((n, FEATURES), dtype=np.float32)
    x[:, : _N * _N] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    if len(begin):
        p = np.searchsorted(start, begin, side="right") - 1
        words = np.bincount(p, minlength=n).astype(np.float64)
        at_least = np.maximum(words, 1)
        lexical = np.bincount(p * _WORDS + (h >> np.uint64(32)).astype(np.int64) % _WORDS, minlength=n * _WORDS).reshape(n, _WORDS)
        x[:, _N * _N : -4] = np.sqrt(lexical / at_least[:, None])
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (p[1:] == p[:-1])))
        key = np.sort(p.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
        again = np.concatenate(([False], key[1:] == key[:-1]))
        x[:, -4] = np.bincount(p, weights=same, minlength=n) / at_least
        x[:, -3] = np.bincount((key >> np.uint64(40)).astype(np.int64), weights=again, minlength=n) / at_least
        x[:, -2] = np.log1p(words) / 4
        x[:, -1] = np.log1p(np.bincount(p, weights=end - begin, minlength=n) / at_least)
    return x


@dataclass(frozen=True)
class QualityModel:
    """Scaling, encoder ``w``, attention ``v``, ``u``, ``a`` and the output unit ``c``, ``d``; ``w is None``: a constant."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray | None
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: float

    def scores(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """The score of each of ``n`` bags from blocks of ``(bag of each passage, features)``."""
        if self.w is None:
            return np.full(n, _sigmoid(self.d))
        bags, hidden = [], []
        for bag, x in blocks:
            bags.append(bag)
            hidden.append(np.tanh((x - self.mean) / self.scale @ self.w + self.b))
        if not bags:
            return np.zeros(0)
        bag, h = np.concatenate(bags), np.concatenate(hidden)
        order = np.argsort(bag, kind="stable")
        return _pooled(self, h[order], bag[order], n)["p"]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pooled(m: QualityModel, h: np.ndarray, bag: np.ndarray, n: int) -> dict:
    """Gated attention over encoded passages. Bags must be in order and none may be empty."""
    start = np.searchsorted(bag, np.arange(n))
    t, g = np.tanh(h @ m.v), _sigmoid(h @ m.u)
    e = (t * g) @ m.a
    e = np.exp(e - np.maximum.reduceat(e, start)[bag])
    att = e / np.add.reduceat(e, start)[bag]
    z = np.add.reduceat(att[:, None] * h, start, axis=0)
    return {"h": h, "t": t, "g": g, "att": att, "z": z, "p": _sigmoid(z @ m.c + m.d)}


def gradient(m: QualityModel, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4) -> dict:
    """Gradient of the weighted mean log loss by each parameter, for scaled passages ``x`` of bags in order."""
    n = len(y)
    f = _pooled(m, np.tanh(x @ m.w + m.b), bag, n)
    err = (f["p"] - y) * weight / weight.sum()
    gz = err[:, None] * m.c
    ga = (f["h"] * gz[bag]).sum(axis=1)
    first = np.searchsorted(bag, np.arange(n))
    ge = f["att"] * (ga - np.add.reduceat(f["att"] * ga, first)[bag])
    gt, gg = ge[:, None] * m.a * f["g"] * (1 - f["t"] ** 2), ge[:, None] * m.a * f["t"] * f["g"] * (1 - f["g"])
    gh = (f["att"][:, None] * gz[bag] + gt @ m.v.T + gg @ m.u.T) * (1 - f["h"] ** 2)
    return {"w": x.T @ gh + decay * m.w, "b": gh.sum(axis=0), "v": f["h"].T @ gt, "u": f["h"].T @ gg, "a": (f["t"] * f["g"]).T @ ge, "c": f["z"].T @ err, "d": err.sum()}


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, gate: int = 12,
          epochs: int = 12, seed: int = 7) -> QualityModel:
    """Adam over mini-batches of bags; ``bag`` is in order from 0. One class only: a constant score.

    ``x`` may be of half precision; only a mini-batch at a time is scaled, so that training needs little besides it.
    """
    n = len(y)
    if not n or len(np.unique(y)) < 2:
        p = float(y.mean()) if n else 0.5
        d = float(np.log((p * n + 1) / ((1 - p) * n + 1)))
        none = np.zeros(0)
        return QualityModel(none, none, None, none, none, none, none, none, d)
    rng = np.random.default_rng(seed)
    total, square = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for low in range(0, len(x), _BLOCK):
        part = x[low : low + _BLOCK].astype(np.float64)
        total += part.sum(axis=0)
        square += (part**2).sum(axis=0)
    mean = total / len(x)
    scale = np.maximum(np.sqrt(np.maximum(square / len(x) - mean**2, 0)), 0.02).astype(np.float32)
    mean = mean.astype(np.float32)
    prior = float((weight * y).sum() / weight.sum())
    par = {"w": rng.normal(0, 0.05, (x.shape[1], hidden)), "b": np.zeros(hidden), "v": rng.normal(0, 0.3, (hidden, gate)),
           "u": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.1, hidden),
           "d": np.array(np.log(prior / (1 - prior)))}
    par = {k: v.astype(np.float32) for k, v in par.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in par.items()}, {k: np.zeros_like(v) for k, v in par.items()}, 0
    start = np.searchsorted(bag, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            ids = order[at : at + 64]
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in ids])
            own = np.repeat(np.arange(len(ids)), start[ids + 1] - start[ids])
            xb = (x[rows].astype(np.float32) - mean) / scale
            grad = gradient(QualityModel(mean, scale, **par), xb, own, y[ids], weight[ids])
            step += 1
            for k in par:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                par[k] = (par[k] - 0.005 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return QualityModel(mean, scale, **par)


def _spread(n: int, most: int) -> np.ndarray:
    """At most so many of ``n`` places, evenly spread."""
    return np.arange(n) if n <= most else np.unique(np.linspace(0, n - 1, most).round().astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
        max_docs: int = 3000, max_passages: int = 16) -> QualityModel:
    """Learn from about ``max_docs`` labelled documents, half of each class, none of them held out.

    The sample is chosen by a hash of the id. It is bounded by ``max_docs`` and by ``max_passages`` of each of these
    documents, spread over its whole length, so that at most 48,000 passages of half-precision features (67 MB) reach the
    driver; scoring takes all texts whole. Rows with a null id or label are not learned from; of contradictory labels the
    lower holds, of several texts with one id the first in order.
    """
    spark = docs.sparkSession
    S.arrow_batches(spark)
    marks = (labels.where(S.learnable(F.col(doc_id)) & F.col(label).isNotNull())
             .groupBy(F.col(doc_id).alias("__id")).agg((F.min(label) > 0).cast("int").alias("y")))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, max_docs / 2 / max(1, counts.get(y, 0))) for y in (0, 1)}
    h = F.shiftrightunsigned(F.xxhash64("__id"), 2)
    limit = F.when(F.col("y") == 1, F.lit(int(share[1] * (1 << 62)))).otherwise(F.lit(int(share[0] * (1 << 62))))
    sample = F.broadcast(marks.where(h < limit))  # about max_docs rows of an id and a bit
    bags = (docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .join(sample, "__id").groupBy("__id").agg(F.min("y").alias("y"), F.min("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, xs = zip(*((r, x.astype(np.float16)) for r, x in encode(batch.column(2)))) if batch.num_rows else ((), ())
            if not rows:
                continue
            row, x = np.concatenate(rows), np.concatenate(xs)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            parts = [x[order[a:b][_spread(b - a, max_passages)]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], names=["id", "y", "x"])

    got = bags.mapInArrow(run, bags.select(F.col("__id").alias("id"), "y").schema.add("x", "binary")).toArrow()
    got = got.sort_by("id").combine_chunks() if got.num_rows else got
    y = got.column("y").to_numpy().astype(np.float32)
    sizes = np.array([len(v.as_buffer()) // (2 * FEATURES) for c in got.column("x").chunks for v in c], np.int64)
    x = np.concatenate([np.frombuffer(v.as_buffer(), np.float16) for c in got.column("x").chunks for v in c]).reshape(-1, FEATURES) if len(y) else np.zeros((0, FEATURES), np.float16)
    del got
    weight = np.where(y > 0, 1 / share[1], 1 / share[0]).astype(np.float32)
    weight = np.minimum(weight / max(float(weight.min()), 1e-9), 8) if len(y) else weight
    model = train(x, np.repeat(np.arange(len(y)), sizes), y, weight)
    del x
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns with ``name``, the score: of the whole text, from nothing but the text.

    A null or empty text is a bag with one empty passage. Rows are never merged or dropped. A column of ``keep`` that is
    called ``name`` already is replaced.
    """
    S.arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep if c != name]
    rows = docs.select(*kept, *([] if text in kept else [F.col(text).alias("__text")]))
    place = rows.columns.index(text if text in kept else "__text")
    schema = docs.select(*kept).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.scores(encode(batch.column(place)), batch.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
