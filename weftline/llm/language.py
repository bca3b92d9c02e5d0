"""Language identification with bit-sliced Bloom filters of n-grams (op10).

One table of slots serves all languages: bit ``l`` of a slot belongs to language ``l``'s Bloom
filter, so that the AND of an n-gram's slots is the mask of all languages that contain it. A
document's score for a language is its share of n-grams found there, corrected for the filter's
false positives; the highest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

GRAM = 4
HASHES = 3
SLOT_BITS = 20
#: Two blanks around each text, so that the shortest one has n-grams.
_PAD = "  "
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LETTER = S.byte_set(b"abcdefghijklmnopqrstuvwxyz", high=True)


@dataclass(frozen=True)
class LanguageModel:
    """``slots[h]`` is a row of bytes with a bit for each language; ``fp`` is each filter's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    fp: np.ndarray
    default: int


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, n-grams as uint32, row of each)``: letters lower-cased, all else a blank."""
    padded = pc.binary_join_element_wise(_PAD, pc.utf8_lower(pc.fill_null(texts, "")), _PAD, "")
    for a, b, data, offsets in S.text_chunks(padded):
        clean = np.where(_LETTER[data], data, np.uint8(32)).astype(np.uint32)
        n = len(clean) - GRAM + 1
        if n <= 0:
            yield a, b, np.zeros(0, np.uint32), np.zeros(0, np.int64)
            continue
        gram = clean[:n] | clean[1 : n + 1] << 8 | clean[2 : n + 2] << 16 | clean[3 : n + 3] << 24
        row = np.repeat(np.arange(b - a), np.diff(offsets))[:n]
        inside = np.arange(n) + GRAM <= offsets[row + 1]
        blanks = (clean[1 : n + 1] == 32) & (clean[2 : n + 2] == 32)
        keep = inside & ~blanks
        yield a, b, gram[keep], row[keep]


def _slots_of(gram: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th of ``HASHES`` slots of each n-gram, cut from one hash."""
    h = S.mix64(gram.astype(np.uint64))
    return (h >> np.uint64(64 - SLOT_BITS * (k + 1)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def fit(docs: DataFrame, use: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        max_docs: int = 1500, min_share: float = 0.02) -> LanguageModel:
    """Learn each language's n-grams from about ``max_docs`` whole documents of it (a bounded sample, by hash of id).

    An n-gram belongs to a language if at least ``min_share`` of its sampled documents (and two, where
    there are that many) have it. The gathered n-grams are bounded by the sample, not by the corpus.
    """
    spark = docs.sparkSession
    S.arrow_batches(spark)
    rows = docs.where(use & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 2).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((1 << SLOT_BITS, 1), np.uint8), np.zeros(0), 0)
    limit = F.create_map(*[F.lit(x) for l in languages for x in (l, int(min(1.0, max_docs / counts[l]) * (1 << 62)))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = pc.index_in(batch.column("lang"), pa.array(languages)).to_numpy(zero_copy_only=False)
            for a, _, gram, row in _grams(batch.column("text")):
                once = np.unique(row.astype(np.uint64) << np.uint64(32) | gram)  # each n-gram of a document once
                of = code[a + (once >> np.uint64(32)).astype(np.int64)].astype(np.uint64)
                key, n = np.unique(of << np.uint64(32) | once & np.uint64(0xFFFFFFFF), return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    grams = rows.where(F.col("h") < F.element_at(limit, F.col("lang"))).select("lang", "text").mapInArrow(count, "key long, n long")
    grams = grams.groupBy("key").agg(F.sum("n").alias("n"))
    size = {l: min(max_docs, counts[l]) for l in languages}
    least = F.element_at(F.create_map(*[F.lit(x) for i, l in enumerate(languages) for x in (i, max(min(2, size[l]), int(size[l] * min_share)))]),
                         F.shiftright("key", 32).cast("int"))
    got = grams.where(F.col("n") >= least).select("key").toArrow().column("key").to_numpy()
    code, gram = got >> 32, (got & 0xFFFFFFFF).astype(np.uint32)
    slots = np.zeros((1 << SLOT_BITS, (len(languages) + 7) // 8), dtype=np.uint8)
    for i in range(len(languages)):
        for k in range(HASHES):
            slots[_slots_of(gram[code == i], k), i // 8] |= np.uint8(1 << i % 8)
    fill = np.array([float((slots[:, i // 8] >> i % 8 & 1).mean()) for i in range(len(languages))])
    return LanguageModel(languages, slots, fill**HASHES, int(np.argmax([counts[l] for l in languages])))


def predict(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and its corrected share for each text; ``und`` and 0 where there is no letter."""
    n, many = len(texts), len(model.languages)
    if not many:
        return ["und"] * n, np.zeros(n)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    found, total = np.zeros((n, many)), np.zeros(n)
    for a, b, gram, row in _grams(texts):
        mask = model.slots[_slots_of(gram, 0)]
        for k in range(1, HASHES):
            mask &= model.slots[_slots_of(gram, k)]
        total[a:b] = np.bincount(row, minlength=b - a)
        for j in range(mask.shape[1]):  # how often each byte of masks occurs in each row, then its bits
            times = np.bincount(row * 256 + mask[:, j], minlength=(b - a) * 256).reshape(-1, 256)
            found[a:b, j * 8 : j * 8 + 8] = (times @ _BITS)[:, : many - j * 8]
    share = np.clip((found - total[:, None] * model.fp) / (1 - model.fp) / np.maximum(total, 1)[:, None], 0, 1)
    best = np.where(share.max(axis=1) > 0, share.argmax(axis=1), model.default)
    lang = [model.languages[i] if ok else "und" for i, ok in zip(best, lettered)]
    return lang, np.where(lettered, share[np.arange(n), best], 0.0)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, from the whole text alone.

    Null, empty or letterless texts give ``und`` and 0; a text none of whose n-grams is known gives the
    commonest learned language and 0; ties go to the first language by name; rows are never merged.
    """
    S.arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 slots, a byte for 8 languages
    keep = [c for c in keep if c not in ("lang_pred", "score")]  # such columns are replaced
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict(shared.value, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
