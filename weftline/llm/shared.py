"""Helpers that the operators share: written intermediates, Arrow text buffers, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weftline.sources.tables import discard, intermediates, materialize, shared_dir  # noqa: F401  (for the operators)

#: Bytes of text that one vectorised step works on; a longer document is one step of its own.
CHUNK_BYTES = 1 << 21
#: Bytes of an Arrow batch between the JVM and Python; a longer document is a batch of its own.
BATCH_BYTES = 1 << 24


def arrow_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, so that documents of any length fit; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows that a model may learn from: those with an id that is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and its ``n + 1`` offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets if len(offsets) else np.zeros(1, np.int64)


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets from 0)`` of consecutive rows with about ``limit`` bytes."""
    data, offsets = text_buffer(col)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def text_pieces(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like ``text_chunks``, but a longer row comes in pieces, each cut behind a whitespace byte if it has one."""
    for a, b, data, offsets in text_chunks(col, limit):
        at = 0
        while len(data) - at > limit and b - a == 1:
            blank = np.flatnonzero(~NOT_SPACE[data[at : at + limit]])
            end = at + (int(blank[-1]) + 1 if len(blank) else limit)
            yield a, b, data[at:end], np.array([0, end - at])
            at = end
        yield a, b, data[at:], offsets - at if at == 0 else np.array([0, len(data) - at])


# An odd multiplier for the rolling hash and its inverse modulo 2**64.
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        def table(base: int) -> np.ndarray:
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers.clear()
        _powers[size] = table(_MUL), table(_INV)
    return _powers[size]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all of the input's."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[begin:end]``, equal for equal bytes wherever they stand."""
    power, inverse = _power_tables(len(data))
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    return mix64((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(begin, end, row)`` of each maximal run of bytes with ``is_word`` (by byte, or by place); runs end at row borders."""
    word = is_word if is_word.dtype == bool and len(is_word) == len(data) != 256 else is_word[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~first[:-1] if len(data) else word
    begin = np.flatnonzero(word & ~before)
    after = np.concatenate((word[1:], [False])) & ~first[1:] if len(data) else word
    end = np.flatnonzero(word & ~after) + 1
    row = np.searchsorted(offsets, begin, side="right") - 1
    return begin, end, row


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to letters, digits and marks: not ASCII's others, nor punctuation and symbols of the
    blocks Latin-1 (U+0080 to U+00BF, but for its three letters and five numbers), U+2000 to U+2FFF and U+3000 to U+303F."""
    word = ALNUM[data]
    if len(data) and data.max() >= 0x80:
        after, third = np.append(data[1:], np.uint8(0)), np.append(data[2:], np.zeros(2, np.uint8))
        for two in (np.flatnonzero((data == 0xC2) & ~_LATIN_WORDS[after]), np.flatnonzero((data == 0xC3) & ((after == 0x97) | (after == 0xB7)))):
            word[two] = word[two + 1] = False
        three = np.flatnonzero((data == 0xE2) | ((data == 0xE3) & (after == 0x80)))
        three = three[three + 2 < len(data)] if len(three) and third.size else three
        word[three] = word[three + 1] = word[three + 2] = False
    return word


def byte_set(chars: bytes, high: bool = False) -> np.ndarray:
    """A table of 256 booleans: the given bytes, and with ``high`` all of non-ASCII UTF-8."""
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    if high:
        out[128:] = True
    return out


#: The whitespace of the contracts: space and the bytes 9 to 13.
WHITESPACE = b" \t\n\x0b\x0c\r"
NOT_SPACE = ~byte_set(WHITESPACE)
#: Second bytes of the letters and numbers among U+0080 to U+00BF.
_LATIN_WORDS = byte_set(b"\xaa\xb2\xb3\xb5\xb9\xba\xbc\xbd\xbe")
ALNUM = byte_set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", high=True)
