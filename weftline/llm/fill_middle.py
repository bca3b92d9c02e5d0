"""Fill-in-the-middle: texts cut at token borders into prefix, middle and suffix, and put in another order.

A text becomes an array of code points (UTF-32). Tokens are runs of ASCII letters and single other characters, so a
border is a place where not both neighbours are letters. Two ranks drawn from the row's key choose the borders; the pieces
are slices of the array. Draws are digests of the key, so a row is cut alike wherever and whenever it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def code_points(text: bytes) -> np.ndarray:
    """UTF-8 as code points. Bytes that aren't UTF-8 stand for themselves, as lone surrogates."""
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def encoded(points: np.ndarray) -> bytes:
    """The UTF-8 of code points that ``code_points`` gave."""
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def borders(points: np.ndarray) -> np.ndarray:
    """Where tokens end, from 0 to the length: ``borders[k]`` is the end of the first ``k`` tokens."""
    if not len(points):
        return np.zeros(1, np.int64)
    letter = ((points | 32) - 97) < 26  # unsigned: below "a" is far above
    return np.concatenate(([0], np.flatnonzero(~(letter[1:] & letter[:-1])) + 1, [len(points)]))


def draws(key: Column, seed: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of the SHA-256 of ``seed`` and the key; a null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS, seed: str = "1:") -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every whole text.

    ``rate`` percent of the texts are cut, ``spm`` percent of them written suffix first. ``form`` is ``plain``, ``psm``
    or ``spm``; a plain output is the text, and its lengths are null. A null text is an empty one; empty texts and texts
    that hold a mark are plain; a null key draws like an empty text; equal rows give equal rows; an empty table an empty
    one. Other columns of ``docs`` don't come along.

    Each row is worked on by itself, in Arrow batches bounded by bytes: nothing is shuffled.
    """
    S.arrow_batches(docs.sparkSession)
    prefix, suffix, middle = marks
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(key), seed)
    plain = (whole == "") | (h3 % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains(whole, F.lit(mark))
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(key).alias("key"), whole.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    kind = docs.schema[key].dataType.simpleString()
    p, s, m = (x.encode() for x in marks)

    def cut(text: bytes, h1: int, h2: int, form: str) -> tuple:
        points = code_points(text)
        at = borders(points)
        n = len(at) - 1
        if form == "plain":
            return n, None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        i, j = int(at[a]), int(at[b])
        head, body, tail = encoded(points[:i]), encoded(points[i:j]), encoded(points[j:])
        return n, i, j - i, b"".join((p, head, s, tail, m, body) if form == "psm" else (s, tail, p, head, m, body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.text_buffer(batch.column(1))
            done = [cut(data[offsets[i] : offsets[i + 1]].tobytes(), h1, h2, form) for i, (h1, h2, form) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))))]
            n, first, second, out = zip(*done) if done else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), batch.column(4), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(out, pa.binary()).view(pa.string())],
                names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    found = rows.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("key", key)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of; exact, as a text that is cut holds no mark."""
    p, s, m = (F.lit(x) for x in marks)
    part = F.split_part
    rest = part(output, m, F.lit(1))
    prefix = F.when(form == "psm", part(part(rest, s, F.lit(1)), p, F.lit(2))).otherwise(part(rest, p, F.lit(2)))
    suffix = F.when(form == "psm", part(rest, s, F.lit(2))).otherwise(part(part(rest, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part(output, m, F.lit(2)), suffix))
