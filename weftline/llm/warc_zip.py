"""Web archives in ZIP packages: written by tasks, located by their directories, read by ranges without extraction.

A package is a ZIP file with stored members: ``archive/*.warc.gz`` (each record a gzip member of its own) and
``indexes/*.cdxj`` (a line with offset and length for each record). The reader parses the end records and the central
directory, in its 32-bit or its ZIP64 form, finds where members' bytes begin, reads the index, and then reads just the ranges of records.
Spark deals out packages, index members and runs of neighbouring records; a task holds one run at a time.

Packages lie in any file system that pyarrow opens (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

#: Bytes of written records after which a task begins its next package, and of records after which its next member.
PACKAGE_BYTES, MEMBER_BYTES = 1 << 28, 1 << 26
#: Bytes that one read takes at most, but for a longer record.
RUN_BYTES = 1 << 23
#: Payloads below this many bytes are always written whole.
LEAST_SHARED = 100
#: Level of the gzip members: archives are written once and large.
GZIP_LEVEL = 1

# Signatures and sizes of ZIP's records, and the names of WARC's.
_END, _END64_AT, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PACKAGES = "path string, bytes long"
MEMBERS = "path string, member string, method int, start long, stored long, size long"
POSITIONS = "path string, member string, start long, offset long, length long"


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


# ---- writing ----

def with_types(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """``pages`` with ``__digest`` and ``__refers``: of equal payloads of 100 bytes or more, the smallest key (not itself: NULL).

    A null payload is empty. A null key comes after all others; rows of the smallest key are all responses. Copies are
    counted before anything meets; a payload that many rows share meets one row.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumn("__digest", F.when(F.octet_length(body) >= LEAST_SHARED, F.sha2(body, 256)))
    first = rows.where("__digest is not null").groupBy("__digest").agg(F.min(key).alias("__first"), F.count("*").alias("__copies")).where("__copies > 1").drop("__copies")
    joined = rows.join(first, "__digest", "left")
    return joined.withColumn("__refers", F.when(~F.col(key).eqNullSafe(F.col("__first")), F.col("__first"))).drop("__first")


def _head(fields: list[tuple[str, str]]) -> bytes:
    clean = lambda v: "".join(c if c >= " " else "%{:02X}".format(ord(c)) for c in v)  # noqa: E731  (no field breaks a line)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields).encode() + b"\r\n"


def _record(key: object, url: str, payload: bytes, digest: str, refers: object) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    fields += [("WARC-Profile", _SAME_PAYLOAD), ("WARC-Refers-To", f"<urn:page:{refers}>")] if refers is not None else []
    return _head([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


class _Package:
    """A package as it is written: its records, then its index and its description."""

    def __init__(self, folder: str):
        self.files, base = _files(folder)
        self.path, self.uri = f"{base}/{uuid.uuid4().hex}.wacz", folder
        self.sink = self.files.open_output_stream(self.path)
        self.zip, self.member, self.index, self.parts, self.bytes, self.at = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED), None, [], 0, 0, 0

    def add(self, record: bytes, url: str, digest: str) -> None:
        if self.member is None or self.at >= MEMBER_BYTES:
            self._end_member()
            self.name, self.at, self.parts = f"data-{self.parts:05d}.warc.gz", 0, self.parts + 1
            self.member = self.zip.open(f"archive/{self.name}", "w", force_zip64=True)
        packed = gzip.compress(record, GZIP_LEVEL, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"url": url, "digest": f"sha256:{digest}", "filename": self.name, "offset": str(self.at), "length": str(len(packed))}))
        self.at, self.bytes = self.at + len(packed), self.bytes + len(packed)

    def _end_member(self) -> None:
        if self.member is not None:
            self.member.close()
            self.member = None

    def close(self) -> tuple[str, int]:
        self._end_member()
        self.zip.writestr("indexes/index.cdxj", "".join(f"- 19700101000000 {line}\n" for line in self.index))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}), zipfile.ZIP_DEFLATED)
        self.zip.close()
        self.sink.close()
        return f"{self.uri.rstrip('/')}/{self.path.rsplit('/', 1)[1]}", self.files.get_file_info(self.path).size


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write each row as a record, in packages in ``folder``; ``path, bytes`` of the packages.

    Payloads are the texts' UTF-8; null ones and null addresses are empty. An empty table writes nothing. A task that runs
    again writes packages of its own, and only those of the run that Spark counts are in the result; so use the result,
    which is written in the shared folder, not a listing.
    """
    S.arrow_batches(pages.sparkSession)
    typed = with_types(pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")), "key", "payload")
    typed = typed.select("key", "url", F.coalesce("__digest", F.sha2("payload", 256)).alias("digest"), "__refers", F.col("payload").cast("binary").alias("payload"))
    where = _files(folder)[0]
    where.create_dir(_files(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            for k, u, digest, refers, body in zip(*batch.columns):
                now = now or _Package(folder)
                now.add(_record(k.as_py(), u.as_py(), body.as_py(), digest.as_py(), refers.as_py()), u.as_py(), digest.as_py())
                if now.bytes >= PACKAGE_BYTES:
                    done, now = [*done, now.close()], None
        if now is not None:
            done.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    return S.materialize(typed.mapInArrow(run, PACKAGES))


# ---- directories ----

def packages(spark: SparkSession, folder: str, pattern: str = "*.wacz") -> DataFrame:
    """``path, bytes`` of a folder's packages, by listing alone."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))


def _directory(read: Callable[[int, int], bytes], size: int) -> tuple[int, int]:
    """``(start, bytes)`` of the central directory."""
    tail_at = max(0, size - 22 - _FULL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_END)
    while at >= 0:
        if at + 22 <= len(tail):
            entries, length, start, note = struct.unpack_from("<HIIH", tail, at + 10)
            wide = entries == _FULL16 or _FULL32 in (length, start) or tail[max(0, at - 20) : max(0, at - 16)] == _END64_AT
            if at + 22 + note <= len(tail) and (wide or start + length == tail_at + at):
                break
        at = tail.rfind(_END, 0, at)  # those were bytes of a comment
    if at < 0:
        raise ValueError("not a ZIP package: it has no end record")
    if wide:
        where = tail_at + at - 20
        mark = read(where, 20) if where >= 0 else b""
        if mark[:4] != _END64_AT:
            raise ValueError("not a ZIP package: its ZIP64 locator is missing")
        end = read(struct.unpack_from("<Q", mark, 8)[0], 56)
        if end[:4] != _END64:
            raise ValueError("not a ZIP package: its ZIP64 end record is missing")
        length, start = struct.unpack_from("<QQ", end, 40)
    return start, length


def _entries(read: Callable[[int, int], bytes], start: int, length: int, step: int = 1 << 20) -> Iterator[tuple[str, int, int, int, int]]:
    """``(name, method, stored bytes, size, place of the local header)`` of each member, in pieces of the directory."""
    have, at, end = b"", start, start + length
    while have or at < end:
        if at < end:
            piece = read(at, min(step, end - at))
            have, at = have + piece, at + len(piece)
        use = 0
        while use + 46 <= len(have):
            if have[use : use + 4] != _ENTRY:
                raise ValueError("not a ZIP package: its directory is broken")
            flags, method = struct.unpack_from("<HH", have, use + 8)
            stored, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", have, use + 20)
            local = struct.unpack_from("<I", have, use + 42)[0]
            after = use + 46 + n_name + n_extra + n_note
            if after > len(have):
                break
            name, extra = have[use + 46 : use + 46 + n_name], have[use + 46 + n_name : use + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # the values that don't fit, in this order
                    wide = list(struct.unpack_from(f"<{min(n, 24) // 8}Q", extra, 4))
                    size, stored, local = (wide.pop(0) if v == _FULL32 and wide else v for v in (size, stored, local))
                extra = extra[4 + n :]
            yield name.decode("utf-8" if flags & 0x800 else "cp437"), method, stored, size, local
            use = after
        have = have[use:]
        if at >= end and have and not use:
            raise ValueError("not a ZIP package: its directory ends early")


def _reader(path: str) -> Callable[[int, int], bytes]:
    files, inner = _files(path)
    source = files.open_input_file(inner)
    return lambda start, length: source.read_at(length, start)


def members(found: DataFrame) -> DataFrame:
    """``path, member, method, start, stored, size`` of all members of packages: where their bytes begin, and how many there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                read, rows = _reader(path), []
                for name, method, stored, whole, local in _entries(read, *_directory(read, size)):
                    head = read(local, 30)
                    if head[:4] != _LOCAL:
                        raise ValueError(f"{path}: no member at {local}")
                    rows.append((path, name, method, local + 30 + sum(struct.unpack_from("<HH", head, 26)), stored, whole))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)

    names = ["path", "member", "method", "start", "stored", "size"]
    kinds = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))))
    return found.select("path", "bytes").repartition("path").mapInArrow(run, MEMBERS)


def _pieces(path: str, start: int, stored: int, method: int, step: int = 1 << 20) -> Iterator[bytes]:
    """A member's bytes, inflated as they come if it isn't stored."""
    read, open_ = _reader(path), zlib.decompressobj(-15) if method == 8 else None
    if method not in (0, 8):
        raise ValueError(f"{path}: method {method} of a member is neither stored nor deflated")
    for at in range(0, stored, step):
        piece = read(start + at, min(step, stored - at))
        yield open_.decompress(piece) if open_ else piece


def _lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _scanned(pieces: Iterator[bytes]) -> Iterator[tuple[int, int]]:
    """``(offset, length)`` of the gzip members of an archive that no index covers."""
    at, begin, inflate = 0, 0, zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            inflate.decompress(piece, 1 << 20)
            while inflate.unconsumed_tail:
                piece_left = inflate.unconsumed_tail
                inflate.decompress(piece_left, 1 << 20)
            at += len(piece) - len(inflate.unused_data)
            piece = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                yield begin, at - begin
                begin, inflate = at, zlib.decompressobj(31)


def positions(found: DataFrame) -> DataFrame:
    """``path, member, start, offset, length`` of all records: from the packages' indexes, and by scanning archives that none covers.

    ``found`` is what ``members`` gives. Indexes may be stored, deflated or gzip files; archives have to be stored, as
    ranges are read from them.
    """
    found = S.materialize(found)
    archives = found.where(F.col("member").rlike(r"^archive/.*\.warc\.gz$"))
    indexes = found.where(F.col("member").rlike(r"^indexes/.*\.cdxj?(\.gz)?$"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, member, method, start, stored, _ in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = _pieces(path, start, stored, method)
                pieces = _unzipped(pieces) if member.endswith(".gz") else pieces
                rows = []
                for line in _lines(pieces):
                    at = line.find(b"{")
                    if at >= 0:
                        fact = json.loads(line[at:])
                        rows.append((path, f"archive/{fact['filename']}", int(fact["offset"]), int(fact["length"])))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)

    def scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, member, method, start, stored, _ in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(path, member, *x) for x in _scanned(_pieces(path, start, stored, method))]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)

    names = ["path", "member", "offset", "length"]
    kinds = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64()))))
    facts = "path string, member string, offset long, length long"
    listed = S.materialize(indexes.repartition("path", "member").mapInArrow(lines, facts))
    bare = archives.join(listed.select("path", "member").distinct(), ["path", "member"], "left_anti").select(*found.columns)
    known = listed.unionByName(bare.repartition("path", "member").mapInArrow(scans, facts))
    checked = archives.select("path", "member", F.when(F.col("method") == 0, F.col("start")).otherwise(F.raise_error(F.lit("an archive in a package is compressed"))).alias("start"))
    return known.join(checked, ["path", "member"]).select("path", "member", "start", "offset", "length")


def _unzipped(pieces: Iterator[bytes]) -> Iterator[bytes]:
    inflate = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            yield inflate.decompress(piece)
            piece, inflate = (inflate.unused_data, zlib.decompressobj(31)) if inflate.eof else (b"", inflate)


# ---- reading ----

def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """The fields (by lower-case name) and the block of a WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError("a WARC record ends early")
    return fields, rest[:length]


def read_records(found: DataFrame) -> DataFrame:
    """``record_id, type, url, digest, refers_to, payload`` of records at ``positions``; a revisit's payload is NULL.

    Neighbouring records are read at once, up to 8 MiB. A payload that doesn't have its record's digest is an error.
    """
    S.arrow_batches(found.sparkSession)
    runs = found.withColumn("run", F.expr(f"offset div {RUN_BYTES}")).repartition("path", "member", "run").sortWithinPartitions("path", "member", "offset")
    columns = ["path", "start", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read = None, None
        for batch in batches:
            rows, i = list(zip(*(c.to_pylist() for c in batch.columns))), 0
            while i < len(rows):
                if rows[i][0] != path:
                    path, read = rows[i][0], _reader(rows[i][0])
                j, (_, start, begin, length) = i + 1, rows[i]
                end = begin + length
                while j < len(rows) and rows[j][:2] == rows[i][:2] and rows[j][2] == end and end + rows[j][3] - begin <= RUN_BYTES:
                    end, j = end + rows[j][3], j + 1
                data, done, size = read(start + begin, end - begin), [], 0
                for _, _, offset, n in rows[i:j]:
                    done.append(_row(gzip.decompress(memoryview(data)[offset - begin : offset - begin + n])))
                    size += len(done[-1][5] or b"")
                    if size >= S.BATCH_BYTES:
                        yield _batch(done)
                        done, size = [], 0
                yield _batch(done)
                i = j

    return runs.select(*columns).mapInArrow(run, "record_id string, type string, url string, digest string, refers_to string, payload binary")


def _row(record: bytes) -> tuple:
    fields, block = _parsed(record)
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        payload = None
    elif digest and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {fields.get('warc-record-id')} doesn't have its payload digest")
    return fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri"), digest, fields.get("warc-refers-to"), payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["record_id", "type", "url", "digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, [pa.string()] * 5 + [pa.binary()])], names)


def page_records(spark: SparkSession, found: DataFrame, kind: str = "long") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of all records of packages.

    A revisit has the bytes and the digest of the payload that was read at the record it refers to; one whose record isn't in
    the packages has neither.
    """
    key = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    rows = read_records(positions(members(found)))
    rows = S.materialize(rows.select(key(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
                                     F.col("type").alias("record_type"), key(F.col("refers_to")).alias("refers_to"), F.col("digest").alias("__said")))
    revisits, responses = rows.where("record_type = 'revisit'"), rows.where("record_type <> 'revisit'")
    used = revisits.select(F.col("refers_to").alias("page_id"), F.col("__said").alias("payload_digest")).distinct()
    whole = responses.join(used, ["page_id", "payload_digest"], "left_semi").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    whole = whole.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("__said"), "payload_digest", "payload_bytes")
    found_again = revisits.select("page_id", "record_type", "refers_to", "__said").join(whole, ["refers_to", "__said"], "left")
    return responses.drop("__said").unionByName(found_again.drop("__said"))
