"""WARC records in ZIP packages: written for pages, and read by ranges without extracting anything.

A package is a ZIP of *stored* members, after the layout of web-archive collections: ``archive/data.warc.gz`` (one gzip
member for each record), ``indexes/index.cdxj`` (a line for each record: sort key, time, JSON with offset and length)
and ``datapackage.json``. Since members are stored, a record is a byte range of the package itself.

Reading takes three narrow steps over a table of paths: the end-of-central-directory record, its ZIP64 locator and record
where sizes call for them, and the central directory give each member's place; a member's local header gives where its
data begin; index lines, read in pieces, give each record's range, and a walk over the gzip members gives those of what no
index line covers, or of an archive without an index. The ranges are spread over tasks, packages cut into runs of neighbouring records, and each run is one read. No step reads a
whole package; a compressed member can't be range-read and is an error.

Defined results: a null URL or null html is written without its header or with ``X-Null-Block`` and comes back null; empty
html comes back empty; ids, URLs and texts of any length and any characters but line breaks in a URL, which are escaped,
come back as they were; repeated rows are repeated records; an empty table makes no package and reads as no records;
other columns are not written. Of packages by other tools, records of type resource, response and conversion are pages,
without an id; an HTTP response is read without its header, and decoded as that says; others (warcinfo, request,
metadata, revisit) are no pages. Header names have any case; a record listed twice is read once. A text that isn't
in its charset is read as UTF-8 with replacement characters.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.arrow import batch_of
from siltbed.llm.scratch import Scratch

RUN_BYTES = 4 << 20
_PACKAGE = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_MEMBER = pa.schema([("path", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("size", pa.int64())])
_RANGE = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("lengths", pa.list_(pa.int64()))])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# --- writing -------------------------------------------------------------------------------------------------------


def _record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {quote(url, safe=_SAFE)}"] if url is not None else []
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    head += ["X-Null-Block: 1"] if html is None else []
    head += ["X-Escaped: 1"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) not in "%")


class PackageWriter:
    """A ZIP of stored members, written front to back; ``zip64`` forces the large format, else it is used where needed."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.entries, self.zip64 = out, 0, [], zip64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes]) -> None:
        """Sizes follow the data in a descriptor, so nothing is held."""
        raw, begin, crc, size = name.encode(), self.at, 0, 0
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 8 | 0x800, 0, 0, 33, 0, 0, 0, len(raw), 0) + raw)
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
            self._write(part)
        wide = self.zip64 or size >= 0xFFFFFFFF
        self._write(struct.pack("<4sIQQ" if wide else "<4sIII", b"PK\7\x08", crc, size, size))
        self.entries.append((raw, crc, size, begin))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, place in self.entries:
            wide = self.zip64 or max(size, place) >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, place) if wide else b""
            s, p = (0xFFFFFFFF, 0xFFFFFFFF) if wide else (size, place)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 8 | 0x800, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, p) + raw + extra)
        size, n = self.at - begin, len(self.entries)
        if self.zip64 or n >= 0xFFFF or max(size, begin) >= 0xFFFFFFFF:
            end = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, begin))
            self._write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            n, size, begin = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, size, begin, 0))


def write_packages(pages: DataFrame, folder: str, zip64: bool = True, index: bool = True) -> DataFrame:
    """Writes a package for each task to ``folder``, which all executors share; (path, records, bytes) of each.

    A task writes under a name of its own and then renames, so a repeated attempt replaces its package by an equal one.
    """

    def write(batches):
        system, base = _open(folder)
        part = TaskContext.get().partitionId()
        name, draft = f"{base}/part-{part:06d}.wacz", f"{base}/.{uuid.uuid4().hex}"
        lines, n = [], 0
        out = None

        def records():
            nonlocal n
            offset = 0
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    data = gzip.compress(_record(page_id, url, html), 6, mtime=0)
                    lines.append(f"{quote(url or '', safe=_SAFE)} 19700101000000 {json.dumps({'offset': offset, 'length': len(data), 'filename': 'data.warc.gz'})}\n".encode())
                    offset, n = offset + len(data), n + 1
                    yield data

        source = records()
        first = next(source, None)
        if first is None:
            return
        out = system.open_output_stream(draft)
        zipped = PackageWriter(out, zip64)
        zipped.member("archive/data.warc.gz", (x for part_ in ((first,), source) for x in part_))
        if index:
            zipped.member("indexes/index.cdxj", iter(lines))
        zipped.member("datapackage.json", iter([json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz"}]}).encode()]))
        zipped.close()
        out.close()
        system.move(draft, name)
        yield batch_of(_PACKAGE, [f"{folder}/part-{part:06d}.wacz"], [n], [zipped.at])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, "path string, records long, bytes long")


# --- reading -------------------------------------------------------------------------------------------------------


def _at(f, start: int, size: int) -> bytes:
    f.seek(start)
    return f.read(size)


def central_directory(f, size: int) -> list[tuple[str, int, int, int, int]]:
    """(name, method, packed size, size, place of the local header) of each member, by reads of the directory only."""
    tail_at = max(0, size - 65557)
    tail = _at(f, tail_at, size - tail_at)
    k = tail.rfind(b"PK\5\6")
    if k < 0:
        raise ValueError("no end of central directory")
    n, length, begin = struct.unpack_from("<HII", tail, k + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or begin == 0xFFFFFFFF:
        where = tail_at + k - 20
        mark, _, place, _ = struct.unpack("<4sIQI", _at(f, where, 20)) if where >= 0 else (b"", 0, 0, 0)
        if mark == b"PK\6\7":
            mark, *_, n, length, begin = struct.unpack("<4sQHHIIQQQQ", _at(f, place, 56))
            if mark != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
    data, p, out = _at(f, begin, length), 0, []
    for _ in range(n):
        mark, method, packed, plain, a, b, c, place = struct.unpack_from("<4s6xH8xIIHHH8xI", data, p)
        if mark != b"PK\1\2":
            raise ValueError("broken central directory")
        name, extra = data[p + 46 : p + 46 + a].decode("utf-8", "replace"), data[p + 46 + a : p + 46 + a + b]
        while len(extra) >= 4:
            tag, m = struct.unpack_from("<HH", extra)
            if tag == 1:  # only fields that are full in the entry are here, in this order
                wide = list(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                place = wide.pop(0) if place == 0xFFFFFFFF else place
            extra = extra[4 + m :]
        out.append((name, method, packed, plain, place))
        p += 46 + a + b + c
    return out


def members(packages: DataFrame) -> DataFrame:
    """(path, member, start, size) of the archives and indexes that each package stores, ranges of the package itself."""

    def locate(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, base = _open(path)
                with system.open_input_file(base) as f:
                    rows = []
                    for name, method, packed, _, place in central_directory(f, f.size()):
                        if name.startswith(("archive/", "indexes/")) and not name.endswith("/"):
                            if method:
                                raise ValueError(f"{path}: {name} is compressed and can't be range-read")
                            a, b = struct.unpack("<HH", _at(f, place + 26, 4))
                            rows.append((path, name, place + 30 + a + b, packed))
                if rows:
                    yield batch_of(_MEMBER, *map(list, zip(*rows)))

    return packages.select("path").mapInArrow(locate, "path string, member string, start long, size long")


def _walk(f, start: int, size: int, at: int = 0) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member of an archive from ``at`` to ``size``, by inflating it in pieces."""
    begun, left, engine = at, b"", zlib.decompressobj(31)
    while at < size or left:
        data = left
        if not data:
            data = _at(f, start + at, min(1 << 20, size - at))
            at += len(data)
        engine.decompress(data)
        left = engine.unused_data if engine.eof else b""
        if engine.eof:
            end = at - len(left)
            yield begun, end - begun
            begun, engine = end, zlib.decompressobj(31)


def _index_lines(f, start: int, size: int, packed: bool) -> Iterator[str]:
    """Lines of an index member, read in pieces."""
    engine, rest, at = zlib.decompressobj(31), b"", 0
    while at < size:
        data = _at(f, start + at, min(1 << 20, size - at))
        at += len(data)
        while packed and data:
            rest += engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
        *lines, rest = (rest + data).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in lines)
    if rest:
        yield rest.decode("utf-8", "replace")


def _archive_of(filename: str, archives: dict[str, tuple[int, int]]) -> str | None:
    """The archive that an index means: by its full name, its name under ``archive/``, or a base name that only one has."""
    for name in (filename, f"archive/{filename}"):
        if name in archives:
            return name
    same = [n for n in archives if n.split("/")[-1] == filename.split("/")[-1]]
    return same[0] if len(same) == 1 else None


def _records(f, start: int, size: int, listed: np.ndarray) -> Iterator[tuple[int, int]]:
    """(offset, length) of all records of an archive in order: those an index lists, and, walked, those in what none covers."""
    end = 0
    for offset, length in listed.tolist():
        if offset < end:  # listed again
            continue
        if offset > end:
            yield from _walk(f, start, offset, end)
        yield offset, length
        end = offset + length
    if end < size:
        yield from _walk(f, start, size, end)


def ranges(found: DataFrame) -> DataFrame:
    """(path, start, size, lengths): runs of neighbouring records of up to ``RUN_BYTES``, from indexes as far as they go."""

    def runs(batches):
        rows: dict[str, list[tuple[str, int, int]]] = {}
        for batch in batches:
            for path, name, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault(path, []).append((name, start, size))
        for path, own in rows.items():
            system, base = _open(path)
            with system.open_input_file(base) as f:
                archives = {n: (s, z) for n, s, z in own if n.startswith("archive/") and ".warc" in n}
                places = {n: array("q") for n in archives}  # 16 bytes a record
                for name, start, size in own:
                    if name.startswith("indexes/") and ".cdx" in name:
                        for line in _index_lines(f, start, size, name.endswith(".gz")):
                            if (k := line.find("{")) >= 0:
                                x = json.loads(line[k:])
                                if (which := _archive_of(x["filename"], archives)) is not None:
                                    places[which].extend((int(x["offset"]), int(x["length"])))
                for name, (start, size) in archives.items():
                    listed = np.frombuffer(places[name], np.int64).reshape(-1, 2)
                    run, lengths, end = None, [], None
                    for offset, length in _records(f, start, size, listed[np.argsort(listed[:, 0], kind="stable")]):
                        if run is None or offset != end or end - run + length > RUN_BYTES:
                            if lengths:
                                yield batch_of(_RANGE, [path], [start + run], [end - run], [lengths])
                            run, lengths = offset, []
                        lengths.append(length)
                        end = offset + length
                    if lengths:
                        yield batch_of(_RANGE, [path], [start + run], [end - run], [lengths])

    return found.mapInArrow(runs, "path string, start long, size long, lengths array<long>")


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name, folded lines joined."""
    text = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ")
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in text.split("\r\n")[1:]) if colon}


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-cased name, block)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (k := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:k].split(b";")[0], 16)
        except ValueError:
            return body  # it only says that it is chunked
        if n == 0:
            return b"".join(out)
        out.append(body[k + 2 : k + 2 + n])
        at = k + 2 + n + 2
    return b"".join(out) if out else body


def page_of(fields: dict[str, str], block: bytes) -> tuple[str, str] | None:
    """(kind, text) of a record that holds a page: a resource's block, or an HTTP response's body, decoded; else None."""
    kind = fields.get("warc-type", "").lower()
    if kind not in ("resource", "response", "conversion"):
        return None
    mime = fields.get("content-type", "").lower()
    if kind == "response" and mime.startswith("application/http"):
        head, _, block = block.partition(b"\r\n\r\n")
        http = _fields(head)
        if "chunked" in http.get("transfer-encoding", "").lower():
            block = _dechunked(block)
        if http.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
            try:
                block = zlib.decompress(block, 47)
            except zlib.error:
                pass  # stored decoded, as many crawlers do
        mime = http.get("content-type", "").lower()
    charset = mime.partition("charset=")[2].split(";")[0].strip("\"' ") or "utf-8"
    try:
        return kind, block.decode(charset, "surrogatepass")
    except (LookupError, UnicodeError):
        return kind, block.decode("utf-8", "replace")


def read_records(spans: DataFrame) -> DataFrame:
    """(page_id, url, html) of all records in these ranges, one read for each run."""

    def read(batches):
        for batch in batches:
            for path, start, size, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                system, base = _open(path)
                with system.open_input_file(base) as f:
                    data = _at(f, start, size)
                out, at = [], 0
                for n in lengths:
                    fields, block = parse_record(gzip.decompress(data[at : at + n]))
                    at += n
                    if (page := page_of(fields, block)) is None:
                        continue
                    url, own = fields.get("warc-target-uri"), fields.get("x-page-id")
                    if own is not None or "x-null-block" in fields or fields.get("x-escaped"):  # of the writer here, which escapes
                        url = unquote(url, errors="surrogatepass") if url is not None else None
                    elif url is not None:
                        url = url.strip("<>")
                    out.append((int(own) if own is not None else None, url, None if "x-null-block" in fields else page[1]))
                if out:
                    yield batch_of(_RECORD, *map(list, zip(*out)))

    return spans.mapInArrow(read, "page_id long, url string, html string")


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of every package; ``packages`` has a column ``path``."""
    parts = max(1, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = ranges(members(packages.select("path").repartition(parts, "path")))
    return read_records(spans.repartition(parts, "path", "start"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Packs the pages in the shared folder and reads them back from there."""
    folder = Scratch(spark, "packages").root  # goes when the session ends, since the result reads it
    if folder.startswith("file:") or "://" not in folder:
        system, base = _open(folder)
        system.create_dir(base)
    done = write_packages(pages, folder).select("path").collect()  # a path for each task
    if not done:
        return spark.createDataFrame([], "page_id long, url string, html string")
    return read_packages(spark.createDataFrame([(r[0],) for r in done], "path string"))


SQL = "select page_id, url, html from pages"
