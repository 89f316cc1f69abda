"""WARC archives: a normaliser for files that are one gzip stream, with a sidecar offset index.

Pages are written as archives that are one gzip stream each, rolled at a bounded size, with an inventory of their records.
The inventory tells which records revisit which. The normaliser inflates each archive once, as a stream, rewrites every
record as a gzip member of its own (revisits without their payload), and writes an index of the members' offsets beside
the archive. Readers then seek to single records.

Files get a new name in each attempt and are renamed when complete; only files named in the stored inventory count, so
tasks can be repeated. A task holds one record at a time. Folders of file: URIs must be shared; others go through pyarrow's file
systems, and a plain path is one of the cluster's default file system.
Archives of several members are read through to their end; a cut member or trailer, or anything after the last member, raises.

Defined results: null html is an empty payload; of equal payloads the records of the largest id are responses, however
many, and where all ids are null all are; a null url is written as a urn of the id; an empty table makes no archive;
other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm._shared import known_columns, local_path, qualified, scratch_root, staged

ARCHIVE_BYTES, ARCHIVE_RECORDS = 32 << 20, 20_000
CHUNK = 1 << 20
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INVENTORY = "path string, record int, page_id long, payload_bytes long, digest string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Schemes of Hadoop's file systems, and of pyarrow's for the same stores.
SCHEMES = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


class Store:
    """Opens, renames and makes folders for local and other URIs."""

    def __init__(self, uri: str):
        self.local = local_path(uri)
        if self.local:
            self.path = self.local
        else:
            from pyarrow import fs

            scheme, _, rest = uri.partition(":")
            if scheme not in SCHEMES:
                raise ValueError(f"archives go to stores of file, {', '.join(SCHEMES)}, not of {scheme}: {uri}")
            try:
                self.fs, self.path = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
            except (OSError, pa.ArrowException) as e:
                raise ValueError(f"the store of {uri} can't be opened: {e}") from e

    def reader(self):
        return open(self.path, "rb") if self.local else self.fs.open_input_file(self.path)

    def writer(self):
        folder = os.path.dirname(self.path)
        if self.local:
            os.makedirs(folder, exist_ok=True)
            return open(self.path + ".part", "wb")
        self.fs.create_dir(folder)
        return self.fs.open_output_stream(self.path + ".part")

    def commit(self):
        if self.local:
            os.replace(self.path + ".part", self.path)
        else:
            self.fs.move(self.path + ".part", self.path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {re.sub('[\r\n]+', ' ', v)}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    fields = [("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url or urn(page_id)[1:-1]), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return record("response", fields, http.encode() + payload)


def parse_head(head: bytes) -> dict[str, str]:
    """Fields of a header block, by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]) if k}


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file piece by piece, member after member. A member without its end or trailer, and anything after
    the last one that isn't a member, raises."""
    inflate, data, begun = zlib.decompressobj(31), b"", False
    while True:
        data = data or stream.read(CHUNK)
        if not data and not begun:
            return
        begun = True
        try:
            piece = inflate.decompress(data, 16 * CHUNK)
        except zlib.error as e:
            raise ValueError(f"the archive isn't whole gzip members: {e}") from e
        if inflate.eof:
            data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
        elif not data and not piece:
            raise ValueError("the archive ends within a gzip member")
        else:
            data = inflate.unconsumed_tail
        yield piece


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a gzip file, one at a time; whether it is one member or many makes no difference."""
    pieces, buffer, at = inflated(stream), bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del buffer[:at]
        at = 0
        buffer.extend(piece)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(buffer) > at:
                    raise ValueError("the archive ends within a record")
                return
        fields = parse_head(bytes(buffer[at:end]))
        size = int(fields["content-length"])
        at = end + 4
        while len(buffer) < at + size + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        if buffer[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        yield fields, bytes(buffer[at : at + size])
        at += size + 4


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = squeeze = None
        rows: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            store.commit()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["path", "record", "page_id", "payload_bytes", "digest"])

        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                if store is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, squeeze, rows, size = Store(path), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0
                    out = store.writer()
                digest = payload_digest(payload)
                made = response(page, url.as_py(), payload, digest)
                out.write(squeeze.compress(made))
                rows.append((path, len(rows), page, len(payload), digest))
                size += len(made)
                if size >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_RECORDS:
                    yield close()
                    store = None
        if store is not None:
            yield close()

    return write


def rewritten(fields: dict[str, str], block: bytes, refers_to: int | None) -> bytes:
    """A record as it came, or as a revisit of the page refers_to, with the HTTP head but without payload."""
    same = [(name, fields[name.lower()]) for name in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest")]
    if refers_to is None:
        return record("response", same, block)
    return record("revisit", [*same, ("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE)], block[: block.index(b"\r\n\r\n") + 4])


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (path, revisits) rows: archives of one member for each record, and their indexes."""
    for batch in batches:
        for row in batch.to_pylist():
            revisits = {r["record"]: r["refers_to"] for r in row["revisits"] or ()}
            path = re.sub(r"\.warc\.gz$", f"-{uuid.uuid4().hex[:8]}.members.warc.gz", row["path"])
            archive, index = Store(path), Store(path + ".index")
            offset = n = 0
            with Store(row["path"]).reader() as source, archive.writer() as out, index.writer() as lines:
                for n, (fields, block) in enumerate(records(source), 1):
                    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = squeeze.compress(rewritten(fields, block, revisits.get(n - 1))) + squeeze.flush()
                    out.write(member)
                    lines.write(json.dumps({"id": fields["warc-record-id"], "offset": offset, "length": len(member)}).encode() + b"\n")
                    offset += len(member)
            archive.commit()
            index.commit()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])


def indexed(path: str) -> Iterator[tuple[int, int]]:
    """Offset and length of each record, from the sidecar index."""
    with Store(path + ".index").reader() as f:
        rest = b""
        while data := f.read(CHUNK):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                entry = json.loads(line)
                yield entry["offset"], entry["length"]


def read_member(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """Fields, block, HTTP fields and payload of a record that is a gzip member."""
    whole = zlib.decompress(data, 31)
    end = whole.index(b"\r\n\r\n")
    fields = parse_head(whole[:end])
    block = whole[end + 4 : end + 4 + int(fields["content-length"])]
    cut = block.index(b"\r\n\r\n")
    return fields, block, parse_head(block[:cut]), block[cut + 4 :]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows: list[tuple] = []
            with Store(path).reader() as f:
                for offset, length in indexed(path):
                    f.seek(offset)
                    fields, _, http, payload = read_member(f.read(length))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload) != int(http["content-length"]) or payload_digest(payload) != digest):
                        raise ValueError(f"{path} at {offset}: the payload isn't what its digest says")
                    rows.append((page_of(fields["warc-record-id"]), int(http["content-length"]), digest, fields["warc-type"], page_of(fields.get("warc-refers-to"))))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of one gzip stream each, in folder; returns their stored inventory. A store that can't be used raises before anything is written."""
    folder = qualified(pages.sparkSession, folder)
    Store(folder)
    rows = known_columns(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return staged(rows.mapInArrow(_write(folder), INVENTORY), "inventory")


def revisits(inventory: DataFrame, least_bytes: int) -> DataFrame:
    """(path, revisits) of each archive: which of its records revisit which page."""
    first = inventory.filter(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    # Stored before records join it, so that a payload that very many pages have can be dealt to several tasks.
    many = staged(first.filter("n > 1 and refers_to is not null").drop("n"), "repeated")
    own = inventory.select("path", "record", "page_id", "digest").join(many, "digest").filter("not (page_id <=> refers_to)")
    found = own.groupBy("path").agg(F.collect_list(F.struct("record", "refers_to")).alias("revisits"))
    return inventory.select("path").distinct().join(found, "path", "left")


def spread_out(rows: DataFrame, n: int) -> DataFrame:
    """A task for each few archives: their rows are small but not the work on them."""
    return rows.repartition(max(1, min(2 * n, 10_000)), "path")


def normalise(archives: DataFrame, n: int) -> DataFrame:
    """(path, records) of the stored normalised archives; each has its index beside it under path + '.index'."""
    return staged(spread_out(archives, n).mapInArrow(_normalise, "path string, records long"), "archives")


def read_archives(archives: DataFrame, n: int) -> DataFrame:
    """Each record of normalised archives, payloads checked against their digests."""
    return spread_out(archives.select("path"), n).mapInArrow(_read, READ)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = folder or f"{scratch_root(pages.sparkSession)}/warc"
    inventory = write_archives(pages, folder)
    found = staged(revisits(inventory, least_bytes), "revisits")
    n = found.count()
    return read_archives(normalise(found, n), n)
