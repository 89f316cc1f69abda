import glob
import gzip

import pytest
from pyspark.sql import functions as F

from riskframe.llm import warc

KIND = "page_id long, url string, html string, digest string, record int, path string"


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>a</p>", "<p>é😀</p>", None, "", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n", "x" * 3_000_000]
    rows = [(i, None if i % 5 == 0 else f"http://h/{i}\r\nX: y", html[i % 6], "d", 1, "p") for i in range(40)]
    return spark.createDataFrame([*rows, (39, "u", html[3], "d", 1, "p"), (None, "u", "only null", "d", 1, "p"), (None, "u", html[0], "d", 1, "p")], KIND).repartition(3)


def brute(rows):
    top = {}
    for i, html in rows:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    out = []
    for i, html in rows:
        data, last = (html or "").encode(), top.get(html or "")
        own = last is None or i == last
        out.append((i, len(data), warc.payload_digest(data), "response" if own else "revisit", None if own else last))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1000, 5])
def test_round_trip(pages, monkeypatch, tmp_path, most):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", most)
    monkeypatch.setattr(warc, "CHUNK", 4096)
    got = warc.archive_round_trip(pages, folder=f"file://{tmp_path}").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r.page_id, r.html) for r in pages.collect()])
    for path in glob.glob(f"{tmp_path}/*.members.warc.gz"):
        offsets = list(warc.indexed(path))
        data = open(path, "rb").read()
        assert sum(n for _, n in offsets) == len(data)
        assert b"".join(gzip.decompress(data[a : a + n]) for a, n in offsets) == gzip.decompress(data)
    assert not glob.glob(f"{tmp_path}/*.part")


def test_small_payloads_stay_responses(pages):
    rows = warc.archive_round_trip(pages, least_bytes=9).collect()
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 9) and any(r.record_type == "revisit" for r in rows)


def test_empty_table(pages):
    assert warc.archive_round_trip(pages.filter(F.lit(False))).count() == 0


def packed(*blocks):
    import zlib

    return zlib.compress(b"".join(warc.response(i, "u", b, "D") for i, b in enumerate(blocks)), wbits=31)


def blocks_of(data):
    import io

    return [block.partition(b"\r\n\r\n")[2] for _, block in warc.records(io.BytesIO(data))]


def test_cut_archives_are_noticed():
    data = packed(b"body")
    assert blocks_of(data) == [b"body"]
    for cut in (len(data) // 2, len(data) - 8, len(data) - 1):
        with pytest.raises(ValueError):
            blocks_of(data[:cut])
    for after in (b"rubbish", b"\0" * 5, data[:9], data[: len(data) - 3]):
        with pytest.raises(ValueError):
            blocks_of(data + after)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_several_members(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    assert blocks_of(packed(b"a", b"b" * 99) + packed() + packed(b"c")) == [b"a", b"b" * 99, b"c"]
    whole = packed(b"a", b"b")
    middle = warc.response(0, "u", b"cut", "D")
    import zlib

    parts = zlib.compress(middle[:40], wbits=31) + zlib.compress(middle[40:], wbits=31)
    assert blocks_of(whole + parts) == [b"a", b"b", b"cut"]
    with pytest.raises(ValueError):
        blocks_of(whole + zlib.compress(middle[:-2], wbits=31))
    assert blocks_of(b"") == []


def test_plain_paths_belong_to_the_default_file_system(spark, tmp_path):
    """Another default file system than the local one: a mount table of its own."""
    from riskframe.llm import _shared

    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert _shared.qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and _shared.qualified(spark, "s3a://b/x") == "s3a://b/x"
    conf.set("fs.viewfs.mounttable.other.link./user", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://other/")
    try:
        assert _shared.qualified(spark, "/user/x") == "viewfs://other/user/x"
    finally:
        conf.set("fs.defaultFS", before or "file:///")
    assert _shared.local_path("viewfs://other/user/x") is None


def test_object_stores(monkeypatch, tmp_path):
    """An archive in a store that Hadoop and pyarrow name differently."""
    import pyarrow as pa
    from pyarrow import fs

    opened = []
    store = lambda uri: opened.append(uri) or (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), uri.split("://")[1])
    monkeypatch.setattr(fs, "FileSystem", type("Stores", (), {"from_uri": staticmethod(store)}))
    pages = pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["u", None], "html": ["<p>é</p>", None]}, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))
    inventory = [r for batch in warc._write("s3a://bucket/warc")(iter([pages])) for r in batch.to_pylist()]
    assert {r["path"].rsplit("/", 1)[0] for r in inventory} == {"s3a://bucket/warc"}
    rows = pa.RecordBatch.from_pylist([{"path": inventory[0]["path"], "revisits": [{"record": 1, "refers_to": 1}]}])
    archives = [b.select([0]) for b in warc._normalise(iter([rows]))]
    read = [tuple(r.values()) for b in warc._read(iter(archives)) for r in b.to_pylist()]
    assert read == [(1, 9, warc.payload_digest("<p>é</p>".encode()), "response", None), (2, 0, warc.payload_digest(b""), "revisit", 1)]
    assert opened and all(u.startswith("s3://bucket/warc/") for u in opened)


def test_stores_that_cannot_be_used_raise_before_any_write(spark, pages):
    for folder in ("ftp://h/x", "wasb://c@a/x"):
        with pytest.raises(ValueError, match="stores of file"):
            warc.archive_round_trip(pages, folder=folder)
