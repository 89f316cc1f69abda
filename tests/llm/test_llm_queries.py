import hashlib
import re

import pytest
from oracle import DATA, needs_data, same

from riskframe.llm import queries


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@needs_data
def test_secret_digests(spark):
    """Against a brute-force scan of every text."""
    from test_secrets import base

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kinds = ("assign", "access", "hex")
    for r in queries.op2_secrets(spark, str(DATA)).collect():
        spans = base(texts[r.doc_id] or "")
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


@needs_data
def test_mixing_columns(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op4_mixing(spark, str(DATA)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text)) and r.taken in (0, r.size, 2 * r.size)
    total = sum(r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) < 0.02 * total


@needs_data
def test_shard_columns(spark):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op10_sharding(spark, str(DATA)).collect():
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 40
