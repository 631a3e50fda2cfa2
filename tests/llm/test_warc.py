"""WARC files and the content-addressed archive against brute force and byte-exact round trips."""

import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from parley.llm import queries, warc

PAGES = "page_id long, url string, html string, payload string, digest int"


def pages():
    rng = random.Random(6)
    odd = ["a\r\n\r\nb", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é漢\x00\x85", " ", "\r\n", "x" * 70_000]
    bodies = [None, "", *odd, *(f"<p>{k}</p>" * rng.randrange(1, 50) for k in range(12))]
    rows = [(k, f"http://h/{k}", rng.choice(bodies), "x", 1) for k in rng.sample(range(1000), 120)]
    rows += [(2000 + k, "http://hot/ \x01\r\nWARC-Type: x", "hot", "x", 1) for k in range(80)]
    return rows + [rows[0], rows[0], (None, None, "hot", None, None), (None, "u", "only here", None, None), (3000, None, None, None, None)]


def brute(rows, least=0):
    """Multiset of (page_id, bytes, digest, type, refers_to)."""
    groups = {}
    for page, _, html, *_ in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for raw, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for k, page in enumerate(ids):
            again = k > 0 and len(raw) >= least
            out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, PAGES).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op13_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("least", [3, 10**6])
def test_small_payloads_stay_responses(spark, least):
    rows = pages()
    got = warc.archived_pages(spark.createDataFrame(rows, PAGES).repartition(3), least=least).drop("record_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, least)


def test_files_are_warc_and_hold_payloads_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    rows = pages()
    found = warc.archived_pages(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}").count()
    names = [f"{d}/{n}" for d, _, ns in os.walk(f"{tmp_path}/warc") for n in ns if n.endswith(".gz") and not n.startswith(".")]
    assert len(names) > 8
    records = [r for n in names for r in warc.parsed(n, open(n, "rb").read())]
    assert len(records) == found == len(rows)
    payloads = [p for _, _, p, f in records if f["warc-type"] == "response"]
    assert len(payloads) == len(set(payloads)) == len({(r[2] or "") for r in rows})
    assert all(not p for _, _, p, f in records if f["warc-type"] == "revisit")
    assert len({f["warc-record-id"] for *_, f in records}) == len(rows)
    for n in names:  # every byte belongs to a record
        raw = gzip.open(n).read()
        assert sum(len(h) + len(p) + 4 for _, h, p, _ in warc.parsed(n, raw)) == len(raw)
    assert spark.read.parquet(f"file://{tmp_path}/archive/payloads").count() == len(payloads)


def foreign(rng, n):
    """Records as other tools write them: own fields, folded lines, binary and repeated payloads."""
    for k in range(n):
        body = rng.choice([b"\x00\xff\r\n\r\nWARC/1.0\r\n", b"same" * 500, rng.randbytes(50), b""])
        http = rng.choice([b"", b"HTTP/1.0 404 Not Found\r\nServer:x\r\n\r\n"])
        kind = b"Content-Type: application/http;msgtype=response\r\n" if http else b"Content-Type: text/plain\r\n"
        yield b"WARC/1.0\r\nwarc-type:  resource\r\nX-Note: a\r\n  folded\r\n" + kind + b"Content-Length: %d\r\n\r\n" % len(http + body) + http + body + b"\r\n\r\n"


def test_foreign_records_come_back_byte_for_byte(spark, tmp_path):
    rng = random.Random(8)
    want = []
    os.mkdir(f"{tmp_path}/in")
    for k in range(4):
        records = list(foreign(rng, 30))
        want += records
        raw = b"".join(records) if k % 2 else b"".join(map(gzip.compress, records))
        open(f"{tmp_path}/in/{k}.warc", "wb").write(raw)
    read = warc.read_warc(spark, f"file://{tmp_path}/in")
    store = f"file://{tmp_path}/store"
    warc.archive(read.drop("fields").filter("at = 0"), store)
    warc.archive(read.drop("fields").filter("at > 0"), store, extend=True)
    back = warc.restore(spark, store, by="at")
    assert sorted(bytes(r.record) for r in back.select("record").collect()) == sorted(want)
    assert [(r.file, r.at) for r in back.orderBy("file", "at").collect()] == [(r.file, r.at) for r in read.orderBy("file", "at").collect()]
    stored = spark.read.parquet(f"{store}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() < len(want)


def test_broken_bytes_are_noticed(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    records = spark.createDataFrame([("r1", b"h", b"one"), ("r2", b"h", b"two")], "record_id string, head binary, payload binary")
    warc.archive(records, store)
    changed = spark.read.parquet(f"{store}/payloads").withColumn("payload", F.lit(b"tampered"))
    changed.write.parquet(f"{store}-2/payloads")
    spark.read.parquet(f"{store}/heads").write.parquet(f"{store}-2/heads")
    with pytest.raises(Exception, match="do not have the digest"):
        warc.restore(spark, f"{store}-2").collect()
    record = next(foreign(random.Random(1), 1))
    for raw, said in ((record[:-5], "ends early"), (b"junk\r\n" + record, "no record begins at byte 0"), (record + b"\r\n", f"byte {len(record)}"), (b"WARC/1.1\r\n\r\n", "no header")):
        with pytest.raises(ValueError, match=said):
            list(warc.parsed("f", raw))


def test_empty_table(spark, tmp_path):
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0
