import hashlib

import pytest

from vigil.llm import warc
from vigil.llm.common import fresh_path
from vigil.llm.warc import archived_pages, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, offset string"
INSIDE = ["x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nPage-ID: 999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nhm",
          "WARC/1.1\r\n", "a" * 3000 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100000\r\n\r\nzz",
          "WARC/1.1\r\nWARC/1.1\r\n" * 20, "end\r\n\r\n", "\r\n\r\n" * 60, "WARC/1.1", "Content-Length: 3\r\n"]
PAGES = [(1, "http://a", "é" * 300), (2, "http://b\r\nWARC/1.1\r\n x", "é" * 300), (3, None, None), (4, "u", "tiny"), (5, "u", "tiny"),
         (None, "u", "é" * 300), (11, "u", ""), *[(20 + i, "u", h) for i, h in enumerate(INSIDE)], (40, "u", INSIDE[2]),
         *[(100 + i, "u", f"page {i} " + "y" * (i * 37 % 3000)) for i in range(150)], (300, "u", "z" * 200_000)]


def by_hand(pages):
    first, out = {}, []
    for key, _, html in pages:
        body = (html or "").encode()
        if key is not None and len(body) >= 100:
            first[body] = min(key, first.get(body, key))
    for key, _, html in pages:
        body = (html or "").encode()
        again = key is not None and len(body) >= 100 and first[body] != key
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bytes_at_once,broadcast", [("4k", 50_000), ("700b", -1), ("128m", 50_000)])
def test_round_trip(spark, monkeypatch, bytes_at_once, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    path = fresh_path(spark, "warc")
    write_archives(spark.createDataFrame([(*p, "x") for p in PAGES], SCHEMA).repartition(3), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_at_once)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert sorted((tuple(r) for r in archived_pages(spark, path).collect()), key=str) == by_hand(PAGES)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeated_rows_and_empty_table(spark):
    pages = [(1, "u", "q" * 100), (1, "u", "q" * 100), (2, "u", "q" * 100), (3, "u", "q" * 99), (4, "u", "q" * 99)]
    path = fresh_path(spark, "warc")
    write_archives(spark.createDataFrame([(*p, "x") for p in pages], SCHEMA), path)
    assert sorted((tuple(r) for r in archived_pages(spark, path).collect()), key=str) == by_hand(pages)
    path = fresh_path(spark, "warc")
    write_archives(spark.createDataFrame([], SCHEMA), path)
    assert archived_pages(spark, path).count() == 0


def test_only_records_reached_from_the_start_count(spark, tmp_path):
    """A record cut off at the end, a file that starts with other bytes, and a chain that jumps over a fake."""
    def record(body, kind="response"):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nPage-ID: 7\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    good = [b"one", record(b"inner") + b"tail", b"x" + record(record(b"deep")), b"last"]
    files = {"whole": b"".join(map(record, good)), "cut": record(b"first") + record(b"gone")[:-6], "late": b"junk" + record(b"never")}
    for name, data in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    got = sorted(r.digest for r in read_archives(spark, str(tmp_path)).collect())
    assert got == sorted(hashlib.sha256(b).hexdigest() for b in [*good, b"first"])
