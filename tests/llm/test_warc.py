import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairsift.llm import common, warc
from pairsift.llm.warc import archive_pages, archive_warc, field, page_of, read_archive, read_warc, write_warc

PAGES = "page_id long, url string, html string, header string, sha256 string, n int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "s", 1) for r in rows], PAGES)


def archived(spark, rows, folder):
    archive_pages(pages(spark, rows).repartition(3), folder)
    return read_archive(spark, folder)


def told(back):
    out = back.select(
        page_of(field(F.col("header"), "WARC-Record-ID")).alias("page_id"),
        F.col("payload").alias("payload"),
        field(F.col("header"), "WARC-Type").alias("kind"),
        page_of(field(F.col("header"), "WARC-Refers-To")).alias("refers_to"),
    )
    return sorted(((r["page_id"], bytes(r["payload"]), r["kind"], r["refers_to"]) for r in out.collect()), key=str)


def brute(rows):
    groups = {}
    for page_id, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page_id is not None, page_id, url is not None, url))
    out = []
    for payload, mine in groups.items():
        mine = sorted(mine, key=lambda r: (r[0], r[1] or 0, r[2], r[3] or ""), reverse=True)
        for i, r in enumerate(mine):
            revisit = len(payload) >= 1000 and i > 0
            out.append((r[1], payload, "revisit" if revisit else "response", mine[0][1] if revisit else None))
    return sorted(out, key=str)


def some_rows():
    big, other = "<p>ä" * 400, "x" * 999
    rows = [(i, f"http://h/{i}", big) for i in range(30)] + [(40 + i, f"http://h/{i}", other) for i in range(3)]
    rows += [(50, "u", "y" * 1000), (51, "u", "y" * 1000), (51, "u", "y" * 1000), (51, "v", "y" * 1000), (51, None, "y" * 1000)]
    rows += [(None, "n", "z" * 1000), (None, "n", "z" * 1000), (None, None, "z" * 1000), (-3, "neg", "z" * 1000), (None, "only", "w" * 1000), (None, None, "w" * 1000)]
    rows += [(60, "u", None), (61, "u", ""), (62, None, None), (62, None, None), (63, "u\r\nWARC-Type: revisit\r\n", "q"), (64, "http://h/ é%20", "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n")]
    return rows


@pytest.mark.parametrize("hot", [True, False])
def test_against_brute_force(spark, tmp_path, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = some_rows()
    back = archived(spark, rows, str(tmp_path / "a"))
    assert told(back) == brute(rows)
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert stored.count() == len({r[2] or "" for r in rows}) == stored.select("sha256").distinct().count()


def test_records_are_exact(spark, tmp_path):
    rows = some_rows()
    back = archived(spark, rows, str(tmp_path / "a"))
    ids = set()
    for r in back.collect():
        header, http, payload, record = (bytes(r[c]) for c in ("header", "http", "payload", "record"))
        lines = header.decode("ascii").split("\r\n")
        assert lines[0] == "WARC/1.1" and lines[-2:] == ["", ""]
        fields = dict(x.split(": ", 1) for x in lines[1:-2])
        assert len(fields) == len(lines) - 3
        block = http + (payload if fields["WARC-Type"] == "response" else b"")
        assert record == header + block + b"\r\n\r\n" and int(fields["Content-Length"]) == len(block)
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
        assert http.endswith(f"Content-Length: {len(payload)}\r\n\r\n".encode())
        ids.add(fields["WARC-Record-ID"])
    assert len(ids) == len(rows)
    uris = {r[0] for r in back.select(field(F.col("header"), "WARC-Target-URI")).collect()}
    assert {"u%0D%0AWARC-Type:%20revisit%0D%0A", "http://h/%20%C3%A9%20", None} <= uris
    known = {r[0] for r in back.select(field(F.col("header"), "WARC-Record-ID")).collect()} | {None}
    assert {r[0] for r in back.select(field(F.col("header"), "WARC-Refers-To")).collect()} <= known


def test_warc_files_round_trip(spark, tmp_path):
    rows = some_rows()
    back = archived(spark, rows, str(tmp_path / "a"))
    write_warc(back, str(tmp_path / "files"), records_per_file=7)
    files = sorted((tmp_path / "files").glob("part-*"))
    want = sorted(bytes(r[0]) for r in back.select("record").collect())
    assert len(files) >= len(rows) // 7 and sum(f.stat().st_size for f in files) == sum(map(len, want))
    read = read_warc(spark, str(tmp_path / "files"))
    assert sorted(bytes(r["header"]) + bytes(r["http"]) + bytes(r["payload"] or b"") + b"\r\n\r\n" for r in read.collect()) == want
    archive_warc(spark, str(tmp_path / "files"), str(tmp_path / "b"))
    assert sorted(bytes(r[0]) for r in read_archive(spark, str(tmp_path / "b")).select("record").collect()) == want


def test_gzip_members_and_other_records(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\ncontent-length:  9 \r\n\r\nsoftware:\r\n\r\n"
    page = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 27\r\nX-Long: " + b"l" * 9000 + b"\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\xff\x00\r\n\r\n!!\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w/one.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page) + gzip.compress(page))
    got = sorted(((bytes(r["http"]), bytes(r["payload"])) for r in read_warc(spark, str(tmp_path / "w")).collect()))
    assert got == [(b"", b"software:"), *[(b"HTTP/1.1 200 OK\r\n\r\n", b"\xff\x00\r\n\r\n!!")] * 2]
    archive_warc(spark, str(tmp_path / "w"), str(tmp_path / "c"))
    assert sorted(bytes(r["record"]) for r in read_archive(spark, str(tmp_path / "c")).collect()) == sorted([info, page, page])
    for name, body in (("cut", info[:-10]), ("wrong", b"no record\r\n\r\n"), ("open", b"WARC/1.0\r\nContent-Length: 1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(body)
        with pytest.raises(PySparkException):
            read_warc(spark, str(tmp_path / name)).collect()


def test_damage_is_found(spark, tmp_path):
    rows = [(i, "u", f"{i}" * 1200) for i in range(3)]
    folder = str(tmp_path / "a")
    archived(spark, rows, folder)
    held = spark.read.parquet(f"{folder}/payloads").collect()
    swap = [(held[0]["sha256"], held[0]["n"], held[1]["frame"]), (held[1]["sha256"], held[1]["n"], held[1]["frame"]), (held[2]["sha256"], held[2]["n"], held[2]["frame"])]
    for name, stored, said in (("swapped", swap, "not that of SHA-256"), ("lacking", swap[1:], "has no payload")):
        spark.createDataFrame(stored, "sha256 string, n int, frame binary").write.parquet(str(tmp_path / name / "payloads"))
        spark.read.parquet(f"{folder}/records").write.parquet(str(tmp_path / name / "records"))
        with pytest.raises(PySparkException, match=said):
            read_archive(spark, str(tmp_path / name)).select(F.sha1("payload")).collect()


def test_empty_table(spark, tmp_path):
    assert archived(spark, [(1, "u", "x")], str(tmp_path / "a")).count() == 1
    archive_pages(pages(spark, [(1, "u", "x")]).limit(0), str(tmp_path / "b"))
    assert read_archive(spark, str(tmp_path / "b")).collect() == []
