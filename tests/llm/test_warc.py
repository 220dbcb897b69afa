from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.warc import arc_records, archive, convert, read_arc, read_warc, write_arc

from .data import clashing

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "x" * 200


def rows():
    return [
        (5, "http://a/", LONG), (3, "http://b/ with space", LONG), (9, "http://c/", LONG), (1, "http://d/", "short"), (2, "http://e/", "short"),
        (10, None, None), (11, "http://f/", ""), (None, "http://g/", LONG), (12, "http://h/", "ü" * 50), (13, "http://i/", "ü" * 50), (14, "http://j/", "ü" * 49 + "x"),
        (15, "http://k/", "WARC/1.0\r\n\r\n\r\nContent-Length: 3\r\n\r\n\n\nhttp://x 0.0.0.0 20200101000000 text/html 5\nabc" * 9), (16, "http://l/", "y" * 3_000_000),
        (5, "http://a/", LONG), (17, "\x00", "z\r\n\r\n" * 40), (18, "http://m/", "z\r\n\r\n" * 40),
    ]


def plain(pages):
    out = []
    first = {}
    for i, _, html in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        known = len(body) >= 100 and digest in first
        out.append((i, len(body), digest, "revisit" if known else "response", first[digest] if known else None))
        first.setdefault(digest, i)
    return sorted(out, key=repr)


def test_round_trip_matches_plain_version(spark):
    table = clashing(spark.createDataFrame(rows(), PAGES).repartition(3), "id", "uri", "digest")
    got = archive(table).drop("uri").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain(rows())


@pytest.mark.parametrize("version", [1, 2])
def test_payloads_survive_both_versions(spark, tmp_path, version):
    pages = spark.createDataFrame(rows(), PAGES)
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    write_arc(pages, arc, "page_id", "url", "html", F.timestamp_seconds(F.lit(86400)), F.lit("10.0.0.1"), version)
    legacy = read_arc(spark, arc).collect()
    want = sorted(repr((None if i is None else str(i), (h or "").encode())) for i, _, h in rows())
    assert sorted(repr((r.id, bytes(r.payload))) for r in legacy) == want
    assert {(r.date, r.ip, r.mime, r.status) for r in legacy} == {("1970-01-02T00:00:00Z", "10.0.0.1", "text/html", "200" if version == 2 else None)}
    assert {r.uri for r in legacy} >= {"http://b/%20with%20space", "http://a/", "%00", None} - {"http://b/%20with%20space"} | {"http://b/%20with%20space"}
    convert(spark, arc, warc)
    records = read_warc(spark, warc).collect()
    whole = {r.record_id: bytes(r.payload) for r in records if r.kind == "response"}
    # A revisit stands for the payload of the record that it refers to.
    got = [(r.id, whole[r.record_id] if r.kind == "response" else whole[r.refers_to]) for r in records]
    assert sorted(map(repr, got)) == want
    assert len({r.record_id for r in records}) == len(records)
    assert {r.record_id for r in records} == {r.record_id for r in legacy}
    for r in records:
        assert r.digest == hashlib.sha256(whole.get(r.record_id, whole.get(r.refers_to))).hexdigest()


def test_written_files_follow_the_format(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", LONG), (2, "http://b/", LONG)], PAGES)
    arc, warc = tmp_path / "arc", tmp_path / "warc"
    write_arc(pages, str(arc), "page_id", "url", "html", F.timestamp_seconds(F.lit(0)), F.lit("10.0.0.1"), 1)
    convert(spark, str(arc), str(warc))
    (file,) = arc.glob("part-*")
    content = gzip.decompress(file.read_bytes())
    assert content.startswith(b"filedesc://part-00000-v1.arc 0.0.0.0 20240101000000 text/plain ")
    assert b"\n1 0 tidemark\nURL IP-address Archive-date Content-type Archive-length\n" in content
    text = b"".join(gzip.decompress(f.read_bytes()) for f in warc.glob("part-*"))
    for record in (b"WARC-Type: warcinfo", b"WARC-Type: response", b"WARC-Type: revisit", b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Refers-To: <urn:uuid:"):
        assert record in text
    assert text.count(LONG.encode()) == 1 and text.endswith(b"\r\n\r\n")


def test_hand_made_archive():
    """A version 2 file with an address with spaces, a broken line and a block that the file ends in."""
    about = b"2 0 someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    head = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 x.arc %d\n" % len(about)
    one = b"http://a/b c 1.2.3.4 20010203040506 text/html 200 abc - 120 x.arc 5\nhello"
    cut = b"http://d/ 1.2.3.4 20010203040506 text/html 404 - - 200 x.arc 50\nshort"
    got = list(arc_records(head + about + b"\n" + one + b"\nthis is no header\n\n" + cut))
    assert [(f["URL"], f["Result-code"], b) for f, b, _ in got] == [("http://a/b c", "200", b"hello"), ("http://d/", "404", b"short")]
    assert list(arc_records(b"")) == [] and list(arc_records(head + about)) == []


def test_empty_table(spark):
    assert archive(spark.createDataFrame([], PAGES)).count() == 0


def test_damaged_files_give_what_can_be_read(spark, tmp_path):
    """Cut and broken files, plain and compressed, beside whole ones; no file ends the reading of others."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", "p" * 150 + str(i)) for i in range(60)], PAGES)
    write_arc(pages.coalesce(1), str(tmp_path / "arc"), "page_id", "url", "html", F.timestamp_seconds(F.lit(0)), F.lit("-"), 1)
    (whole,) = [f.read_bytes() for f in (tmp_path / "arc").glob("*.gz")]
    raw = gzip.decompress(whole)
    bad = tmp_path / "bad"
    bad.mkdir()
    middle = raw.index(b"http://x/30 ")
    files = {
        "whole.gz": whole,
        "cut.gz": whole[: len(whole) // 2],
        "broken.gz": whole[: len(whole) // 2] + b"\xff" * 40 + whole[len(whole) // 2 + 40 :],
        "cut.arc": raw[: middle + 90],
        "noise.arc": raw[:middle] + b"some noise\nmore of it\n" + raw[middle:],
        "none.arc": b"this is no archive at all",
        "number.arc": b"filedesc://x 0.0.0.0 20200101 text/plain many\nabc\n",
        "two.gz": gzip.compress(raw[:middle]) + gzip.compress(raw[middle:]),
    }
    for name, content in files.items():
        (bad / name).write_bytes(content)
    got = read_arc(spark, str(bad)).collect()
    damaged = {r.uri: r.mime for r in got if r.kind == "damaged"}
    assert set(damaged) == set(files) - {"whole.gz", "two.gz"}
    assert "ends within compressed" in damaged["cut.gz"] and "no version block" in damaged["number.arc"] and "no header" in damaged["noise.arc"]
    read = [r for r in got if r.kind != "damaged"]
    assert {r.id for r in read if r.id} == {str(i) for i in range(60)} and len(read) >= 3 * 60 + 31
    convert(spark, str(bad), str(tmp_path / "warc"))
    back = read_warc(spark, str(tmp_path / "warc")).collect()
    assert len(back) == len(read) and not [r for r in back if r.kind == "damaged"]


def test_a_warc_record_that_does_not_match_its_digest(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "p" * 150 + str(i)) for i in range(5)], PAGES)
    write_arc(pages.coalesce(1), str(tmp_path / "arc"), "page_id", "url", "html", F.timestamp_seconds(F.lit(0)), F.lit("-"), 2)
    convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    (raw,) = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz")]
    (tmp_path / "bad").mkdir()
    at = raw.index(b"p" * 150 + b"3")
    (tmp_path / "bad" / "x.warc").write_bytes(raw[:at] + b"q" + raw[at + 1 :])
    got = read_warc(spark, str(tmp_path / "bad")).collect()
    assert sorted(r.id for r in got if r.kind != "damaged") == ["0", "1", "2", "4"]
    assert [r.mime for r in got if r.kind == "damaged"][0].endswith("does not match its digest")


def test_many_copies_of_a_payload_do_not_meet(spark, tmp_path):
    """Payloads are joined by record, not by digest."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", LONG) for i in range(300)], PAGES).repartition(4)
    got = archive(pages).collect()
    assert {(r.record_type, r.refers_to) for r in got if r.page_id > 0} == {("revisit", 0)} and len(got) == 300
