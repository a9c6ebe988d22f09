import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import warc

PAGE = "page_id long, url string, html string, record_type string, payload string"
ROWS = [(1, "http://a/%41\n", "same"), (2, None, "same"), (3, "http://c", "same"), (4, "u", None), (5, "u", ""), (6, "ü", "ö" * 70000), (7, "x", "one"),
        (7, "x", "one"), (None, "n", "one"), (None, "n", "lone"), (8, "\r\n\r\nWARC/1.1", "a\r\n\r\nb")]


def archive(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE).repartition(2)
    return warc.archive_pages(pages, **options)


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    got = warc.read_warc(spark, archive(spark, ROWS), verify=True).withColumn("page_id", warc.page_id(F.col("record_id"))).collect()
    assert len(got) == len(ROWS)
    seen = {(r.page_id, r.payload_digest): r for r in got}
    for page, url, html in ROWS:
        r = seen[page, sha(html)]
        same = [p for p, _, h in ROWS if (h or "") == (html or "")]
        leader = max([p for p in same if p is not None], default=None)
        assert r.record_type == ("response" if page == leader else "revisit")
        assert r.refers_to == (None if page == leader else f"<urn:page:{leader}>")
        assert (r.target_uri, r.payload_bytes) == (url, len((html or "").encode()))
        assert r.payload == ((html or "").encode() if page == leader else None)


def test_short_payloads_are_responses(spark):
    got = warc.read_warc(spark, archive(spark, ROWS, least_bytes=4)).collect()
    assert sorted(r.payload_digest for r in got if r.record_type == "revisit") == [sha("same")] * 2


def test_filters_are_pushed(spark):
    path = archive(spark, ROWS)
    records = warc.read_warc(spark, path, payload=False)
    revisits = records.where("record_type = 'revisit'")
    assert revisits.count() == sum(r.record_type == "revisit" for r in records.collect())
    assert records.where(F.col("target_uri") == "http://a/%41\n").count() == 1
    assert records.where(F.col("record_id").isin("<urn:page:3>", "<urn:page:4>")).count() == 2
    assert records.where(f"payload_digest = '{sha('one')}' AND record_type = 'response'").count() == 2
    assert records.where("payload IS NOT NULL").count() == 0
    reader = warc.WarcReader({"path": path}, None)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.wanted == {"warc-type": {"revisit"}}


def test_unwanted_payloads_are_not_inflated(spark):
    """A record whose payload is damaged can be passed over, but not read."""
    path = archive(spark, [(1, "u", "x" * 10), (2, "v", " ".join(str(hash((i, i * i))) for i in range(6000)))])
    for name in warc.committed(path):
        place, local = warc.open_place(name)
        data = bytearray(place.open_input_file(local).read())
        offsets = [i for i in range(len(data)) if data[i:i + 4] == b"\x1f\x8b\x08\x04"]
        for i in offsets:
            n = warc._member_length(bytes(data[i:i + 64]))
            if n > 1000:
                data[i + n - 8:i + n - 4] = b"\0\0\0\0"
        with place.open_output_stream(local, compression=None) as out:
            out.write(bytes(data))
    assert warc.read_warc(spark, path).where("record_id = '<urn:page:1>'").first().payload == b"x" * 10
    assert warc.read_warc(spark, path, payload=False).count() == 2
    with pytest.raises(Exception, match="data check|ends early"):
        warc.read_warc(spark, path).where("record_id = '<urn:page:2>'").collect()


def test_foreign_files_and_empty_tables(spark, tmp_path):
    block = b"HTTP/1.0 200 OK\r\n\r\nbody"
    text = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(text) * 3)
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r.payload, r.payload_bytes) for r in got] == [(b"body", 4)] * 3
    assert warc.read_warc(spark, str(tmp_path), payload=False).where("record_type = 'response'").count() == 3
    assert warc.read_warc(spark, archive(spark, [])).count() == 0


def test_a_repeated_task_leaves_nothing_twice(spark):
    path = archive(spark, ROWS[:3])
    place, root = warc.open_place(path)
    stray = [f for f in warc.committed(path)][0]
    place.copy_file(warc.open_place(stray)[1], f"{root}/part-stray.warc.gz")
    assert warc.read_warc(spark, path).count() == 3


def test_headers_of_any_length_and_blanks_at_their_ends(spark):
    rng = random.Random(5)
    long = "http://a/" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=150_000))
    rows = [(1, long, "one"), (2, "  http://b/ \t ", "two"), (3, "\u00a0x\u3000", "three"), (4, "% 41 %", "four"), (5, " ", "five")]
    path = archive(spark, rows)
    for payload in (True, False):
        got = {warc_id: uri for warc_id, uri in warc.read_warc(spark, path, payload=payload).select("record_id", "target_uri").collect()}
        assert got == {f"<urn:page:{p}>": u for p, u, _ in rows}
    assert warc.read_warc(spark, path).where(F.col("target_uri") == "  http://b/ \t ").count() == 1


def test_a_member_that_ends_early_is_an_error(tmp_path):
    data = warc.member(b"WARC/1.1\r\nWARC-Type: response\r\n" + bytes(random.Random(1).randbytes(200_000)))
    (tmp_path / "cut.warc.gz").write_bytes(data[:len(data) // 2])
    with open(tmp_path / "cut.warc.gz", "rb"):
        reader = warc.WarcReader({"path": str(tmp_path)}, None)
        with pytest.raises(ValueError, match="do not end"):
            list(reader.read(warc.WarcPart(str(tmp_path / "cut.warc.gz"))))
