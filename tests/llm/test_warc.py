"""Archives: round trips and malformed input."""

import io
import struct

import pytest
import zstandard

from gridloom.llm import warc
from gridloom.llm.common import shared_dir

PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "other"), (4, "u", None), (5, "u v\r\nX: y", ""), (7, "u", "é" * 200_000), (None, "u", "same"), (None, "u", "single"), (9, "u", "twice"), (9, "u", "twice")]


def test_round_trip_in_spark(spark):
    df = spark.createDataFrame([(h, i, u, "d") for i, u, h in PAGES], "html string, page_id long, url string, digest string")
    got = sorted(map(tuple, warc.round_trip(df, shared_dir(spark)).collect()), key=str)
    largest = {}
    for i, _, h in PAGES:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        data, top = (h or "").encode(), largest[h or ""]
        revisit = top >= 0 and i != top
        want.append((i, len(data), warc.digest32(data), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0), shared_dir(spark)).count() == 0


def test_payloads_come_back(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"<html>{i}" + "text " * i) for i in range(300)], "page_id long, url string, html string")
    folder = shared_dir(spark) + "/archives"
    manifest = warc.write_archives(df.repartition(3), folder, least=10)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(manifest, folder).collect()}
    assert got == {r.page_id: r.html for r in df.collect()}
    assert sum(r.records for r in manifest.collect()) == 300


def archive(records, dictionary=b""):
    out = io.BytesIO()
    warc.write_archive(out, records, dictionary)
    return out.getvalue()


def test_dictionary_and_frames():
    records = [warc.write_record(i, f"http://h/{i}", b"<html>" + b"body %d " % i * 40, "response", None, warc.digest32(b"<html>" + b"body %d " % i * 40)) for i in range(500)]
    d = warc.train(records)
    assert d
    data = archive(records, d)
    assert struct.unpack("<I", data[:4])[0] == warc.MAGIC
    assert list(warc.read_archive(io.BytesIO(data), chunk=7)) == records == list(warc.read_archive(io.BytesIO(data)))
    assert len(data) < len(archive(records))
    # A dictionary that is not compressed is read too.
    frames = data[8 + struct.unpack("<I", data[4:8])[0]:]
    assert list(warc.read_archive(io.BytesIO(struct.pack("<II", warc.MAGIC, len(d)) + d + frames))) == records


@pytest.mark.parametrize("damage", [lambda b: b[4:], lambda b: b[:-3], lambda b: b[:6], lambda b: b + b"junk", lambda b: b[:-1] + bytes([b[-1] ^ 1])])
def test_damaged_archives_fail(damage):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(damage(archive([b"x" * 100, b"y" * 100])))))


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WORC/1.1"), (b"WARC-Type: response\r\n", b""), (b"Content-Length: ", b"Content-Length: 1"), (b"payload", b"payl0ad"), (b"WARC-Date:", b"WARC-Date ")])
def test_damaged_records_fail(old, new):
    good = warc.write_record(1, "u", b"payload", "response", None, warc.digest32(b"payload"))
    warc._row(good, True)
    assert good.count(old)
    i = good.rindex(b"\r\n\r\nHTTP") if old == b"Content-Length: " else 0
    bad = good[:good.rindex(old, 0, i)] + good[good.rindex(old, 0, i):].replace(old, new, 1) if i else good.replace(old, new)
    with pytest.raises(warc.WarcError):
        warc._row(bad, True)


def test_zstandard_is_the_reader_of_one_frame_a_record():
    data = archive([b"a" * 10, b"b" * 20])
    first = zstandard.ZstdDecompressor().decompressobj()
    assert first.decompress(data[8:]) == b"a" * 10
