"""Archives: round trip, spec checks on hand-made archives, broken ones."""

import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from photospark.llm import warc

DDL = "page_id bigint, url string, html string, payload int, digest int, first int, row int"
LONG = "<p>é repeated</p>" * 20


@pytest.fixture(scope="module")
def pages():
    rows = [(i, f"http://h/{i % 7} x", f"<html>{i}" + "word " * (i % 90) + "</html>") for i in range(300)]
    rows += [(1000 + i, f"http://copy/{i}", LONG) for i in range(80)] + [(5000, None, None), (5001, "", ""), (5002, "u\r\nX: y", ""), (5003, "u", "x" * 300_000)]
    rows += [(7, "again", rows[7][2]), (60, "again", rows[60][2]), (None, "n", "no id " * 40), (None, "n", "no id " * 40), (None, "n", LONG)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DDL)


def wanted(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, float("inf")), float("inf") if i is None else i)
    out, done = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        again = len(b) >= 100 and b in done
        done.add(b)
        refers = first.get(b) if again else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", None if refers in (None, float("inf")) else refers))
    return sorted(out, key=str)


def test_round_trip(spark, pages):
    df = warc.round_trip(frame(spark, pages).repartition(6))
    got = [tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == wanted(pages)
    assert df.filter("error is not null").count() == 0
    assert warc.round_trip(frame(spark, [])).collect() == []


def test_hot_payload_is_joined_apart(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 10)
    got = warc.round_trip(frame(spark, pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == wanted(pages)


def test_archives_hold_the_payloads_and_follow_the_format(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/out"
    manifest = warc.write_archives(frame(spark, pages).coalesce(1), folder, archive_size=200_000)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(pages)
    rows = warc.read_archives(spark, folder).filter("record_type = 'response'").collect()
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in rows}
    assert all(texts[i] == (h or "") for i, _, h in pages if i in texts and i not in (7, 60, None))
    ids = {r["record_id"] for r in rows}
    for r in warc.read_archives(spark, folder, manifest).filter("record_type = 'revisit'").collect():
        assert r["payload"] is None and r["record_id"] not in ids
    files = [f.read_bytes() for f in (tmp_path / "out").glob("*.warc.zst")]
    # the archive of the one long page has too few records for a dictionary
    data = next(f for f in files if f[:4] == struct.pack("<I", 0x184D2A5D))
    size = struct.unpack("<I", data[4:8])[0]
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and one.unused_data


def test_files_of_failed_attempts_are_not_read(spark, pages, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = warc.write_archives(frame(spark, pages[:50]), folder)
    (tmp_path / "pages-000000-dead-0000.warc.zst").write_bytes(warc.archive_bytes([warc.record_bytes("response", "<x>", b"", [])] * 3))
    got = warc.read_archives(spark, folder, manifest).filter("record_type = 'response'")
    assert got.count() == 50 and warc.read_archives(spark, folder).filter("record_type = 'response'").count() == 53


def plain_record(i, block=None, **fields):
    block = b"HTTP/1.1 200 OK\r\n\r\nbody %d" % i if block is None else block
    return warc.record_bytes("response", f"<urn:uuid:{i}>", block, [("X-Page-Id", str(i)), *fields.items()])


def records(data):
    return list(warc.records_of(memoryview(data)))


def test_dictionary_plain_packed_or_none():
    plain = [plain_record(i) for i in range(400)]
    dictionary = zstandard.train_dictionary(4096, plain, k=64, d=8)
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    frames = b"".join(map(packer.compress, plain))
    for body in (dictionary.as_bytes(), zstandard.ZstdCompressor().compress(dictionary.as_bytes())):
        got = records(struct.pack("<II", 0x184D2A5D, len(body)) + body + frames)
        assert [r.payload for r in got] == [b"body %d" % i for i in range(400)] and not any(r.error for r in got)
    assert all("frame" in r.error for r in records(frames))
    middle = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    none = zstandard.ZstdCompressor(write_content_size=False)
    got = records(none.compress(plain[0]) + middle + none.compress(plain[1]))
    assert [r.payload for r in got] == [b"body 0", b"body 1"]
    assert records(b"") == [] and "cut off" in records(struct.pack("<II", 0x184D2A5D, 900) + b"x")[0].error
    assert records(struct.pack("<II", 0x184D2A5D, 4) + b"junk" + frames)[0].error.startswith("dictionary")


@pytest.mark.parametrize("break_, said", [
    (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"), "version"), (lambda r: r.replace(b"Content-Length", b"Content-Size"), "lacks"),
    (lambda r: r + b"more", "Content-Length"), (lambda r: r[:-4], "Content-Length"), (lambda r: r.replace(b"body", b"bodx"), "digest"),
    (lambda r: r.replace(b"WARC-Date", b": no name"), "without a name"), (lambda r: r + r, "Content-Length"), (lambda r: b"", "version"),
    (lambda r: r.replace(b"Content-Length: ", b"Content-Length: -"), "no number"),
])
def test_broken_records_are_told_and_the_rest_read(break_, said):
    packer = zstandard.ZstdCompressor()
    got = records(packer.compress(plain_record(1)) + packer.compress(break_(plain_record(2))) + packer.compress(plain_record(3)))
    assert [bool(r.error) for r in got] == [False, True, False] and said in got[1].error
    whole = packer.compress(plain_record(1))
    assert [r.error for r in records(whole + whole[:-3])][1] == "frame is cut off"


def test_payload_lengths_and_foreign_records():
    ok = records(zstandard.ZstdCompressor().compress(plain_record(1, b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody")))
    assert "payload of 4" in ok[0].error
    foreign = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <a>\r\nWARC-Date: x\r\nX-Long: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    got = records(zstandard.ZstdCompressor().compress(foreign))[0]
    assert (got.kind, got.payload, got.fields["x-long"], got.error) == ("request", b"hi", "a b", None)
