import base64
import gzip
import hashlib
import json
import re
import zlib
from pathlib import Path

import pytest
from pyspark.errors import PythonException

from weirloom.llm import warc

SCHEMA = "page_id long, url string, html string"
HARD = ["", None, "x", "ends\r\n", "ends\r", "\r\n", "\r\n\r\n", "a\r\n\r\nb\r\n\r\n", "\r\n\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é日本\n\x00\x01", "a\r\n\r\n\r\n\r", "﻿mark"]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain(rows, least=0):
    out = []
    for i, _, html in rows:
        size = len((html or "").encode())
        ids = [x[0] for x in rows if (x[2] or "") == (html or "") and x[0] is not None]
        kept = max(ids) if ids and size >= least else i
        out.append((i, size, digest(html), "response" if kept == i else "revisit", None if kept == i else kept))
    return sorted(out, key=str)


def trip(spark, df, folder, per_file=5, **more):
    warc.write(df, f"file://{folder}/mono", **more)
    warc.normalise(spark, f"file://{folder}/mono", f"file://{folder}/out", per_file)
    rows = warc.resolve(warc.read(spark, f"file://{folder}/out"))
    return sorted(((warc_id(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, warc_id(r.refers_to)) for r in rows.collect()), key=str)


def warc_id(urn):
    found = re.fullmatch(r"<urn:weirloom:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def test_round_trip_of_hard_payloads(spark, tmp_path):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(HARD * 3)] + [(None, None, "no id"), (None, "http://h/\r\nX: y", ""), (100, "http://h/100", "again"), (100, "http://h/100", "again"), (7, "u", "again")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert trip(spark, df, tmp_path) == plain(rows)
    back = warc.resolve(warc.read(spark, f"file://{tmp_path}/out", payloads=True)).collect()
    held = {(i, digest(h)): (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == held[warc_id(r.record_id), r.payload_digest] for r in back)
    assert {r.uri for r in back if r.record_id.endswith(":>")} == {None, "http://h/%0D%0AX: y"}


def test_files_are_what_other_readers_expect(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * (i % 5 * 50)) for i in range(40)]
    trip(spark, spark.createDataFrame(rows, SCHEMA).coalesce(2), tmp_path, per_file=7)
    for mono in tmp_path.glob("mono/*.gz"):
        stream = zlib.decompressobj(31)
        stream.decompress(mono.read_bytes())
        assert stream.eof and not stream.unused_data  # one gzip stream over all records
    entries = [json.loads(x) for f in tmp_path.glob("out/kind=index/*.txt") for x in f.read_text().split("\0") if x]
    files = {tuple(map(int, re.search(r"part-(\d+)-.*c(\d+)\.txt", f.name).groups())): f.read_bytes() for f in tmp_path.glob("out/kind=archive/*.txt")}
    assert len(entries) == 40 and all(len(gzip.decompress(f)) for f in files.values())
    ends = {k: 0 for k in files}
    for e in sorted(entries, key=lambda e: (e["part"], e["roll"], e["offset"])):
        key = e["part"], e["roll"]
        assert e["offset"] == ends[key]
        record = zlib.decompress(files[key][e["offset"] : e["offset"] + e["length"]], 31)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and e["record_id"].encode() in record
        ends[key] += e["length"]
    assert ends == {k: len(f) for k, f in files.items()}


def test_wanted_records_only(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"text {i}") for i in range(20)]
    trip(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)
    some = warc.index(spark, f"file://{tmp_path}/out").where("uri LIKE '%/1_'")
    got = warc.read(spark, f"file://{tmp_path}/out", some, payloads=True).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == [f"text {i}" for i in range(10, 20)]


def test_other_writers_and_record_types(spark, tmp_path):
    """Records of any type and header order, folded lines, no HTTP block, several files."""
    info = b"WARC/1.0\r\nContent-Length: 5\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:a>\r\nX-Long: a\r\n b\r\n\r\na\r\n\r\n\r\n\r\n"
    text = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:b>\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    (tmp_path / "mono").mkdir()
    (tmp_path / "mono" / "a.warc.gz").write_bytes(gzip.compress(info + text))
    (tmp_path / "mono" / "b.warc.gz").write_bytes(gzip.compress(text[:-4].replace(b"<urn:b>", b"<urn:c>")))  # without its last blank lines
    warc.normalise(spark, f"file://{tmp_path}/mono", f"file://{tmp_path}/out")
    got = {r.record_id: (r.record_type, bytes(r.payload)) for r in warc.read(spark, f"file://{tmp_path}/out", payloads=True).collect()}
    assert got == {"<urn:a>": ("warcinfo", b"a\r\n\r\n"), "<urn:b>": ("resource", b"xyz"), "<urn:c>": ("resource", b"xyz")}


@pytest.mark.parametrize("bad", [b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n", b"WARC/1.0\r\nContent-Length: 2\r\n\r\nlonger\r\n\r\n", b"not an archive\r\n\r\n", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n\r\n"])
def test_broken_files_are_errors(bad):
    pieces = [("f", p) for p in bad.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n")]
    with pytest.raises(ValueError):
        list(warc.split_records(iter(pieces)))


def test_wrong_digest_is_an_error(spark, tmp_path):
    (tmp_path / "mono").mkdir()
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    (tmp_path / "mono" / "a.gz").write_bytes(gzip.compress(record))
    warc.normalise(spark, f"file://{tmp_path}/mono", f"file://{tmp_path}/out")
    with pytest.raises(PythonException, match="digest"):
        warc.read(spark, f"file://{tmp_path}/out").collect()


def test_records_over_16_mib(spark, tmp_path):
    rows = [(1, "u", "a" * (17 << 20)), (2, "u", "after"), (3, "u", "b" * (16 << 20))]
    assert trip(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), tmp_path) == plain(rows)
    for f in tmp_path.glob("out/kind=archive/*.txt"):
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") == 3


def test_least_size_empty_table_and_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "long enough"), (4, "u", "long enough")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert trip(spark, df, tmp_path / "a", least=5) == plain(rows, 5)
    odd = df.selectExpr("*", "1 AS n", "2 AS value", "3 AS kept", "4 AS payload", "5 AS sha1")
    assert trip(spark, odd, tmp_path / "b") == plain(rows)
    assert trip(spark, df.limit(0), tmp_path / "c") == []
