import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from casemesh.functions.text import sanitize_name
from casemesh.sources import blobs as B
from casemesh.sources.boxes import read_boxes


def png(width, height):
    head = struct.pack(">II", width, height) + b"\x08\x02\x00\x00\x00"
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def jpeg(width, height):
    return (b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, height, width)
            + b"\x01\x11\x00" + b"\x00" * 12)


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body + b"\x00" * 12


def archive(*entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return buffer.getvalue()


FILES = [
    # declared, content, media type, threat
    ("text/plain", b"plain words", "text/plain", None),
    ("text/csv", b"a,b\x00", "application/octet-stream", None),
    ("text/plain", b"x <ScRiPt>y", "text/plain", "script marker <script"),
    ("application/pdf", b"%PDF-1.4 << /Launch >>", "application/pdf", "pdf action /Launch"),
    ("application/pdf", b"%PDF-1.4 stream\r\n/JS /Launch\nendstream", "application/pdf", None),
    ("application/pdf", b"not really", "application/octet-stream", None),
    ("application/pdf", b"MZ\x90", "application/x-dosexec", None),
    ("image/png", archive(("a", b"b")), "application/zip", None),
    ("image/png", png(800, 600), "image/png", None),
    ("image/png", png(20000, 2), "image/png", "image too large"),
    ("image/jpeg", jpeg(9000, 9000), "image/jpeg", "image too large"),
    ("image/jpeg", jpeg(640, 480), "image/jpeg", None),
    ("image/webp", webp(b"VP8X", b"\x00\x00\x00\x00" + (10999).to_bytes(3, "little") + (9).to_bytes(3, "little")), "image/webp", "image too large"),
    ("image/webp", webp(b"VP8L", b"\x2f" + (99 | 199 << 14).to_bytes(4, "little") + b"\x00" * 8), "image/webp", None),
    ("image/webp", webp(b"VP8 ", b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 12000, 10)), "image/webp", "image too large"),
    ("", b"\x00\x00\x00\x18ftypmp42", "video/mp4", None),
    ("", b"RIFF\x00\x00\x00\x00WAVE", "audio/wav", None),
    ("audio/mpeg", b"ID3\x04", "audio/mpeg", None),
    ("video/mpeg", b"unknown", "video/mpeg", None),
    ("text/plain", b"", "application/octet-stream", None),
]


@pytest.fixture(scope="module")
def typed(spark):
    df = spark.createDataFrame([(i, d, bytearray(c)) for i, (d, c, _, _) in enumerate(FILES)], "i INT, declared STRING, content BINARY")
    return df.withColumn("mime", B.sniff_mime(F.col("content"), F.col("declared"))).withColumn(
        "size", F.length("content").cast("long"))


def test_types_and_threats(typed):
    rows = {r.i: r for r in B.scan_threats(typed).collect()}
    assert [(rows[i].mime, rows[i].threat) for i in range(len(FILES))] == [(m, t) for _, _, m, t in FILES]


def test_gate(typed):
    rows = {r.i: r.reason for r in B.gate_blobs(B.scan_threats(typed)).collect()}
    assert [rows[i] for i in (0, 1, 2, 6, 7, 8, 15, 19)] == [
        None, "unsupported_type", "threat", "unsupported_type", "unsupported_type", None, None, "empty"]
    tiny = {r.i: r.reason for r in B.gate_blobs(typed.withColumn("threat", F.lit(None)), max_mb=0).collect()}
    assert tiny[0] == "too_large"


def test_text_is_utf8_else_latin1(spark):
    df = spark.createDataFrame([(1, bytearray("é".encode())), (2, bytearray(b"caf\xe9"))], "i INT, content BINARY")
    rows = df.select("i", B.decode_text(F.col("content"), F.lit("text/plain")).alias("t"),
                     B.decode_text(F.col("content"), F.lit("image/png")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [("é", None), ("café", None)]


def test_archives_and_inventory(spark, tmp_path):
    made = {
        "fine.zip": archive(("a.txt", b"hello"), ("b.txt", b"there")), "slip.zip": archive(("ok", b"1"), ("../x", b"2")),
        "nested.zip": archive(("inner.TAR", b"1")), "bomb.zip": archive(("zero", b"\x00" * (2 << 20))),
        "big.zip": archive(*[(f"f{i}", bytes(range(256)) * 7000) for i in range(3)]), "bad.zip": b"PK\x03\x04junk"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    blobs = B.scan_blobs(spark, str(tmp_path), "*.zip")
    assert {r.path.rsplit("/", 1)[1]: r.size for r in blobs.collect()} == {n: len(d) for n, d in made.items()}
    found = {r.path.rsplit("/", 1)[1]: (r.entries, r.reason) for r in B.scan_archives(blobs, max_bytes=4 << 20, max_ratio=500).collect()}
    assert found["fine.zip"] == (2, None) and found["slip.zip"] == (2, "path_traversal")
    assert found["nested.zip"] == (1, "nested_archive") and found["bomb.zip"] == (1, "compression_ratio")
    assert found["big.zip"] == (3, "unpacked_size") and found["bad.zip"] == (0, "corrupt")


def test_file_names(spark):
    names = ["../../etc/pass wd", "स्कैन 1.pdf", "", None, "a" * 300, "dir/"]
    df = spark.createDataFrame(list(enumerate(names)), "i INT, n STRING")
    got = [r.s for r in df.select(sanitize_name(F.col("n")).alias("s")).collect()]
    assert got[0] == "pass_wd" and got[2:4] == ["unnamed_upload"] * 2 and len(got[4]) == 255 and got[5] == "unnamed_upload"


def test_boxes_from_files(spark, tmp_path):
    (tmp_path / "scan_p2.json").write_text(json.dumps([
        {"text": "थाना", "confidence": 0.9, "box": [1, 2, 3, 4], "lang": "hi"}, {"text": "x", "confidence": 0.5, "box": []}]))
    rows = read_boxes(spark, str(tmp_path)).orderBy("box_no").collect()
    assert [(r.page, r.box_no, r.text, r.x1, r.y2, r.lang) for r in rows] == [(2, 0, "थाना", 1, 4, "hi"), (2, 1, "x", None, None, None)]
