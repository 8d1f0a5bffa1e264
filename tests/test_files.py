import io
import struct
import tarfile
import zipfile
import zlib

from pyspark.sql import functions as F

from modspark.operators import files as M
from modspark.sources import files as S


def zipped(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return buffer.getvalue()


def tarred(entries):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return buffer.getvalue()


def png(width, height, rgb):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    line = b"\0" + bytes(rgb) * width
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(line * height)) + chunk(b"IEND", b""))


def put(folder, files):
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


def name_of(path):
    return path.rsplit("/", 1)[1]


def test_screen(spark, tmp_path):
    good_zip = zipped([("a.txt", b"hello")])
    folder = put(tmp_path, {
        "ok.pdf": b"%PDF-1.4", "fake.pdf": b"MZ\x90", "ok.png": b"\x89PNG\r\n\x1a\nx", "wrong.png": b"\xff\xd8\xff", "empty.txt": b"",
        "null.txt": b"ab\0c", "fine.txt": b"hello", "run.exe": b"x", "script.txt": b"#!/bin/sh", "ok.mp4": b"\0\0\0\x18ftypmp42", "ok.webp": b"RIFF1234WEBPVP8 ",
        "good.zip": good_zip, "bad.zip": zipped([("../x.txt", b"a")]), "prog.zip": zipped([("a.txt", b"ok"), ("b.dat", b"MZ..")])})
    files = S.read_files(spark, folder).withColumn("declared_name", F.lit(None).cast("string"))
    entries = S.list_entries(files.where(F.col("path").endswith(".zip")))
    inside = M.entry_findings(entries).select("path", F.col("finding").isNull().alias("ok"))
    got = {name_of(r.path) for r in M.screen(files, inside).where("safe").collect()}
    assert got == {"ok.pdf", "ok.png", "fine.txt", "ok.mp4", "ok.webp", "good.zip"}


def test_archives(spark, tmp_path):
    folder = put(tmp_path, {
        "many.zip": zipped([(f"f{i}.txt", b"x") for i in range(101)]), "big.zip": zipped([("z.txt", b"0" * (51 * M.MB))]),
        "exe.tar": tarred([("notes.txt", b"x"), ("run.exe", b"x")]), "up.tar": tarred([("../x", b"x")]),
        "fine.zip": zipped([("n.txt", b"text inside"), ("k.bin.txt", b"\xff\xfeok")]), "broken.zip": b"PK\x03\x04rubbish"})
    entries = S.list_entries(S.read_files(spark, folder))
    got = {name_of(r.path): r.finding for r in M.entry_findings(entries.where("error is null")).collect()}
    assert got == {"many.zip": "too many entries", "big.zip": "zip bomb expansion", "exe.tar": "denied extension", "up.tar": "path traversal", "fine.zip": None}
    assert [name_of(r.path) for r in entries.where("error is not null").collect()] == ["broken.zip"]
    texts = {r.entry_name: r.text for r in S.entry_texts(entries.where(F.col("path").endswith("fine.zip"))).collect()}
    assert texts == {"n.txt": "text inside", "k.bin.txt": "ok"}


def test_office_packages(spark, tmp_path):
    body = b'<?xml version="1.0"?><w:document><w:t>Hello &amp; good</w:t><w:t>day</w:t></w:document>'
    folder = put(tmp_path, {"a.docx": zipped([("word/document.xml", body)]), "m.docx": zipped([("word/document.xml", body), ("word/vbaProject.bin", b"x")]),
                            "s.xlsm": zipped([("xl/sharedStrings.xml", b"<a>cell</a>")])})
    entries = S.list_entries(S.read_files(spark, folder))
    assert {name_of(r.path): r.macro for r in M.package_findings(entries).collect()} == {"a.docx": False, "m.docx": True, "s.xlsm": True}
    texts = {(name_of(r.path), r.text) for r in M.package_text(entries).collect()}
    assert ("a.docx", "Hello & good day") in texts and ("s.xlsm", "cell") in texts


def test_text_decoding(spark):
    rows = [(1, "héllo".encode()), (2, "سلام".encode("cp1256")), (3, b"a\0b"), (4, b"x" * 60000)]
    got = {r.id: (r.text, r.finding) for r in spark.createDataFrame(rows, "id int, content binary").select(
        "id", F.inline(F.array(M.plain_text(F.col("content"))))).collect()}
    assert got[1][0] == "héllo" and got[2][0] == "سلام" and got[3][0] is None and got[3][1] and len(got[4][0]) == 60000


def test_images(spark, tmp_path):
    folder = put(tmp_path, {"skin.png": png(300, 200, (220, 160, 120)), "sky.png": png(10, 10, (80, 120, 220))})
    images = spark.read.format("image").load(folder)
    got = {name_of(r.path): r.flagged for r in M.skin_share(M.image_pixels(images), "path").collect()}
    assert got == {"skin.png": True, "sky.png": False}
    sizes = images.select(M.oversized(F.col("image.width"), F.col("image.height")).alias("o"))
    assert not any(r.o for r in sizes.collect())


def test_routing(spark):
    rows = [("photo", "/a/x"), ("other", "/a/x.zip"), ("document", "/a/x.txt"), ("voice", "/a/x"), ("thing", "/a/x.gif"), ("thing", "/a/x")]
    df = spark.createDataFrame(rows, "kind string, path string")
    got = [r.r for r in df.select(M.route(F.col("kind"), F.col("path")).alias("r")).collect()]
    assert got == ["photo", "archive", "document", "audio", "animation", "unknown"]
    assert [r.t for r in spark.createDataFrame([("Video",), ("mydoc",), ("blob",)], "d string").select(M.known_type(F.col("d")).alias("t")).collect()] == ["video", "document", "photo"]
