from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from tintero.operators import extract as X
from tintero.sources import archive as Z
from tintero.sources import folders as D
from tintero.streaming import pages as P


def test_safe_names():
    assert Z.is_safe("OEBPS/a.xhtml") and not Z.is_safe("../x") and not Z.is_safe("a/../../x") and not Z.is_safe("/etc/x") and not Z.is_safe("C:/x") and not Z.is_safe("..\\x")


def test_pack_and_read(spark, tmp_path):
    files = spark.createDataFrame([("b", n, bytearray(d)) for n, d in (("OEBPS/z", b"z"), ("mimetype", Z.MIMETYPE), ("META-INF/container.xml", b"c"), ("OEBPS/x/mimetype", b"no"))], "archive string, name string, data binary")
    plan = {r.name: r for r in Z.pack_plan(files).collect()}
    assert plan["mimetype"].seq == 0 and plan["mimetype"].method == "STORED" and plan["mimetype"].crc == 749429103 and "OEBPS/x/mimetype" not in plan
    packed = bytes(Z.pack(files).first().content)
    z = zipfile.ZipFile(io.BytesIO(packed))
    assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    folder = zipfile.ZipFile(io.BytesIO(bytes(Z.pack(files, "folder").first().content)))
    assert any(i.is_dir() for i in folder.infolist())
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as w:
        w.writestr("../x", b"1")
        w.writestr("d/", b"")
        w.writestr("ok", b"2")
    found = spark.createDataFrame([("e.zip", bytearray(evil.getvalue())), ("bad.zip", bytearray(b"no"))], "archive string, content binary")
    rows = Z.entries(found)
    assert [r.name for r in Z.unpacked(rows).collect()] == ["ok"] and rows.where("error IS NULL").count() == 3 and [(r.archive, r.name) for r in Z.damaged(rows).collect()] == [("bad.zip", None)]
    s = Z.structure(Z.entries(Z.pack(files))).first()
    assert s.has_mimetype and s.has_meta_inf and s.has_oebps


def test_a_damaged_entry_costs_only_itself(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as w:
        w.writestr("a", b"first entry")
        w.writestr("b", b"second entry")
    data = bytearray(out.getvalue())
    data[data.index(b"second")] ^= 1
    rows = Z.entries(spark.createDataFrame([("x.zip", data)], "archive string, content binary"))
    assert [(r.name, bytes(r.data)) for r in Z.unpacked(rows).collect()] == [("a", b"first entry")]
    assert [r.name for r in Z.damaged(rows).collect()] == ["b"]


def test_no_file_leaves_its_folder(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([("../escaped.txt", bytearray(b"x"))], "name string, data binary")
    with pytest.raises(Exception, match="not a name within"):
        Z.save_files(df, "name", "data", str(tmp_path / "in"))
    assert not (tmp_path / "escaped.txt").exists()


def test_choosing_among_many_archives(spark):
    found = spark.range(1500).selectExpr("format_string('%05d.epub', id) AS archive", "CAST('x' AS BINARY) AS content")
    assert Z.choose_archive(found, 1201) == "01200.epub" and Z.choose_archive(found) is None and Z.choose_archive(found, 1501) is None and Z.choose_archive(found, 0) is None
    assert Z.choose_archive(found.limit(1), 7) == "00000.epub"


def test_lifted(spark):
    files = spark.createDataFrame([("a", "top/mimetype", bytearray(b"m")), ("a", "top/OEBPS/x", bytearray(b"x")), ("b", "mimetype", bytearray(b"m"))], "archive string, name string, data binary")
    assert sorted((r.archive, r.name) for r in Z.lifted(files).collect()) == [("a", "OEBPS/x"), ("a", "mimetype"), ("b", "mimetype")]


def test_book_roundtrip(spark, tmp_path):
    sections = spark.createDataFrame([("b", 1, f"Capitulo000{k}.xhtml", f"T{k} & <x>", "<html/>") for k in (2, 1)], "book_id string, ord int, name string, title string, xhtml string")
    meta = spark.createDataFrame([("b", "Título & más", ["A"], "es", ["s"], ["d"], ["id1"])], "book_id string, title string, authors array<string>, language string, subjects array<string>, descriptions array<string>, identifiers array<string>")
    built = Z.build_books(sections, meta, ["book_id"]).withColumn("name", F.concat("book_id", F.lit(".epub")))
    Z.save_files(built, "name", "content", str(tmp_path))
    found = Z.archives(spark, str(tmp_path))
    assert Z.choose_archive(found) == "b.epub"
    read = Z.books(found)
    row = read.first()
    assert row.title == "Título & más" and row.authors == ["A"] and row.error is None
    assert [r.href for r in Z.spine_of(read).orderBy("spine_idx").collect()] == ["Text/Capitulo0001.xhtml", "Text/Capitulo0002.xhtml"]
    assert [r.title for r in Z.toc_of(read).orderBy("pos").collect()] == ["T1 & <x>", "T2 & <x>"]
    assert Z.rejected(Z.books(spark.createDataFrame([("x", bytearray(b"no"))], "archive string, content binary"))).count() == 1


def test_folders(spark, tmp_path):
    text = tmp_path / "OEBPS" / "Text"
    (text / "sub").mkdir(parents=True)
    for n in ("b.xhtml", "a.XHTML", "c.txt"):
        (text / n).write_text(f"á {n}", encoding="utf-8")
    (text / "sub" / "z.xhtml").write_text("z")
    images = tmp_path / "OEBPS" / "Images" / "deep"
    images.mkdir(parents=True)
    (images / "x.PNG").write_bytes(b"1")
    assert [(r.ord, r.file_name, r.content) for r in D.xhtml_folder(spark, str(tmp_path)).orderBy("ord").collect()] == [(1, "a.XHTML", "á a.XHTML"), (2, "b.xhtml", "á b.xhtml")]
    assert D.xhtml_folder(spark, str(tmp_path / "none")).count() == 0
    assert D.resource_folders(spark, "file://" + str(tmp_path)).count() == 1 and D.xhtml_folder(spark, "file://" + str(tmp_path)).count() == 2 and D.resource_folders(spark, str(tmp_path / "none")).count() == 0
    assert [(r.href, r.media_type) for r in D.resource_folders(spark, str(tmp_path)).collect()] == [("Images/deep/x.PNG", "image/png")]


def test_streams(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/pages.parquet").schema
    pages = spark.readStream.schema(schema).option("pathGlobFilter", "pages.parquet").parquet(data)
    q = P.extracted_stream(pages, spark.read.parquet(f"{data}/site_config.parquet")).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    table = X.extract(spark.read.parquet(f"{data}/pages.parquet"), spark.read.parquet(f"{data}/site_config.parquet"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "o")).collect())) == sorted(map(str, table.collect()))


def test_resources_and_cover_go_into_the_book(spark):
    sections = spark.createDataFrame([("b", 1, "a.xhtml", "A", "<html/>")], "book_id string, ord int, name string, title string, xhtml string")
    meta = spark.createDataFrame([("b", None, None, None, None, None, None)], "book_id string, title string, authors array<string>, language string, subjects array<string>, descriptions array<string>, identifiers array<string>")
    res = spark.createDataFrame([("b", "Images/c.jpg", bytearray(b"j"), True), ("b", "Styles/s.css", bytearray(b"p"), False), ("b", "Styles/s.css", bytearray(b"p"), False), ("z", "x.css", bytearray(b"p"), None)], "book_id string, href string, data binary, is_cover boolean")
    built = Z.build_books(sections, meta, ["book_id"], res)
    assert built.count() == 1
    read = Z.books(built.select(F.col("book_id").alias("archive"), "content"))
    assert sorted((r.href, r.is_cover) for r in Z.resources_of(read).collect()) == [("Images/c.jpg", True), ("Styles/s.css", False), ("Text/a.xhtml", False), ("toc.ncx", False)]
