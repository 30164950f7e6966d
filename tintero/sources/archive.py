"""EPUB and ZIP archives as rows: reading, safe unpacking, and writing with the mimetype first and stored."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text_rules as R
from ..functions.arrow import map_rows
from ..operators.position import by_order

MIMETYPE = b"application/epub+zip"
STAMP = (1980, 1, 1, 0, 0, 0)

_ENTRY = pa.schema([("archive", pa.string()), ("seq", pa.int32()), ("name", pa.string()), ("is_dir", pa.bool_()), ("method", pa.string()), ("size", pa.int64()), ("crc", pa.int64()), ("safe", pa.bool_()), ("data", pa.binary()), ("error", pa.string())])
_ENTRY_SQL = "archive string, seq int, name string, is_dir boolean, method string, size long, crc long, safe boolean, data binary, error string"


def archives(spark: SparkSession, path: str, suffix: str = ".epub") -> DataFrame:
    """(archive, content) of the files of a folder with the suffix in any case; a folder without any is refused by Spark's reader only if it is missing."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.endswith(F.lower("path"), F.lit(suffix))).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def choose_archive(found: DataFrame, choice: int | None = None) -> str | None:
    """The only archive of a folder, or the ``choice``-th (from 1) by name; None if there is none or the choice is open."""
    names = found.select("archive").orderBy("archive")
    if choice is None:
        first = names.take(2)
        return first[0][0] if len(first) == 1 else None
    only = names.take(2)
    if len(only) == 1:
        return only[0][0]
    at = names.offset(choice - 1).first() if choice >= 1 else None
    return None if at is None else at[0]


_DAMAGED = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError)


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def is_safe(name: str) -> bool:
    """Whether an entry stays inside the folder it is unpacked to."""
    flat = posixpath.normpath(name.replace("\\", "/"))
    return not (flat.startswith(("/", "../")) or flat == ".." or flat[1:2] == ":")


def entries(found: DataFrame) -> DataFrame:
    """One row per entry of every archive; unsafe names are marked.

    A damaged entry has no data and says why in ``error``, a file that is no archive is one row with nothing but that.
    """

    def one(row: dict) -> list[dict]:
        try:
            z = zipfile.ZipFile(io.BytesIO(row["content"] or b""))
        except _DAMAGED as e:
            return [{"archive": row["archive"], "error": _said(e)}]
        out = []
        for k, i in enumerate(z.infolist()):
            method = {zipfile.ZIP_STORED: "STORED", zipfile.ZIP_DEFLATED: "DEFLATED"}.get(i.compress_type, str(i.compress_type))
            entry = {"archive": row["archive"], "seq": k, "name": i.filename, "is_dir": i.is_dir(), "method": method, "size": i.file_size, "crc": i.CRC, "safe": is_safe(i.filename)}
            try:
                entry["data"] = b"" if i.is_dir() else z.read(i)
            except _DAMAGED as e:
                entry["error"] = _said(e)
            out.append(entry)
        return out

    return map_rows(found.select("archive", "content"), one, _ENTRY, _ENTRY_SQL)


def unpacked(rows: DataFrame) -> DataFrame:
    """Files of the archives; entries that would leave the folder are skipped, damaged ones as well."""
    return rows.where("safe AND NOT is_dir AND error IS NULL").drop("error")


def damaged(rows: DataFrame) -> DataFrame:
    """(archive, name, error): entries that can't be read, and files that are no archives (without a name)."""
    return rows.where("error IS NOT NULL").select("archive", "name", "error")


def structure(rows: DataFrame) -> DataFrame:
    """(archive, has_mimetype, has_meta_inf, has_oebps): what a folder or archive needs before it is packed."""
    return rows.groupBy("archive").agg(
        F.bool_or(F.col("name") == "mimetype").alias("has_mimetype"), F.bool_or(F.startswith("name", F.lit("META-INF/"))).alias("has_meta_inf"), F.bool_or(F.startswith("name", F.lit("OEBPS/"))).alias("has_oebps")
    )


_BOOK = pa.schema(
    [
        ("archive", pa.string()), ("base", pa.string()), ("title", pa.string()), ("authors", pa.list_(pa.string())), ("language", pa.string()), ("subjects", pa.list_(pa.string())), ("descriptions", pa.list_(pa.string())), ("identifiers", pa.list_(pa.string())),
        ("resources", pa.list_(pa.struct([("href", pa.string()), ("media_type", pa.string()), ("is_cover", pa.bool_())]))), ("spine", pa.list_(pa.string())),
        ("toc", pa.list_(pa.struct([("toc_id", pa.int32()), ("parent_id", pa.int32()), ("pos", pa.int32()), ("title", pa.string()), ("href", pa.string())]))), ("error", pa.string()),
    ]
)
_BOOK_SQL = (
    "archive string, base string, title string, authors array<string>, language string, subjects array<string>, descriptions array<string>, identifiers array<string>, resources array<struct<href:string,media_type:string,is_cover:boolean>>, "
    "spine array<string>, toc array<struct<toc_id:int,parent_id:int,pos:int,title:string,href:string>>, error string"
)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def read_book(archive: str, content: bytes) -> dict:
    """Metadata, resources, reading order and contents of one EPUB; ``error`` says what is wrong with a bad one."""
    book: dict = {f.name: None for f in _BOOK} | {"archive": archive, "authors": [], "subjects": [], "descriptions": [], "identifiers": [], "resources": [], "spine": [], "toc": []}
    try:
        z = zipfile.ZipFile(io.BytesIO(content or b""))
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(e.attrib["full-path"] for e in container.iter() if _local(e) == "rootfile")
        base, opf = posixpath.dirname(opf_path), ElementTree.fromstring(z.read(opf_path))
        book["base"] = base
        items: dict[str, tuple[str, str, str]] = {}
        cover, ncx = None, None
        for e in opf.iter():
            kind, text = _local(e), (e.text or "").strip()
            if kind == "title":
                book["title"] = book["title"] or text
            elif kind == "language":
                book["language"] = text
            elif kind in ("creator", "subject", "description", "identifier"):
                book[{"creator": "authors", "subject": "subjects", "description": "descriptions", "identifier": "identifiers"}[kind]].append(text)
            elif kind == "meta" and e.get("name") == "cover":
                cover = e.get("content")
            elif kind == "item":
                items[e.get("id", "")] = (e.get("href", ""), e.get("media-type", ""), e.get("properties", ""))
            elif kind == "spine":
                ncx = e.get("toc")
            elif kind == "itemref" and e.get("idref") in items:
                book["spine"].append(items[e.get("idref", "")][0])
        book["resources"] = [{"href": h, "media_type": m, "is_cover": k == cover or "cover-image" in p} for k, (h, m, p) in items.items()]
        if ncx in items:
            _read_ncx(ElementTree.fromstring(z.read(posixpath.normpath(posixpath.join(base, items[ncx][0])))), book["toc"])
        if not book["spine"]:
            book["error"] = "empty spine"
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, zlib.error) as e:
        book["error"] = _said(e)
    return book


def _read_ncx(root: ElementTree.Element, out: list[dict]) -> None:
    todo = [(p, None, k) for k, p in enumerate(e for m in root.iter() if _local(m) == "navMap" for e in m if _local(e) == "navPoint")]
    while todo:
        point, parent, pos = todo.pop(0)
        label = next((t.text or "" for t in point.iter() if _local(t) == "text"), "")
        src = next((c.get("src", "") for c in point if _local(c) == "content"), "")
        number = len(out) + 1
        out.append({"toc_id": number, "parent_id": parent, "pos": pos, "title": label, "href": src.partition("#")[0]})
        todo += [(c, number, k) for k, c in enumerate(e for e in point if _local(e) == "navPoint")]


def books(found: DataFrame) -> DataFrame:
    """One row per EPUB with nested metadata, resources, spine and contents."""
    return map_rows(found.select("archive", "content"), lambda row: [read_book(row["archive"], row["content"])], _BOOK, _BOOK_SQL)


def spine_of(read: DataFrame) -> DataFrame:
    return read.where("error IS NULL").select(F.col("archive").alias("book_id"), F.posexplode("spine").alias("spine_idx", "href"))


def resources_of(read: DataFrame) -> DataFrame:
    return read.where("error IS NULL").select(F.col("archive").alias("book_id"), F.explode("resources").alias("r")).select("book_id", "r.*")


def resource_files(read: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, href, media_type, is_cover, data): each book's resources with their bytes, from its unpacked entries."""
    path = F.when(F.col("base") == "", F.col("r.href")).otherwise(F.concat("base", F.lit("/"), F.col("r.href")))
    listed = read.where("error IS NULL").select(F.col("archive").alias("book_id"), "base", F.explode("resources").alias("r")).select("book_id", path.alias("name"), "r.*")
    return listed.join(files.select(F.col("archive").alias("book_id"), "name", "data"), ["book_id", "name"]).drop("name")


def xhtml_resources(resources: DataFrame) -> DataFrame:
    """Only the resources that are XHTML, by their media type."""
    return resources.where(F.col("media_type") == R.XHTML)


def toc_of(read: DataFrame) -> DataFrame:
    return read.where("error IS NULL").select(F.col("archive").alias("book_id"), F.explode("toc").alias("t")).select("book_id", "t.*")


def rejected(read: DataFrame) -> DataFrame:
    """Archives that aren't books or whose reading order is empty."""
    return read.where("error IS NOT NULL").select("archive", "error")


# Writing


def pack_plan(files: DataFrame, directories: bool = False) -> DataFrame:
    """(archive, seq, name, method, size, crc): the order and checksums of a packed EPUB.

    Data are summed up where they lie; only names, sizes and checksums are put in order, a large archive by several tasks.
    The mimetype at the root comes first and stored; the rest is deflated by name, META-INF and OEBPS only if
    ``directories`` are to be kept, else every file not named mimetype.
    """
    top = F.col("name") == "mimetype"
    named = F.element_at(F.split("name", "/"), -1) == "mimetype"
    rest = (F.startswith("name", F.lit("META-INF/")) | F.startswith("name", F.lit("OEBPS/"))) if directories else ~named
    summed = files.where(top | rest).select("archive", F.when(top, 0).otherwise(1).alias("_rest"), "name", F.length("data").cast("long").alias("size"), F.crc32("data").alias("crc"))
    placed = by_order(summed, "archive", ["_rest", "name"], "seq", costly=True)
    return placed.select("archive", "seq", "name", F.when(F.col("_rest") == 0, "STORED").otherwise("DEFLATED").alias("method"), "size", "crc")


def zip_bytes(members: list[tuple[str, bytes]], first_stored: bool = True, directories: bool = False) -> bytes:
    """An archive of (name, data), in order; with ``first_stored`` a leading mimetype isn't compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        seen: set[str] = set()
        for name, data in members:
            if directories and name != "mimetype":
                parts = name.split("/")[:-1]
                for k in range(len(parts)):
                    if (d := "/".join(parts[: k + 1]) + "/") not in seen:
                        seen.add(d)
                        z.writestr(zipfile.ZipInfo(d, STAMP), b"")
            info = zipfile.ZipInfo(name, STAMP)
            info.compress_type = zipfile.ZIP_STORED if first_stored and name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def pack(files: DataFrame, kind: str = "epub") -> DataFrame:
    """(archive, content): each archive's files packed; ``epub`` (mimetype first), ``folder`` (with directory entries) or ``zip``.

    A group is one archive, whose bytes have to fit one task as they have to fit one file.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        members = sorted(((str(n), bytes(d)) for n, d in zip(pdf["name"], pdf["data"], strict=True)), key=lambda m: (kind != "zip" and m[0] != "mimetype", m[0]))
        if kind == "epub":
            members = [m for m in members if m[0] == "mimetype" or not m[0].endswith("/mimetype")]
        elif kind == "folder":
            members = [m for m in members if m[0] == "mimetype" or m[0].startswith(("META-INF/", "OEBPS/"))]
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "content": [zip_bytes(members, kind != "zip", kind == "folder")]})

    return files.select("archive", "name", "data").groupBy("archive").applyInPandas(one, "archive string, content binary")


def lifted(files: DataFrame) -> DataFrame:
    """Files of archives without a mimetype at the root, moved up out of their first folder (by name)."""
    has = F.max((F.col("name") == "mimetype").cast("int"))
    first = F.min(F.when(F.contains("name", F.lit("/")), F.substring_index("name", "/", 1)))
    info = files.groupBy("archive").agg(has.alias("has"), first.alias("top"))
    j = files.join(info, "archive")
    inside = F.startswith("name", F.concat(F.col("top"), F.lit("/")))
    name = F.when(F.col("has") == 1, F.col("name")).when(inside, F.expr("substring(name, length(top) + 2)"))
    return j.withColumn("name", name).where("name IS NOT NULL").drop("has", "top")


def skeleton(archive: str) -> list[tuple[str, str, bytes]]:
    """(archive, name, data) of an empty book: the mimetype, a container and a stylesheet."""
    container = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    return [(archive, "mimetype", MIMETYPE), (archive, "META-INF/container.xml", container.encode()), (archive, "OEBPS/Styles/stylesheet.css", b"body { margin: 1em; text-align: justify; }\nh1 { text-align: center; }\n")]


def completed(files: DataFrame) -> DataFrame:
    """(archive, name, data): folders without a mimetype get the files of an empty book; those that have one stay as they are.

    A file of a folder's own stands in place of the empty book's.
    """
    bare = structure(files).where("NOT has_mimetype").select("archive")
    empty = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(bytearray(d)).alias("data")) for _, n, d in skeleton("")])
    new = bare.select("archive", F.explode(empty).alias("f")).select("archive", "f.name", "f.data")
    return files.select("archive", "name", "data").unionByName(new.join(files.select("archive", "name"), ["archive", "name"], "left_anti"))


def _xml(text: str | None) -> str:
    return (text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def book_files(archive: str, meta: dict, sections: list[tuple[str, str, str]], extra: list[tuple[str, bytes]] | None = None, cover: str | None = None) -> list[tuple[str, bytes]]:
    """The files of one book: package, contents, sections (name, title, xhtml) in order and other resources (path below OEBPS, data)."""
    extra = extra or []
    manifest = [f'<item id="s{k}" href="Text/{_xml(n)}" media-type="application/xhtml+xml"/>' for k, (n, _, _) in enumerate(sections)]
    manifest += [f'<item id="r{k}" href="{_xml(p)}" media-type="{_media(p)}"/>' for k, (p, _) in enumerate(extra)]
    refs = "".join(f'<itemref idref="s{k}"/>' for k in range(len(sections)))
    points = "".join(f'<navPoint id="n{k}" playOrder="{k + 1}"><navLabel><text>{_xml(t)}</text></navLabel><content src="Text/{_xml(n)}"/></navPoint>' for k, (n, t, _) in enumerate(sections))
    dc = [f"<dc:title>{_xml(meta.get('title'))}</dc:title>", f"<dc:language>{_xml(meta.get('language') or 'es')}</dc:language>"]
    dc += [f"<dc:creator>{_xml(a)}</dc:creator>" for a in meta.get("authors") or []] + [f"<dc:subject>{_xml(s)}</dc:subject>" for s in meta.get("subjects") or []]
    dc += [f"<dc:description>{_xml(d)}</dc:description>" for d in meta.get("descriptions") or []] + [f"<dc:identifier>{_xml(i)}</dc:identifier>" for i in meta.get("identifiers") or [archive]]
    at = next((k for k, (p, _) in enumerate(extra) if p == cover), None)
    if at is not None:
        dc.append(f'<meta name="cover" content="r{at}"/>')
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" version="2.0"><metadata>{"".join(dc)}</metadata><manifest>{"".join(manifest)}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx">{refs}</spine></package>'
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>{points}</navMap></ncx>'
    own = {p for p, _ in extra}
    base = [(n, d) for _, n, d in skeleton(archive) if n.removeprefix("OEBPS/") not in own]
    return [*base, ("OEBPS/content.opf", opf.encode()), ("OEBPS/toc.ncx", ncx.encode()), *[(f"OEBPS/Text/{n}", x.encode()) for n, _, x in sections], *[(f"OEBPS/{p}", d) for p, d in extra]]


_TYPES = {"xhtml": "application/xhtml+xml", "css": "text/css", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "ttf": "application/x-truetype-font", "otf": "application/vnd.ms-opentype"}


def _media(path: str) -> str:
    return _TYPES.get(path.rpartition(".")[2].lower(), "application/octet-stream")


def build_books(sections: DataFrame, metadata: DataFrame, group: list[str], resources: DataFrame | None = None) -> DataFrame:
    """(group columns, content): an EPUB per group of sections (ord, name, title, xhtml), with the group's metadata row.

    ``resources`` has (group columns, href, data, is_cover), paths below OEBPS; of several covers the first by path
    counts.  One group is one book or part, the unit that is written as one file.
    """
    meta_cols = ["title", "authors", "language", "subjects", "descriptions", "identifiers"]
    kinds = dict(sections.dtypes)
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "content binary"])
    none = F.lit(None)
    # whatever goes into a book beside its sections, one kind of row each; books without sections aren't built
    keys = [F.col(g).alias(f"_{g}") for g in group]
    beside = metadata.select(*keys, *meta_cols, none.cast("string").alias("href"), none.cast("binary").alias("data"), none.cast("boolean").alias("is_cover"))
    if resources is not None:
        types = dict(metadata.dtypes)
        beside = beside.unionByName(resources.select(*keys, *[none.cast(types[c]).alias(c) for c in meta_cols], "href", "data", "is_cover"))

    def one(key: tuple, pages: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(pages):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (*group, "content")})
        pages = pages.sort_values(["ord", "name"], kind="stable")
        own = other[other["href"].isna()]
        meta = {c: _plain(own[c].iloc[0]) if len(own) else None for c in meta_cols}
        meta["authors"] = [a if isinstance(a, str) else f"{a.get('first') or ''} {a.get('last') or ''}".strip() for a in meta["authors"] or []]
        extra = other[other["href"].notna()].sort_values("href", kind="stable").drop_duplicates("href")
        files = [(str(h), bytes(d or b"")) for h, d in zip(extra["href"], extra["data"], strict=True)]
        cover = next((h for h, c in zip(extra["href"], extra["is_cover"], strict=True) if c is True or c == 1), None)
        name = "_".join(str(k) for k in key)
        data = zip_bytes(book_files(name, meta, [(n, t or n, x or "") for n, t, x in zip(pages["name"], pages["title"], pages["xhtml"], strict=True)], files, cover))
        return pd.DataFrame({**{g: [k] for g, k in zip(group, key, strict=True)}, "content": [data]})

    pages = sections.select(*group, "ord", "name", "title", "xhtml")
    return pages.groupBy(*group).cogroup(beside.groupBy(*[f"_{g}" for g in group])).applyInPandas(one, schema)


def _plain(value: object) -> object:
    """A metadata field as Python has it; missing values of any kind are None."""
    if value is None or isinstance(value, float):
        return None
    return value if isinstance(value, str) else list(value)  # type: ignore[call-overload]


def save_files(df: DataFrame, name_col: str, data_col: str, folder: str) -> None:
    """Writes one loose file per row to a folder that all executors share; a repeated attempt overwrites its own file.

    Names that would leave the folder are refused.
    """
    import os

    def write(rows: Iterator) -> None:
        for name, data in rows:
            if not is_safe(name):
                raise ValueError(f"not a name within the folder: {name}")
            path = os.path.join(folder, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".part", "wb") as f:
                f.write(bytes(data))
            os.replace(path + ".part", path)

    df.select(name_col, F.col(data_col).cast("binary")).foreachPartition(write)


def media_types(files: DataFrame, path_col: str) -> DataFrame:
    return files.withColumn("media_type", R.media_type(path_col))
