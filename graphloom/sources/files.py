"""Resource files: listing, names, decoding by format."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUFFIXES = (".txt", ".epub", ".pdf")


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, length and content of the files below root that have one of these suffixes; content is read only if used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.lower("path").endswith(s)
    return f.filter(ok).select("path", "length", "content")


def metadata(files: DataFrame, path: str = "file_path", taken: DataFrame | None = None) -> DataFrame:
    """text_id, title, author and extension from names like 0001_Some_Title_Author.txt.

    A numeric first part n gives id n + 1; other files are numbered in path order.  Of what follows, the last of two
    parts or more is the author.  taken (text_id): ids in use; numbers that are taken or come up twice, and files without
    a number, then get ids above all of these.
    """
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))
    parts = F.split(stem, "_")
    numbered = F.get(parts, 0).rlike(r"^[0-9]+\z")
    rest = F.when(numbered, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    many = F.size(rest) >= 2
    spaced = lambda x: F.trim(F.replace(x, F.lit("-"), F.lit(" ")))
    named = F.trim(F.array_join(F.transform(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(1))), spaced), " "))
    title = F.coalesce(F.nullif(F.when(many, named).otherwise(F.trim(F.translate(stem, "_-", "  "))), F.lit("")), stem)
    if taken is None:
        order = F.row_number().over(Window.orderBy(path))  # one row a file
        number = F.when(numbered, F.element_at(parts, 1).cast("int") + 1).otherwise(order)
    else:
        used = taken.select(F.col("text_id").cast("int").alias("_own"), F.lit(True).alias("_used")).distinct()
        own = F.when(numbered, F.try_element_at(parts, F.lit(1)).cast("int") + 1)
        first = F.row_number().over(Window.partitionBy("_own").orderBy(path)) == 1
        files = files.withColumn("_own", own).join(used, "_own", "left")
        files = files.withColumn("_own", F.when(F.col("_used").isNull() & F.col("_own").isNotNull() & first, F.col("_own")))
        top = files.agg(F.max("_own").alias("m")).unionByName(taken.agg(F.max("text_id").cast("int").alias("m"))).agg(F.coalesce(F.max("m"), F.lit(0)).alias("_top"))
        others = files.filter("_own is null").select(path)
        others = others.withColumn("_rank", F.row_number().over(Window.orderBy(path)))  # one row a file
        files = files.join(others, path, "left").join(F.broadcast(top))
        number = F.coalesce("_own", F.col("_top") + F.col("_rank"))
        files = files.withColumn("_number", number).drop("_own", "_used", "_top", "_rank")
        number = F.col("_number")
    return files.select(*(c for c in files.columns if c != "_number"), number.cast("int").alias("text_id"), title.alias("title"), F.when(many, F.nullif(spaced(F.element_at(rest, -1)), F.lit(""))).alias("author"), ext.alias("ext"))


def decode_text(raw: bytes) -> str:
    """UTF-8 with or without a mark, else Latin-1, which never fails."""
    for name in ("utf-8", "utf-8-sig"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def strip_markup(markup: str) -> str:
    return html.unescape(re.sub(r"<[^>]+>", " ", markup))


def collapse(text: str) -> str:
    lines = (re.sub(r"\s+", " ", x).strip() for x in text.splitlines())
    return "\n".join(x for x in lines if x)


def decode_epub(raw: bytes) -> str:
    """The book's HTML documents, a blank line between: in the order of its spine, then what that leaves out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        docs = [n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
        spine = [n for n in _spine(z) if n in set(docs)]
        docs = [*spine, *(n for n in docs if n not in set(spine))]
        return "\n\n".join(t for n in docs if (t := collapse(strip_markup(decode_text(z.read(n))))))


def _spine(z: zipfile.ZipFile) -> list[str]:
    """Archive names in reading order; empty if the package can't be read."""
    tag = lambda name, text: [dict(re.findall(r'([\w:-]+)\s*=\s*"([^"]*)"', m)) for m in re.findall(rf"<(?:\w+:)?{name}\b([^>]*)>", text)]
    try:
        opf = next(a["full-path"] for a in tag("rootfile", decode_text(z.read("META-INF/container.xml"))) if "full-path" in a)
        text = decode_text(z.read(opf))
    except (KeyError, StopIteration):
        return []
    base = posixpath.dirname(opf)
    href = {a["id"]: posixpath.normpath(posixpath.join(base, unquote(a["href"]))) for a in tag("item", text) if "id" in a and "href" in a}
    return [href[a["idref"]] for a in tag("itemref", text) if a.get("idref") in href]


_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|'|\bT[dDjJ]\b|\bBT\b")
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _shown(content: bytes) -> str:
    """Text that a page's content stream shows, in stream order."""
    out, held = [], []
    for m in _STRING.finditer(content):
        x = m[0]
        if x[:1] == b"(":
            held.append(re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else _ESCAPE.get(e[1], e[1]), x[1:-1], flags=re.S))
        elif x[:1] == b"<":
            digits = re.sub(rb"\s", b"", x[1:-1])
            held.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif x in (b"Tj", b"TJ", b"'"):
            out += [b"\n"] * (x == b"'") + held
            held = []
        elif x != b"BT":
            out.append(b"\n")
            held = []
    return collapse(b"".join(out).decode("latin-1"))


def decode_pdf(raw: bytes, ocr: Callable[[bytes, int], str] | None = None) -> str:
    """Text of pages with plain or deflated streams and one-byte fonts, a blank line between.  Where a page shows none,
    ocr(file, page) is asked; other fonts and filters need a decoder of one's own in load_texts."""
    if b"%PDF-" not in raw[:1024] or b"/Encrypt" in raw:
        raise ValueError("not a PDF, or an encrypted one")
    pages = []
    for m in re.finditer(rb"<<((?:[^<>]|<[^<]|>[^>]|<<.*?>>)*?)>>\s*stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" in body or b"/Contents" in m[1]:
            pages.append(_shown(body))
    if not pages and ocr:
        pages = [""] * max(1, len(re.findall(rb"/Type\s*/Page\b", raw)))
    return "\n\n".join(t for k, p in enumerate(pages) if (t := p or (ocr(raw, k) if ocr else "")))


def load_texts(files: DataFrame, decoders: dict[str, object] | None = None) -> DataFrame:
    """path and text; decoders by suffix may be replaced or added."""
    table = {".txt": decode_text, ".epub": decode_epub, ".pdf": decode_pdf} | (decoders or {})

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            yield pd.DataFrame({"path": d["path"], "text": [table[p[p.rindex(".") :].lower()](bytes(c)) for p, c in zip(d["path"], d["content"], strict=True)]})

    return files.select("path", "content").mapInPandas(each, "path string, text string")
