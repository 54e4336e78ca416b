"""Files as sources: type detection, safe unzip, parsers, the documents table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ravelin.functions.text import content_hash, file_type

#: Limits of an archive.
MAX_BYTES, MAX_FILES, MAX_DEPTH = 500 * 1024 * 1024, 1000, 3
KEPT = (".pdf", ".docx", ".txt", ".doc")
LOW_TEXT = 100
PARSED = (
    "doc_id string, source_path string, original_filename string, file_type string, content_hash string, full_text string, structure_tier int, "
    "headings array<struct<level:int,text:string,char_offset:int>>, title string, title_source string, page_count int, language string, ocr_used boolean, parser_used string, "
    "tables array<struct<page:int,markdown:string,char_start:int,char_end:int>>, extraction_warnings array<string>, extraction_errors array<string>, metadata map<string,string>"
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """Files below the paths: ``path, modificationTime, length, content``; paths that do not exist give none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    paths = [p for p, path in found if path.getFileSystem(conf).globStatus(path)]
    if not paths:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(paths)


def kind_of_zip(content: bytes) -> str:
    """docx if it holds a word document, zip if anything else, unknown if it can't be read."""
    try:
        names = zipfile.ZipFile(io.BytesIO(content)).namelist()
    except (zipfile.BadZipFile, OSError):
        return "unknown"
    return "docx" if "[Content_Types].xml" in names and any(n.startswith("word/") for n in names) else "zip"


def unzip(content: bytes, depth: int = 0) -> Iterator[tuple[str, bytes]]:
    """Members ``(name, content)`` of an archive, nested ones flattened.

    Stops at the depth, the size, the number of files or a path that leads outside; what came
    before is kept.
    """
    if depth > MAX_DEPTH:
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError):
        return
    total = count = 0
    for info in archive.infolist():
        if info.is_dir():
            continue
        count += 1
        if total + info.file_size > MAX_BYTES or count > MAX_FILES or info.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", info.filename):
            return
        try:
            with archive.open(info) as opened:
                member = opened.read(MAX_BYTES - total + 1)  # what is really there, whatever the archive says
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):
            continue
        total += len(member)
        if total > MAX_BYTES:
            return
        if info.filename.lower().endswith(".zip"):
            yield from unzip(member, depth + 1)
        elif info.filename.lower().endswith(KEPT):
            yield info.filename, member


def expand(files: DataFrame) -> DataFrame:
    """Files with archives replaced by their members: ``(path, original_filename, file_type, content)``; members are named ``archive::member``."""
    columns = ["path", "original_filename", "file_type", "content"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, name, kind, content in zip(batch.path, batch.original_filename, batch.file_type, batch.content):
                kind = kind_of_zip(content) if kind == "zip" else kind
                if kind != "zip":
                    yield pd.DataFrame([(path, name, kind, content)], columns=columns)
                    continue
                for member, inner in unzip(content):
                    head = inner[:8]
                    sort = "unknown" if not inner else "pdf" if head.startswith(b"%PDF") else kind_of_zip(inner) if head.startswith(b"PK\x03\x04") else "doc" if head == bytes.fromhex("D0CF11E0A1B11AE1") else "txt"
                    yield pd.DataFrame([(path, f"{name}::{member}", sort, inner)], columns=columns)  # a member at a time is held

    named = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("original_filename"), file_type(F.col("content")).alias("file_type"), "content")
    archives = named.filter("file_type = 'zip'").mapInPandas(rows, "path string, original_filename string, file_type string, content binary")
    return named.filter("file_type <> 'zip'").unionByName(archives)


def parse_txt(content: bytes) -> dict:
    """Text of a plain file: UTF-8 (with or without mark), UTF-16 with a mark, else Windows-1252."""
    warnings: list[str] = []
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = content.decode("utf-16", errors="replace")
    else:
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = content.decode("cp1252", errors="replace")
            warnings.append("charset guessed")
    if len(text) < LOW_TEXT:
        warnings.append("low text")
    return {"full_text": text, "structure_tier": 3, "title_source": "none", "extraction_warnings": warnings, "parser_used": "txt_parser"}


def markdown_table(rows: list[list[str]]) -> str:
    cells = [[re.sub(r"\s*\n\s*", " ", c).strip() for c in row] for row in rows]
    if not cells:
        return ""
    lines = ["| " + " | ".join(row) + " |" for row in cells]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in cells[0]) + " |", *lines[1:]])


def parse_docx(content: bytes) -> dict:
    """Paragraphs and tables of a word document in body order; heading styles become headings, the first one the title."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    parts: list[str] = []
    headings, tables, at = [], [], 0
    for node in body:
        if node.tag == f"{_W}p":
            text = text_of(node)
            if not text.strip():
                continue
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            if name == "Title" or name.startswith("Heading"):
                level = re.search(r"(\d+)$", name)
                headings.append({"level": int(level.group(1)) if level else 1, "text": text, "char_offset": at})
        elif node.tag == f"{_W}tbl":
            text = markdown_table([[text_of(c) for c in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")])
            if not text:
                continue
            tables.append({"page": None, "markdown": text, "char_start": at, "char_end": at + len(text)})
        else:
            continue
        parts.append(text)
        at += len(text) + 1
    full = "\n".join(parts)
    return {
        "full_text": full, "structure_tier": 1, "headings": headings, "tables": tables, "title": headings[0]["text"] if headings else None,
        "title_source": "native" if headings else "none", "extraction_warnings": ["low text"] if len(full) < LOW_TEXT else [], "parser_used": "docx_parser",
    }


def parse_doc(content: bytes) -> dict:
    return {"file_type": "txt", "full_text": "", "structure_tier": 3, "title_source": "none", "extraction_errors": ["legacy .doc is not read"], "parser_used": "none"}


def parse_pdf(content: bytes) -> dict:
    """Without a PDF library there is an error document; pass another parser to ``parse`` where there is one."""
    return {"full_text": "", "structure_tier": 3, "title_source": "none", "extraction_errors": ["no PDF parser"], "parser_used": "pdf_parser"}


PARSERS: dict[str, Callable[[bytes], dict]] = {"txt": parse_txt, "docx": parse_docx, "doc": parse_doc, "pdf": parse_pdf}


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], dict]] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Documents of ``expand``ed files, one row each; contents in ``known`` (``content_hash``) are skipped before they are parsed.

    Ids come from the content and the name, so a task that runs again gives the same rows. A
    parser that fails gives an error document. Files of unknown type give none.
    """
    table = {**PARSERS, **(parsers or {})}
    hashed = files.filter(F.col("file_type").isin(*table)).withColumn("content_hash", content_hash(F.col("content")))
    if known is not None:
        hashed = hashed.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    hashed = hashed.withColumn("doc_id", F.sha2(F.concat_ws("|", "content_hash", "original_filename"), 256))
    columns = [c.split()[0] for c in re.split(r", (?=\w+ (?:string|int|array|boolean|map))", PARSED)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                base = {"headings": [], "tables": [], "extraction_warnings": [], "extraction_errors": [], "metadata": {}, "ocr_used": False, "page_count": None, "language": None, "title": None}
                base |= {"doc_id": row.doc_id, "source_path": row.path, "original_filename": row.original_filename, "file_type": row.file_type, "content_hash": row.content_hash}
                try:
                    base |= table[row.file_type](row.content)
                except Exception as error:  # noqa: BLE001 - whatever a parser meets becomes the document's error
                    base |= {"full_text": "", "structure_tier": 3, "title_source": "none", "parser_used": row.file_type, "extraction_errors": [f"{type(error).__name__}: {error}"[:500]]}
                out.append([base.get(c) for c in columns])
            yield pd.DataFrame(out, columns=columns).astype({"page_count": "Int32"})

    return hashed.select("doc_id", "path", "original_filename", "file_type", "content_hash", "content").mapInPandas(rows, PARSED)
