"""Text of uploaded files: TXT, MD, DOCX and HWPX, from the binaryFile source or a table with (path, content)."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.batches import pieces

#: Greatest file, greatest sum of unpacked sections, and extensions that are read.
MAX_BYTES, MAX_UNPACKED = 8 * 1024 * 1024, 50 * 1024 * 1024
EXTENSIONS = ("pdf", "docx", "hwpx", "txt", "md")
#: What a damaged, encrypted or oddly packed file raises: its own status, never the job's end.
DAMAGED = (ValueError, KeyError, EOFError, OSError, RuntimeError, NotImplementedError, struct.error, zlib.error, zipfile.BadZipFile, ElementTree.ParseError)
_SECTION = re.compile(r"Contents/section(\d+)\.xml")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parsed(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data:
        raise ValueError("document type")
    return ElementTree.fromstring(data)


def _unpacked(z: zipfile.ZipFile, name: str, left: int) -> bytes:
    """An entry's bytes; an error if there are more than ``left``, whatever its header says."""
    with z.open(name) as f:
        data = f.read(left + 1)
    if len(data) > left:
        raise ValueError("too large")
    return data


def _own_text(p: ElementTree.Element) -> str:
    """Text of a paragraph without that of paragraphs inside it, which are lines of their own."""
    parts = []
    for child in p:
        kind = _local(child.tag)
        if kind != "p":
            parts.append((child.text or "") if kind == "t" else "\t" if kind == "tab" else _own_text(child))
    return "".join(parts)


def _docx(data: bytes) -> str:
    """Paragraphs in order, those of tables included."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = _parsed(_unpacked(z, "word/document.xml", MAX_UNPACKED))
    return "\n".join(_own_text(p) for p in root.iter() if _local(p.tag) == "p").strip()


def _outer(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for child in node:
        if _local(child.tag) == "p":
            yield child
        else:
            yield from _outer(child)


def _hwpx(data: bytes) -> str:
    """Sections by number; outermost paragraphs, trimmed, blank ones dropped."""
    sections: dict[int, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.filename.startswith("/") or ".." in info.filename or "\\" in info.filename:
                raise ValueError("entry name")
            if m := _SECTION.fullmatch(info.filename):
                sections[int(m[1])] = _unpacked(z, info.filename, MAX_UNPACKED - sum(map(len, sections.values())))
    if not sections:
        raise ValueError("no section")
    lines = ("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip() for k in sorted(sections) for p in _outer(_parsed(sections[k])))
    return "\n".join(x for x in lines if x)


def _extracted(batches: Iterator[pa.RecordBatch], pdf_text: Callable[[bytes], str] | None = None) -> Iterator[pa.RecordBatch]:
    """Texts of the files that have no status yet, few at a time; rows that have one pass."""
    readers = {"docx": _docx, "hwpx": _hwpx, "pdf": pdf_text}
    for batch in pieces(batches, "content"):
        texts, statuses = [], []
        for kind, data, status in zip(*(batch.column(c) for c in ("kind", "content", "status")), strict=True):
            text, status, kind = None, status.as_py(), kind.as_py()
            if status is None:
                try:
                    text = data.as_py().decode("utf-8") if kind in ("txt", "md") else readers[kind](data.as_py())
                    status = "ok"
                except DAMAGED:
                    status = "parse error"
            texts.append(text)
            statuses.append(status)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(statuses, pa.string())], names=["path", "text", "status"])


def is_scanned(path: Column, text: Column) -> Column:
    """A PDF without any text is a scan; other files without text are just empty."""
    return (F.lower(F.substring_index(path, ".", -1)) == "pdf") & ~F.coalesce(text, F.lit("")).rlike(r"\S")


def extract_text(files: DataFrame, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text, status) of (path, content). status: ok, empty, too large, hwp, unsupported, bad magic, no pdf reader, scanned, or parse error.

    Gates are expressions, so the bytes of refused files never reach Python. PDF needs a reader, which is given: ``pdf_text`` takes the bytes of a file and raises ValueError where they are damaged. A PDF
    without any text is ``scanned``.
    """
    kind = F.lower(F.substring_index("path", ".", -1))
    magic = F.when(kind == "pdf", F.substring("content", 1, 5) == F.lit(b"%PDF-")).when(kind.isin("docx", "hwpx"), F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")).otherwise(F.lit(True))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    gate = (
        F.when(size == 0, "empty").when(size > MAX_BYTES, "too large").when(kind == "hwp", "hwp").when(~kind.isin(*EXTENSIONS), "unsupported")
        .when(~magic, "bad magic").when((kind == "pdf") & F.lit(pdf_text is None), "no pdf reader")
    )
    gated = files.select("path", "content", kind.alias("kind"), gate.alias("status"))
    # One pass for all: what made the files isn't run again for those that are refused, and their bytes stay where they are.
    held = gated.select("path", "kind", F.when(F.col("status").isNull(), F.col("content")).alias("content"), "status")
    read = held.mapInArrow(lambda batches: _extracted(batches, pdf_text), "path string, text string, status string")
    scanned = (F.col("status") == "ok") & is_scanned(F.col("path"), F.col("text"))
    return read.withColumn("status", F.when(scanned, "scanned").otherwise(F.col("status")))
