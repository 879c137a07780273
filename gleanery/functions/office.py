"""Text and metadata of office files and pages, from their bytes, in Arrow batches; only the standard library is used.

Paragraphs of .docx, cells of .xlsx (first sheets and rows), slides of .pptx, text of .html; .pdf where pypdf is
installed; anything else is decoded as plain text. A file that cannot be read gives '' and no metadata, never an error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.functions.html import html_text

MOST_PAGES, MOST_SHEETS, MOST_ROWS = 20, 10, 100


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(xml: bytes) -> list[str]:
    out = []
    for p in ElementTree.fromstring(xml).iter():
        if _local(p.tag) == "p":
            text = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t")
            if text.strip():
                out.append(text)
    return out


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m.group(1)), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _docx(z: zipfile.ZipFile) -> tuple[str, dict]:
    lines = _paragraphs(z.read("word/document.xml"))
    return "\n\n".join(lines), {"paragraphs": str(len(lines)), "has_images": str(any(n.startswith("word/media/") for n in z.namelist())).lower()}


def _pptx(z: zipfile.ZipFile) -> tuple[str, dict]:
    slides = _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")
    parts = ["\n".join([f"Slide {k}", *_paragraphs(z.read(n))]) for k, n in enumerate(slides, 1)]
    return "\n\n".join(parts), {"slides": str(len(slides)), "has_images": str(any(n.startswith("ppt/media/") for n in z.namelist())).lower()}


def _column(cell: str) -> int:
    """Column number from 0 of a reference like AB12."""
    n = 0
    for c in cell:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of every sheet in the order of the workbook; without a workbook, numbered parts."""
    have = z.namelist()
    try:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    except KeyError:
        return [(f"Sheet {k}", n) for k, n in enumerate(_numbered(have, r"xl/worksheets/sheet(\d+)\.xml"), 1)]
    part = {r.get("Id"): (r.get("Target") or "") for r in links}
    found = []
    for k, s in enumerate((s for s in book.iter() if _local(s.tag) == "sheet"), 1):
        target = part.get(next((v for a, v in s.attrib.items() if _local(a) == "id"), ""), "")
        path = target[1:] if target.startswith("/") else f"xl/{target}"
        if path in have:
            found.append((s.get("name") or f"Sheet {k}", path))
    return found


def _xlsx(z: zipfile.ZipFile) -> tuple[str, dict]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in s.iter() if _local(t.tag) == "t"))
    sheets = _sheets(z)
    out = []
    for title, name in sheets[:MOST_SHEETS]:
        lines, seen = [title], 0
        for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if _local(r.tag) == "row"):
            seen += 1
            if seen > MOST_ROWS:
                lines.append("[more rows]")
                break
            cells: list[str] = []
            for c in row:
                at = _column(c.get("r") or "")
                cells += [""] * (at - len(cells))  # cells that the file leaves out
                value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(x.strip() for x in cells):
                lines.append("\t".join(cells))
        out.append("\n".join(lines))
    return "\n\n".join(out), {"sheets": str(len(sheets))}


def _pdf(data: bytes) -> tuple[str, dict]:
    try:
        from pypdf import PdfReader
    except ImportError:
        return _plain(data), {}
    pages = PdfReader(io.BytesIO(data)).pages
    return "\n\n".join(p.extract_text() or "" for p in pages[:MOST_PAGES]), {"pages": str(len(pages))}


def _plain(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def extract(ext: str | None, data: bytes | None) -> tuple[str, dict]:
    """(text, metadata) of one file."""
    if data is None:
        return "", {}
    try:
        if ext in ("docx", "xlsx", "pptx"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}[ext](z)
        if ext == "pdf":
            return _pdf(data)
        if ext in ("html", "htm"):
            return html_text(_plain(data)) or "", {}
        return _plain(data), {}
    except Exception:
        return "", {}


def with_text(df: DataFrame, ext: str, content: str) -> DataFrame:
    """``df`` with ``content`` (binary) replaced by text and metadata; nothing else is kept of the bytes."""
    names = [n for n in df.columns if n != content]
    shape = ", ".join([*(f"`{n}` {t}" for n, t in df.drop(content).dtypes), "text string", "metadata map<string,string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(e, c) for e, c in zip(b.column(ext).to_pylist(), b.column(content).to_pylist())]
            texts = pa.array([t.replace("\x00", "") for t, _ in got], pa.string())
            meta = pa.array([list(m.items()) for _, m in got], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), texts, meta], [*names, "text", "metadata"])

    return df.mapInArrow(run, shape)
