"""File sources (S1-S6, S8, S10, S11, D24): the format gate and parsers of text, Markdown, HTML tables, DOCX and XLSX, all with
the standard library, applied to binary files in Arrow batches. PDF is in pdf.py."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Limits of packed files, and types by extension.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 10_000, 250 << 20, 200
MIME = {
    "txt": "text/plain",
    "md": "text/markdown",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ELEMENT = "kind string, text string, level int, line_start int, line_end int, cells array<string>"


# Types that a sender may declare besides a format's own.
ALSO = {"txt": ("application/octet-stream",), "md": ("text/plain", "text/x-markdown", "application/octet-stream")}


def gate(name: str, content: bytes, most: int = 50 << 20, declared: str | None = None) -> tuple[str, str | None, str | None, str | None]:
    """(code, format, sha256, encoding); code is OK or the first thing wrong with the file. declared: the type that its sender
    gives, which must be the format's."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    digest = hashlib.sha256(content).hexdigest()
    if kind not in MIME:
        return "UNSUPPORTED_FORMAT", None, digest, None
    if declared and declared.split(";")[0].strip().lower() not in (MIME[kind], *ALSO.get(kind, ("application/octet-stream",))):
        return "MIME_MISMATCH", kind, digest, None
    if not content:
        return "EMPTY", kind, digest, None
    if len(content) > most:
        return "TOO_LARGE", kind, digest, None
    if kind in ("txt", "md"):
        for encoding in ("utf-8-sig", "gb18030"):
            try:
                text = content.decode(encoding)
            except UnicodeDecodeError:
                continue
            bad = any(ord(c) < 32 and c not in "\t\n\r\f" for c in text)
            return ("CONTROL_CHARACTERS" if bad else "OK"), kind, digest, encoding
        return "BAD_ENCODING", kind, digest, None
    if kind == "pdf":
        return ("OK" if content.startswith(b"%PDF-") and b"/Encrypt" not in content else "ENCRYPTED" if content.startswith(b"%PDF-") else "BAD_SIGNATURE"), kind, digest, None
    if kind == "xls":
        return ("OK" if content.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1") else "BAD_SIGNATURE"), kind, digest, None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries = z.infolist()
    except zipfile.BadZipFile:
        return "BAD_SIGNATURE", kind, digest, None
    total = sum(e.file_size for e in entries)
    if len(entries) > MOST_ENTRIES or total > MOST_BYTES or total > MOST_RATIO * max(1, sum(e.compress_size for e in entries)):
        return "ARCHIVE_BOMB", kind, digest, None
    part = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml"}[kind]
    return ("OK" if any(e.filename == part for e in entries) else "BAD_SIGNATURE"), kind, digest, None


def _element(kind: str, text: str, level: int | None = None, lines: tuple[int, int] | None = None, cells: list[str] | None = None) -> dict:
    return {"kind": kind, "text": text, "level": level, "line_start": lines and lines[0], "line_end": lines and lines[1], "cells": cells}


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("gb18030")


def parse_text(content: bytes) -> list[dict]:
    """S3: paragraphs between blank lines, with lines from 1."""
    out, open_ = [], []
    for n, line in enumerate([*_decoded(content).splitlines(), ""], 1):
        if line.strip():
            open_.append((n, line))
        elif open_:
            out.append(_element("paragraph", "\n".join(x for _, x in open_), lines=(open_[0][0], open_[-1][0])))
            open_ = []
    return out


def parse_markdown(content: bytes) -> list[dict]:
    """Headings, fenced code, table rows, list items and paragraphs."""
    out, open_, fence = [], [], None

    def end():
        nonlocal open_
        if open_:
            out.append(_element("code" if fence is not None else "paragraph", "\n".join(x for _, x in open_), lines=(open_[0][0], open_[-1][0])))
            open_ = []

    for n, line in enumerate([*_decoded(content).splitlines(), ""], 1):
        s = line.strip()
        if fence is not None:
            if s.startswith(fence):
                end()
                fence = None
            else:
                open_.append((n, line))
        elif s.startswith(("```", "~~~")):
            end()
            fence = s[:3]
        elif m := re.fullmatch(r"(#{1,6})\s+(.*?)\s*#*", s):
            end()
            out.append(_element("heading", m[2], len(m[1]), (n, n)))
        elif s.startswith("|") and s.endswith("|") and len(s) > 1:
            end()
            if not re.fullmatch(r"\|(\s*:?-{3,}:?\s*\|)+", s):
                out.append(_element("table_row", s, lines=(n, n), cells=[c.strip() for c in s[1:-1].split("|")]))
        elif not s:
            end()
        else:
            open_.append((n, line))
    end()
    return out


def parse_docx(content: bytes) -> list[dict]:
    """Paragraphs, headings by style and table rows in the order of the body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out = []
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    for e in body if body is not None else ():
        if e.tag == f"{W}p" and (text := words(e).strip()):
            style = e.find(f"{W}pPr/{W}pStyle")
            m = re.fullmatch(r"(?:Heading|标题)\s*([1-6])", style.get(f"{W}val", "")) if style is not None else None
            out.append(_element("heading" if m else "paragraph", text, int(m[1]) if m else None))
        elif e.tag == f"{W}tbl":
            for row in e.iter(f"{W}tr"):
                cells = [words(c).strip() for c in row.findall(f"{W}tc")]
                out.append(_element("table_row", " | ".join(cells), cells=cells))
    return out


def _column(reference: str) -> int | None:
    """0 for A, 26 for AA; null if a cell's reference names no column."""
    letters = re.match("[A-Z]+", reference)
    return sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else None


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in the workbook's order; by number where the workbook does not tell."""
    names = z.namelist()
    parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    if "xl/workbook.xml" not in names or "xl/_rels/workbook.xml.rels" not in names:
        return [(n.rsplit("/", 1)[-1].removesuffix(".xml"), n) for n in parts]
    of = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    ids = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    found = [(s.get("name", ""), of.get(s.get(ids), "")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{X}sheet")]
    found = [(name, p.removeprefix("/") if p.startswith("/") else f"xl/{p}") for name, p in found]
    return [(name, p) for name, p in found if p in names]


def parse_xlsx(content: bytes) -> list[dict]:
    """Rows of all sheets that are not blank, each cell in its column; line_start is the row's number. A formula without a
    cached value gives a row of kind warning."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{X}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        out = []
        for name, sheet in _sheets(z):
            for number, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{X}row"), 1):
                cells: list[str] = []
                n = int(row.get("r", number))
                for c in row.iter(f"{X}c"):
                    at = _column(c.get("r", ""))
                    v, inline = c.find(f"{X}v"), c.find(f"{X}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{X}t")) if inline is not None else (v.text or "") if v is not None else ""
                    if c.find(f"{X}f") is not None and not text:
                        out.append(_element("warning", f"FORMULA_WITHOUT_VALUE {name}!{c.get('r', '')}", lines=(n, n)))
                    cells += [""] * ((len(cells) if at is None else at) - len(cells))
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                if any(c.strip() for c in cells):
                    out.append(_element("table_row", " | ".join(cells), lines=(n, n), cells=cells))
        return out


class _Table(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.cell, self.spans = [], None, False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []
            self.spans |= any(k in ("rowspan", "colspan") and v not in (None, "1") for k, v in attrs)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            (self.rows or self.rows.append([]) or self.rows)[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_table(markup: str) -> list[list[str]] | None:
    """The cells of a table; null if cells span rows or columns, as their places are not certain then."""
    t = _Table()
    t.feed(markup)
    return None if t.spans else [r for r in t.rows if r]


class Registry:
    """One parser for each format."""

    def __init__(self):
        self.parsers: dict[str, Callable[[bytes], list[dict]]] = {}

    def register(self, kind: str, parser: Callable[[bytes], list[dict]]) -> None:
        if kind in self.parsers:
            raise ValueError(f"{kind} has a parser")
        self.parsers[kind] = parser

    def get(self, kind: str) -> Callable[[bytes], list[dict]]:
        if kind not in self.parsers:
            raise LookupError(f"no parser for {kind}")
        return self.parsers[kind]


def standard_registry() -> Registry:
    from .pdf import parse_pdf

    r = Registry()
    for kind, parser in (("txt", parse_text), ("md", parse_markdown), ("docx", parse_docx), ("xlsx", parse_xlsx), ("pdf", parse_pdf)):
        r.register(kind, parser)
    return r


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def gated(files: DataFrame) -> DataFrame:
    """S1 for (path, content) rows: adds code, format, sha256, encoding."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [gate(n, bytes(c)) for n, c in zip(p["path"], p["content"])]
            yield p.assign(**{k: [g[i] for g in got] for i, k in enumerate(("code", "format", "sha256", "encoding"))})

    return files.select("path", "content").mapInPandas(run, "path string, content binary, code string, format string, sha256 string, encoding string")


def parsed(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """An element row (path, order, kind, text, level, lines, cells) for each block of files that passed the gate; a
    file that its parser cannot read gives one row of kind error."""
    registry = registry or standard_registry()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content, kind in zip(p["path"], p["content"], p["format"]):
                try:
                    found = registry.get(kind)(bytes(content))
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    found = [_element("error", type(e).__name__)]
                rows += [{"path": path, "order": i, **x} for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "order", "kind", "text", "level", "line_start", "line_end", "cells"]).astype({"level": "Int32", "line_start": "Int32", "line_end": "Int32"})

    return files.where("code = 'OK'").select("path", "content", "format").mapInPandas(run, f"path string, order int, {ELEMENT}")


def heading_paths(elements: DataFrame) -> DataFrame:
    """The headings above each element: the last of each level that no lower level has closed since."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("order")
    e = elements
    for k in range(1, 7):
        at = F.last(F.when(F.col("level") == k, F.col("order")), ignorenulls=True).over(w)
        text = F.last(F.when(F.col("level") == k, F.col("text")), ignorenulls=True).over(w)
        closed = F.last(F.when(F.col("level") < k, F.col("order")), ignorenulls=True).over(w)
        e = e.withColumn(f"_h{k}", F.when(closed.isNull() | (at > closed), text))
    out = F.filter(F.array(*[F.col(f"_h{k}") for k in range(1, 7)]), lambda x: x.isNotNull())
    return e.withColumn("heading_path", out).drop(*[f"_h{k}" for k in range(1, 7)])


# Warnings that ask for text recognition, and that leave a file incomplete.
OCR_WARNINGS, LOSSES = ("OCR_REQUIRED",), ("OCR_REQUIRED", "FORMULA_WITHOUT_VALUE", "PAGE_UNREADABLE")


def completeness(elements: DataFrame) -> DataFrame:
    """(path, requires_ocr, is_complete) of parsed files, from the codes that their warnings begin with; an error leaves nothing
    complete."""
    code = F.split("text", " ")[0]
    warning = F.col("kind") == "warning"
    return elements.groupBy("path").agg(F.bool_or(warning & code.isin(*OCR_WARNINGS)).alias("requires_ocr"), (~F.bool_or((F.col("kind") == "error") | (warning & code.isin(*LOSSES)))).alias("is_complete"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Never inferred; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose size and hash are the expected ones; expected has (path, sha256, size)."""
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long")).join(expected, ["path", "sha256", "size"], "left_semi")
