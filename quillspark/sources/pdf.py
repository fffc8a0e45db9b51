"""PDF source (S7): the text of pages that carry it in plain fonts, with the standard library. A page without readable text gives a
warning that asks for text recognition, which is left to a parser that a caller registers instead."""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
#: Strings, hexadecimal strings, numbers and operators of a page's content.
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _stream(body: bytes) -> bytes:
    m = STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" not in body[: m.start()]:
        return m[1] if b"/Filter" not in body[: m.start()] else b""
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error:
        return b""


def _objects(content: bytes) -> dict[int, bytes]:
    found = {int(n): body for n, body in OBJECT.findall(content)}
    for body in list(found.values()):
        if b"/ObjStm" in body[:300]:
            first, data = re.search(rb"/First\s+(\d+)", body), _stream(body)
            if first:
                begin = int(first[1])
                numbers = [int(x) for x in data[:begin].split()]
                ends = [*numbers[3::2], len(data) - begin]
                for number, a, z in zip(numbers[::2], numbers[1::2], ends):
                    found.setdefault(number, data[begin + a : begin + z])
    return found


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page objects in the order of the page tree; by number where there is no tree."""
    roots = [b for b in objects.values() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
    out, todo, seen = [], list(reversed(roots)), set()
    while todo:
        body = todo.pop()
        if re.search(rb"/Type\s*/Page\b(?!s)", body):
            out.append(body)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        refs = [int(r) for r in REFERENCE.findall(kids[1])] if kids else []
        todo += [objects[r] for r in reversed(refs) if r in objects and r not in seen]
        seen.update(refs)
    return out or [b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]


def _text(token: bytes) -> str:
    if token.startswith(b"<"):
        data = bytes.fromhex((lambda h: h + "0" * (len(h) % 2))(re.sub(rb"\s", b"", token[1:-1]).decode()))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def page_text(data: bytes) -> str:
    """The text that a page's content shows; a move to another line is a line break, a wide gap a blank."""
    out: list[str] = []
    waiting: list[str | float] = []
    for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
        waiting.clear()
        for token in TOKEN.findall(block):
            first = token[:1]
            if first in b"(<":
                waiting.append(_text(token))
            elif first in b"[]":
                continue
            elif first.isdigit() or first in b"-.":
                waiting.append(float(token))
            else:
                if token in (b"Tj", b"TJ", b"'", b'"'):
                    if token in (b"'", b'"'):
                        out.append("\n")
                    out += [x if isinstance(x, str) else " " if x < -200 else "" for x in (waiting if token != b'"' else waiting[-1:])]
                elif token in (b"T*", b"TD", b"Tm") or token == b"Td" and waiting and waiting[-1] != 0:
                    out.append("\n")
                elif token == b"Td":
                    out.append(" ")
                waiting.clear()
        out.append("\n")
    return re.sub(r"[ \t]*\n\s*", "\n", re.sub(r"[ \t]+", " ", "".join(out))).strip()


def parse_pdf(content: bytes) -> list[dict]:
    """Elements of a PDF: a paragraph for each page that has text (level is the page's number), a warning for one that has none."""
    from .formats import _element

    objects, out = _objects(content), []
    for n, page in enumerate(_pages(objects), 1):
        refs = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        data = b"\n".join(_stream(objects.get(int(r), b"")) for r in REFERENCE.findall(refs[1])) if refs else b""
        text = page_text(data)
        readable = sum(c.isprintable() or c == "\n" for c in text) > 0.9 * len(text) > 0 and any(map(str.isalnum, text))
        out.append(_element("paragraph", text, n) if readable else _element("warning", f"OCR_REQUIRED page {n}", n))
    return out
