"""Text of PDF pages: an extractor without other libraries, for files with simple fonts.

It reads plain and compressed objects and the text operators of page contents. Fonts with encodings of their own, scans and encrypted
files need another extractor, which ``read_documents`` takes as a parameter.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|[-+]?(?:\d+\.?\d*|\.\d+)|/[^\s/\[\]()<>]+|[A-Za-z]+\*?|['\"]", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
GAP = -200  # thousandths of the font size; a larger step back between strings is a blank


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in [b for b in found.values() if re.search(rb"/Type\s*/ObjStm\b", b)]:
        inner, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
        numbers = list(map(int, inner[:first].split()))
        ends = [*numbers[3::2], len(inner) - first]
        for number, at, end in zip(numbers[::2], numbers[1::2], ends, strict=True):
            found.setdefault(number, inner[first + at : first + end])
    return found


def _stream(body: bytes) -> bytes:
    m = _STREAM.match(body)
    if not m:
        return b""
    if b"/FlateDecode" in m[1]:
        return zlib.decompressobj().decompress(m[2])
    return m[2] if b"/Filter" not in m[1] else b""


def _text(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PLAIN.get(m[1], m[1]), token[1:-1])
    if raw.startswith(b"\xfe\xff") or (len(raw) > 1 and len(raw) % 2 == 0 and not any(raw[::2])):
        return raw.removeprefix(b"\xfe\xff").decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    out, held, depth = [], [], 0
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t in (b"[", b"]"):
            depth += 1 if t == b"[" else -1
        elif t[:1] in b"(<":
            held.append(_text(t))
        elif t[:1] in b"+-.0123456789":
            held.append(" " if depth and float(t) < GAP else float(t))
        else:
            if t in (b"'", b'"', b"T*", b"ET", b"Tm") or (t in (b"Td", b"TD") and held and held[-1] != 0.0):
                out.append("\n")
            if t in (b"Tj", b"TJ", b"'", b'"'):
                out += [x for x in held if isinstance(x, str)]
            held = []
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page, in the order of the page tree."""
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("encrypted PDF")
    objects, seen, out = _objects(data), set(), []

    def visit(number: int) -> None:
        body = objects.get(number, b"")
        if number in seen:
            return
        seen.add(number)
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
            for m in _REFERENCE.finditer(kids[1]):
                visit(int(m[1]))
        elif re.search(rb"/Type\s*/Page\b", body):
            parts = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
            content = b"\n".join(_stream(objects.get(int(m[1]), b"")) for m in _REFERENCE.finditer(parts[1])) if parts else b""
            out.append(_shown(content))

    roots = [int(m[1]) for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", b))]
    for number in roots or sorted(objects):
        visit(number)
    return out
