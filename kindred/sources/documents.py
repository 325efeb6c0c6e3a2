"""Text of PDF and DOCX files with the standard library alone; null if there is none."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def docx_text(content: bytes) -> str | None:
    """Paragraphs, one a line."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    out = []
    for p in root.iter(f"{_WORD}p"):
        out.append("".join(x.text or "" if x.tag == f"{_WORD}t" else "\t" if x.tag == f"{_WORD}tab" else "\n" for x in p.iter() if x.tag in (f"{_WORD}t", f"{_WORD}tab", f"{_WORD}br")))
    return "\n".join(out)


def _literal(s: bytes) -> str:
    s = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), s)
    s = re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), s, flags=re.DOTALL)
    return s.decode("utf-16-be" if s.startswith(b"\xfe\xff") else "latin-1", "replace")


_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|\bT[dDmjJ]\b|['\"]|\bET\b", re.DOTALL)


def pdf_text(content: bytes) -> str | None:
    """Shown strings of the page streams (plain or deflated, simple encodings), a line for each move to another line."""
    if not content.startswith(b"%PDF"):
        return None
    lines, line = [], []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.DOTALL):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"Tj" not in data and b"TJ" not in data:
            continue
        for t in _SHOWN.findall(data):
            if t.startswith(b"("):
                line.append(_literal(t[1:-1]))
            elif t.startswith(b"<"):
                digits = re.sub(rb"\s", b"", t[1:-1])
                line.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
            elif t not in (b"Tj", b"TJ") and line:
                lines.append("".join(line))
                line = []
        if line:
            lines.append("".join(line))
            line = []
    return "\n".join(lines) or None


def text_of(content: bytes | None, kind: str) -> str | None:
    if content is None:
        return None
    if kind == "resume_pdf":
        return pdf_text(content)
    if kind == "resume_docx":
        return docx_text(content)
    return content.decode("utf-8", "replace")
