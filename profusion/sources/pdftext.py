"""Text of PDF files, page by page, for files whose text is text: Flate or plain streams, simple and composite fonts.

Objects are read from the file as they stand (object streams too), without the cross-reference table, so files with a
damaged table are read as well. Pages come in the order of the page tree. Codes become characters by a font's ToUnicode
map, else as Windows-1252. A line ends where the text position moves down. Encrypted files, other filters and files without
pages have no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(
    rb"%[^\r\n]*|(?P<text>\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\))|<<|>>|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\[)|(?P<shut>\])|/(?P<name>[^\s/\[\]()<>%]*)"
    rb"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[A-Za-z'\"*][A-Za-z0-9*]*)",
    re.S,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Pdf:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-" or b"/Encrypt" in data:
            raise ValueError("no readable PDF")
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                self._unpack(body)
        self.fonts: dict[int, dict[bytes, str]] = {}

    def _unpack(self, body: bytes) -> None:
        raw, first = self.stream(body), int(self.value(body, b"First") or 0)
        at = [int(x) for x in raw[:first].split()]
        places = list(zip(at[::2], at[1::2], strict=False))
        for i, (number, start) in enumerate(places):
            end = places[i + 1][1] if i + 1 < len(places) else len(raw) - first
            self.objects.setdefault(number, raw[first + start : first + end])

    @staticmethod
    def value(body: bytes, key: bytes) -> bytes | None:
        """What stands after a key, up to the next key: a number, a reference, an array or a dictionary's beginning."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*(\[.*?\]|<<.*?>>|/?[^/<>\[\]]+)", body, re.S)
        return m[1].strip() if m else None

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        head = body[: m.start()]
        filters = re.findall(rb"/(\w+Decode)\b", head)
        if not filters:
            return m[1]
        if filters != [b"FlateDecode"]:
            raise ValueError("a filter that is not read")
        return zlib.decompressobj().decompress(m[1])

    def refs(self, body: bytes | None) -> list[int]:
        return [int(x) for x in _REF.findall(body or b"")]

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """Each page with its resources, which it may have from above."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        todo, seen = [(n, b"") for n in self.refs(self.value(root, b"Pages"))], set()
        while todo:
            number, above = todo.pop(0)
            body = self.objects.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            held = self._resources(body) or above
            kids = self.refs(self.value(body, b"Kids"))
            if kids:
                todo = [(k, held) for k in kids] + todo
            elif re.search(rb"/Type\s*/Page\b", body):
                yield body, held

    def _resources(self, body: bytes) -> bytes:
        m = re.search(rb"/Resources\s*(?:(\d+)\s+\d+\s+R|(<<.*))", body, re.S)
        return b"" if not m else self.objects.get(int(m[1]), b"") if m[1] else m[2]

    def maps(self, resources: bytes) -> dict[bytes, dict[bytes, str]]:
        """The ToUnicode map of each font name."""
        m = re.search(rb"/Font\s*(?:(\d+)\s+\d+\s+R|<<(.*?)>>)", resources, re.S)
        listed = b"" if not m else self.objects.get(int(m[1]), b"") if m[1] else m[2]
        out = {}
        for name, number in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", listed):
            of = self.refs(self.value(self.objects.get(int(number), b""), b"ToUnicode"))
            if of:
                out[name] = self._unicode(of[0])
        return out

    def _unicode(self, number: int) -> dict[bytes, str]:
        if number in self.fonts:
            return self.fonts[number]
        out: dict[bytes, str] = {}
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        raw = self.stream(self.objects.get(number, b""))
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[bytes.fromhex(a.decode())] = text(b)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
            for a, b, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
                low, size = int(a, 16), len(a) // 2
                own = re.findall(rb"<([0-9A-Fa-f]+)>", many)
                for k in range(min(int(b, 16) - low + 1, 1 << 16)):
                    got = (text(own[k]) if k < len(own) else "") if own else text(one)[:-1] + chr(ord(text(one)[-1]) + k)
                    out[(low + k).to_bytes(size, "big")] = got
        self.fonts[number] = out
        return out

    def text(self) -> str:
        out = []
        for body, resources in self.pages():
            raw = b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.refs(self.value(body, b"Contents")))
            out.append(shown(raw, self.maps(resources)) + "\n")
        return "".join(out)


def literal(raw: bytes) -> bytes:
    """The bytes of a string in parentheses."""

    def escaped(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x[:1] in b"\r\n" else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escaped, raw[1:-1], flags=re.S)


def spelled(raw: bytes, codes: dict[bytes, str] | None) -> str:
    if not codes:
        return raw.decode("cp1252", "replace")
    size = max(map(len, codes))
    return "".join(codes.get(raw[i : i + size], "") for i in range(0, len(raw), size))


def shown(raw: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """The text that a page's operators show."""
    out: list[str] = []
    stack: list = []
    codes, listed, height = None, None, None

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for m in _TOKEN.finditer(raw):
        kind = m.lastgroup
        if kind in ("text", "hex"):
            value = literal(m["text"]) if kind == "text" else bytes.fromhex((h := re.sub(rb"\s", b"", m["hex"]).decode()) + "0" * (len(h) % 2))
            (stack if listed is None else listed).append(value)
        elif kind == "number":
            (stack if listed is None else listed).append(float(m["number"]))
        elif kind == "name":
            stack.append(m["name"])
        elif kind == "open":
            listed = []
        elif kind == "shut":
            stack.append(listed or [])
            listed = None
        elif kind == "word":
            op = m["word"]
            if op == b"Tf" and len(stack) > 1:
                codes = fonts.get(stack[-2])
            elif op in (b"Td", b"TD") and len(stack) > 1 and stack[-1]:
                line()
            elif op == b"Tm" and stack:
                if height is not None and stack[-1] != height:
                    line()
                height = stack[-1]
            elif op in (b"T*", b"'", b'"'):
                line()
            if op in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                out.append(spelled(stack[-1], codes))
            elif op == b"TJ" and stack and isinstance(stack[-1], list):
                # A wide gap between two pieces is a space.
                out.append("".join(spelled(x, codes) if isinstance(x, bytes) else " " if x < -200 else "" for x in stack[-1]))
            elif op == b"ET":
                line()
            stack = []
    return "".join(out).rstrip("\n")


def pdf_text(content: bytes) -> str | None:
    """Text page by page; null if the file is damaged or of a kind that is not read."""
    try:
        pdf = Pdf(content)
        return pdf.text() if any(True for _ in pdf.pages()) else None
    except (ValueError, zlib.error, IndexError, TypeError):
        return None
