"""Text and images of PDF files, page by page.

Streams go through their chain of filters and predictors (pdf_filters); fonts map codes by
their ToUnicode table or else as Windows-1252; text of forms comes where a page shows
them. Photographs stay as they are, raw images become PNG. Encrypted files are an error; an
image that can't be rebuilt is left out."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

from tarnkit.sources import pdf_filters

LEAST_SIDE, MOST_IMAGES = 50, 5  # of images on a page; both are the feature
MOST_FORMS = 8  # how deep forms may lie in forms

OBJECT = re.compile(rb"(?<![0-9])([0-9]+)\s+[0-9]+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"([0-9]+)\s+[0-9]+\s+R\b")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Pdf:
    """The objects of a file, by number."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"%PDF-"):
            raise ValueError("no PDF file")
        self.objects = {int(m.group(1)): m.group(2) for m in OBJECT.finditer(data)}
        ends = [data[data.rfind(b"trailer") :]] if b"trailer" in data else []
        ends += [self.head(b) for b in self.objects.values() if re.search(rb"/Type\s*/XRef\b", self.head(b))]
        if any(b"/Encrypt" in e for e in ends):
            raise ValueError("encrypted PDF file")
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", self.head(body)):
                packed, first, n = self.stream(body), self.number(body, b"First"), self.number(body, b"N")
                places = list(map(int, packed[:first].split()))[: 2 * n]
                ends = [*places[3::2], len(packed) - first]
                for key, at, end in zip(places[::2], places[1::2], ends, strict=True):
                    self.objects.setdefault(key, packed[first + at : first + end])

    @staticmethod
    def head(body: bytes) -> bytes:
        m = STREAM.search(body)
        return body[: m.start()] if m else body

    def number(self, body: bytes, key: bytes) -> int:
        """The integer under key, direct or in an object of its own; 0 without one."""
        m = re.search(rb"/" + key + rb"\s+([0-9]+)(\s+[0-9]+\s+R\b)?", self.head(body))
        return 0 if not m else int(self.objects.get(int(m.group(1)), b"0").split()[0]) if m.group(2) else int(m.group(1))

    def raw(self, body: bytes) -> bytes:
        """A stream's bytes before its filters; its length counts where it fits what is there."""
        m = STREAM.search(body)
        if not m:
            return b""
        n = self.number(body, b"Length")
        return body[m.start(1) : m.start(1) + n] if len(m.group(1)) <= n <= len(m.group(1)) + 2 else m.group(1)

    def stream(self, body: bytes) -> bytes:
        return pdf_filters.decoded(self.raw(body), self.head(body))[0]

    def image(self, body: bytes) -> bytes | None:
        """A photograph as it is stored, a raw image as PNG, None where it is neither."""
        data, photo = pdf_filters.decoded(self.raw(body), self.head(body))
        if photo:
            return data
        width, height, bits = (self.number(body, k) for k in (b"Width", b"Height", b"BitsPerComponent"))
        space = self.entry(self.head(body), b"ColorSpace").lstrip()
        if re.match(rb"\[\s*/Indexed\b", space):
            base, looked = re.match(rb"\[\s*/Indexed\s*(/\w+|\[.*?\]|[0-9]+\s+[0-9]+\s+R)\s*[0-9]+\s*(.*)", space, re.S).groups()
            r = REFERENCE.match(looked)
            palette = self.stream(self.objects.get(int(r.group(1)), b"")) if r else raw_string(next(m.group() for m in TOKEN.finditer(looked)))
            depth = self._depth(base)
            palette = pdf_filters.without_black(palette) if depth == 4 else bytes(x for x in palette for _ in range(3)) if depth == 1 else palette
            return pdf_filters.png(width, height, bits or 8, 3, data, palette)
        depth = 1 if re.search(rb"/ImageMask\s+true", self.head(body)) else self._depth(space)
        if depth == 4 and bits == 8:
            return pdf_filters.png(width, height, 8, 2, pdf_filters.without_black(data))
        return pdf_filters.png(width, height, bits or 1, 2 if depth == 3 else 0, data) if depth in (1, 3) else None

    def _depth(self, space: bytes) -> int:
        """How many numbers a colour has; 0 for a space that isn't known."""
        r = re.match(rb"\[?\s*(?:/ICCBased\s+)?([0-9]+)\s+[0-9]+\s+R\b", space)
        if r:
            body = self.objects.get(int(r.group(1)), b"")
            return self.number(body, b"N") or self._depth(body.lstrip())
        for name, depth in ((b"DeviceRGB", 3), (b"CalRGB", 3), (b"DeviceGray", 1), (b"CalGray", 1), (b"DeviceCMYK", 4)):
            if re.match(rb"\[?\s*/" + name, space):
                return depth
        return 0

    def entry(self, body: bytes, key: bytes) -> bytes:
        """What is written after key, with a reference to a single object followed."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        r = REFERENCE.match(rest)
        return self.objects.get(int(r.group(1)), b"") if r else rest

    def named(self, body: bytes, key: bytes) -> dict[bytes, int]:
        """Names and object numbers of the dictionary under key."""
        found = self.entry(body, key)
        inner = re.match(rb"\s*<<(.*?)>>", found, re.S)
        return {m.group(1): int(m.group(2)) for m in re.finditer(rb"/([^\s/<>\[\]]+)\s+([0-9]+)\s+[0-9]+\s+R\b", inner.group(1))} if inner else {}

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """The dictionary and the resources of each page in reading order; without a tree, by number."""
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        seen: set[int] = set()
        found = False
        stack = [(int(m.group(1)), b"") for b in roots if (m := re.search(rb"/Pages\s+([0-9]+)\s", b))][:1]
        while stack:
            key, inherited = stack.pop()
            body = self.head(self.objects.get(key, b""))
            if key in seen:
                continue
            seen.add(key)
            own = self.entry(body, b"Resources") or inherited
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                stack += [(int(m.group(1)), own) for m in reversed(list(REFERENCE.finditer(kids.group(1))))]
            elif body:
                found = True
                yield body, own
        if not found:
            for body in (self.head(b) for _, b in sorted(self.objects.items())):
                if re.search(rb"/Type\s*/Page\b", body):
                    yield body, self.entry(body, b"Resources")

    def contents(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[.*?\]|[0-9]+\s+[0-9]+\s+R\b)", page, re.S)
        return b"\n".join(self.stream(self.objects.get(int(r.group(1)), b"")) for r in REFERENCE.finditer(m.group(1))) if m else b""


def unicode_map(table: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each code, from a ToUnicode table."""
    width, found = 1, {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "surrogatepass")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width, found[int(a, 16)] = max(width, len(a) // 2), text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for a, b, first, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            width, low, high = max(width, len(a) // 2), int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
            if listed:
                found |= dict(zip(range(low, high + 1), map(text, HEX.findall(listed)), strict=False))
            else:
                base = text(first)
                found |= {c: base[:-1] + chr(min(0x10FFFF, ord(base[-1]) + c - low)) for c in range(low, high + 1)}
    return width, found


def raw_string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = b"".join(token[1:-1].split())
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return ESCAPE.sub(lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else ESCAPED.get(m.group(1), m.group(1)), token[1:-1])


def page_text(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]], form: Callable[[bytes], str] = lambda name: "") -> str:
    """Shown strings, and the text of forms by name; a move to another line breaks it, a wide gap is a space."""
    out: list[str] = []
    held: list[bytes] = []
    width, table = 1, None

    def show(token: bytes) -> str:
        raw = raw_string(token)
        if table is None:
            return raw.decode("cp1252", "replace")
        text = "".join(table.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")  # halves of a character may be two codes

    def broken() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for m in TOKEN.finditer(content):
        token = m.group()
        if not (token[:1].isalpha() or token in (b"'", b'"')):
            held.append(token)
            continue
        if token == b"Tf":
            width, table = next((fonts[h[1:]] for h in reversed(held) if h[:1] == b"/" and h[1:] in fonts), (1, None))
        elif token == b"Do" and held and (inner := form(held[-1][1:])):
            broken()
            out.append(inner + "\n")
        elif token in (b"T*", b"ET", b"Tm") or token in (b"Td", b"TD") and held[-1:] and held[-1].lstrip(b"+-0.") != b"":
            broken()
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                broken()
            for h in held:
                if h[:1] in (b"(", b"<"):
                    out.append(show(h))
                elif token == b"TJ" and h[:1] == b"-" and float(h) < -200:
                    out.append(" ")
        held.clear()
    return "".join(out).strip()


def shown(pdf: Pdf, content: bytes, resources: bytes, within: tuple[int, ...] = ()) -> str:
    """The text of a page or form, with its fonts and the forms it shows; none shows itself."""
    fonts = {}
    for name, key in pdf.named(resources, b"Font").items():
        table = pdf.stream(pdf.entry(pdf.objects.get(key, b""), b"ToUnicode"))
        if table:
            fonts[name] = unicode_map(table)
    inner = pdf.named(resources, b"XObject")

    def form(name: bytes) -> str:
        key = inner.get(name, -1)
        body = pdf.objects.get(key, b"")
        if key in within or len(within) == MOST_FORMS or not re.search(rb"/Subtype\s*/Form\b", pdf.head(body)):
            return ""
        return shown(pdf, pdf.stream(body), pdf.entry(pdf.head(body), b"Resources") or resources, (*within, key))

    return page_text(content, fonts, form)


def parse(data: bytes) -> tuple[str, list]:
    """The text of the pages with blank lines between, and their images, each once."""
    pdf = Pdf(data)
    texts, images, seen, n = [], [], set(), 0
    for page, resources in pdf.pages():
        n += 1
        texts.append(shown(pdf, pdf.contents(page), resources))
        kept = 0
        for key in pdf.named(resources, b"XObject").values():
            body = pdf.objects.get(key, b"")
            if kept == MOST_IMAGES or not re.search(rb"/Subtype\s*/Image\b", pdf.head(body)) or min(pdf.number(body, b"Width"), pdf.number(body, b"Height")) < LEAST_SIDE:
                continue
            try:
                image = pdf.image(body)
            except (ValueError, zlib.error, IndexError, AttributeError):
                image = None
            mark = hashlib.md5(image or b"").digest()
            if image and mark not in seen:
                seen.add(mark)
                kept += 1
                images.append({"name": f"page {n} image {kept}", "data": image, "place": n})
    if not n:
        raise ValueError("no pages")
    return "\n\n".join(t for t in texts if t), images
