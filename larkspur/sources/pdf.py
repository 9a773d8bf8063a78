"""When a PDF document was made: by its cross-reference data, not by searching its bytes.

Read are cross-reference tables and streams with their earlier sections, objects
in object streams, literal, hexadecimal and UTF-16 strings, and metadata packets.
What can't be read (damaged, encrypted) has no dates here.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

SPACE = b"\0\t\n\f\r "
TOKEN = re.compile(rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\0\t\n\f\r ]*)*(<<|>>|\[|\]|/[^\0\t\n\f\r ()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/%]+|\(|<)")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
LEVELS = 60  #: nested values, followed references and sections, at most


@dataclass(frozen=True)
class Ref:
    number: int


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string after its opening parenthesis, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            m = re.compile(rb"[0-7]{1,3}|\r\n|.", re.DOTALL).match(data, at)
            if not m:
                break
            at, x = m.end(), m[0]
            out += bytes([int(x, 8) & 255]) if x[:1].isdigit() and x[:1] < b"8" else b"" if x in (b"\r\n", b"\n", b"\r") else ESCAPES.get(x, x)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def value(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The value that begins at a place: numbers, names (as text with /), strings (as bytes), lists, dictionaries, references."""
    m = TOKEN.match(data, at)
    if not m or depth > LEVELS:
        raise ValueError("no value")
    t, at = m[1], m.end()
    if t == b"(":
        return literal(data, at)
    if t == b"<":
        end = data.index(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2)), end + 1
    if t in (b"<<", b"["):
        items = []
        while True:
            m = TOKEN.match(data, at)
            if m and m[1] in (b">>", b"]"):
                break
            item, at = value(data, at, depth + 1)
            items.append(item)
        return (dict(zip(items[::2], items[1::2])) if t == b"<<" else items), m.end()
    if t[:1] == b"/":
        return t.decode("latin-1"), at
    if re.fullmatch(rb"[+-]?\d+", t):
        m = re.compile(rb"[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R(?![A-Za-z])").match(data, at)
        return (Ref(int(t)), m.end()) if m else (int(t), at)
    return t.decode("latin-1"), at


def unpredicted(data: bytes, columns: int, predictor: int) -> bytes:
    """Bytes without the row filters of PNG that have no, left, or up neighbours (the ones in use for tables)."""
    if predictor < 10:
        return data
    out, before = bytearray(), bytes(columns)
    for lo in range(0, len(data), columns + 1):
        kind, row = data[lo], bytearray(data[lo + 1 : lo + 1 + columns])
        for i in range(len(row)):
            left = row[i - 1] if i else 0
            row[i] = (row[i] + {0: 0, 1: left, 2: before[i]}[kind]) & 255
        out += row
        before = bytes(row)
    return bytes(out)


@dataclass
class Document:
    data: bytes
    places: dict[int, tuple[int, int, int]] = field(default_factory=dict)  #: kind, then offset, or number of the stream and place in it
    trailer: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        at, seen = int(re.findall(rb"startxref\s+(\d+)", self.data)[-1]), set()
        while at is not None and at not in seen and len(seen) < LEVELS:
            seen.add(at)
            found = self.table(at) if re.compile(rb"\s*xref\b").match(self.data, at) else self.stream_table(at)
            for k, v in found.items():
                self.trailer.setdefault(k, v)
            for more in (found.get("/XRefStm"), found.get("/Prev")):
                at = more if isinstance(more, int) and more not in seen else None
                if at is not None:
                    break

    def table(self, at: int) -> dict:
        m = re.compile(rb"\s*xref\s*").match(self.data, at)
        at = m.end()
        while m := re.compile(rb"(\d+)\s+(\d+)\s*").match(self.data, at):
            first, n = int(m[1]), int(m[2])
            at = m.end()
            for i in range(n):
                e = re.compile(rb"(\d+)\s+\d+\s+([nf])\s*").match(self.data, at)
                at = e.end()
                if e[2] == b"n":
                    self.places.setdefault(first + i, (1, int(e[1]), 0))
        return value(self.data, self.data.index(b"trailer", at) + 7)[0]

    def stream_table(self, at: int) -> dict:
        d, raw = self.stream(at)
        widths, index = d["/W"], d.get("/Index", [0, d["/Size"]])
        numbers = [k for first, n in zip(index[::2], index[1::2]) for k in range(first, first + n)]
        for i, k in enumerate(numbers):
            row, parts = raw[i * sum(widths) : (i + 1) * sum(widths)], []
            for w in widths:
                parts.append(int.from_bytes(row[:w], "big") if w else None)
                row = row[w:]
            kind = 1 if parts[0] is None else parts[0]
            if kind in (1, 2):
                self.places.setdefault(k, (kind, parts[1] or 0, parts[2] or 0))
        return d

    def stream(self, at: int) -> tuple[dict, bytes]:
        """The dictionary and the content of the stream object at a place."""
        m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        d, at = value(self.data, m.end())
        m = re.compile(rb"\s*stream\r?\n").match(self.data, at)
        size = self.get(d["/Length"])
        raw = self.data[m.end() : m.end() + size]
        filters = self.get(d.get("/Filter", []))
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "/FlateDecode":
                raise ValueError(f"filter {f}")
            raw = zlib.decompressobj().decompress(raw)
            how = self.get(d.get("/DecodeParms")) or {}
            how = how[0] if isinstance(how, list) else how
            raw = unpredicted(raw, how.get("/Columns", 1), how.get("/Predictor", 1))
        return d, raw

    def get(self, x: object) -> object:
        """What a reference refers to; other values as they are."""
        for _ in range(LEVELS):
            if not isinstance(x, Ref):
                return x
            if x.number not in self.places:
                return None
            kind, a, b = self.places[x.number]
            if kind == 1:
                m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, a)
                x = value(self.data, m.end())[0]
            else:
                d, raw = self.stream(self.places[a][1])
                places = [int(n) for n in raw[: d["/First"]].split()][1::2]
                x = value(raw, d["/First"] + places[b])[0]
        return None

    def content(self, x: object) -> bytes | None:
        return self.stream(self.places[x.number][1])[1] if isinstance(x, Ref) and x.number in self.places else None


def said(raw: object) -> str | None:
    """A text string: UTF-16 or UTF-8 by its first bytes, else one byte for each character."""
    if not isinstance(raw, bytes):
        return None
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    return raw.decode("utf-8-sig" if raw[:3] == b"\xef\xbb\xbf" else "latin-1", "replace")


def dates(data: bytes) -> list[str]:
    """The dates of a document as written: of its metadata packet, and of its dictionary (when made, else when changed)."""
    try:
        doc = Document(data)
        if "/Encrypt" in doc.trailer:
            return []
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error):
        return []
    out = []
    for find in (packet_date, dictionary_date):
        try:
            found = find(doc)
        except (ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error):
            found = None  # one of the two may be damaged
        if found:
            out.append(found)
    return out


def packet_date(doc: Document) -> str | None:
    root = doc.get(doc.trailer.get("/Root"))
    packet = doc.content(root.get("/Metadata"))
    m = re.search(rb"CreateDate(?:[^>=]*>\s*|\s*=\s*[\"'])([^<\"']+)", packet or b"")
    return m[1].decode("utf-8", "replace") if m else None


def dictionary_date(doc: Document) -> str | None:
    info = doc.get(doc.trailer.get("/Info"))
    return said(doc.get(info.get("/CreationDate"))) or said(doc.get(info.get("/ModDate")))
