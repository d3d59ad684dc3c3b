"""Secret scans: a recursive decoding worklist over whole texts.

The text is the first layer.  Each layer is scanned by the base patterns and
unwrapped: percent escapes and Unicode escapes decode the whole layer with a
map of every character to its place in the text; base64 runs, also those wrapped
over lines, decode at all four alignments to layers of their own.  Compressed
bytes in them, or in percent escapes, are inflated wherever they start: all
members, and of a damaged stream what comes before the damage.  Bytes are read as
UTF-8, else as Latin-1, and as UTF-16 too if they hold a zero byte (an ASCII
character of UTF-16 has one).  New layers join the worklist until none is new; a
layer seen before at the same place is not scanned again, so cycles end.  Every
span is reported at its place in the text: that of the escapes it was read
through, or of the whole run of base64 (all lines of a wrapped one) or of escapes.

No shuffle; a task holds one text and its layers.  ``max_layer`` bounds an
inflated layer, against bombs: one that would grow larger is not a text to scan
and is left out whole.

Defined results: a null text is empty and has no spans; secrets found twice at
the same place count once; base spans always stay; repeated rows are scanned
alike; other columns pass through.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import urllib.parse
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh

KINDS = ("assign", "access", "hex")
# Fixed patterns of the op6 contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters in all
HEX = re.compile(r"[0-9a-f]{16,}")
#: One of these stands in every assignment.
CUES = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that go on at the start of the next line.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t>]*+[A-Za-z0-9+/_-]++)++={0,2}")
BREAK = re.compile(r"[\x20\t\r\n>]+")
SOLID = re.compile(r"\S+")
#: Starts of gzip and zlib streams.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def in_order(spans) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


class Layer:
    """A text and where each character of it stands in the first layer."""

    def __init__(self, text: str, at: list[tuple[int, int]] | tuple[int, int] | None):
        self.text, self.at = text, at

    def place(self, s: int, e: int) -> tuple[int, int]:
        if self.at is None:
            return s, e
        if isinstance(self.at, tuple):
            return self.at
        return self.at[s][0], self.at[e - 1][1]


def _escapes(run: str) -> str:
    text = ONE.sub(lambda m: _char(int(m[1] or m[2] or m[4], 16) if m[3] is None else int(m[3])), run)
    # surrogate pairs written as two escapes are one character
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _char(code: int) -> str:
    return chr(code) if code <= 0x10FFFF else "�"


def rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each run of escapes decoded, or None without any."""
    parts: list[str] = []
    at: list[tuple[int, int]] = []
    last = 0
    for m in pattern.finditer(layer.text):
        parts.append(layer.text[last : m.start()])
        at += [layer.place(i, i + 1) for i in range(last, m.start())]
        parts.append(text := decode(m[0]))
        at += [layer.place(m.start(), m.end())] * len(text)
        last = m.end()
    if not parts:
        return None
    parts.append(layer.text[last:])
    at += [layer.place(i, i + 1) for i in range(last, len(layer.text))]
    return Layer("".join(parts), at)


def member(data: bytes, most: int) -> tuple[bytes, int, bool] | None:
    """(contents, length, undamaged) of the compressed stream that data starts with; None beyond ``most`` bytes."""
    z = zlib.decompressobj(47)
    out: list[bytes] = []
    at = size = 0
    step = 1 << 16
    while at < len(data) and not z.eof:
        before = z.copy() if step > 1 else None
        try:
            out.append(z.decompress(data[at : at + step], most - size + 1))
        except zlib.error:
            if before is None:
                return b"".join(out), at, False
            # again in smaller pieces, up to the damaged byte
            z, step = before, step >> 4
            continue
        size += len(out[-1])
        if size > most:
            return None
        at += step
    return b"".join(out), min(at, len(data)) - len(z.unused_data), z.eof


def unpacked(data: bytes, most: int) -> tuple[list[bytes], list[bytes]]:
    """(bytes outside compressed streams, contents of such streams), layer by layer; a stream of more than ``most`` bytes is left out."""
    plain: list[bytes] = []
    contents: list[bytes] = []
    work, seen = [(data, False)], {data}
    while work:
        data, inner = work.pop()
        keep = contents if inner else plain
        last = pos = 0
        joined: list[bytes] = []

        def close() -> None:
            whole = b"".join(joined)
            joined.clear()
            if whole and whole not in seen:
                seen.add(whole)
                work.append((whole, True))

        while m := PACKED.search(data, pos):
            start = m.start()
            found = member(data[start:], most)
            if found and not found[0] and not found[2]:
                pos = start + 1
                continue
            if start > last:
                close()
                keep.append(data[last:start])
            if not found:
                close()
                last = pos = len(data)
                break
            body, length, good = found
            joined.append(body)
            # a damaged stream may have been none
            last, pos = (start + length,) * 2 if good else (start, start + 2)
            if not good:
                close()
        close()
        if last < len(data):
            keep.append(data[last:])
    return plain, contents


def readings(data: bytes) -> list[str]:
    """The texts that bytes may stand for."""
    try:
        out = [data.decode()]
    except UnicodeDecodeError:
        out = [data.decode("latin-1")]
    if 0 in data:
        # something before them may shift the pairs
        out += [data[k:].decode(code, "replace") for k in (0, 1) for code in ("utf-16-le", "utf-16-be")]
    return out


def texts_of_base64(run: str, most: int) -> list[str]:
    """The texts that a run of base64 may hold, at all four alignments."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    out: dict[str, None] = {}
    for k in range(4):
        part = body[k:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        for data in sum(unpacked(binascii.a2b_base64(part + "=" * (-len(part) % 4)), most), []):
            out |= dict.fromkeys(readings(data))
    return list(out)


def from_base64(run: str, most: int) -> str | None:
    """The text that a run of base64 holds if it starts with the run, or None if it holds none."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    found = sum(reversed(unpacked(binascii.a2b_base64(body + "=" * (-len(body) % 4)), most)), [])
    return readings(found[0])[0] if found else None


def texts_of_percent(run: str, most: int) -> list[str]:
    """The texts compressed in the bytes of percent escapes and the characters between them."""
    out: dict[str, None] = {}
    for form in {run, run.replace("+", " ")}:
        for data in unpacked(urllib.parse.unquote_to_bytes(form), most)[1]:
            out |= dict.fromkeys(readings(data))
    return list(out)


def all_spans(text: str, max_layer: int = 1 << 26) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both in order."""
    base = base_spans(text)
    found = set(base)
    work: deque[Layer] = deque([Layer(text, None)])
    seen = {(text, 0, len(text))}

    def add(child: Layer | None) -> None:
        if child and child.text:
            key = (child.text, *child.place(0, len(child.text)))
            if key not in seen:
                seen.add(key)
                work.append(child)

    while work:
        layer = work.popleft()
        if layer.at is not None:
            found |= {(k, *layer.place(s, e)) for k, s, e in base_spans(layer.text)}
        if "%" in layer.text:
            add(rewritten(layer, PERCENT, lambda run: bytes.fromhex(run.replace("%", "")).decode(errors="replace")))
            for m in SOLID.finditer(layer.text):
                if "%" in m[0]:
                    for decoded in texts_of_percent(m[0], max_layer):
                        add(Layer(decoded, layer.place(m.start(), m.end())))
        if "\\" in layer.text or "&#" in layer.text:
            add(rewritten(layer, ESCAPE, _escapes))
        for m in BASE64.finditer(layer.text):
            for decoded in texts_of_base64(m[0], max_layer):
                add(Layer(decoded, layer.place(m.start(), m.end())))
        if "\n" in layer.text:
            for m in WRAPPED.finditer(layer.text):
                for decoded in texts_of_base64(BREAK.sub("", m[0]), max_layer):
                    add(Layer(decoded, layer.place(m.start(), m.end())))
    return in_order(base), in_order(found)


def find_secrets(docs: DataFrame, text: str = "text", max_layer: int = 1 << 26) -> DataFrame:
    """docs with base_spans and spans, arrays of (kind, start, end) in code points."""
    names = fresh(docs, "base_spans", "spans")
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, span) for n in names)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [all_spans(t.as_py() or "", max_layer) for t in b.column(text)]
            lists = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=schema.names)

    return docs.mapInArrow(scan, schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, text -> counts, digest of the base spans, and all spans."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_assign long, n_access long, n_hex long, base_sha256 string, spans string").fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text"):
                base, found = all_spans(t.as_py() or "")
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret replaced by ``mark`` and n_chars counted anew; texts without secrets, and null ones, stay as they are."""
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = b.column("n_chars").to_pylist() if "n_chars" in b.schema.names else [None] * len(texts)
            for i, t in enumerate(texts):
                if t and (spans := all_spans(t)[1]):
                    texts[i] = cut(t, spans, mark)
                    sizes[i] = len(texts[i])
            cols = [pa.array(texts, pa.string()) if n == "text" else pa.array(sizes, b.column(n).type) if n == "n_chars" else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(clean, schema)


def cut(text: str, spans: list[Span], mark: str) -> str:
    out, last = [], 0
    for _, s, e in spans:
        if s >= last:
            out += [text[last:s], mark]
        last = max(last, e)
    return "".join([*out, text[last:]])


def encode64(text: str) -> str:
    """For tests: the text as base64."""
    return base64.b64encode(text.encode()).decode()
