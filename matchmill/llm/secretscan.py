"""Secrets in texts and in what the texts hold encoded: a worklist of layers that are decoded until nothing new comes.

A layer is a text, with the place in the document that each of its characters stands for. The document itself is the
first. From a layer come
  url      the layer with its `%XX` escapes decoded,
  unicode  the layer with its `\\uXXXX`, `\\UXXXXXXXX`, `\\u{X}`, `\\xXX`, `&#N;` and `&#xN;` escapes decoded,
  base64   each run of base64 (of 16 characters or more, lines joined) that holds text or compressed data,
  gzip, zlib, bz2, xz, zstd   what such data unpacks to.
Every new layer is scanned as the document is and goes on the worklist. A layer whose text was met before at the same place
is not taken again, so data that unpack to themselves end the chain. Spans are mapped back: an escape's character stands for
the whole escape, a base64 byte for the characters that hold its bits, an unpacked character for all of the packed data.

A span found in a layer is called kind@layers, as in `assign@base64+gzip`, unless the same kind has the same place already.

Layers that unpack are read up to MOST_BYTES in all per document; where a document holds more, the rest isn't dropped in
silence: the packed data are a span of the kind `oversize`.

Defined cases: null counts as the empty text, without spans; rows are scanned one by one, so repeated rows and null ids stay
as they are; a very long text is scanned whole; kinds may overlap each other but not themselves within a layer; escaped or
unpacked bytes that are no UTF-8 are taken as Latin-1; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .scratch import small_batches
from .workers import free

#: The base kinds, and how many characters of which group a match must have.
KINDS: dict[str, tuple[re.Pattern, int, int]] = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a run that long begins where the run of any length does
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
#: What every keyword of `assign` contains, in small letters.
STEMS = ("passw", "secret", "token", "api")
#: Bytes that the unpacked layers of one document may have in all.
MOST_BYTES = 64 << 20

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{2,})*={0,2}")
LINE = re.compile(r"[^\r\n]{16,}")
#: Characters of RUN as 1, others as 0: only a text with LEAST_RUN in a row can hold base64, a hex or an access key.
RUNS = bytes(bool(re.match(r"[A-Za-z0-9+/_-]", chr(i))) for i in range(256))
LEAST_RUN = b"\1" * 16
BREAK = re.compile(r"[\r\n]")
#: The bytes that compressed data begin with.
MAGIC = {b"\x1f\x8b": "gzip", b"x\x01": "zlib", b"x\x5e": "zlib", b"x\x9c": "zlib", b"x\xda": "zlib", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
#: The share of a decoded run that must be printable for it to count as text.
PRINTABLE = 0.9


@dataclass
class Layer:
    """A text, the names of the decoders that led to it, and for each character the document's characters [start, end)."""

    text: str
    how: tuple[str, ...]
    start: np.ndarray
    end: np.ndarray

    def place(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])

    def key(self) -> tuple[bytes, int, int]:
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), int(self.start[0]), int(self.end[-1])


def has_run(text: str) -> bool:
    return LEAST_RUN in text.encode("utf-8", "surrogatepass").translate(RUNS)


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """The base spans of a text by kind."""
    small, run = text.lower(), has_run(text)
    for kind, (pattern, group, least) in KINDS.items():
        if not (any(s in small for s in STEMS) if kind == "assign" else run):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def _rewritten(layer: Layer, name: str, pattern: re.Pattern, decoded: Callable[[str], tuple[str, list[int]] | None]) -> Layer | None:
    """The layer with each match of `pattern` decoded. `decoded` gives the new text and, for each of its characters, where
    its escape begins in the match."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0
    for m in pattern.finditer(text):
        if (new := decoded(m[0])) is None or not new[0]:
            continue
        a, b = m.span()
        offset = np.array([*new[1], b - a]) + a
        parts += [text[at:a], new[0]]
        starts += [layer.start[at:a], layer.start[offset[:-1]]]
        ends += [layer.end[at:a], layer.end[offset[1:] - 1]]
        at = b
    if not parts:
        return None
    return Layer("".join([*parts, text[at:]]), (*layer.how, name), np.concatenate([*starts, layer.start[at:]]), np.concatenate([*ends, layer.end[at:]]))


def _characters(raw: bytes) -> tuple[str, np.ndarray]:
    """The text of some bytes, and the byte at which each character begins."""
    try:
        return raw.decode("utf-8"), np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    except UnicodeDecodeError:
        return raw.decode("latin-1"), np.arange(len(raw))


def _from_url(run: str) -> tuple[str, list[int]]:
    text, at = _characters(bytes.fromhex(run.replace("%", "")))
    return text, (at * 3).tolist()


def _from_escapes(run: str) -> tuple[str, list[int]] | None:
    if run[0] == "&":
        return html.unescape(run), [0] * len(html.unescape(run))
    codes, places = [], []
    for m in ONE_ESCAPE.finditer(run):
        code = int(m[1] or m[2], 16)
        if 0xDC00 <= code < 0xE000 and codes and 0xD800 <= codes[-1] < 0xDC00:
            codes[-1] = 0x10000 + ((codes[-1] - 0xD800) << 10) + code - 0xDC00
            continue
        codes.append(code)
        places.append(m.start())
    if any(c > 0x10FFFF or 0xD800 <= c < 0xE000 for c in codes):
        return None
    return "".join(map(chr, codes)), places


def _packing(raw: bytes) -> str | None:
    return next((name for magic, name in MAGIC.items() if raw.startswith(magic)), None)


def _unpacked(raw: bytes, name: str, most: int) -> bytes:
    """At most `most` + 1 bytes of what compressed data hold, members in a row included; what precedes damage counts."""
    out = b""
    try:
        if name == "zstd":
            with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as reader:
                return reader.read(most + 1)
        while len(out) <= most and raw and _packing(raw) == name:
            reader = zlib.decompressobj(31 if name == "gzip" else 15) if name in ("gzip", "zlib") else bz2.BZ2Decompressor() if name == "bz2" else lzma.LZMADecompressor()
            out += reader.decompress(raw, most + 1 - len(out))
            raw = reader.unused_data
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass
    return out


def _readable(raw: bytes) -> bool:
    codes = np.frombuffer(raw, np.uint8)
    good = ((codes >= 32) & (codes != 127)) | ((codes >= 9) & (codes <= 13))
    try:
        return len(codes) > 0 and float(good.mean()) >= PRINTABLE and raw.decode("utf-8") is not None
    except UnicodeDecodeError:
        return False


def _from_base64(run: str) -> tuple[bytes, np.ndarray, np.ndarray] | None:
    """The bytes of a run, and where the characters that hold each byte begin and end. A run may begin with characters
    that belong to the text before it, so each of the four phases is tried."""
    places = np.array([i for i, c in enumerate(run) if c not in "\r\n="], np.int64)
    letters = BREAK.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    for phase in range(4):
        body = letters[phase:]
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue
        if raw and (_packing(raw) or _readable(raw)):
            byte = np.arange(len(raw))
            first = byte // 3 * 4 + byte % 3 + phase
            return raw, places[first], places[first + 1] + 1
    return None


class Scan:
    """The worklist of one document."""

    def __init__(self, text: str):
        self.found: dict[tuple[str, int, int], str] = {}
        self.spans: list[tuple[int, int, int, str]] = []
        self.seen: set[tuple[bytes, int, int]] = set()
        self.left = MOST_BYTES
        self.work: deque[Layer] = deque()
        if text:
            whole = np.arange(len(text) + 1) if self.encoded(text) else np.zeros(0, np.int64)
            if len(whole):
                self.add(Layer(text, (), whole[:-1], whole[1:]))
            else:  # nothing to decode: places are the document's own
                for kind, a, b in matches(text):
                    self.span(kind, (), a, b)
        while self.work:
            self.decode(self.work.popleft())

    @staticmethod
    def encoded(text: str) -> bool:
        return bool(("%" in text and URL.search(text)) or (("\\" in text or "&#" in text) and ESCAPE.search(text)) or has_run(text))

    def span(self, kind: str, how: tuple[str, ...], a: int, b: int) -> None:
        if (kind, a, b) not in self.found:
            self.found[kind, a, b] = name = f"{kind}@{'+'.join(how)}" if how else kind
            self.spans.append((a, ORDER.get(kind, len(ORDER)) + len(how) * (len(ORDER) + 1), b, name))

    def add(self, layer: Layer) -> None:
        if not layer.text or (key := layer.key()) in self.seen:
            return
        self.seen.add(key)
        for kind, a, b in matches(layer.text):
            self.span(kind, layer.how, *layer.place(a, b))
        self.work.append(layer)

    def decode(self, layer: Layer) -> None:
        if "%" in layer.text and (new := _rewritten(layer, "url", URL, _from_url)):
            self.add(new)
        if ("\\" in layer.text or "&#" in layer.text) and (new := _rewritten(layer, "unicode", ESCAPE, _from_escapes)):
            self.add(new)
        for m in RUN.finditer(layer.text) if has_run(layer.text) else ():
            if self.from_run(layer, m.start(), m[0]) or "\n" not in m[0]:
                continue
            for line in LINE.finditer(m[0]):  # lines that aren't one run are runs of their own
                self.from_run(layer, m.start() + line.start(), line[0])

    def from_run(self, layer: Layer, at: int, run: str) -> bool:
        if (got := _from_base64(run)) is None:
            return False
        raw, first, end = got
        self.unpack(raw, (*layer.how, "base64"), layer.start[first + at], layer.end[end + at - 1])
        return True

    def unpack(self, raw: bytes, how: tuple[str, ...], start: np.ndarray, end: np.ndarray) -> None:
        """Takes bytes as a layer if they are text, and what they hold if they are compressed, and so on."""
        whole = int(start[0]), int(end[-1])
        met = set()
        while (name := _packing(raw)) and (digest := hashlib.sha256(raw).digest()) not in met:
            met.add(digest)
            if not (inner := _unpacked(raw, name, self.left)):
                break
            if len(inner) > self.left:
                self.span("oversize", (*how, name), *whole)
                return
            self.left -= len(inner)
            raw, how = inner, (*how, name)
            start, end = (np.broadcast_to(np.int64(x), len(raw)) for x in whole)
        text, at = _characters(raw)
        self.add(Layer(text, how, start[at], end[np.append(at[1:], len(raw)) - 1]))

    def base(self) -> str:
        return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(self.spans) if name in ORDER)

    def every(self) -> str:
        return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(self.spans))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a document, by start, then kind; offsets count code points."""
    return [(name, a, b) for a, _, b, name in sorted(Scan(text or "").spans)]


def masked(text: str | None) -> str | None:
    """The text with every span replaced by the kind of the first span there, in angle brackets."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in spans(text):
        if a >= at:
            out += [text[at:a], f"<{kind.partition('@')[0]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_decoded"]
    for batch in batches:
        rows = []
        for value in batch.column(1):
            scan = Scan((value.as_buffer().to_pybytes() if value.is_valid else b"").decode("utf-8", "replace"))
            kinds = [name for *_, name in scan.spans]
            rows.append([*(kinds.count(k) for k in KINDS), hashlib.sha256(scan.base().encode()).hexdigest(), scan.every(), sum("@" in k for k in kinds)])
        types = [*(pa.int64() for _ in KINDS), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded) per document; n_decoded counts the spans that only
    a decoded layer shows."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_digested, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long")


def _masked(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    free()
    for batch in batches:
        columns = list(batch.columns)
        columns[text] = pa.array([masked(t) for t in batch.column(text).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with every span of its texts, decoded ones included, replaced by its kind in angle brackets; nulls stay."""
    small_batches(docs.sparkSession)
    text = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _masked(it, text), docs.schema)
