"""Secret scans through nested encodings.

Each text is a base layer.  A worklist unwraps it: percent and Unicode escapes
are decoded in place, base64 runs and compressed bytes give layers of their
own, and every new layer is scanned and unwrapped again until none is left.  A
layer that was seen at the same place before is not entered again, so data that
decodes to itself ends too.  Every character of a layer knows the code points of
the base text that it came from, so each finding has a span in the whole text;
a finding inside compressed bytes has the span of the bytes.

Kinds, leftmost and not overlapping within a kind: ``assign`` (a name such as
password or token, = or :, and 6 or more value characters), ``access`` (AKIA
and capitals or digits, 20 or more in all), ``hex`` (24 or more of 0-9a-f).

Compressed data is looked for at any place of a decoded layer; members or frames
that follow each other are one stream.  Base64 runs go on over line breaks.

Rows are independent; a task holds one batch of texts.  Compressed data is
unpacked in windows that end where no finding or encoded run can cross; layers
are taken up one at a time, so a long one is never held whole.  A run without
such a place for ``max_layer`` bytes (a decompression bomb) is cut there;
``n_unscanned`` counts these cuts.  Not counted: compressed data that a window
holds as escapes between bare line breaks or words may be cut in two.

Defined results: a null or empty text has no findings; repeated rows repeat
their result; other columns are not read.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: 16 base64 characters are the 12 bytes of the shortest finding.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: The same over line breaks; the last line may be short.
BASE64_LINES = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?")
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
#: Escapes of one character, as printed bytes and JSON have them; read only in search of compressed data.
SHORT = re.compile(ESCAPE.pattern + r"""|\\([abfnrtv0\\'"/])""")
SHORT_CHARS = dict(zip("abfnrtv0\\'\"/", "\a\b\f\n\r\t\v\0\\'\"/"))
#: First bytes of gzip, bzip2, xz and Zstandard data, and the two of zlib (window size, check of both, no dictionary).
MAGIC = (b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
_ZLIB = [re.escape(bytes((c, f))) for c in range(8, 128, 16) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 32]
START = re.compile(b"|".join([re.escape(MAGIC[0]), rb"BZh[1-9](?:1AY&SY|\x17rE8P\x90)", *map(re.escape, MAGIC[2:]), *_ZLIB]), re.DOTALL)
#: Places that no finding and no encoded run crosses.
SAFE = re.compile(rb"\s[A-Za-z]{1,15} (?=[A-Za-z])|\s\S{0,15}[ \t]*\r?\n")
MAX_LAYER = 64 << 20


def _runs_of(chars: bytes) -> bytes:
    return bytes(120 if b in chars else 32 for b in range(256))


_HEX_RUN, _B64_RUN = _runs_of(b"0123456789abcdef"), _runs_of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


class Layer:
    """A text with, for each character, the span of the base text it came from (None: the base itself; two integers: one span for all)."""

    __slots__ = ("text", "lo", "hi")

    def __init__(self, text: str, lo=None, hi=None):
        self.text, self.lo, self.hi = text, lo, hi

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.lo is None:
            return start, end
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return int(self.lo[start]), int(self.hi[end - 1])

    def part(self, text: str, start: np.ndarray, end: np.ndarray) -> Layer:
        """A layer whose character i came from characters start[i] to end[i] - 1 of this one."""
        if self.lo is None:
            return Layer(text, start, end)
        if isinstance(self.lo, int):
            return Layer(text, self.lo, self.hi)
        return Layer(text, self.lo[start], self.hi[end - 1])


def find(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the findings of one layer; ``raw`` is its UTF-8, for quick tests that rule kinds out."""
    out = []
    if b"=" in raw or b":" in raw:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_RUN):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of ``pattern`` decoded; a match is (characters, source width of each or None for the whole)."""
    pieces, starts, ends, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        chars, width = decode(m)
        if chars is None:
            continue
        changed = True
        plain = np.arange(at, m.start())
        first = np.arange(m.start(), m.end(), width)
        pieces += [layer.text[at : m.start()], chars]
        starts += [plain, first]
        ends += [plain + 1, first + width]
        at = m.end()
    if not changed:
        return None
    plain = np.arange(at, len(layer.text))
    return layer.part("".join([*pieces, layer.text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]))


def _percent(m: re.Match) -> tuple[str, int]:
    return bytes.fromhex(m[0].replace("%", "")).decode("latin-1"), 3


def _escape(m: re.Match) -> tuple[str | None, int]:
    digits = next(g for g in m.groups() if g is not None)
    code = int(digits, 10 if m.lastindex == 6 else 16)
    return (chr(code), m.end() - m.start()) if code < 0x110000 and not 0xD800 <= code < 0xE000 else (None, 0)


def _short(m: re.Match) -> tuple[str | None, int]:
    return (SHORT_CHARS[m[7]], 2) if m[7] else _escape(m)


class Stream:
    """Compressed data from ``start`` of ``data`` on: the chunks it unpacks to, then its ``end`` and whether it broke off (``open``) there or is ``sound``."""

    def __init__(self, data: bytes, start: int):
        self.data, self.start, self.end, self.open, self.sound = data, start, start + 1, False, False

    def _kind(self, at: int) -> int:
        return next((k for k, magic in enumerate(MAGIC) if self.data.startswith(magic, at)), -1)

    def _member(self, kind: int, at: int) -> Iterator[bytes]:
        """One member; a small step first, since most that only look like zlib data fail at once."""
        tool = zstandard.ZstdDecompressor().decompressobj() if kind == 3 else bz2.BZ2Decompressor() if kind == 1 else lzma.LZMADecompressor() if kind == 2 else zlib.decompressobj(47)
        step = 64
        while at < len(self.data) and not tool.eof:
            part = self.data[at : at + step]
            at += len(part)
            step = 32 if kind == 3 else 4096  # Zstandard objects have no bound but that of their input
            if kind in (1, 2):
                yield tool.decompress(part, 1 << 20)
                while not tool.eof and not tool.needs_input:
                    yield tool.decompress(b"", 1 << 20)
            elif kind == 3:
                yield tool.decompress(part)
            else:
                yield (got := tool.decompress(part, 1 << 20))
                while not tool.eof and (tool.unconsumed_tail or len(got) == 1 << 20):
                    yield (got := tool.decompress(tool.unconsumed_tail, 1 << 20))
        self.open = not tool.eof
        self.end = at - len(tool.unused_data)

    def __iter__(self) -> Iterator[bytes]:
        kind, at = self._kind(self.start), self.start
        try:
            while True:
                yield from self._member(kind, at)
                self.sound = self.sound or not self.open
                if self.open or kind < 0:
                    return
                at = self._next(kind)
                if self._kind(at) != kind:
                    return
        except (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError, ValueError):
            self.open = False  # what was sound has been given

    def _next(self, kind: int) -> int:
        """Where the next member may begin: behind zero bytes, or Zstandard's skippable frames."""
        at = self.end
        if kind in (0, 2):
            while self.data.startswith(b"\0", at):
                at += 1
        while kind == 3 and 0x50 <= (self.data[at : at + 1] or b"\0")[0] <= 0x5F and self.data.startswith(b"\x2a\x4d\x18", at + 1):
            at += 8 + int.from_bytes(self.data[at + 4 : at + 8], "little")
        return at


def _cut(data: bytes) -> int:
    """The last place of ``data`` that nothing crosses, 0 if there is none."""
    cut, back = 0, 1 << 12
    while not cut and back < 2 * len(data):
        for m in SAFE.finditer(data, max(0, len(data) - back)):
            cut = m.end()
        back *= 8
    at = 0
    while (m := START.search(data, at, cut)) is not None:
        stream = Stream(data, m.start())
        for _ in stream:
            pass
        if stream.open or (stream.sound and stream.end > cut):
            return m.start()
        at = max(stream.end if stream.sound else 0, m.start() + 1)
    return cut


def _windows(parts: Iterator[bytes], most: int, lost: list[int]) -> Iterator[bytes]:
    held, limit = bytearray(), max(1, most // 8)
    for part in parts:
        held += part
        while len(held) >= limit:
            if cut := _cut(bytes(held)):
                yield bytes(held[:cut])
                del held[:cut]
                limit = max(1, most // 8, 2 * len(held))
            elif len(held) < most:
                limit = min(most, 2 * len(held))
            else:
                lost[0] += 1
                yield bytes(held)
                held.clear()
                limit = max(1, most // 8)
    if held:
        yield bytes(held)


def _unpacked(data: bytes, layer: Layer, start: np.ndarray | None, end: np.ndarray | None, most: int, lost: list[int], taken: list[tuple[int, int]]) -> Iterator[Layer]:
    """Layers of what ``data`` holds compressed, at any place; byte i came from characters start[i] to end[i] - 1 of the layer (None: i)."""
    at = 0
    while (m := START.search(data, at)) is not None:
        s = m.start()
        stream, first, size = Stream(data, s), [], 0
        parts = iter(stream)
        for part in parts:
            first.append(part)
            size += len(part)
            if size >= max(1, most // 8):
                extent = Stream(data, s)
                for _ in extent:
                    pass
                break
        else:
            extent = stream
        stop = extent.end if extent.sound or extent.open else len(data)
        if size >= 12:
            lo, hi = layer.span(int(s if start is None else start[s]), int(stop if end is None else end[stop - 1]))
            for window in _windows(itertools.chain(first, parts), most, lost):
                yield Layer(window.decode("latin-1"), lo, hi)
        if extent.sound:
            taken.append((s, extent.end))
        at = max(extent.end if extent.sound else 0, s + 1)


def _bytes_layers(data: bytes, layer: Layer, start: np.ndarray, end: np.ndarray, most: int, lost: list[int]) -> Iterator[Layer]:
    """Layers of decoded bytes: what they unpack to, and the printable runs of the rest."""
    taken: list[tuple[int, int]] = []
    yield from _unpacked(data, layer, start, end, most, lost, taken)
    at = 0
    for lo, hi in [*taken, (len(data), len(data))]:
        for m in PRINTABLE.finditer(data, at, lo):
            yield layer.part(m[0].decode("ascii"), start[m.start() : m.end()], end[m.start() : m.end()])
        at = hi


def _base64_run(layer: Layer, body: str, index: np.ndarray, most: int, lost: list[int]) -> Iterator[Layer]:
    """Layers of base64 text; its character i stands at index[i] of the layer."""
    body = body.replace("-", "+").replace("_", "/")
    for shift in range(4):  # what stands before the data may be of its alphabet too
        own = body[shift:]
        keep = len(own) - (len(own) % 4 == 1)
        if keep < 16:
            break
        data = binascii.a2b_base64(own[:keep] + "=" * (-keep % 4))
        if PRINTABLE.search(data) or START.search(data):
            k = np.arange(len(data))
            yield from _bytes_layers(data, layer, index[shift + k * 4 // 3], index[shift + (k * 4 + 4 + 2) // 3 - 1] + 1, most, lost)


def _base64(layer: Layer, most: int, lost: list[int]) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        yield from _base64_run(layer, m[0], np.arange(m.start(), m.end()), most, lost)
    if "\n" in layer.text:
        for m in BASE64_LINES.finditer(layer.text):
            if "\n" in m[0]:
                chars = np.frombuffer(m[0].encode("ascii"), np.uint8)
                index = np.flatnonzero(chars > 32)
                yield from _base64_run(layer, chars[index].tobytes().decode("ascii"), index + m.start(), most, lost)


def unwrap(layer: Layer, raw: bytes, most: int, lost: list[int]) -> Iterator[Layer]:
    """The layers one decoding below."""
    if b"%" in raw and (got := _in_place(layer, PERCENT, _percent)):
        yield got
    if (b"\\" in raw or b"&#" in raw) and (got := _in_place(layer, ESCAPE, _escape)):
        yield got
        if b"\\" in raw and (got := _in_place(layer, SHORT, _short)):
            yield from _unpacked(got.text.encode("latin-1", "replace"), got, None, None, most, lost, [])
    if b"x" * 16 in raw.translate(_B64_RUN):
        yield from _base64(layer, most, lost)
    if layer.lo is not None:
        yield from _unpacked(layer.text.encode("latin-1", "replace"), layer, None, None, most, lost, [])


def scan(text: str, max_layer: int = MAX_LAYER) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(base findings, all findings, layers, layers not unpacked) of one text, findings as (start, kind, end) in order."""
    raw = text.encode("utf-8", "surrogatepass")
    base = sorted(find(text, raw))
    found, seen, lost = set(base), set(), [0]
    work = [unwrap(Layer(text), raw, max_layer, lost)]
    while work:  # the innermost decoding first, one layer at a time
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        raw = layer.text.encode("utf-8", "surrogatepass")
        key = (hashlib.sha1(raw).digest(), layer.span(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        for start, kind, end in find(layer.text, raw):
            lo, hi = layer.span(start, end)
            found.add((lo, kind, hi))
        work.append(unwrap(layer, raw, max_layer, lost))
    return base, sorted(found), len(seen), lost[0]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """(id, base, found, n_layers, n_unscanned): findings of the text itself and of all its layers.

    A finding is (kind, start, end) in code points of the whole text, end
    exclusive, sorted by start, then kind as listed, then end.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [scan(x.as_py() or "", max_layer) for x in part.column(1)]
                cols = [[[(KINDS[k], s, e) for s, k, e in r[i]] for r in rows] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, spans) for c in cols], pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                    ["id", "base", "found", "n_layers", "n_unscanned"],
                )

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"id {df.schema[id_col].dataType.simpleString()}, base {kind}, found {kind}, n_layers long, n_unscanned long").withColumnRenamed("id", id_col)


def joined(spans: str) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``scan_secrets``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select(id_col, *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), "n_layers", "n_unscanned")
